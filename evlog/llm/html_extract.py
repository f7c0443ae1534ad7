"""HTML extraction (1): nearest-URL page differencing.

Pages of a host are sorted by URL path and each is paired with the neighbour
whose path shares more leading segments (then characters). The order is cut
into ranges of about ``RANGE`` pages wherever it falls due, and the first and
last page of each range meet their neighbours beyond the cut afterwards: every
page is paired with its true neighbour at every size, and no host is one task.
Pages of a host with the same lines are one page there, at their first path, so
that a copy is never anyone's neighbour. The text lines of a pair are aligned
by longest common subsequence, and lines that the pair shares are deleted where
they are outside the page's article. Only hashes of lines travel to the
pairing; a page is parsed once.

Differencing alone can't give right results: shared passages of an article
would go, and menus and adverts that differ from page to page would stay. So
markup tells, where it can, what the article is (its lines stay even if
shared), and lines outside it that differencing left go too; on pages that mark
no article, differencing decides on every line that markup doesn't name as a
menu, header, footer, sidebar, notice, advert, form, script, style or comment.

The article is ``main``, or else the articles that aren't in a sidebar, menu or
the like. What holds it is never taken for something else, whatever its class
says, and neither are classes that tell a state (``has-sidebar``).

Defined cases: null or empty html gives an empty text; a null url is of the
empty host; a page that is alone in its host loses no line by differencing, and
neither does one all of whose lines its neighbour has; repeated rows are pages
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evlog.llm.sparkio import dropped, partitions, stored
from evlog.llm.textbytes import BYTE64, span_hashes
from evlog.llm.url_filter import url_parts

#: Pages of a range of the order of URLs, about.
RANGE = 100_000
#: Largest table of an alignment; longer sequences are halved until they fit (Hirschberg), with the same result.
ALIGN_CELLS = 4_000_000
#: Bytes of keys and line numbers that are sent to all workers at most; beyond it, the join shuffles.
BROADCAST_BYTES = 16 << 20

#: Element names and class words with a role: fixed values of HTML and of common page templates.
RAW = frozenset("script style noscript template textarea iframe svg math object select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav aside footer form menu dialog button search".split())
CHROME_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar sidenav cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login share sharing social "
    "related recommended recommendations trending disqus discussion reply replies respond responses pagination pager toolbar widget widgets skip".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of a class that tells what a page has or does, not what the element is.
STATES = frozenset("has no with without is not open opened closed enabled disabled visible".split())
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")

OTHER, ARTICLE, DROPPED = 0, 1, 2


class Element:
    """An element with what its markup says of it: ``named`` (its tag), ``worded`` (its attributes) and ``content`` (main or article)."""

    __slots__ = ("name", "parent", "named", "worded", "header", "content", "size", "role")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent, self.size, self.role = name, parent, 0, OTHER
        self.named, self.worded = name in CHROME, False
        self.header = name == "header"
        self.content = name if name in ("main", "article") else ""
        for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for token in value.split():
                    words = WORD.findall(token)
                    if not STATES.intersection(words):
                        self.worded |= bool(CHROME_WORDS.intersection(words)) or any(w.startswith("comment") for w in words)
                        self.header |= "header" in words
            elif key == "role" and value == "main":
                self.content = "main"
            elif (key == "role" and value in CHROME_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                self.worded = True
        if name in ("html", "body", "main"):
            self.worded = False
        if name == "article":  # an article may tell that comments are open; a comment is one by its whole class
            classes = {t for k, v in ATTRIBUTE.findall(attributes) if k.lower() == "class" for t in v.strip("\"'").lower().split()}
            self.worded = bool(classes & {"comment", "reply", "teaser", "ad", "advert", "promo", "sponsored"})

    def above(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent


def _chosen(candidates: list[Element], inside: Element | None = None) -> list[Element]:
    """The candidates that nothing around them speaks against, or the largest that no tag speaks against."""
    free, doubtful = [], []
    for c in candidates:
        around = []
        for e in c.above():
            if e is inside:
                break
            around.append(e)
        if c.worded or any(e.named and e.name != "form" for e in around):
            continue
        if not any(e.worded or e.header for e in around):
            free.append(c)
        elif inside is None or 2 * c.size > inside.size:  # within main, only if it is most of it
            doubtful.append(c)
    return free or sorted(doubtful, key=lambda e: -e.size)[:1]


def assign_roles(elements: list[Element]) -> None:
    mains = _chosen([e for e in elements if e.content == "main"])
    articles = [e for e in elements if e.content == "article"]
    if mains:
        roots = mains
        kept = [a for m in mains for a in _chosen([a for a in articles if m in a.above()], m)]
    else:
        outer = [a for a in articles if not any(e.content == "article" and not e.worded for e in a.above())]
        roots, kept = _chosen(outer), []
    holds = {id(x) for e in (*roots, *kept) for x in (e, *e.above())}
    root = {id(e) for e in roots}
    for e in elements:  # a parent comes before its children
        around = e.parent.role if e.parent is not None else OTHER
        if id(e) in holds:
            e.role = ARTICLE if id(e) in root else around
        elif around == DROPPED or e.named or e.worded or (e.header and around != ARTICLE):
            e.role = DROPPED
        else:
            e.role = around


def lines(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of each text block in page order; scripts, styles and markup are gone, white space is single."""
    if not page:
        return []
    found: list[tuple[Element | None, str]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    parts: list[str] = []
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[-1] if stack else None
                found.append((own, text))
                while own is not None:
                    own.size += len(text)
                    own = own.parent
            parts.clear()

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name in ("br", "hr", "wbr") or name in VOID:
            if name == "hr":
                close()
            elif name != "wbr":
                parts.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    if any(x.name in BLOCKS or x.named or x.worded for x in stack[k:]):
                        close()
                    del stack[k:]
                    break
            continue
        if name in RAW:
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name == "head" and done is None:
                continue
            at = done.end() if done else end
            continue
        if name in BLOCKS:
            close()
            while stack and name in CLOSES.get(stack[-1].name, ()):
                stack.pop()
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p"), None)
            if k is not None and not any(x.name in BLOCKS for x in stack[k + 1 :]):  # inline elements left open in a paragraph end with it
                del stack[k:]
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        e = Element(name, attributes, stack[-1] if stack else None)
        if e.named or e.worded:
            close()
        elements.append(e)
        stack.append(e)
    close()
    assign_roles(elements)
    return [(OTHER if e is None else e.role, text) for e, text in found]


def line_hash(texts: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return span_hashes(raw, ends - np.array([len(d) for d in data], dtype=np.int64), ends, BYTE64).view(np.int64) if data else np.zeros(0, np.int64)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a with each prefix of b, in the memory of one row."""
    row, b_ = np.zeros(len(b) + 1, np.int32), np.array(b, dtype=np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b_ == v)))
    return row


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Indexes in x of a longest common subsequence with y."""
    if not x or not y:
        return []
    if len(x) == 1:
        return [0] if x[0] in y else []
    if len(x) * len(y) > ALIGN_CELLS:
        half = len(x) // 2
        k = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:k]) + [half + i for i in _aligned(x[half:], y[k:])]
    best = [[0] * (len(y) + 1)]
    for v in x:
        row, up = [0], best[-1]
        for c, w in enumerate(y):
            row.append(up[c] + 1 if v == w else max(up[c + 1], row[c]))
        best.append(row)
    out = []
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes in a of a longest common subsequence with b."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    out = [*range(lo), *range(hi_a, len(a))]
    x, y = a[lo:hi_a], b[lo:hi_b]
    both = set(x) & set(y)
    keep_x, keep_y = [i for i, v in enumerate(x) if v in both], [j for j, v in enumerate(y) if v in both]  # lines of one side only match nothing
    if keep_x and keep_y:
        out += [lo + keep_x[i] for i in _aligned([x[i] for i in keep_x], [y[j] for j in keep_y])]
    return sorted(out)


def _prefix(a: str, b: str) -> tuple[int, int]:
    """(leading segments, leading characters) that two paths share."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    return segments, next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))


def main_text(roles: list[int], texts: list[str], shared: set[int]) -> tuple[str, int]:
    """The text that stays, and how many lines outside the article differencing deleted."""
    gone = {i for i in shared if roles[i] != ARTICLE}
    if ARTICLE in roles:
        return "\n".join(t for r, t in zip(roles, texts, strict=True) if r == ARTICLE), len(gone)
    left = [t for i, (r, t) in enumerate(zip(roles, texts, strict=True)) if r == OTHER and i not in gone]
    if not left and OTHER in roles:  # its neighbour has all of it: nothing tells what the pair's template is
        return "\n".join(t for r, t in zip(roles, texts, strict=True) if r == OTHER), 0
    return "\n".join(left), len(gone)


def _shared(page: dict, before: tuple | None, after: tuple | None) -> list[int]:
    """The lines a page shares with the nearer of its neighbours (path, hashes)."""
    sides = [(_prefix(page["path"], x[0]), -i, x[1]) for i, x in enumerate((before, after)) if x is not None]
    return common_lines(page["hashes"], max(sides, key=lambda s: s[:2])[2]) if sides else []


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared lines of the pages of a range; its first and last page pass on with the neighbour they have here."""
    types = [("key", pa.int64()), ("shared", pa.list_(pa.int32())), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_()), ("inner_path", pa.string()), ("inner_hashes", pa.list_(pa.int64()))]
    out: list[dict] = []

    def judged(before: dict | None, page: dict, after: dict | None) -> dict:
        sides = [(x["path"], x["hashes"]) if x is not None and x["host"] == page["host"] else None for x in (before, after)]
        if before is not None and after is not None:
            return {"key": page["key"], "shared": _shared(page, *sides), "first": False, "last": False}
        inner = sides[0] or sides[1] or (None, None)
        return {**page, "first": before is None, "last": after is None, "inner_path": inner[0], "inner_hashes": inner[1]}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in types], [n for n, _ in types])

    before = page = None
    for part in batches:
        for after in part.to_pylist():
            if page is not None:
                out.append(judged(before, page, after))
            before, page = page, after
        if len(out) >= 1000:
            yield batch()
            out = []
    if page is not None:
        out.append(judged(before, page, None))
        yield batch()


def align_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for first and last pages, whose neighbours beyond the cut are the edges next to them."""
    for batch in batches:
        rows = batch.to_pylist()
        found = []
        for r in rows:
            inner, before, after = (None if r[f"{s}_path"] is None else (r[f"{s}_path"], r[f"{s}_hashes"]) for s in ("inner", "before", "after"))
            found.append(_shared(r, before if r["first"] else inner, after if r["last"] else inner))
        yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["key", "shared"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars, n_shared (lines shared with its nearest page) and n_deleted (those of them outside the article, which differencing deleted)."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = url_parts(F.col(url_col))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [lines(x.as_py()) for x in part.column("html")]
                hashes = [line_hash([t for _, t in x]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("id", "url", "host", "path")] + [pa.array([int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) for h in hashes], pa.int64()), pa.array([[r for r, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string())), pa.array([h.tolist() for h in hashes], pa.list_(pa.int64()))],
                    ["id", "url", "host", "path", "content", "roles", "lines", "hashes"],
                )

    parsed = stored(source.mapInArrow(parse, f"id {kind}, url string, host string, path string, content bigint, roles array<int>, lines array<string>, hashes array<bigint>").withColumn("key", F.xxhash64("host", "content")))
    pages_ = parsed.where(F.size("hashes") > 0).groupBy("key", "host").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    ranges = max(partitions(spark), parsed.count() // RANGE)
    ranged = pages_.repartitionByRange(ranges, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    edge = "host string, path string, hashes array<bigint>, first boolean, last boolean, inner_path string, inner_hashes array<bigint>"
    aligned = stored(ranged.mapInArrow(align, f"key bigint, shared array<int>, {edge}"))
    near = Window.partitionBy("host").orderBy("path", "key")  # two rows a range
    edges = aligned.where("first or last").select("*", *[f(c).over(near).alias(f"{name}_{c}") for name, f in (("before", F.lag), ("after", F.lead)) for c in ("path", "hashes")])
    shared = stored(aligned.where("not (first or last)").select("key", "shared").unionByName(edges.mapInArrow(align_edges, "key bigint, shared array<int>")).where(F.size("shared") > 0))
    rows, lines_ = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()
    joined = parsed.drop("hashes", "host", "path", "content").join(F.broadcast(shared) if 16 * rows + 4 * lines_ <= BROADCAST_BYTES else shared, "key", "left")
    dropped(aligned)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(r, t, set(s or ())) for r, t, s in zip(batch.column("roles").to_pylist(), batch.column("lines").to_pylist(), batch.column("shared").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array([t for t, _ in rows], pa.string()), pa.array([len(t) for t, _ in rows], pa.int64()), pa.array([len(s or ()) for s in batch.column("shared").to_pylist()], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
                ["id", "url", "text", "n_chars", "n_shared", "n_deleted"],
            )

    return joined.mapInArrow(finish, f"id {kind}, url string, text string, n_chars bigint, n_shared bigint, n_deleted bigint").withColumnRenamed("id", id_col)
