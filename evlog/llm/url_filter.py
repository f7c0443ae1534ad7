"""URL filters (10): host rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from ``TRAINING_URLS``, a small labelled
table that is a parameter of the operator; by default it is made by a rule from
words of usual subjects. The model has ``DIMENSIONS`` weights, whatever the
number of pages. Judging is a map over the pages: no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and the model's verdict for empty strings (allow: the intercept decides).
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, under its path. Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words of the labelled URL table, by label (1: to be blocked). Usual subjects of sites.
BLOCK_WORDS = (
    "porn xxx sex adult cams escort nude erotic hentai milf fetish dating casino poker slots roulette blackjack jackpot bet bets betting gamble lottery bingo pills viagra cialis pharmacy meds drugs steroid "
    "loan loans payday credit debt money cash rich forex binary replica rolex luxury cheap discount spam farm links seo backlink traffic clicks click ads adserver banner popup track tracker tracking pixel "
    "win winner prize free gift crack keygen warez torrent hack cheats virus malware phish"
).split()
ALLOW_WORDS = (
    "news blog library school college university museum garden kitchen weather science history music art books poetry travel river harbour meadow mountain forest island city town village council health clinic "
    "hospital research journal paper archive docs guide manual wiki forum help support software code data map maps photo film theatre radio sport football chess cycling running recipes bakery farmers market "
    "shop store bank energy water law court press review magazine letters language learning teacher student math physics chemistry biology nature animal bird flower tree family children toys craft design "
    "architecture engineering railway airport hotel restaurant coffee tea wine church charity foundation institute society club festival concert gallery studio workshop office service company team"
).split()


def labelled_urls(seed: int = 11, each: int = 10) -> tuple[tuple[int, str], ...]:
    """The labelled URL table: hosts made of a subject's word and neutral parts, in the shapes that sites use, and hosts of no subject.

    Both labels get the same paths, prefixes and endings, so that only the words tell them apart.
    """
    rng = random.Random(seed)
    neutral = "my the best top online web site zone hub world 24 live pro plus net one".split()
    syllables = "an ar be de en er es ha he in is it le ma me ne no on or ou re ri se st ta te th ti to un ve".split()
    name = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))

    def url(word: str, path_word: str) -> str:
        parts = [word, *(rng.choice([rng.choice(neutral), name()]) for _ in range(rng.choice([0, 0, 0, 1, 1, 1, 1, 2, 2, 2])))]
        rng.shuffle(parts)
        host = rng.choice(["", "", "www.", "m.", "blog.", "en."]) + rng.choice(["-", "", "."]).join(parts) + rng.choice([".com", ".net", ".org", ".info", ".tv", ".co.uk", ".de", f".{name()}.org", f".{name()}.com"])
        number = rng.randint(1, 999)
        path = rng.choice([f"/en/{number}", f"/de/{number}.html", f"/fr/{number}/", f"/es/{number}", "/", "", "/index.html", f"/page/{number}", f"/{name()}/{number}", f"/{path_word}/{number}", f"/{path_word}-{name()}"])
        return f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '', '?page=2', '#top'])}"

    rows = [(1, url(w, w)) for w in BLOCK_WORDS for _ in range(each)] + [(0, url(w, w)) for w in ALLOW_WORDS for _ in range(each // 2)]
    rows += [(0, url(name(), name())) for _ in range(each * len(BLOCK_WORDS) // 2)]
    return (*rows, (0, ""))


#: The labelled URL table, which is small: it is made on the driver and trained on there.
TRAINING_URLS = labelled_urls()

DIMENSIONS = 1 << 15
NGRAMS = (3, 4, 5)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: empty strings where it is null or has no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls. Of equally long rules the smaller string wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):  # the last to fit wins
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule = F.when(fits, F.lit(at + under)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams of host and path, each marked with where it stands; sorted, distinct."""
    out = set()
    for mark, s in ((1, f"^{host}$"), (2, f"^{path}$")):
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in NGRAMS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, mark * 131 + n, dtype=np.uint64)
                for k in range(n):
                    h = (h * np.uint64(0x100000001B3)) ^ codes[k : len(codes) - n + 1 + k]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.update(((h >> np.uint64(40)) % np.uint64(DIMENSIONS)).tolist())
    return np.array(sorted(out), dtype=np.int64)


def _split(url: str) -> tuple[str, str]:
    if "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def train(urls: Sequence[tuple[int, str]] = TRAINING_URLS, rounds: int = 600, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient descent from zero: the same table gives the same model."""
    found = [features(*_split(url)) for _, url in urls]
    sizes = np.array([max(1, len(f)) for f in found])
    at, row = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    value = 1 / np.sqrt(sizes[row])
    y = np.array([label for label, _ in urls], dtype=float)
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(y)) + b)))
        g = p - y
        w -= rate * (np.bincount(at, g[row] * value, DIMENSIONS) / len(y) * 10 + decay * w)
        b -= rate * g.mean()
    return w, b


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, urls: Sequence[tuple[int, str]] = TRAINING_URLS, threshold: float = 0.5) -> DataFrame:
    """Per page: its id, host, path, rule (or null), verdict (allow or block) and the model's block probability."""
    weights, bias = train(urls)
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}
        for batch in batches:
            out = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    f = features(*key)
                    known[key] = float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(1, len(f))) + bias))))
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    kind = parts.schema["_id"].dataType.simpleString()
    scored = parts.mapInArrow(score, f"_id {kind}, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
