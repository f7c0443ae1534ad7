"""Language ID (5): cross-parsing against suffix automata of labelled text.

Training: a bounded sample of labelled texts per language (``SAMPLE_TEXTS``
distinct whole texts, those of the smallest hashes among the texts of at most
``SAMPLE_BYTES`` bytes; a language without such a text draws from all its
texts) is joined and turned into a suffix automaton, on the driver, once. Its
transitions are packed into a double array, whose size grows with the sample,
not with the alphabet, and sent to the workers. Prediction: the text is parsed
greedily into the longest phrases that occur in a language's sample; the
language needing the fewest phrases wins (ties: the smaller language name).
Prediction is a map over the documents.

Every text is parsed as a whole. For speed, a long text is entered at each
``BLOCK`` characters at once; a run goes on beyond its block until it starts a
phrase where the run of a later block starts one too, from where both are the
same, so that the count is that of one run from the beginning.

Texts are compared in lower case, with each run of non-letters as one space.
Defined cases: null text, or text without a letter, is ``und`` with score 0;
with no labelled text at all every text is ``und``; rows without a language
are predicted but not learnt from; repeated rows give repeated results; of
columns that have a name of the results, the results stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb

SAMPLE_TEXTS = 48
SAMPLE_BYTES = 4096
BLOCK = 2048
#: Bytes of text that are parsed beside each other.
SLICE = 2 << 20
UNDETERMINED = "und"


def normalise(text: str | None) -> str:
    """Lower case; letters stay, every run of anything else is one space; none at the ends."""
    if not text:
        return ""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) if not text.isascii() else " ".join(text.translate(_ASCII).split())


_ASCII = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the automaton of all substrings of a sequence."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


class Packed:
    """An automaton as a double array: the transition of ``state`` by ``c`` is at ``base[state] + c`` if ``own`` there is the state."""

    def __init__(self, go: list[dict[int, int]], width: int):
        edges = sum(map(len, go))
        size = 2 * edges + 2 * width + 4096
        taken = np.zeros(size, dtype=bool)
        self.base, self.own, self.to = np.zeros(len(go), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        at = 0  # where the search for room begins
        for s in sorted((s for s in range(len(go)) if len(go[s]) > 1), key=lambda s: -len(go[s])):
            cs = list(go[s])
            start = at
            while True:
                if start + 256 + width > len(taken):
                    more = len(taken)
                    taken = np.append(taken, np.zeros(more, bool))
                    self.own, self.to = np.append(self.own, np.full(more, -1, np.int32)), np.append(self.to, np.zeros(more, np.int32))
                full = taken[start + cs[0] : start + cs[0] + 256].copy()
                for c in cs[1:]:
                    full |= taken[start + c : start + c + 256]
                if not full.all():
                    break
                start += 256
            b = start + int(full.argmin())
            self.base[s] = b
            for c, t in go[s].items():
                taken[b + c], self.own[b + c], self.to[b + c] = True, s, t
            at = max(at, b - 2 * width)  # gaps that stay behind are for the states with one transition
        single = np.array([s for s in range(len(go)) if len(go[s]) == 1], dtype=np.int64)
        free = np.flatnonzero(~taken[width:])[: len(single)] + width
        assert len(free) == len(single)
        c = np.array([next(iter(go[s])) for s in single.tolist()], dtype=np.int64)
        self.base[single] = free - c
        self.own[free], self.to[free] = single, [go[s][k] for s, k in zip(single.tolist(), c.tolist(), strict=True)]
        last = int(self.base.max(initial=0)) + width
        self.own, self.to = self.own[:last].copy(), self.to[:last].copy()
        self.root = np.array([go[0].get(c, 0) for c in range(width)], dtype=np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase starts with c). A letter that no sample has is a phrase of its own."""
        at = self.base[state] + c
        nxt, miss = self.to[at], self.own[at] != state
        new = miss | (state == 0)
        gone = np.flatnonzero(miss)
        nxt[gone] = self.root[c[gone]]
        return nxt, new


class Model:
    """One automaton per language over the letters of all samples; other letters are code 0 and occur in none."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: [normalise(t) for t in v] for k, v in samples.items()}
        letters = sorted({c for v in texts.values() for t in v for c in t} | {" "})
        self.width = len(letters) + 2  # 0: unknown; the last: between texts
        self.code = np.zeros(max(map(ord, letters)) + 1, dtype=np.int32)
        for i, c in enumerate(letters, 1):
            self.code[ord(c)] = i
        self.tables = []
        for k in self.languages:
            codes: list[int] = []
            for t in texts[k]:
                codes += [*self.encode(t).tolist(), self.width - 1]
            self.tables.append(Packed(suffix_automaton(codes), self.width))

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(points < len(self.code), self.code[np.minimum(points, len(self.code) - 1)], 0)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each normalised text in each language (texts x languages)."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not sizes.any():
            return out
        flat = self.encode("".join(texts))
        ends = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (ends - sizes)[owner] + nth * BLOCK
        size = np.minimum(BLOCK, ends[owner] - start)
        order = np.argsort(-size, kind="stable")
        start_, size_ = start[order], size[order]
        several = blocks[owner] > 1
        kept = np.flatnonzero(several[order])  # columns whose phrase starts are noted
        note = np.full(len(owner), -1)
        note[order[kept]] = np.arange(len(kept))
        alive = np.searchsorted(-size_, -np.arange(int(size_[0])), side="left")  # blocks longer than each step
        noted = np.searchsorted(kept, alive)
        far = np.flatnonzero(start + BLOCK < ends[owner])  # blocks that another one follows
        place = np.empty(len(owner), np.int64)
        place[order] = np.arange(len(owner))
        for lang, table in enumerate(self.tables):
            state = np.zeros(len(owner), dtype=np.int32)
            count = np.zeros(len(owner), dtype=np.int64)
            starts = np.zeros((len(alive), len(kept)), dtype=bool)
            for step in range(len(alive)):
                n = alive[step]
                state[:n], new = table.step(state[:n], flat[start_[:n] + step])
                count[:n] += new
                if noted[step]:
                    starts[step, : noted[step]] = new[kept[: noted[step]]]
            own = count[place]
            if len(far):
                more, into, row = self._run_on(table, flat, starts, note, far, state[place[far]], start, ends[owner])
                for i in np.flatnonzero(blocks > 1).tolist():
                    b, entry, total = int(np.searchsorted(owner, i)), 0, 0
                    while b >= 0:
                        total += int(own[b]) - int(starts[:entry, note[b]].sum()) + int(more[b])
                        b, entry = int(into[b]), int(row[b])
                    out[i, lang] = total
            single = ~several
            out[owner[single], lang] = own[single]
        return out

    @staticmethod
    def _run_on(table: Packed, flat: np.ndarray, starts: np.ndarray, note: np.ndarray, live: np.ndarray, state: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each block: phrases begun beyond it until it meets a later run, that run's block (-1: the text ended) and place in it."""
        more, into, row = np.zeros(len(start), np.int64), np.full(len(start), -1), np.zeros(len(start), np.int64)
        step = BLOCK
        while len(live):
            state, new = table.step(state, flat[start[live] + step])
            then = live + step // BLOCK
            met = new & starts[step % BLOCK, note[then]]
            more[live] += new & ~met
            into[live[met]], row[live[met]] = then[met], step % BLOCK
            step += 1
            stay = ~met & (start[live] + step < end[live])
            live, state = live[stay], state[stay]
        return more, into, row

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, phrases per character) of each text. Score: by how much the runner-up needs more phrases, 0 to 1."""
        norm = [normalise(t) for t in texts]
        counts = self.phrases(norm) if self.languages else np.zeros((len(texts), 0))
        langs, scores, rates = [], [], []
        for t, row in zip(norm, counts, strict=True):
            if not t or not len(row):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                rates.append(0.0)
                continue
            best = int(row.argmin())
            second = int(np.partition(row, 1)[1]) if len(row) > 1 else 0
            langs.append(self.languages[best])
            scores.append(float(1 - row[best] / second) if second else 1.0)
            rates.append(float(row[best] / len(t)))
        return langs, scores, rates


def samples(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, most: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """At most ``texts`` distinct whole texts per language, those of the smallest hashes among texts of at most ``most`` bytes.

    A count per language gives a hash bound that lets about twice ``texts`` rows through, whatever the input's size.
    """
    text = F.col(text_col).cast("string")
    known = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"), (F.octet_length(text) <= most).alias("short"))
    counts = known.groupBy("k").agg(F.approx_count_distinct(F.when(F.col("short"), F.col("h")), 0.02).alias("n"), F.approx_count_distinct("h", 0.02).alias("all")).collect()
    if not counts:
        return {}
    limit = F.lit(None).cast("bigint")
    for r in sorted(counts):
        share = min(1.0, 2 * (texts + 4 * math.sqrt(texts)) / max(1, r.n or r.all))
        limit = F.when((F.col("k") == r.k) & (F.col("short") | F.lit(not r.n)), F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).otherwise(limit)
    rows = known.where(F.col("h") <= limit).groupBy("k", "h").agg(F.first("t").alias("t")).collect()
    out: dict[str, list[str]] = {r.k: [] for r in counts}
    for r in sorted(rows, key=lambda r: (r.k, r.h, r.t)):
        if len(out[r.k]) < texts:
            out[r.k].append(r.t)
    return out


def identify(docs: DataFrame, learned: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rate (phrases per character of the normalised text) added."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(learned))  # some bytes for each character of the sample

    @F.arrow_udf("lang_pred string, score double, rate double")
    def predict(text: pa.Array) -> pa.Array:
        parts = []
        for i, j, _, _ in tb.slices(text, SLICE):
            found = shared.value.predict(text.slice(i, j - i).to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())], ["lang_pred", "score", "rate"]))
        tb.release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rate", pa.float64())]))

    names = ("lang_pred", "score", "rate")
    keep = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in names], F.lit(None).alias("_")).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = keep.withColumn("own", predict("text"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names], "own.*")
