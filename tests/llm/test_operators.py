"""Each operator against a plain version of its contract, over hard rows and an empty table."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evlog.llm import ann, components, decontaminate, html_extract, language_id, license_scan, lm_scoring, near_dedup, packing, suffix_dedup, url_filter


def test_1_html(spark, nothing):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><li>Home</nav><div class="ad">buy</div><div class="x">shared line</div>%s<footer>&copy; x</footer></body></html>'
    rows = [
        (1, "http://h.com/a/1", page % "<article><h1>A &amp; b</h1><p><b>one\n  two<br><p>three&nbsp;four<form>f</form><p>shared line</article>", "r"),
        (2, "http://h.com/a/2", page % "<div>own words</div><p>own words 2", "r"),
        (3, "http://h.com/a/3", page % "<p>other", "r"), (4, "http://other.com/", page % "<p>alone", "r"), (5, None, None, "r"), (6, "x", "", "r"), (7, "u", "<p>a &am", "r"), (3, "http://h.com/a/3", page % "<p>other", "r"),
        (8, "v", "<article>" + "<p>" + "long " * 50_000 + "</article>", "r"), (9, "w", "no tags < 3 <b", "r"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, roles string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == 10
    assert got[1].text == "A & b\none two\nthree four\nshared line" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "own words\nown words 2" and got[2].n_deleted == 4 and got[4].text == "shared line\nalone" and got[3].text == "other"
    assert got[5].text == "" == got[6].text and got[7].text == "a &am" and got[8].n_chars == 249_999 and got[9].text == "no tags < 3"
    assert html_extract.extract(df.limit(0)).collect() == []
    assert html_extract.common_lines([1, 2, 3, 4], [2, 9, 4, 1]) == [1, 3]
    old, html_extract.ALIGN_CELLS = html_extract.ALIGN_CELLS, 0
    assert html_extract.common_lines([1, 2, 3, 4, 7], [9, 2, 8, 4, 1, 7]) == [1, 3, 4]
    html_extract.ALIGN_CELLS = old


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="single has-sidebar"><article><p>a<p>b</article>', "a\nb"),
        ('<article class="post comments-open"><p>a</article>', "a"),
        ('<div class="page menu-open"><article>a</article></div>', "a"),
        ('<div class="sidebar"><div class="menu"><article>a</article></div></div>', "a"),
        ("<form action=x><div><article>a<form>no</form></article></div></form>", "a"),
        ('<main><p>a</p><aside><article>teaser</article></aside><div class="related"><article>teaser</article></div><p>b</p></main>', "a\nb"),
        ('<main><article class="teaser">t</article><p>a</p></main>', "a"),
        ("<div role='main'><p>a</p></div><p>no", "a"),
        ('<article>a<ol class="commentlist"><li>no</ol><div class="responses">no</div><section id="comments"><article>no</article></section></article>', "a"),
        ('<article>a</article><article class="comment">no</article>', "a"),
        ("<article><header><h1>a</h1></header>b</article><header>no</header>", "a\nb"),
        ('<p class="no-ads">a</p><p class="ads">no</p><span class="ad">no</span>', "a"),
        ("<article>a</article><article>b</article>", "a\nb"),
        ("<nav><article>no</article></nav><p>a", "a"),
        ("<p>a<b>c<p>d</b>e<table><tr><td>f<td>g</table>", "ac\nde\nf\ng"),
    ],
)
def test_1_what_the_article_is(page, want):
    roles, texts = zip(*html_extract.lines(page), strict=True)
    assert html_extract.main_text(list(roles), list(texts), set())[0] == want


def test_1_copies_are_nobodys_neighbours(spark):
    page = "<div>menu</div><div>%s</div><div>foot</div>"
    rows = [(i, f"http://h.org/{i}", page % w) for i, w in enumerate(["same", "same", "same", "other", "last", "last"])] + [(9, "http://one.org/", page % "x"), (10, "http://two.org/a", page % "x"), (11, "http://two.org/b", page % "x")]
    rows += [(20, "http://sub.org/a", "<p>a<p>b"), (21, "http://sub.org/b", "<p>a<p>b<p>c")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == ["same", "same", "same", "other", "last", "last"]
    assert got[9] == "menu\nx\nfoot" == got[10] == got[11]
    assert got[20] == "a\nb" and got[21] == "c"


def test_1_lcs_against_a_plain_table():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found, rest = html_extract.common_lines(a, b), iter(b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_1_every_page_meets_its_true_neighbour(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"http://{h}/{s}/{k:03}", f"<p>menu of {h} {s} {k // 2}<p>own {i}", "r") for i, (h, s, k) in enumerate((h, s, k) for h in ("hot.com", "b.org") for s in "xyz" for k in range(40 if h == "hot.com" else 2))]
    rng.shuffle(rows)
    order = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, [t for t in h.split("<p>") if t]) for i, u, h, _ in rows)
    want = {}
    for at, (host, path, i, own) in enumerate(order):
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0] == host]
        best = max(near, key=lambda x: html_extract._prefix(path, x[1]))
        want[i] = "\n".join(t for t in own if t not in best[3])
    monkeypatch.setattr(html_extract, "SUBHOST", 5, raising=False)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, roles string")
    for size in (100_000, 4):
        monkeypatch.setattr(html_extract, "RANGE", size, raising=False)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_1_long_pages_are_aligned_in_full(monkeypatch):
    rng = random.Random(7)
    for _ in range(30):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
        monkeypatch.setattr(html_extract, "ALIGN_CELLS", 4_000_000)
        whole = html_extract.common_lines(a, b)
        monkeypatch.setattr(html_extract, "ALIGN_CELLS", 0)
        found = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(found) == len(whole) and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_2_suffix_dedup(docs, rows, nothing):
    cols = ["doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256"]
    got = sorted(map(tuple, suffix_dedup.dedup(docs).select(*cols).collect()))
    assert got == sorted(suffix_dedup.brute_force([(r[0], r[1]) for r in rows]))
    assert suffix_dedup.dedup(nothing).collect() == []


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 20_000), (2, 3), (3, 3), (4, 1), (5, 1)])
def test_2_arrays_against_every_window(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # leads are split, and windows counted
    rng = random.Random(seed)
    words = ["ab", "ba", "\0", "ñ", "c"]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(40)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), length=12, lead=4).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows, 12))


def test_3_license_scan(docs, rows, nothing):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in license_scan.PHRASES}
        every = sorted(k for v in places.values() for k in v)
        found = {}
        lines = low.split("\n")
        for block in zip(lines, [*lines[1:], ""], strict=True):
            have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "\n".join(block)))
            for label, t in license_scan.TEMPLATES:
                own = set(t.split())
                if len(have & own) >= math.ceil(license_scan.THRESHOLD * len(own) - 1e-9):
                    found[label] = max(found.get(label, 0), len(have & own) / len(own))
        base = sorted(k for k, v in places.items() if v)
        want = (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base), ",".join(sorted({*base, *found})), 1.0 if every else max(found.values(), default=0.0))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, text
    assert "mit" in {x for r in got.values() for x in r.labels.split(",")} and license_scan.scan(nothing).collect() == []


def test_3_templates_over_a_line_break(spark):
    bsd = "Redistribution and use in source and binary forms, with or without{}modification, are permitted provided"
    texts = ["x\n" + bsd.format("\n"), bsd.format("\r\n * ") + "\nx", bsd.format(" "), bsd.format("\n\n"), "y\nReleased under\nthe MIT license\n", "released under\n\n\nthe mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score, r.n_blocks) for r in license_scan.scan(df).collect()}
    assert got == {0: ("bsd", 1.0, 1), 1: ("bsd", 1.0, 1), 2: ("bsd", 1.0, 1), 3: ("", 0.0, 0), 4: ("mit", 1.0, 1), 5: ("", 0.0, 0)}


def test_4_lm(docs, rows, nothing):
    held = F.col("doc_id") % 4 == 2
    got = sorted(map(tuple, lm_scoring.score_documents(docs, held).collect()))
    texts = [(i, i % 4 == 2, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    c = Counter(w for _, h, t in texts if not h for w in t)
    pairs = Counter(p for _, h, t in texts if not h for p in zip([None, *t], t, strict=False))
    threes = Counter(p for _, h, t in texts if not h for p in zip([None, *t], t, t[1:], strict=False))
    n, v = sum(c.values()), len(c)
    more = []
    for (i, h, t), g in zip(sorted(texts, key=lambda x: x[0]), got, strict=True):
        base = [math.log10((c[w] + 1) / (n + v + 1)) for w in t]
        assert g[:5] == (i, h, len(t), sum(c[w] > 0 for w in t), n) and abs(g[5] - sum(base)) < 1e-6
        counts = lambda k, cut, f: float(f(lm_scoring.levels(np.array([k]), cut), cut)[0]) if k >= cut else 0.0
        own = []
        for k, w in enumerate(t):
            u = t[k - 1] if k else None
            p = 0.7 * 10 ** base[k] + 0.2 * max(counts(pairs[u, w], 2, lm_scoring.least_count) - 0.5, 0) / max(1, c[u])
            if k and (context := counts(pairs[t[k - 2] if k > 1 else None, u], 2, lm_scoring.most_count)):
                p += 0.1 * max(counts(threes[t[k - 2] if k > 1 else None, u, w], 2, lm_scoring.least_count) - 0.5, 0) / context
            own.append(math.log10(min(1, p)))
        assert g[6] >= sum(own) - 1e-6  # the filter may see more than there is, never less
        more.append((g[6] - sum(own), len(t)))
    assert sum(m for m, _ in more) < 0.03 * sum(k for _, k in more)
    assert lm_scoring.score_documents(nothing, held).collect() == []


def test_4_filter_holds_all_it_was_given():
    rng = np.random.default_rng(1)
    h, c = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(2, 500, 20_000)
    f = lm_scoring.Filter([lm_scoring.segment(h, c, 1 << 20)])
    assert (f.level(np.zeros(len(h), np.int64), h) >= lm_scoring.levels(c)).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (f.level(np.zeros(len(other), np.int64), other) > 0).mean() < 0.02
    assert (lm_scoring.least_count(lm_scoring.levels(c)) <= c).all()


def test_4_filter_keeps_its_bits_at_every_size(docs, rows, monkeypatch):
    held = F.col("doc_id") % 4 == 2
    want = sorted(map(tuple, lm_scoring.score_documents(docs, held).collect()))
    monkeypatch.setattr(lm_scoring, "MAX_BYTES", 2000, raising=False)
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 2000, raising=False)  # several passes
    got = sorted(map(tuple, lm_scoring.score_documents(docs, held).collect()))
    assert [g[:6] for g in got] == [w[:6] for w in want] and np.allclose([g[6] for g in got], [w[6] for w in want], rtol=0, atol=1e-9)
    assert lm_scoring.ranges([3, 3, 9, 1, 1], 6) == [(0, 2), (2, 3), (3, 5)]


def test_4_the_query_keeps_bigrams_seen_once(spark, tmp_path):
    from evlog.llm.queries import QUERIES

    rows = [(i, f"w{i} x{i} y{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_lm_scoring"](spark, str(tmp_path)).where("not held_out").collect()
    for r in got:  # each word and each bigram inside a text stands once: p = 0.2 * (1 - 0.5) / 1 + 0.7 * p1
        inner = math.log10(0.1 + 0.7 * 2 / (r.train_tokens + 3 * len(got) + 2))
        assert abs(r.score - r.base_score - 2 * (inner - math.log10(2 / (r.train_tokens + 3 * len(got) + 2)))) < 2 and r.score > 2 * inner + 2 * math.log10(0.7 / (r.train_tokens + 3 * len(got) + 2))


def test_4_what_stands_twice_scores_higher(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=80)) for _ in range(120)]
    rows = list(enumerate(texts + texts[:20]))
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(False), cutoff=1).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 120))


def test_4_probabilities_add_up_to_one_at_most():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 9, 4000)
    pairs, threes, ones = Counter(zip(words, words[1:], strict=False)), Counter(zip(words, words[1:], words[2:], strict=False)), Counter(words.tolist())
    level = lambda k, cut: int(lm_scoring.levels(np.array([k]), cut)[0]) if k >= cut else 0
    for t, u in [(1, 2), (3, 3), (8, 1)]:
        total = 0
        for w in range(1, 9):
            c = np.array([ones[t], ones[u], ones[w], 5])
            p = lm_scoring.terms(c, np.array([0, 3]), np.array([0, level(pairs[t, u], 1), level(pairs[u, w], 1)]), np.array([0, 0, level(threes[t, u, w], 2)]), len(words), 8, 1)
            total += 10 ** p[2]
        assert 0.5 < total <= 1


def test_4_a_full_segment_ends():
    f = lm_scoring.Filter([b"\xff" * 8 + b"\x03"])
    assert f.level(np.zeros(5, np.int64), np.arange(5).astype(np.uint64)).tolist() == [3] * 5


def test_5_language(docs, rows, nothing):
    learned = language_id.samples(docs, F.col("doc_id") % 3 != 1)
    assert set(learned) == {"de", "en"}
    got = {r.doc_id: r for r in language_id.identify(docs, learned).collect()}
    assert set(docs.columns) <= set(language_id.identify(docs, learned).columns)
    for i, text, *_ in rows:
        if not text or not any(ch.isalpha() for ch in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert 0 <= got[i].score <= 1 and got[i].lang_pred in learned
    assert all(got[i].lang_pred == ("de" if "ung" in t else "en") for i, t, *_ in rows[-26:] if len(t) > 120)
    assert language_id.identify(nothing, language_id.samples(nothing, F.lit(True))).collect() == []
    assert language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("block", [2048, 7, 3])
def test_5_phrases_are_longest_matches(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(block)
    sources = {"a": ["abracadabra"], "b": ["banana"], "c": [language_id.normalise("".join(rng.choices("abc ", k=50))) for _ in range(3)]}
    model = language_id.Model(sources)
    texts = ["abrabanana", "cadab", "zzz", "b", "", "nanabraz", sources["c"][0] * 2, *("".join(rng.choices("abcz", k=rng.randint(0, 60))) for _ in range(60))]
    for text, got in zip(texts, model.phrases(texts).tolist(), strict=True):
        for k, own in enumerate(sources.values()):
            n, at = 0, 0
            while at < len(text):
                j = at + 1
                while j < len(text) and any(text[at : j + 1] in source for source in own):
                    j += 1
                at, n = j, n + 1
            assert got[k] == n, (text, own)


def test_5_predictions_against_plain_parsing(spark, docs, rows):
    learned = language_id.samples(docs, F.col("doc_id") % 3 != 1)
    want = {}
    for i, text, *_ in rows:
        t = language_id.normalise(text)
        if len(t) < 3000:
            counts = []
            for k in sorted(learned):
                own, n, at = "\n".join(language_id.normalise(x) for x in learned[k]), 0, 0
                while at < len(t):
                    j = at + 1
                    while j < len(t) and t[at : j + 1] in own:
                        j += 1
                    at, n = j, n + 1
                counts.append((n, k))
            want[i] = min(counts)[1] if t else "und"
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, learned).collect()}
    assert {i: got[i] for i in want} == want and len(want) > 40


def test_5_samples_are_whole_texts(spark):
    rows = [(i, ("ab " * i).strip(), "x") for i in range(1, 200)] + [(900 + i, "yz " * (2000 + i), "y") for i in range(3)]
    got = language_id.samples(spark.createDataFrame(rows, "doc_id int, text string, lang string"), F.lit(True))
    assert len(got["x"]) == language_id.SAMPLE_TEXTS and {*got["x"]} <= {r[1] for r in rows} and len(got["y"]) == 3
    assert max(map(len, got["x"])) <= language_id.SAMPLE_BYTES and min(map(len, got["y"])) > language_id.SAMPLE_BYTES


def test_6_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x)]
    rows += [(2000, rows[5][1], "q"), (2001, None, "q"), (2002, [0.0] * 24, "q"), (2003, [float("nan")] * 24, "q"), (2004, [1.0, None] * 12, "q"), (2005, [1.0], "q"), (40, rows[40][1], "q"), (2006, [float("inf")] * 24, "q")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    ids, v = np.array([r[0] for r in rows[:1501] + [rows[1506]]]), np.array([r[1] for r in rows[:1501] + [rows[1506]]])
    got: dict[int, list] = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in sorted({*ids[ids % 20 == 0].tolist()}):
        s = (v * v[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        other = np.flatnonzero(ids != q)
        best = other[np.lexsort((ids[other], -s[other]))[:20]]
        assert [g[0] for g in got[q]] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] <= b[1]) for a, b in zip(got[q], got[q][1:], strict=False))
        recall.append(len({*ids[best].tolist()} & {g[1] for g in got[q]}) / len({*ids[best].tolist()}))
    assert np.mean(recall) >= 0.95 and 2000 in got
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4] and ann.search(df.limit(0), F.lit(True)).collect() == []


def test_6_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    codes = ann.Codes(x, float(np.abs(x).max()), 256)
    shard = ann.Shard(np.arange(400), x, codes)
    q = codes.code(x[:1], False)[0]
    apart = np.bitwise_count(codes.code(x, True) ^ q).astype(int)
    for radius in (0, 15, 16, 37, 60, 100, 130):
        found, compared = shard.within(q, radius)
        s, a = divmod(radius, 16)
        assert found.tolist() == np.flatnonzero(apart.sum(axis=1) <= radius).tolist()
        assert compared == (apart <= np.where(np.arange(16) <= a, s, s - 1)).any(axis=1).sum()  # just the buckets that are probed
    pairs = codes.code(x[:40], False)
    radius, reach = ann.learned_radius(pairs, codes.code(x[40:80], True), 0.9)
    shard = ann.Shard(np.arange(40), x[40:80], codes)
    assert sum(i in shard.probe(pairs[i], radius) for i in range(40)) >= 36 > sum(i in shard.probe(pairs[i], radius - 1) for i in range(40))


def test_6_whole_query_against_brute_force(spark, tmp_path):
    from evlog.llm.queries import QUERIES

    rng = np.random.default_rng(5)
    x = rng.standard_normal((2500, 32))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for size in (ann.SHARD, 700):
        old, ann.SHARD = ann.SHARD, size
        got: dict[int, list] = {}
        for r in QUERIES["op6_ann"](spark, str(tmp_path)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score, r.probed))
        ann.SHARD = old
        found = 0
        for q in range(0, 2500, 20):
            s = (x * x[q]).sum(axis=1)
            best = [i for i in np.lexsort((np.arange(2500), -s)) if i != q][:20]
            assert all(score == s[i] for _, i, score, _ in got[q]) and [r for r, *_ in sorted(got[q])] == list(range(1, 21))
            found += len({*best} & {i for _, i, _, _ in got[q]})
        assert found >= 0.9 * 20 * 125 and np.mean([p for v in got.values() for *_, p in v]) < 0.6


def test_6_products_beyond_doubles(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e199]), (2, [-1e200, 1e200]), (3, [1e-200, 0.0]), (4, [1e300, -1e300])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got][0] == 1 and got[0].score == float("inf") and sorted(r.vec_id for r in got) == [1, 2, 3, 4]


def test_7_decontamination(spark, docs, rows, nothing):
    words = rows[9][1].split()
    items = [(1, " ".join(words[20:45])), (2, "two words"), (10, None), (3, ""), (4, rows[20][1][:150]), (5, "ONE!"), (6, " ".join(words[40:60])), (7, "absent entirely from all of the texts that are here"), (2, "two words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(decontaminate.brute_force([(r[0], r[1]) for r in rows], items))
    for block in (1 << 20, 40):  # one pass, several
        own = docs if block > 40 else docs.dropDuplicates(["doc_id"])
        got = decontaminate.decontaminate(own, bench, block_bytes=block).drop("longest_match", "matches")
        assert sorted(map(tuple, got.collect())) == (want if block > 40 else sorted(set(want)))
    assert decontaminate.decontaminate(nothing, bench).collect() == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_7_blocks_keep_every_row(spark):
    a, b = "one two three four five six seven eight nine ten eleven", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, a), (None, f"{b} {b}"), (None, a), (3, a), (3, "x " + a), (3, a), (4, f"{a} {b}"), (None, None)]
    items = [(1, a), (2, b), (5, "theta iota kappa")]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(decontaminate.brute_force(rows, items), key=str)
    for block in (1 << 20, 60, 10):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block).drop("longest_match", "matches")
        assert sorted(map(tuple, got.collect()), key=str) == want, block


@pytest.mark.parametrize("seed", range(3))
def test_7_longest_matches_against_every_pair_of_places(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: [f"v{rng.randint(0, 5)}" for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([2, 4, 30])))) for i in range(6)]
    texts = [(i, " ".join(pick(20) + items[rng.randrange(6)][1].split()[rng.randint(0, 3) :] + pick(10))) for i in range(15)] + [(99, "")]
    want = {}
    for i, text in texts:
        w, found = text.split(), set()
        for k, item in items:
            t = item.split()
            need = min(5, len(t))
            for a in range(len(w)):
                for b in range(len(t)):
                    if w[a : a + 1] == t[b : b + 1] and not (a and b and w[a - 1] == t[b - 1]):
                        n = 0
                        while a + n < len(w) and b + n < len(t) and w[a + n] == t[b + n]:
                            n += 1
                        if n >= need:
                            found.add((str(k), b, a, n))
        want[i] = found
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 40):
        got = decontaminate.decontaminate(docs, bench, window=5, block_bytes=block).collect()
        assert {r.doc_id: {tuple(m) for m in r.matches} for r in got} == want
        assert all(r.longest_match == max((m[3] for m in want[r.doc_id]), default=0) for r in got)


def test_7_null_item_ids_are_searched(spark):
    import hashlib

    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, b), (3, "other")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, a), (None, b), (None, b)], "item_id bigint, text string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 20, 20, 2, digest("7"), True), (2, 10, 10, 1, digest(""), True), (3, 1, 0, 0, digest(""), False)]
    for block in (1 << 20, 10):
        assert sorted(map(tuple, decontaminate.decontaminate(docs, bench, block_bytes=block).drop("longest_match", "matches").collect())) == want


def test_8_packing(docs, rows, nothing, tokenizer):
    encoder = packing.Encoder(tokenizer)
    got: dict[int, list] = {}
    windows: dict[int, list] = {}
    for r in packing.pack_documents(docs, tokenizer).collect():
        got.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, *_ in rows:
        ids = np.array(encoder.whole(text or "") + [0], dtype="<u4")
        pieces = sorted(got[i], key=lambda r: r.start)
        copies = 2 if i == 7 else 1
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
        assert sum(r.length for r in pieces) == copies * len(ids)
        if copies == 1:
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert 1024 * len(windows) <= sum(n for p in windows.values() for _, n in p) + 1024 * 3  # two tasks' groups, and a rise
    assert packing.pack_documents(nothing, tokenizer).collect() == []


@pytest.mark.parametrize("text", ["  a", "a  b\n\n c \n", "\n\nx\t y", "it's   l've \r\n z", "a\xa0b \xa0 c", "<|endoftext|> hi", "x" * 3000, "é  ü\n", " \n a", "a \nb", "١٢ 12a", "\x1c a", "　"])
def test_8_ids_are_the_tokenizers(tokenizer, text):
    import pyarrow as pa

    from evlog.llm import textbytes as tb

    e = packing.Encoder(tokenizer)
    ids, at = e.encode(*tb.utf8(pa.array([text, None, "b " + text, text])))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*e.whole(t), 0] for t in (text, "", "b " + text, text)]


def test_8_differencing():
    assert packing.differencing([8, 7, 6, 5, 4], 2) in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0], [0, 1, 1, 0, 1], [1, 0, 0, 1, 0])
    rng = random.Random(2)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    bins = np.bincount(packing.differencing(sizes, 40), weights=sizes, minlength=40)
    assert bins.max() - bins.min() < 60


@pytest.mark.parametrize("seed", range(6))
def test_8_windows_rise_where_one_is_exceeded(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 900), rng.randint(1, 5000), 1024, 600]) for _ in range(rng.choice([1, 5, 120]))]
    for piece in (128, 1024):
        pieces = packing.pack(lengths, 1024, piece)
        used = Counter()
        for i, at, n, w, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == used[w] and n > 0
            used[w] += n
        assert max(used.values()) <= 1024
        for i, total in enumerate(lengths):
            at = 0
            for _, start, n, *_ in sorted(p for p in pieces if p[0] == i):
                assert start == at
                at += n
            assert at == total
        if piece == 128 and len(lengths) > 100:
            assert len(used) <= -(-sum(lengths) // 1024) + 2
    # three pieces of 600 fit two by two in no window: by size two windows would do
    assert len({p[3] for p in packing.pack([600, 600, 600], 1024, 1024)}) == 3


def test_9_near_dedup(docs, rows, nothing):
    for width, (num, den) in ((3, (85, 100)), (5, (8, 10))):
        sets = {}
        for i, t, *_ in rows:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        comp = {i: i for i in sets}
        while True:
            moved = False
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                        comp[a], moved = comp[b], True
            if not moved:
                break
        got = near_dedup.near_duplicates(docs, width=width, threshold=(num, den)).collect()
        assert sorted(tuple(r) for r in got) == sorted((r[0], len(sets[r[0]]), comp[r[0]], comp[r[0]] == r[0]) for r in rows)
        assert len(set(comp.values())) < len(comp) - 2
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_9_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(80)) for w in ("x", "y", "z"))
    near = lambda t: t.replace("40", "other")
    rows = [(None, a), (5, near(a)), (None, near(a)), (3, b), (3, c), (9, near(c)), (None, "lone words of nobody"), (None, None), (3, b)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=3, threshold=(85, 100)).collect()
    want = [(None, 78, 5, False), (5, 78, 5, True), (None, 78, 5, False), (3, 78, 3, True), (3, 78, 3, True), (9, 78, 3, False), (None, 2, None, True), (None, 0, None, True), (3, 78, 3, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_9_large_group_and_chain(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"u{rng.random()}"
        texts.append(w)
    chain = [f"c{k}" for k in range(100)]
    texts += [chain[k * 4 :] + [f"d{j}" for j in range(k * 4)] for k in range(12)]  # each is near its neighbours only
    long = [f"l{k}" for k in range(900)]
    texts += [long, long[:400] + ["x"] + long[401:], long[450:] + long[:450], long[:600]]
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in texts]
    comp = list(range(len(sets)))
    for _ in range(20):
        for a in range(len(sets)):
            for b in range(len(sets)):
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=3, threshold=(85, 100)).collect()}
    assert got == dict(enumerate(comp))


def test_9_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(3)
    path = rng.sample(range(1000), 300)
    edges = list(zip(path, path[1:], strict=False)) + [(2000, i) for i in range(2001, 2100)] + [(1 << 60, -5), (7000, 7000), (-5, 6000)]
    edges += [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(300)] + edges[:5]
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(rng.sample(edges, len(edges)), "a bigint, b bigint").repartition(4)
    for at_once in (0, len(edges)):
        got = components.components(df, at_once).collect()
        assert sorted(map(tuple, got)) == sorted(want.items())
        assert components.components(df.limit(0), at_once).collect() == []


def test_9_jobs_on_the_driver(spark):
    """The driver keeps plans and figures of each job: their number must not grow with every round of verification and contraction."""
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 9000)}" for _ in range(120)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(120)] = f"u{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    began = jobs()
    got = near_dedup.near_duplicates(df, width=3, threshold=(85, 100))
    assert jobs() - began <= 100  # 69; 142 when each call of components and each few pairs took rounds of their own
    assert len({r.component_id for r in got.collect()}) < len(rows)


def test_10_url_filter(spark):
    rows = [(1, "http://a.Example.COM/en/1?q#f"), (2, "https://www.example.com/en/"), (3, None), (4, "nothing"), (5, "ftp://x.net/es/1"), (6, "http://net/fr/"), (7, "http://cheap-pills.example.org/de/1"), (8, "http://a.com"), (9, "http://m.there.example.org/en/3"), (10, "x://"), (11, "http://wwwexample.com/en/"), (11, "http://wwwexample.com/en/"), (12, "http://a.b/" + "p" * 100_000)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert [got[i].rule for i in (2, 3, 4, 5, 6, 7, 8, 9, 11)] == ["www.example.com/en/", None, None, "net/es/", "net/fr/", None, None, None, "com/"]
    assert (got[3].host, got[3].path, got[3].verdict) == ("", "", "allow") == (got[4].host, got[4].path, got[4].verdict)
    assert got[2].verdict == "allow" and got[7].verdict == "block" and got[9].verdict == "allow" and len(got[12].path) == 100_001
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_10_query_against_a_plain_version(spark, tmp_path):
    from evlog.llm.queries import QUERIES

    rng = random.Random(4)
    urls = [u for _, u in url_filter.labelled_urls(seed=3)[::7]] + [None, "", "x", "://", "a://B.Com", "http://WWW.Example.com/en/a://b", "http://ü.net/es/?x", "http://x.net/fr", "http://x.net:80/fr/", "http://e.com?a/b", "http://example.com#/en/"]
    urls += ["".join(rng.choices("ab./:?#-", k=rng.randint(0, 20))) for _ in range(100)]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    weights, bias = url_filter.train()
    for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        grams = set()
        for mark, s in ((1, f"^{host}$"), (2, f"^{path}$")):
            for n in url_filter.NGRAMS:
                for k in range(len(s) - n + 1):
                    h = mark * 131 + n
                    for c in s[k : k + n]:
                        h = (h * 0x100000001B3 & (2**64 - 1)) ^ ord(c)
                    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
                    grams.add((h >> 40) % url_filter.DIMENSIONS)
        score = 1 / (1 + math.exp(-(sum(weights[g] for g in grams) / math.sqrt(max(1, len(grams))) + bias)))
        verdict = max(fits)[2] if fits else "block" if score >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fits)[1] if fits else None, verdict) and abs(r.score - score) < 1e-9, url


def test_10_urls_that_were_not_trained_on():
    w, b = url_filter.train()
    held = [(y, u) for y, u in url_filter.labelled_urls(seed=77) if u not in {x for _, x in url_filter.TRAINING_URLS}]
    got = [w[f := url_filter.features(*url_filter._split(u))].sum() / max(1, len(f)) ** 0.5 + b > 0 for _, u in held]
    assert len(held) > 1000 and np.mean([g == bool(y) for g, (y, _) in zip(got, held, strict=True)]) > 0.93
    assert np.mean([g for g, (y, _) in zip(got, held, strict=True) if not y]) < 0.05
