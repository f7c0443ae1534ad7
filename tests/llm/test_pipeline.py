"""Every stage of the pipeline against a plain version, each on its own input."""

import pytest

import corpus_pipeline as cp
from evlog.llm import decontaminate, near_dedup, suffix_dedup
from evlog.llm.packing import Encoder


@pytest.fixture(scope="module")
def sf_dir(spark, docs, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    words = rows[6][1].split()
    items = [(1, " ".join(words[100:130])), (2, None), (3, " ".join(rows[21][1].split()[:14]))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path, tokenizer):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {}
    for name, stage in cp.STAGES:
        before = sorted(((r.doc_id, r.text) for r in now.collect()), key=lambda r: r[0])
        out = stage(spark, now, sf_dir)
        if name == "packing":
            pieces = out.collect()
            break
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = [(r.doc_id, r.text) for r in now.orderBy("doc_id").collect()]
        assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "language_id":
            want = [(i, t) for i, t in before if t and any(c.isalpha() for c in t)]
        elif name == "near_dedup":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before if (w := t.encode().lower().split())}
            comp = {i: i for i in sets}
            for _ in sets:
                for a in sets:
                    for b in sets:
                        if comp[b] < comp[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                            comp[a] = comp[b]
            want = sorted({(i, t) for i, t in before if comp[i] == i})
            assert len(want) < len({i for i, _ in before})
        elif name == "suffix_dedup":
            gone = {r[0]: r for r in suffix_dedup.brute_force(before)}
            assert [i for i, _ in got] == [i for i, _ in before]
            want = got
            for (i, t), (_, old) in zip(got, before, strict=True):
                assert (t == old) == (gone[i][2] == 0) and 0 <= gone[i][1] - gone[i][2] - len(t.encode()) <= 6 * gone[i][3]
            assert any(gone[i][2] for i in gone)
        else:
            bad = {r[0] for r in decontaminate.brute_force(before, items) if r[5]}
            want = [(i, t) for i, t in before if i not in bad]
            assert bad
        assert got == want, name
        texts = dict(got)
    e = Encoder(tokenizer)
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in texts} == {i: len(e.whole(t)) + 1 for i, t in texts.items()}


def test_run(spark, sf_dir):
    import __spark_entry__

    got = cp.run(spark, sf_dir)
    assert got.count() > 0 and got.columns[0] == "doc_id"
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_null_ids_and_repeats(spark):
    rows = [(None, "some words of a text that is here twice over", "en", "s", 1), (None, "some words of a text that is here twice over", "en", "s", 1), (3, "quite another text with more words in it than that", "en", "s", 2), (3, "quite another text with more words in it than that", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (3, 3), (3, 3)]
    assert cp.near_dedup_stage(spark, docs, "").count() == 2


def test_rows_of_one_id_are_documents_of_their_own(spark, tmp_path):
    base = [" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma", "delta", "eps")]
    leak = " ".join(base[4].split()[:12])
    texts = [(None, base[0]), (None, base[1]), (None, base[0]), (3, base[2]), (3, base[3]), (3, base[2]), (None, base[2] + " more"), (None, base[4]), (3, base[4] + " end of it"), (5, "%"), (5, "%"), (5, "?"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    key = lambda r: (r[0] or 0, r[1] or "")
    kept = cp.near_dedup_stage(spark, docs, "")
    want = [(None, base[0]), (None, base[1]), (3, base[2]), (3, base[3]), (3, base[4] + " end of it"), (5, "%"), (5, "?"), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key) and kept.columns == docs.columns
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = cp.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted([t for t in texts if leak not in (t[1] or "")], key=key)
    own = [(i, t) for i, t in texts if t != base[2]]
    got = suffix_dedup.dedup(docs.where(f"text is null or text <> '{base[2]}'")).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(suffix_dedup.brute_force(own), key=str)


def test_extra_columns_may_clash(spark, tmp_path):
    names = "score lang_pred rate kept n_bytes n_removed spans kept_sha256 doc row id component_id n_hit item_id".split()
    long = " ".join(f"w{k}" for k in range(90))
    rows = [(1, long + " one", "en", "s", len(long) + 4, *names), (2, long + " " + " ".join(f"v{k}" for k in range(90)), "en", "s", 5, *names), (3, "another text", "en", "s", 12, *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "none of it")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [tuple(r)[5:] for r in out.collect()] == [tuple(names)] * 3
    assert cp.packing_stage(spark, docs, "").count() >= 3
