import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, key string, h int"


def prose(rng, n, lang="en"):
    parts = {"en": "th er on an in re nd at st es en of te ed or ti hi as to".split(), "de": "ein sch ung der ich lich keit ver zu über ge be auf".split()}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null, empty, letterless, long, repeated and near texts; ties; benchmark words; license lines. Extra columns clash with inner names."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t", "12345 !!", "one", "two words", prose(rng, 40_000)]
    base = prose(rng, 300)
    texts += [base, base, base]
    for k in (1, 2, 12, 60):
        w = base.split()
        for i in range(k):
            w[(i * 37 + 11) % len(w)] = f"x{k}y{i}"
        texts.append(" ".join(w))
    passage = prose(rng, 70)
    texts += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 60) for _ in range(4)]
    texts += [passage + passage, "ÄÖÜ é ß " + prose(rng, 90, "de") + " İK", prose(rng, 50, "de"), "z" * 900, "a\x00b\x1fc d  e"]
    texts += ["Licensed under CC BY 4.0.\nnothing", "the GNU General Public License", "All  Rights\nreserved cc by cc by", "released under the MIT license", "mit released license the"]
    texts += [prose(rng, rng.randint(3, 120), rng.choice(["en", "de"])) for _ in range(25)]
    out = [(i, t, None if i % 9 == 8 else ("de" if t and "ung" in t else "en"), "src", len(t or ""), "x", 1, "k", 2) for i, t in enumerate(texts)]
    return out + [out[7]]  # a row that repeats with its id


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
