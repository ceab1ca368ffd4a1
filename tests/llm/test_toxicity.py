"""The toxicity model: accuracy on labels that it hasn't seen, misspellings, gradients, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import toxicity
from foliant.llm.queries import QUERIES

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())]
)


def prose(n, seed, rude=(), each=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "re", "lo", "mi", "sen", "dor", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(rng.randrange(each), n, each) if rude else ():
        words[i] = rng.choice(rude)
    return " ".join(words)


@pytest.fixture(scope="module")
def fitted():
    rude = ["zounderkin", "grobbelt", "fnarqwist"]
    texts = [prose(100, i, rude if i % 4 == 0 else ()) for i in range(800)]
    return toxicity.fit(texts, np.array([int(i % 4 == 0) for i in range(800)]), 0.25)


def chances(scorer, texts):
    return scorer.probability(scorer.margin(texts))


def test_finds_known_and_misspelt_words_in_texts_of_any_length(fitted):
    clean = [prose(n, 5000 + n) for n in (5, 50, 500, 20_000)]
    assert (chances(fitted, clean) < 0.3).all()
    for word in ("grobbelt", "GROBBELT", "grobbeltt", "zzounderkin", "fnarqwistz"):
        found = chances(fitted, [f"{t} {word}, {t}" for t in clean])
        assert (found > 0.5).all(), (word, found)


def test_the_query_on_unseen_labels(spark, sf_dir):
    found = QUERIES["op12_toxicity"](spark, sf_dir).alias("f")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    # The smallest table has few toxic documents; the larger ones' accuracy is in the README.
    held_out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held_out) >= 0.8 * len(held_out)


def test_gradients_equal_differences():
    bags = toxicity.Bags.of(["abc abd abc", "xyz abd", "q"])
    rng = np.random.default_rng(1)
    table, soft = rng.normal(size=(1 << toxicity.BUCKET_BITS, 2)), rng.normal(size=(3, 2))
    y, passages = np.array([1, 0, 1]), [bags.document(i) for i in range(3)]

    def loss():
        total = 0.0
        for words, kind in zip(passages, y):
            vectors = [table[bags.buckets[bags.bounds[w] : bags.bounds[w + 1]]].mean(axis=0) for w in words]
            logits = np.mean(vectors, axis=0) @ soft[:-1] + soft[-1]
            total += np.log(np.exp(logits).sum()) - logits[kind]
        return total / len(y)

    used, of_bucket, of_softmax = toxicity._gradients(bags, passages, y, table, soft)
    for array, at, got in [*((table, (used[i], 1), of_bucket[i, 1]) for i in range(0, len(used), 3)), *((soft, (i, j), of_softmax[i, j]) for i in range(3) for j in range(2))]:
        was, e = array[at], 1e-5
        array[at] = was + e
        up = loss()
        array[at] = was - e
        down = loss()
        array[at] = was
        assert got == pytest.approx((up - down) / (2 * e), abs=1e-7)


def test_words_have_the_numbers_of_their_buckets():
    """Whole arrays against one word at a time; equal words in any place and text have equal numbers."""
    values = np.random.default_rng(2).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    texts = ["one two_three", "", "é", "two, one; 漢字漢字 one1", "x" * 40]
    words = toxicity.Words.of(texts)
    got = toxicity.word_numbers(words, values)
    bags = toxicity.Bags.of(texts)
    assert np.allclose(got, bags.word_means(values)[bags.words], atol=1e-5)
    names = ["one", "two", "three", "é", "two", "one", "漢字漢字", "one1", "x" * 40]
    assert words.text.tolist() == [0, 0, 0, 2, 3, 3, 3, 3, 4]
    for name, number in zip(names, got):
        assert number == pytest.approx(toxicity.word_numbers(toxicity.Words.of([name]), values)[0], abs=1e-5)


def test_a_long_text_is_read_in_pieces(fitted, monkeypatch):
    texts = [prose(3000, 9, ["grobbelt"], 900), None, "", "one", prose(500, 10)]
    whole = fitted.margin(texts)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.allclose(fitted.margin(texts), whole)
    assert [p for p in toxicity.pieces_of("")] == [""]
    assert "".join(toxicity.pieces_of(texts[0])) == texts[0]


@pytest.mark.parametrize(
    ("rows", "share"),
    [
        ([], None),
        ([(1, "a text", None)], 0.0),
        ([(1, "a text", 0), (2, None, 0)], 0.0),
        ([(1, "a text", 1), (1, "a text", 1), (None, "", 1)], 1.0),
        ([(1, "", 1), (2, None, 0)], 0.5),
    ],
)
def test_without_labels_of_both_kinds(spark, rows, share):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("score", "held_out")})
    found = toxicity.toxicity_scores(docs.select("doc_id", "text", "score"), docs).collect()
    assert len(found) == len(rows)
    assert all(r["score"] == pytest.approx(share, abs=1e-3) for r in found)


def test_odd_rows_and_bounds(spark):
    rows = [(i, prose(60, i, ["grobbelt"] if i % 2 else (), 15), i % 2) for i in range(80)]
    rows += [(None, None, 1), (None, "", None), (3, rows[3][1], 1), (3, "other", 0), (900, "x" * 300_000, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("x"))
    found = toxicity.toxicity_scores(docs, docs, train_rows=60, train_chars=10_000).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    texts, y, _ = toxicity.sample(docs, docs, train_rows=60, train_chars=10_000)
    assert 0 < len(texts) <= 60
    assert sum(map(len, texts)) <= 10_000
    assert len(y) == len(texts)
