"""Joins of words: top postings without all pairs, and very frequent words over several tasks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import match, tokens

WORDS = [f"word{i}" for i in range(60)]


def texts(spark, n, key, seed, common=("always",)):
    """Words by a skewed distribution, and one that every text has."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = {WORDS[min(59, int(rng.expovariate(0.08)))] for _ in range(25)} | set(common)
        rows.append((i, " ".join(rng.sample(sorted(words), len(words)))))
    rows += [(n, ""), (n + 1, None), (n + 2, "the of a")]
    return spark.createDataFrame(rows, f"{key} long, text string")


def topics(spark, n, key, common):
    """Texts of 20 topics with words of their own, and words that all texts have."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        words = {f"topic{i % 20}x{rng.randrange(24)}" for _ in range(24)} | set(common)
        rows.append((i, " ".join(rng.sample(sorted(words), len(words)))))
    return spark.createDataFrame(rows, f"{key} long, text string")


def top_words(df, key):
    found = defaultdict(set)
    for r in tokens.top_keywords(df, key=key, n=match.TOP).collect():
        found[r[key]].add(r["word"])
    return found


@pytest.mark.parametrize(("n", "first"), [(1, 1), (3, 4), (3, 20), (50, 2)])
def test_top_postings_equal_all_pairs(spark, n, first):
    docs, items = texts(spark, 80, "doc_id", 1), texts(spark, 40, "item_id", 2)
    left, right = top_words(docs, "doc_id"), top_words(items, "item_id")
    wanted = set()
    for doc, words in left.items():
        pairs = sorted((-len(words & other), item) for item, other in right.items() if words & other)
        wanted |= {(doc, item, -k, rank) for rank, (k, item) in enumerate(pairs[:n], 1)}
    found = match.top_postings(docs, items, n=n, first=first).collect()
    assert {(r["doc_id"], r["item_id"], r["k"], r["rank"]) for r in found} == wanted
    assert len(found) == len(wanted)


def test_top_postings_form_few_pairs(spark, monkeypatch):
    """Counted: the pairs made, against all that share a word (which is every pair here)."""
    common = ("always", "ever", "often")
    docs, items = (topics(spark, n, key, common) for n, key in ((60, "doc_id"), (200, "item_id")))
    made, probed = [], match._probed

    def counted(*args):
        pairs = probed(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(match, "_probed", counted)
    match.top_postings(docs, items, n=1, first=2).collect()
    every = match.match_corpus(docs, items).count()
    assert every == 60 * 200
    assert sum(made) < every / 5


def test_frequent_words_are_spread_over_tasks(spark):
    """One word is in every text; the largest task of the join gets a bounded number of its rows."""
    left = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("w"), F.col("id").cast("string"))).otherwise("always").alias("word"))
    right = spark.range(90).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("w"), F.col("id").cast("string"))).otherwise("always").alias("word"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = left.join(right, "word")
        spread = match.spread_join(left, right, "word", rows=100)
        rows = [Counter((r["doc_id"], r["item_id"], r["word"]) for r in df.collect()) for df in (whole, spread)]
        largest = [df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] for df in (whole, spread)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] == rows[1]
    assert largest[0] >= 2000 * 60
    assert largest[1] <= largest[0] / 3


def test_without_frequent_words_or_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, word string")
    right = spark.createDataFrame([(7, "a"), (8, None)], "item_id long, word string")
    assert [tuple(r) for r in match.spread_join(left, right, "word").select("doc_id", "item_id").collect()] == [(1, 7)]
    assert match.spread_join(left.limit(0), right, "word", rows=1).count() == 0
    none = texts(spark, 0, "doc_id", 1)
    assert match.top_postings(none, texts(spark, 3, "item_id", 2)).count() == 0


def nodes(node):
    yield node
    for i in range(node.children().size()):
        yield from nodes(node.children().apply(i))


def test_words_of_texts_without_a_key_dont_carry_the_texts(spark):
    texts = ["red green red", "green blue", "", None, "red green red", "none shared"]
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "a int, b int, resume string, posting string")
    bare, keyed = match.with_keywords(pairs), match.with_keywords(pairs, resume_key="a", posting_key="b")
    assert bare.columns == [*pairs.columns, "resume_words", "posting_words"]
    assert sorted(map(str, bare.collect())) == sorted(map(str, keyed.collect()))
    plan = bare._jdf.queryExecution().optimizedPlan()
    counted = [s for n in nodes(plan) if n.nodeName() == "Aggregate" and "word:string" in (s := n.schema().simpleString())]
    assert len(counted) == 2
    assert all(s.count("string") == 1 for s in counted), counted
