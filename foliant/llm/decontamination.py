"""Benchmark decontamination: documents that hold a window much like a benchmark item.

Words are runs of letters and digits, lower-cased. A window has as many words as the item. Similarity is that of the
two multisets of five-word shingles: sum of the smaller counts over the sum of the larger ones. Windows of 0.8 or more
are leaks. A document of fewer words than the item is one window, whole.

Steps: (1) Shingle hashes of all documents meet those of the items; at similarity t an item-sized window holds at
least 2t / (1 + t) of the item's shingles (a shorter document: t of them), so documents with fewer are done, and of the others only the windows that
hold so many are looked at: no window that can reach the threshold is left out. (2) Each such window gets a SimHash
of its shingles. (3) Multi-index blocks: fingerprints are cut into radius + 1 blocks, and windows meet the items of
their length on any equal block, which finds all pairs within the radius. (4) Those within the radius are verified by
their exact similarity. A pair at the threshold differs in about 10 bits of 64 with a deviation of 3; the radius of 24
is five deviations away.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is one shingle;
items with equal words are matched once and reported each; repeated documents give one row; a null id is reported as
null; an empty table of documents or items gives no leak; other columns are ignored, ``without_leaks`` keeps them.
Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import unused
from foliant.llm.common import cut, let

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 24
#: A table of at most so many rows of a few numbers (32 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words (1 to 5), made from the hashes of shorter runs; none if words are fewer."""

    def both(left: Column, right: Column, apart: int) -> Column:
        """Hashes of runs of left and right together, where right begins so many words later."""
        return let(
            F.struct(left.alias("l"), right.alias("r")),
            lambda x: F.zip_with(
                F.slice(x["l"], 1, F.size(x["r"]) - apart),
                F.slice(x["r"], apart + 1, F.size(x["r"]) - apart),
                lambda a, b: F.xxhash64(a, b),
            ),
        )

    def made(one: Column) -> Column:
        if size == 1:
            return one
        two = both(one, one, 1)
        if size == 2:
            return two
        if size == 3:
            return both(two, one, 2)
        four = let(two, lambda t: both(t, t, 2))
        return four if size == 4 else both(four, one, 4)

    return F.when(F.size(words) >= size, let(F.transform(words, lambda w: F.xxhash64(w)), made)).otherwise(
        F.array().cast("array<long>")
    )


def simhash(hashes: Column) -> Column:
    """A bit is set if it is set in over half of the hashes."""

    def bit(at: Column) -> Column:
        votes = F.size(F.filter(hashes, lambda h: F.getbit(h, at) == 1))
        return F.when(2 * votes > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(
            F.lit(0).cast("long")
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, at: acc.bitwiseOR(bit(at))
    )


def _with_blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each of the radius + 1 blocks of ``fp``."""
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = [
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"),
        )
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
    ]
    return df.withColumn("b", F.explode(F.array(*blocks))).select("*", "b.*").drop("b")


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """For a table in the shared folder: broadcast if its rows, or the numbers in their lists, are checked to be few."""
    weight = F.lit(1) if weight is None else weight
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS else df


def _overlap(a: Column, b: Column) -> Column:
    """Sum over the distinct values of the smaller of their counts in the two arrays."""

    def count(values: Column, value: Column) -> Column:
        return F.size(F.filter(values, lambda x: x == value))

    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, value: acc + F.least(count(a, value), count(b, value))
    )


def _needed(n_shingles: Column, threshold: float) -> Column:
    return F.ceil(F.lit(2 * threshold / (1 + threshold) - 1e-9) * n_shingles).cast("int")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document and item: doc_id, text_hash, item_id, similarity (the best), start_word (its first window)."""
    named = cut(
        items.select(F.col(item_col).alias("item_id"), plain_words(F.col(item_text_col)).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_list(F.struct("item_id")).alias("ids"))
        .select(
            F.xxhash64("words").alias("item"),
            F.size("words").alias("n"),
            F.least(F.size("words"), F.lit(SHINGLE)).alias("k"),
            "ids",
            "words",
        )
    )
    sizes = sorted(r["k"] for r in named.select("k").distinct().collect())  # at most five
    corpus = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        plain_words(F.col(text_col)).alias("words"),
    )
    found = [_leaks_of_size(corpus, named.where(F.col("k") == k), k, threshold, radius) for k in sizes]
    if not found:
        return corpus.select(
            "doc_id",
            "text_hash",
            F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"),
            F.lit(0.0).alias("similarity"),
            F.lit(0).alias("start_word"),
        ).where(F.lit(False))
    matched = reduce(DataFrame.unionAll, found)
    best = matched.groupBy("doc_id", "text_hash", "item").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start_word"),
    )
    return best.join(named.select("item", F.explode("ids.item_id").alias("item_id")), "item").select(
        "doc_id", "text_hash", "item_id", "similarity", "start_word"
    )


def _leaks_of_size(corpus: DataFrame, items: DataFrame, k: int, threshold: float, radius: int) -> DataFrame:
    """doc_id, text_hash, item, start, similarity of all windows at the threshold, for items with shingles of k words."""
    hashed = cut(
        items.select("item", "n", shingle_hashes(F.col("words"), k).alias("item_hashes")).withColumn(
            "fp", simhash(F.col("item_hashes"))
        )
    )
    owners = cut(
        hashed.select("item", "n", F.explode(F.array_distinct("item_hashes")).alias("h"))
        .groupBy("h")
        .agg(F.collect_list(F.struct("item", "n")).alias("of"))
    )
    per_doc = corpus.select("doc_id", "text_hash", shingle_hashes(F.col("words"), k).alias("hashes"))
    hits = (
        per_doc.select("doc_id", "text_hash", F.size("hashes").alias("m"), F.posexplode("hashes").alias("at", "h"))
        .join(_small(owners, F.size("of")), "h")
        .select("doc_id", "text_hash", "m", "at", F.explode("of").alias("o"))
        .select("doc_id", "text_hash", "m", "at", "o.*")
        .groupBy("doc_id", "text_hash", "item", "n")
        .agg(F.array_sort(F.collect_set("at")).alias("hits"), F.first("m").alias("m"))
    )
    shingles = F.col("n") - (k - 1)
    short = F.col("m") < shingles
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    reach = (
        hits.withColumn(
            "need",
            F.when(short, F.ceil(F.lit(threshold - 1e-9) * shingles).cast("int")).otherwise(_needed(shingles, threshold)),
        )
        .where(F.size("hits") >= F.col("need"))
        .withColumn(
            "runs",
            F.when(short, whole).otherwise(F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.size("hits") - F.col("need") + 1),
                    lambda i: F.struct(
                        F.greatest(
                            F.element_at("hits", i + F.col("need") - 1) - (F.col("n") - k), F.lit(0)
                        ).alias("low"),
                        F.element_at("hits", i).alias("high"),
                    ),
                ),
                lambda r: r["low"] <= r["high"],
            )),
        )
    )
    starts = cut(
        reach.select(
            "doc_id",
            "text_hash",
            "n",
            F.explode(
                F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["low"], r["high"]))))
            ).alias("start"),
        )
        .groupBy("doc_id", "text_hash", "n")
        .agg(F.collect_set("start").alias("starts"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("n", "starts")).alias("windows"))
    )
    numbers = F.aggregate("windows", F.lit(0), lambda total, w: total + F.size(w["starts"]))
    wanted = _small(starts.withColumnsRenamed({"doc_id": "w_doc", "text_hash": "w_hash"}), numbers)
    windows = (
        corpus.join(
            wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_hash") == F.col("w_hash")), "inner"
        )
        .select("doc_id", "text_hash", "windows", shingle_hashes(F.col("words"), k).alias("hashes"))
        .select("doc_id", "text_hash", "hashes", F.explode("windows").alias("w"))
        .select("doc_id", "text_hash", "hashes", "w.n", F.explode("w.starts").alias("start"))
        .where((F.col("start") == 0) | (F.col("start") + F.col("n") - k < F.size("hashes")))
        .select("doc_id", "text_hash", "n", "start", F.slice("hashes", F.col("start") + 1, shingles).alias("hashes"))
        .dropDuplicates(["doc_id", "text_hash", "n", "start"])
        .withColumn("fp", simhash(F.col("hashes")))
    )
    left = _with_blocks(windows, radius)
    right = _with_blocks(hashed, radius).withColumnRenamed("fp", "item_fp")
    same = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    near = left.join(right, ["n", "block", "bits"]).where(same)
    similarity = let(
        _overlap(F.col("hashes"), F.col("item_hashes")),
        lambda x: x / (F.size("hashes") + F.size("item_hashes") - x),
    )
    # A pair meets on each block that it shares; the first of them stands for it.
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    differs = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(
        *[
            F.when(F.shiftrightunsigned(differs, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(i))
            for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
        ]
    )
    return (
        near.where(F.col("block") == first)
        .select("doc_id", "text_hash", "item", "start", similarity.alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = leaks(docs, items, id_col=id_col, text_col=text_col).select("doc_id", "text_hash").distinct()
    doc, text_hash = unused("leak_doc", docs), unused("leak_hash", docs)
    found = found.withColumnsRenamed({"doc_id": doc, "text_hash": text_hash})
    same = docs[id_col].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text_col]) == F.col(text_hash))
    return docs.join(_small(cut(found)), same, "left_anti")
