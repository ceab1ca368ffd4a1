"""SimHash fingerprints, their links at a few differing bits, and the components of the links.

Pigeonhole blocks: a fingerprint of 64 bits is cut into ``radius + 3`` blocks. Two fingerprints that differ in
``radius`` bits or fewer agree on at least three whole blocks, so for every choice of three blocks the fingerprints
are joined on those blocks and the pairs are verified by their Hamming distance. Equal fingerprints are one node
beforehand, whatever the number of their documents.

A block value that many fingerprints share (a large group of near copies) would give a pair for each two of them.
Such a group is linked exactly without pairs: within it, each fingerprint is put under itself and under each
fingerprint at one differing bit outside the shared blocks. Two fingerprints meet under a common neighbour if and
only if they differ in two bits or fewer, and each meets only the smallest node there. No group is cut or sampled.

Components: every node takes the smallest label among its neighbours and then its label's label, until nothing
changes; each round is written to the shared folder, two of which stay there.

That is ``near_duplicates``. ``representatives``, for the pipeline, links texts by the exact similarity of their sets of
five-word shingles. Its candidates are texts whose SimHash fingerprints over those shingles agree on three of six
blocks and differ in 24 bits or fewer (``close_pairs``). Similar texts that agree on fewer blocks follow by an exact
way: bands of minima of shingle hashes show which are still apart, an inverted index of rare shingles joins them.
Texts are long and are dealt by key only where their ids are marked in a bitmap, as they may be similar to another.

Defined results: a null text is an empty text; texts without words have fingerprint zero and are linked like any
other; rows that repeat a doc_id give repeated rows; null ids count as larger than all others and are returned; ids
may be numbers or text; an empty table gives an empty table; ``representatives`` keeps the other columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from foliant.functions.text import unused
from foliant.llm.common import cut, shared_dir, small_batches

SHINGLE = 3
RADIUS = 2
SEED = 42
#: A block value shared by more fingerprints than this is linked through common neighbours.
LARGE_GROUP = 64
#: ``representatives`` links texts whose sets of five-word shingles are at least this similar.
SIMILAR_SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 32, 3
#: Fingerprints of such texts differ in about 10 bits at the threshold, with a deviation of 3. All that differ in
#: SIMILAR_BLOCKS bits or fewer agree on a choice of blocks, and so do many that differ in up to SIMILAR_RADIUS. Three
#: of six blocks are 32 bits, so that few texts agree by chance also among hundreds of millions.
SIMILAR_BLOCKS, SIMILAR_RADIUS = 3, 24
#: Longs that hold the parities of a set of shingles, by which dissimilar pairs are told without their sets.
PARITY_WORDS = 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.array([fingerprint(t.encode()) if t else 0 for t in batch], np.uint64)
        yield pd.Series(found.view(np.int64))


def block_masks(radius: int = RADIUS, agree: int = 3) -> list[int]:
    """One mask for each choice of ``agree`` blocks out of ``radius + agree``."""
    n = radius + agree
    bounds = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(nodes: DataFrame, masks: list[int]) -> DataFrame:
    keyed = [
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block"))
        for i, m in enumerate(masks)
    ]
    return nodes.select("fp", "node", F.explode(F.array(*keyed)).alias("k")).select("fp", "node", "k.*")


def _neighbours(masks: list[int]) -> Column:
    """The fingerprint and those at one differing bit outside the blocks of its choice."""
    free = [[0] + [_signed(1 << b) for b in range(64) if not mask >> b & 1] for mask in masks]
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in free])
    return F.transform(F.get(flips, F.col("choice")), lambda flip: F.col("fp").bitwiseXOR(flip))


def links(nodes: DataFrame, *, radius: int = RADIUS, large_group: int = LARGE_GROUP) -> DataFrame:
    """Pairs (a, b) of linked nodes, a < b, whose components are those of all links. ``nodes``: fp, node."""
    masks = block_masks(radius)
    keyed = _blocks(nodes, masks)
    sizes = keyed.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(keyed.join(sizes, ["choice", "block"]))
    small = members.where(F.col("n") <= large_group)
    left, right = small.alias("l"), small.alias("r")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius
    pairs = left.join(
        right,
        (F.col("l.choice") == F.col("r.choice"))
        & (F.col("l.block") == F.col("r.block"))
        & (F.col("l.node") < F.col("r.node"))
        & near,
    ).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    if radius != 2:
        raise ValueError("common neighbours link fingerprints at two bits")
    under = members.where(F.col("n") > large_group).select("choice", "node", F.explode(_neighbours(masks)).alias("at"))
    smallest = under.groupBy("choice", "at").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = (
        under.join(smallest.drop("n"), ["choice", "at"]).where("a < node").select("a", F.col("node").alias("b"))
    )
    return pairs.union(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, label: the smallest node that it reaches, for each node of the pairs (a, b).

    Rounds write to two folders in turn. Spark takes a join to be as large as the product of its sides, also after a
    checkpoint; over many rounds of joins that is a number of millions of digits, but a file's size is what it is.
    """
    spark = pairs.sparkSession
    edges = cut(pairs.union(pairs.select("b", "a")).toDF("u", "v"))
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def kept(labels: DataFrame, turn: int) -> DataFrame:
        labels.write.mode("overwrite").parquet(f"{folder}/{turn % 2}")
        return spark.read.schema(labels.schema).parquet(f"{folder}/{turn % 2}")

    first = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label"))
    labels, turn = kept(first.withColumn("new", F.lit(True)), 0), 0
    while labels.where("new").limit(1).count():
        turn, now = turn + 1, labels.select("u", "label")
        low = edges.join(now.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        near = now.join(low, "u").select("u", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = now.select(F.col("u").alias("label"), F.col("label").alias("next"))
        found = near.join(jump, "label").select("u", F.least("label", "next").alias("label"), "was")
        labels = kept(found.select("u", "label", (F.col("label") != F.col("was")).alias("new")), turn)
    return labels.select(F.col("u").alias("node"), "label")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", large_group: int = LARGE_GROUP
) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (the smallest doc_id it reaches)."""
    found = cut(small_batches(docs).select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    labels = components(links(nodes, large_group=large_group))
    classes = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return found.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def shingles(text: bytes, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles, in order; of fewer words, the text is one shingle."""
    words = text.lower().split()
    runs = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs))
    hashes.sort()
    return hashes


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One number for each band: of its BAND_ROWS minima and its place."""
    low = (hashes * multipliers[:, None]).min(axis=1).reshape(BANDS, BAND_ROWS)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def name_of(text: bytes) -> bytes:
    """128 bits that stand for the words of a text: two different ones of n are taken for equal below n^2 / 2^129."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()), SEED)


@F.pandas_udf(
    StructType(
        [StructField("name", BinaryType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))]
    )
)
def _banded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    multipliers = _multipliers()
    for batch in texts:
        plain = [(t or "").encode() for t in batch]
        sets = [shingles(t) for t in plain]
        fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        found = [bands(s, multipliers).view(np.int64) for s in sets]
        yield pd.DataFrame({"name": [*map(name_of, plain)], "fp": fps, "bands": found})


@F.pandas_udf(BinaryType())
def _named(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([name_of((t or "").encode()) for t in batch])


@F.pandas_udf(ArrayType(LongType()))
def _shingled(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles((t or "").encode()).view(np.int64) for t in batch])


@F.pandas_udf(ArrayType(LongType()))
def _parities(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64 * PARITY_WORDS bits: whether an odd number of the shingles falls on each."""
    size = 64 * PARITY_WORDS
    for batch in sets:
        odd = [np.bincount(np.asarray(s, np.int64).view(np.uint64) % size, minlength=size) & 1 for s in batch]
        yield pd.Series([np.packbits(x.astype(np.uint8)).view(np.int64) for x in odd])


MARKS_A_ROW, MAX_MARK_BITS = 8, 28  # of a bitmap: 32 MB at most


def _by_marks(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among ``ids`` (one column), with a few others, and the rows whose id surely is not.

    No row is dealt for that: the hashes of the ids are marked in a bitmap that goes to all.
    """
    ids = cut(ids.distinct())
    width = min(MAX_MARK_BITS, max(15, (MARKS_A_ROW * ids.count()).bit_length()))

    def place(column):
        return F.xxhash64(column).bitwiseAND(F.lit((1 << width) - 1))

    def within(at):
        return at.bitwiseAND(F.lit((1 << 15) - 1))

    marks = ids.select(place(ids.columns[0]).alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
    marks = marks.agg(F.bitmap_construct_agg(within(F.col("at"))).alias("bits"))
    part, bits = unused("part", docs), unused("bits", docs)
    at = within(place(id_col))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    placed = docs.withColumn(part, F.shiftright(place(id_col), 15))
    placed = placed.join(F.broadcast(cut(marks).toDF(part, bits)), part, "left")
    return placed.where(marked).select(*docs.columns), placed.where(~marked).select(*docs.columns)


def close_pairs(nodes: DataFrame, *, large_group: int = LARGE_GROUP) -> DataFrame:
    """Pairs (a, b), a < b, of texts that agree on three blocks of their fingerprints and differ in SIMILAR_RADIUS bits or
    fewer: each text with the smallest such one of each choice of blocks. ``nodes``: t, fp.

    Where more than ``large_group`` agree, a text meets only the smallest of all.
    """

    def close(x, y):
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= SIMILAR_RADIUS

    blocks = _blocks(nodes.select("fp", F.col("t").alias("node")), block_masks(SIMILAR_BLOCKS))
    keyed = blocks.select(F.xxhash64("choice", "block").alias("k"), F.col("node").alias("t"), "fp")
    groups = keyed.groupBy("k").agg(F.min("t").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(keyed.join(groups, "k"))
    large = members.where((F.col("n") > large_group) & (F.col("low") < F.col("t"))).select("low", "t", "fp").distinct()
    large = large.join(nodes.select(F.col("t").alias("low"), F.col("fp").alias("low_fp")), "low").where(close("low_fp", "fp"))
    small = members.where(F.col("n") <= large_group).select("k", "t", "fp")
    left, right = small.alias("l"), small.alias("r")
    met = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.t") < F.col("r.t")) & close("l.fp", "r.fp"))
    first = met.groupBy("r.k", F.col("r.t").alias("b")).agg(F.min("l.t").alias("a")).select("a", "b")
    return cut(first.union(large.select("low", "t")).distinct())


def _similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar. ``sets``: t, s."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    similarity = shared / (F.size("sa") + F.size("sb") - shared)
    return both.where(similarity >= threshold - 1e-9).select("a", "b")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """h, at, n, own, t: of each set of n shingles (t, s), ``own`` of which no other has, the rarest others and their places.

    Shingles are in order of the number of texts that have them, those that one text has alone first. Sets at the
    threshold share a shingle among their first n - threshold * n + 1: a set of which so many are its own is similar to
    none.
    """
    each = sets.select("t", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = each.join(often, "h").groupBy("t", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    own = F.col("n") - F.size("s")
    first = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    rare = F.slice("s", 1, F.greatest(F.lit(0), F.least(first - own, F.size("s"))))
    listed = shared.select("t", "n", own.alias("own"), F.posexplode(rare).alias("at", "x"))
    return listed.select(F.col("x.h").alias("h"), (F.col("at") + F.col("own")).alias("at"), "n", "own", "t")


def _hub_pairs(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b): of the texts that list a shingle, those of other components with the one that has the smallest share
    of shingles of its own, which is similar to most that are similar to any. ``labels``: t, label."""
    rows = listed.select("h", "t", (F.col("own") / F.col("n")).alias("share")).join(labels, "t")
    hubs = rows.groupBy("h").agg(F.min(F.struct("share", "t", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = rows.join(hubs.where("low < high").drop("low", "high"), "h").where("label <> hub.label")
    return met.select(F.least("t", "hub.t").alias("a"), F.greatest("t", "hub.t").alias("b")).distinct()


def _candidates(listed: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that list a shingle and may be similar by sizes, places and parities.

    ``listed`` is what ``_prefixes`` gives, ``labels`` (t, label, odd) the components so far and the parities. Of the
    components that list a shingle, the one with most texts meets only the others, not itself. Each bit that parities
    differ in stands for a shingle at least that only one of two texts has.
    """
    rows = cut(listed.join(labels, "t"))
    sizes = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("m"))
    rows = cut(rows.join(largest.where("m > 1").drop("m"), "h"))
    left, right = rows.where("label <> largest").alias("l"), rows.alias("r")
    after = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))  # shared ones from this one on
    enough = after >= threshold / (1 + threshold) * (F.col("l.n") + F.col("r.n")) - 1e-6
    differing = sum(F.bit_count(F.col("l.odd")[i].bitwiseXOR(F.col("r.odd")[i])) for i in range(PARITY_WORDS))
    enough &= differing <= (1 - threshold) / (1 + threshold) * (F.col("l.n") + F.col("r.n")) + 1e-6
    once = (F.col("r.label") == F.col("r.largest")) | (F.col("l.t") < F.col("r.t"))
    met = left.join(right, (F.col("l.h") == F.col("r.h")) & (F.col("l.label") != F.col("r.label")) & enough & once)
    return met.select(F.least("l.t", "r.t").alias("a"), F.greatest("l.t", "r.t").alias("b")).distinct()


def _merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """t, label: the components of what ``labels`` (t, label) has linked and of the further pairs (a, b).

    Only the pairs between components go through rounds, by the labels of those.
    """
    known = pairs.join(labels.toDF("a", "low_a"), "a", "left").join(labels.toDF("b", "low_b"), "b", "left")
    known = known.select("a", "b", F.coalesce("low_a", "a").alias("low_a"), F.coalesce("low_b", "b").alias("low_b"))
    known = cut(known.where("low_a <> low_b"))
    over = components(known.select("low_a", "low_b").distinct().toDF("a", "b")).toDF("label", "low")
    ends = known.select("a", "low_a").union(known.select("b", "low_b")).toDF("t", "label")
    every = labels.select("t", "label").union(ends).distinct()
    return every.join(over, "label", "left").select("t", F.coalesce("low", "label").alias("label"))


def similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR
) -> DataFrame:
    """doc_id, name, component: name stands for the words of a row; texts are linked at the threshold of similarity.

    Candidates are the texts with close fingerprints (``close_pairs``). What those miss is found exactly: texts that
    share one of BANDS bands may be similar, and at a similarity of 0.8 a pair shares none with a probability of
    (1 - 0.8^3)^32 = 1e-10. A band whose texts fingerprints have connected needs no more pairs, so that a large group
    of near copies gives a few pairs for each text. The texts of all other bands are joined through their rarest
    shingles: those that list one meet a hub first, and what is then still apart is joined exactly (``_prefixes``,
    ``_hub_pairs``, ``_candidates``).
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(small_batches(named).select("doc_id", _banded("text").alias("f")).select("doc_id", "f.*"))
    # Equal texts are one, under a number; the row with the smallest id gives its words.
    once = found.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    once = cut(once.withColumn("t", F.monotonically_increasing_id()))
    close = close_pairs(once.select("t", "fp"))
    keyed = once.select("t", F.explode("bands").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a < z").select("k")
    members = cut(keyed.join(shared, "k"))
    needed = members.select("t").union(close.select("a")).union(close.select("b")).distinct()
    met = cut(once.select("doc_id", "name", "t").join(needed, "t"))
    maybe, _ = _by_marks(named, "doc_id", met.select("doc_id"))
    rows = small_batches(maybe).withColumn("name", _named("text")).join(met, ["doc_id", "name"])
    plain = rows.groupBy("doc_id", "name").agg(F.first("t").alias("t"), F.first("text").alias("text"))
    sets = cut(small_batches(plain).select("t", _shingled("text").alias("s")))
    near = cut(_similar_pairs(close, sets, threshold))
    labels = components(near).withColumnRenamed("node", "t")
    placed = members.join(labels, "t", "left").select("k", "t", F.coalesce("label", "t").alias("label"))
    mixed = placed.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = cut(placed.join(mixed.select("k"), "k").select("t", "label").distinct())
    theirs = cut(sets.join(apart.select("t"), "t", "left_semi").withColumn("odd", _parities("s")))
    listed = cut(_prefixes(theirs, threshold))
    labels = cut(_merged(labels, cut(_similar_pairs(_hub_pairs(listed, apart), sets, threshold))))
    labelled = theirs.select("t", "odd").join(labels, "t", "left").withColumn("label", F.coalesce("label", "t"))
    more = _similar_pairs(cut(_candidates(listed, labelled, threshold)), sets, threshold)
    whole = _merged(labels, cut(more))
    classes = once.select("name", "t").join(whole, "t", "left").select("name", F.coalesce("label", "t").alias("component"))
    return found.select("doc_id", "name").join(classes, "name")


def representatives(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR
) -> DataFrame:
    """The documents that stay: of each component of similar texts, that with the smallest id; of rows that repeat it, one.

    Rows without an id can't stand for others or be told apart; they stay.
    """
    known = docs.where(F.col(id_col).isNotNull())
    classes = cut(similar(known, id_col=id_col, text_col=text_col, threshold=threshold))
    best = classes.groupBy("component").agg(F.min(F.struct("doc_id", "name")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = cut(best)
    # A row that is alone in its component stays; all others, and all that share an id with those, are looked up.
    crowded = classes.join(best.where("n > 1").select("component"), "component").select("doc_id")
    looked_up, alone = _by_marks(known, id_col, crowded)
    name = unused("name", docs)
    stay = best.select(F.col("best.doc_id").alias(id_col), F.col("best.name").alias(name))
    rows = small_batches(looked_up).withColumn(name, _named(F.col(text_col))).join(stay, [id_col, name], "left_semi")
    kept = rows.dropDuplicates([id_col, name]).select(*docs.columns)
    return kept.unionByName(alone).unionByName(docs.where(F.col(id_col).isNull()))
