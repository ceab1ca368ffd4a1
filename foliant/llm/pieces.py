"""SentencePiece encoding and decoding with a given piece table, as a relational lattice.

Text is split at white space (U+2581 counts as white space, as it stands for it in pieces); a word is encoded with the
mark U+2581 before it. A word is cut into units where no path can go on: between a letter or digit and a sign that
follows it in no piece; the best paths of units are that of the word. The best path of a unit has the highest sum of piece scores; at equal sums, the path whose last piece is the shorter one.
A character that is no piece is given as its UTF-8 bytes.

The lattice works on the distinct units of the corpus: explode the places where a piece can end, join the substrings
that end there with the piece table, group the edges by unit, and fold them in order of their ends with Spark's
``aggregate``: the state holds the best score and path to each character. Pieces that others always beat are left out
of the join beforehand. A unit of more than MAX_UNIT characters isn't cut: its best path is
found where it is looked up, character by character, with the scores to the characters before and a way back from
each, which takes time and memory in proportion to its length.

Units are repeated many times over, so texts aren't joined with units row by row. Each task packs its texts into
blocks of bounded size: a list of distinct units, cut by hash into buckets, and the texts as numbers in that list,
the smaller the more often a unit comes. Blocks are written once, as a table of the shared folder that is bucketed by
block. Its lists are dealt once by bucket: there their distinct units are encoded, and the lists go back to their block
as ids. The block's texts, which aren't shuffled, are then written as ids.

Defined results: a null text or one without words has no ids; decoding gives the words joined by one space; repeated
rows are encoded each; a null id stays null; unknown ids decode to nothing; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import ctypes
import gc
import json
import math
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import let, shared_dir, small_batches

MARK = "▁"
#: Longer units take the path of ``long_path``.
MAX_UNIT = 64
#: Words in a block, and in a row of its texts: they bound the memory of the tasks that pack and unpack it.
BLOCK_WORDS = 1_000_000
ROW_WORDS = 200_000
#: Texts of so many bytes end a block as well.
BLOCK_BYTES = 32_000_000
#: Spark deals to so many tasks, and writes to so many files of a table, at most; there may be more buckets of units.
MAX_TASKS = 100_000
#: A vocabulary has a few tens of thousands of pieces; a larger table than this is not taken.
MAX_PIECES = 1_000_000
#: Pieces of so many characters or more are found by their last ones.
TAIL = 4
BYTE_PENALTY = 10.0
#: Labels of edges from here on are no pieces: the number of bytes of a character is added.
UNKNOWN = 1 << 24


def read_pieces(spark: SparkSession, model_file: str) -> DataFrame:
    """id, piece, score, kind (normal, byte or other) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = []
    for i in range(model.get_piece_size()):
        other = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        kind = "byte" if model.is_byte(i) else "other" if other else "normal"
        rows.append((i, model.id_to_piece(i), float(model.get_score(i)), kind))
    return spark.createDataFrame(rows, "id int, piece string, score double, kind string")


class PieceTable(NamedTuple):
    """What a path needs: id and score by piece, the longest one's length, the id of byte 0, the lowest score."""

    pieces: dict[str, tuple[int, float]]
    longest: int
    byte_zero: int
    low: float


def _piece_table(pieces: DataFrame) -> PieceTable:
    """The normal pieces, collected (the table is checked to have at most MAX_PIECES)."""
    normal = pieces.where("kind = 'normal' and piece <> ''")
    facts = normal.agg(F.count("id").alias("n"), F.max(F.length("piece")).alias("long"), F.min("score").alias("low"))
    facts = facts.first()
    if facts["n"] > MAX_PIECES:
        raise ValueError(f"{facts['n']} pieces; a piece table has at most {MAX_PIECES}")
    zero = pieces.where("kind = 'byte'").agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if zero["low"] is None or zero["high"] - zero["low"] != 255:
        raise ValueError("the piece table needs the 256 byte pieces in order")
    best = normal.groupBy("piece").agg(F.max_by("id", "score").alias("id"), F.max("score").alias("score"))
    known = {r["piece"]: (r["id"], r["score"]) for r in best.collect()}
    return PieceTable(known, facts["long"], zero["low"], facts["low"])


def useful_pieces(table: PieceTable) -> dict[str, int]:
    """The ids of the pieces that can be on a best path of a unit that isn't long.

    All others are beaten: other pieces spell the same at a higher sum, by more than sums of doubles can be off. In a
    path, those can stand in their place, so whoever leaves them out finds the same paths.
    """
    pieces, longest, _, low = table
    highest = max([abs(low) + BYTE_PENALTY, *(abs(score) for _, score in pieces.values())])
    off = 4 * MAX_UNIT * MAX_UNIT * highest * 2.0**-52
    out = {}
    for piece, (label, score) in pieces.items():
        sums = [0.0] + [-math.inf] * len(piece)
        for stop in range(1, len(piece) + 1):
            for start in range(max(0, stop - longest, stop == len(piece)), stop):
                known = pieces.get(piece[start:stop])
                if known:
                    sums[stop] = max(sums[stop], sums[start] + known[1])
        if not sums[-1] > score + off:
            out[piece] = label
    return out


def encode_units(
    units: DataFrame,
    pieces: DataFrame,
    *,
    unit_col: str = "unit",
    keys: tuple[str, ...] = (),
    table: PieceTable | None = None,
) -> DataFrame:
    """The rows of ``units`` (distinct, not empty) with ``ids``: the best path of each through the lattice.

    ``keys``: columns that go with a unit; where units are dealt by them, they aren't dealt anew. ``table``: that of
    ``pieces``, where it is collected already.
    """
    spark, unit, kept = units.sparkSession, F.col(unit_col), [*keys, unit_col]
    table = table or _piece_table(pieces)
    byte_zero, low = table.byte_zero, table.low
    by_id = dict(table.pieces.values())
    scores = F.from_json(F.lit(json.dumps([by_id.get(i) for i in range(max(by_id) + 1)])), "array<double>")
    # A piece is found by its end: a short one as a whole, others by their last TAIL characters, which then tell few apart.
    useful = [(p[-TAIL:], min(len(p), TAIL), p, i) for p, i in useful_pieces(table).items()]
    useful = spark.createDataFrame(useful, "tail string, size int, piece string, id int")

    def edge(size, label):
        """An edge is one number, in order of its end and start: stop, start, and its piece or the bytes of its character."""
        start = (F.col("stop") - size).cast("long")
        return F.shiftleft(F.col("stop").cast("long"), 48).bitwiseOR(F.shiftleft(start, 32)).bitwiseOR(label.cast("long"))

    stops = units.select(*kept, F.explode(F.sequence(F.lit(1), F.length(unit))).alias("stop"))
    found = []
    for size in range(1, TAIL + 1):
        name = f"p{size}"
        ending = useful.where(F.col("size") == size)
        if size < TAIL:
            ending = ending.select(F.col("tail").alias(f"tail{size}"), F.col("id").alias(name))
        else:
            ending = ending.groupBy(F.col("tail").alias(f"tail{size}")).agg(F.collect_list(F.struct("piece", "id")).alias(name))
        tail = F.when(F.col("stop") >= size, F.substring(unit, F.col("stop") - size + 1, F.lit(size)))
        stops = stops.join(F.broadcast(ending), tail == F.col(f"tail{size}"), "left").drop(f"tail{size}")
        if size == 1:
            character = F.octet_length(F.substring(unit, F.col("stop"), F.lit(1))) + UNKNOWN
            found.append(F.array(edge(F.lit(1), F.coalesce(name, character))))
        elif size < TAIL:
            found.append(F.when(F.col(name).isNotNull(), F.array(edge(F.lit(size), F.col(name)))))
        else:
            ends = F.filter(name, lambda p: F.endswith(F.substring(unit, F.lit(1), F.col("stop")), p["piece"]))
            found.append(F.transform(ends, lambda p: edge(F.length(p["piece"]), p["id"])))
    none = F.array().cast("array<bigint>")
    edges = (
        stops.select(*kept, F.concat(*(F.coalesce(x, none) for x in found)).alias("edges"))
        .groupBy(unit_col, *keys)  # where groups are sorted, keys tell few of them apart
        .agg(F.sort_array(F.collect_list("edges")).alias("edges"))  # each begins with its end
    )

    def label_of(e):
        return e.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def start_of(e):
        return F.shiftright(e, 32).bitwiseAND(F.lit((1 << 16) - 1)).cast("int")

    def step(best, ending):
        def reached(e):
            unknown = (low - BYTE_PENALTY) * (label_of(e) - UNKNOWN)
            score = F.get(best, start_of(e))["score"] + F.coalesce(F.get(scores, label_of(e)), unknown)
            return F.struct(score.alias("score"), e.alias("edge"))

        def went(top):
            path = F.array_append(F.get(best, start_of(top["edge"]))["path"], top["edge"])
            return F.struct(top["score"].alias("score"), path.alias("path"))

        # At equal scores the latest start, and so the shortest piece, is the greatest.
        return F.array_append(best, let(F.array_max(F.transform(ending, reached)), went))

    def bytes_at(start):
        code = F.hex(F.encode(F.substring(unit, start + 1, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)),
            lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + byte_zero,
        )

    none = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("path")))
    found = edges.select(
        *kept, F.aggregate("edges", none, step, lambda best: F.element_at(best, -1)["path"]).alias("path")
    )
    spelled = F.flatten(
        F.transform(
            "path", lambda e: F.when(label_of(e) < UNKNOWN, F.array(label_of(e))).otherwise(bytes_at(start_of(e)))
        )
    )
    has_unknown = F.exists("path", lambda e: label_of(e) >= UNKNOWN)
    return found.select(*kept, F.when(has_unknown, spelled).otherwise(F.transform("path", label_of)).alias("ids"))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one text after another, and how many each text has; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.replace_substring(texts, MARK, " "))
    words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real), np.diff(before[ends], prepend=0)


def cut_pattern(pieces: DataFrame) -> str:
    """A pattern of the places, within a word, that are within no piece: before signs, after a letter or digit.

    Of the piece table only its signs and the letters before them are collected.
    """
    normal = pieces.where("kind = 'normal'")
    sign = r"[^\p{L}\p{N}\s" + MARK + "]"
    signs = normal.select(F.explode(F.regexp_extract_all("piece", F.lit(f"({sign})"), F.lit(1))).alias("c")).distinct()
    after = normal.select(F.explode(F.regexp_extract_all("piece", F.lit(rf"([\p{{L}}\p{{N}}]{sign})"), F.lit(1))).alias("two"))
    letters: dict[str, str] = defaultdict(str)
    for row in after.distinct().sort("two").collect():
        letters[row["two"][1]] += row["two"][0]
    free = "".join(sorted(r["c"] for r in signs.collect() if r["c"] not in letters))
    parts = [rf"(?=[{re.escape(free)}])"] if free else []
    parts += [rf"(?<![{re.escape(letters[c])}])(?={re.escape(c)})" for c in sorted(letters)]
    return rf"(?<=[^\W_])(?:{'|'.join(parts)})" if parts else r"(?!)"


def _objects(strings: pa.Array) -> list:
    """Strings as Python's, sooner than to_pylist gives them."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def units_of(words: pa.Array, cuts: re.Pattern) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of distinct words; how many each word has, and which they are, one word after another."""
    plain = pc.ascii_is_alnum(words)  # no sign, so one unit
    marked = pc.binary_join_element_wise(pa.scalar(MARK, words.type), words, pa.scalar("", words.type))
    signed = "\n".join(_objects(marked.filter(pc.invert(plain))))
    lines = cuts.sub(" ", signed).split("\n") if signed else []
    split = pc.split_pattern(pa.array(lines, words.type), " ")
    plain = plain.to_numpy(zero_copy_only=False)
    sizes = np.ones(len(words), np.int64)
    sizes[~plain] = pc.list_value_length(split).to_numpy()
    coded = pa.concat_arrays([marked.filter(pa.array(plain)), split.flatten()]).dictionary_encode()
    numbers, of_plain = coded.indices.to_numpy(), np.repeat(plain, sizes)
    which = np.empty(len(numbers), np.int64)
    which[of_plain], which[~of_plain] = np.split(numbers, [plain.sum()])
    return coded.dictionary, sizes, which


def _squeeze(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(3).compress(planes.tobytes())


def _unsqueeze(packed: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _expanded(
    entries: np.ndarray, begins: np.ndarray, sizes: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The size of each entry, and the values of all: entry i stands for sizes[i] values from begins[i] on."""
    size = sizes[entries]
    ends = np.cumsum(size)
    return size, values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[entries] - ends + size, size)]


def _stops(sizes: np.ndarray, n: list[int]) -> np.ndarray:
    """Where each text ends, of n[i] entries of those sizes."""
    return np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(n)]


PACKED = "block long, bucket int, units string, ids array<string>, n_units array<int>, n_words array<long>, packed binary, rarity binary"
FOUND = "block long, bucket int, counts binary, packed binary"
PACKED_TYPE, FOUND_TYPE, ENCODED_TYPE = (
    pa.schema({"block": pa.int64(), "bucket": pa.int32(), "units": pa.string(), "ids": pa.list_(pa.string()), "n_units": pa.list_(pa.int32()), "n_words": pa.list_(pa.int64()), "packed": pa.binary(), "rarity": pa.binary()}),
    pa.schema({"block": pa.int64(), "bucket": pa.int32(), "counts": pa.binary(), "packed": pa.binary()}),
    pa.schema({"doc_id": pa.string(), "n_words": pa.int64(), "ids": pa.list_(pa.int32())}),
)


def _give_back() -> None:
    """Memory that a task no longer uses goes back to the system, as Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def _pack(n_buckets: int, cuts: str):
    """For each block: rows of its texts (bucket null) and one row for each bucket of its units.

    A row of units is text of one line for the block and one for each unit. Units are listed by bucket; their numbers
    in the texts go by rarity (of which the first row of texts has one for each listed unit), then as listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cuts)
        first, done = TaskContext.get().partitionId() << 24, 0

        def block(ids: list, words: list[pa.Array], n_words: np.ndarray) -> pa.RecordBatch:
            block_id = first + done
            coded = pa.concat_arrays(words).dictionary_encode()
            stream = coded.indices.to_numpy()
            units, size, which = units_of(coded.dictionary, pattern)
            begins = np.cumsum(size) - size
            word_counts = np.bincount(stream, minlength=len(size))
            counts = np.bincount(which, np.repeat(word_counts, size), len(units))
            bucket = np.array([zlib.crc32(u) % n_buckets for u in _objects(units.cast(pa.large_binary()))], np.int64)
            columns = pa.table({"bucket": bucket, "unit": units})
            order = pc.sort_indices(columns, [("bucket", "ascending"), ("unit", "ascending")]).to_numpy()
            rarity = (64 - np.frexp(counts)[1])[order].astype(np.uint8)
            moved = np.empty(len(units), np.uint32)
            moved[order[np.argsort(rarity, kind="stable")]] = np.arange(len(units))
            flat, rows = moved[which], []
            ends = np.cumsum(n_words)
            cuts_at = np.flatnonzero(np.diff(ends // ROW_WORDS)) + 1
            for begin, end in zip([0, *cuts_at], [*cuts_at, len(ids)]):
                texts = stream[ends[begin] - n_words[begin] : ends[end - 1]]
                sizes, tokens = _expanded(texts, begins, size, flat)
                n_units = np.diff(_stops(sizes, n_words[begin:end]), prepend=0)
                rows.append((block_id, None, None, ids[begin:end], n_units, n_words[begin:end], _squeeze(tokens), None))
            rows[0] = (*rows[0][:-1], _squeeze(rarity))
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            listed = _objects(units.take(pa.array(order)))
            for begin, end in zip(starts, [*starts[1:], len(order)]):
                lines = "\n".join([str(block_id), *listed[begin:end]])
                rows.append((block_id, int(bucket[order[begin]]), lines, None, None, None, None, None))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), PACKED_TYPE.types)], schema=PACKED_TYPE)

        ids, words, sizes, held, heavy = [], [], [], 0, 0
        for batch in batches:
            keys = batch.column("id").to_pylist()
            found, n_words = words_of(batch.column("text"))
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            begin, at = 0, 0
            ends, weights = np.cumsum(n_words), np.cumsum(n_bytes, dtype=np.int64)
            while begin < len(keys):
                # A block ends with the text that fills it.
                before = (ends[begin - 1], weights[begin - 1]) if begin else (0, 0)
                full = (ends - before[0] + held >= BLOCK_WORDS) | (weights - before[1] + heavy >= BLOCK_BYTES)
                full[:begin] = False
                end = int(full.argmax()) + 1 if full.any() else len(keys)
                ids += keys[begin:end]
                words.append(found.slice(at, ends[end - 1] - at))
                sizes.append(n_words[begin:end])
                held, heavy, at = held + ends[end - 1] - before[0], heavy + weights[end - 1] - before[1], ends[end - 1]
                if full.any():
                    yield block(ids, words, np.concatenate(sizes))
                    done, ids, words, sizes, held, heavy = done + 1, [], [], [], 0, 0
                begin = end
        if ids:
            yield block(ids, words, np.concatenate(sizes))
        del ids, words, sizes
        _give_back()

    return run


def long_path(unit: str, table: PieceTable) -> np.ndarray:
    """The best path of a unit of any length, by the rules of ``encode_units``."""
    pieces, longest, byte_zero, low = table
    n = len(unit)
    scores, back, labels = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
    for stop in range(1, n + 1):
        for start in range(max(0, stop - longest), stop):
            known = pieces.get(unit[start:stop])
            if known:
                label, score = known
            elif start + 1 == stop:
                label, score = -1, (low - BYTE_PENALTY) * len(unit[start].encode())
            else:
                continue
            if scores[start] + score >= scores[stop]:
                scores[stop], back[stop], labels[stop] = scores[start] + score, start, label
    path, at = [], n
    while at:
        spelled = [b + byte_zero for b in unit[back[at]].encode()] if labels[at] < 0 else [labels[at]]
        path += spelled[::-1]
        at = back[at]
    return np.array(path[::-1], np.int32)


def _values(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _look_up(table):
    """The ids of the units of each block's list of a bucket, with how many each unit has."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        units, ids = _values(known["unit"]).cast(pa.large_string()), _values(known["ids"])
        sizes, flat = pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()
        lists = [x.as_py().partition("\n") for x in rows["units"]]
        listed = pc.split_pattern(pa.array([x for _, _, x in lists], pa.large_string()), "\n")
        n_units, wanted = pc.list_value_length(listed).to_numpy(), listed.flatten()
        which = pc.index_in(wanted, units)
        if which.null_count:
            long = pc.unique(wanted.filter(which.is_null()))
            paths = [long_path(u, table.value) for u in long.to_pylist()]
            units = pa.concat_arrays([units, long])
            sizes = np.concatenate((sizes, [len(x) for x in paths]))
            flat = np.concatenate((flat, *paths))
            which = pc.index_in(wanted, units)
        begins, which, out = np.cumsum(sizes) - sizes, which.to_numpy(), []
        for (block, _, _), bucket, mine in zip(lists, rows["bucket"], np.split(which, np.cumsum(n_units)[:-1])):
            counts, found = _expanded(mine, begins, sizes, flat)
            out.append((int(block), bucket.as_py(), _squeeze(counts.astype(np.uint32)), _squeeze(found.astype(np.uint32))))
        columns = [pa.array(x, t) for x, t in zip(zip(*out), FOUND_TYPE.types)]
        return pa.table(columns, schema=FOUND_TYPE) if out else FOUND_TYPE.empty_table()

    return run


def _unpack(texts: pa.Table, parts: pa.Table) -> pa.Table:
    """The texts of one block as ids."""
    parts = parts.sort_by("bucket")
    sizes = np.concatenate([np.zeros(0, np.uint32), *[_unsqueeze(x.as_py(), np.uint32) for x in parts["counts"]]]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *[_unsqueeze(x.as_py(), np.uint32) for x in parts["packed"]]]).view(np.int32)
    rarity = texts["rarity"].drop_null().to_pylist()
    as_listed = np.argsort(_unsqueeze(rarity[0], np.uint8), kind="stable") if rarity else np.zeros(0, np.int64)
    begins = (np.cumsum(sizes) - sizes)[as_listed]
    sizes = sizes[as_listed]
    _give_back()
    out = []
    for row in texts.select(["ids", "n_units", "n_words", "packed"]).to_pylist():
        size, flat = _expanded(_unsqueeze(row["packed"], np.uint32), begins, sizes, ids)
        stops = np.concatenate(([0], _stops(size, row["n_units"]))).astype(np.int32)
        columns = [pa.array(row["ids"], pa.string()), pa.array(row["n_words"], pa.int64())]
        out.append(pa.table([*columns, pa.ListArray.from_arrays(stops, flat)], schema=ENCODED_TYPE))
    return pa.concat_tables(out) if out else ENCODED_TYPE.empty_table()


def encode(
    docs: DataFrame,
    pieces: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_bucket: int = 500,
) -> DataFrame:
    """One row per document: doc_id, n_words, ids. The number of buckets follows that of documents.

    The blocks stay in the shared folder as a table of the session's catalog, whose name begins with foliant_blocks.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n_buckets = max(8, docs.count() // docs_per_bucket)
    n_tasks = min(n_buckets, MAX_TASKS)
    name = f"foliant_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(_pack(n_buckets, cut_pattern(pieces)), PACKED)
    packed = packed.withColumn("kind", F.when(F.col("bucket").isNull(), "texts").otherwise("units"))
    write = packed.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
    write.partitionBy("kind").bucketBy(n_tasks, "block").saveAsTable(name)
    blocks = spark.table(name)
    # Both readers of the lists use the same two columns, so that Spark deals them once.
    lists = blocks.where("kind = 'units'").select("bucket", "units").repartition(n_tasks, "bucket")
    listed = F.substr("units", F.instr("units", "\n") + 1)
    units = lists.select("bucket", F.explode(F.split(listed, "\n")).alias("unit"))
    units = units.where(F.length("unit") <= MAX_UNIT).dropDuplicates(["bucket", "unit"])
    piece_table = _piece_table(pieces)
    known = encode_units(units, pieces, keys=("bucket",), table=piece_table)
    sent = spark.sparkContext.broadcast(piece_table)
    found = (
        lists.groupBy("bucket")
        .cogroup(known.withColumnRenamed("bucket", "of").groupBy("of"))
        .applyInArrow(_look_up(sent), FOUND)
    )
    texts = blocks.where("kind = 'texts'").select("block", "ids", "n_units", "n_words", "packed", "rarity")
    encoded = (
        texts.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_unpack, "doc_id string, n_words long, ids array<int>")
    )
    return encoded.withColumn("doc_id", F.col("doc_id").cast(id_type))


def piece_bytes(pieces: DataFrame) -> dict[int, bytes]:
    """What each id stands for (of a checked table: a few MB)."""
    return {
        r["id"]: bytes([int(r["piece"][3:5], 16)]) if r["kind"] == "byte" else r["piece"].encode()
        for r in pieces.where("kind <> 'other'").collect()
    }


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_words, ids) with ``text``; bytes that are no UTF-8 become U+FFFD."""
    stands_for = piece_bytes(pieces)
    # A byte is a character of its own until all are joined, as a character may be spelled by several pieces.
    spelled = [stands_for.get(i, b"").decode("latin-1") for i in range(max(stands_for) + 1)]
    table = F.from_json(F.lit(json.dumps(spelled)), "array<string>")
    joined = F.array_join(F.transform("ids", lambda i: F.get(table, i)), "")
    text = F.replace(F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string")), F.lit(MARK), F.lit(" "))
    return encoded.select("doc_id", "n_words", "ids", F.regexp_replace(text, "^ ", "").alias("text"))
