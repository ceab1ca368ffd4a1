"""Removal of repeated passages: words covered by a window of 20 words whose sequence starts earlier in the corpus.

Three passes over the texts, each a Spark job; between them only windows that may repeat are moved.

1. Count-min sketch. A window is counted under its minimiser, the smallest hash among the runs of ``GRAM`` words in
   it, so that the windows around one run of words share one count: two windows of equal words that start at different
   places hold their minimiser at different places, so a count is never below the number of places of any of its
   windows. Each task sketches its texts in parts of bounded size (two rows of counters, only those in use, which
   stop at two); the parts meet by blocks of counters, and the counters that reach two make two bitmaps, which go to all
   tasks. The width follows the bytes of text, up to 2 * 2^MAX_BITS bits (256 MB), so that up to some 30 GB of text
   few windows pass by chance; beyond, more do, never fewer.
2. Windows whose minimiser is estimated repeated in both rows, under a 96-bit hash of their words, which stands for
   the words: two different windows of n are taken for equal with a probability below n^2 / 2^97 (n = 10^12: 10^-5). Within a part of
   bounded size only the first of equal windows goes on and the others are known to be repeats, so that one frequent
   passage gives a window for each part and not for each document; the known repeats of a part go to their documents
   without a bucket. The windows to be compared meet in buckets of their minimiser, packed by part and bucket, and are
   put in order of (hash, document, start): the first starts the passage and all others are repeats. No window is left out. The number of buckets follows that of documents.
3. Each document, its text compressed, meets its repeats as runs of consecutive starts and drops the words that they
   cover.

Defined results: a null or empty text has no words; documents of fewer words than a window lose nothing; rows that
repeat a doc_id with other texts count as one document each, in no defined order among them; rows that repeat it with
the same text are one document, and each gets what that keeps; a null id comes after all others, and rows without an
id are a document each: of equal texts, one keeps what starts nowhere earlier. An empty table gives an empty table;
other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches

WINDOW = 20
GRAM = 8
#: A row of the sketch has at least COUNTERS counters for each minimiser expected, and 2^MAX_BITS at most.
COUNTERS, MIN_BITS, MAX_BITS = 4, 16, 30
#: Bytes of text for each minimiser: some six a word, seven words.
BYTES_OF_MINIMISER = 42
BLOCK_BITS = 16
ROWS = 2
#: Windows in a part: bounds the memory of a task.
PART = 2_000_000
#: Bytes of text that are hashed at a time, if no single text is longer.
CHUNK = 1 << 20
#: Stands for a null id between the steps.
NO_ID = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class _Kept(dict):
    """Tables that a process keeps; they aren't sent with the functions that use them."""

    def __reduce__(self):
        return _Kept, ()


POWERS = _Kept()


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64, and more."""
    if len(POWERS.get(base, ())) <= n:
        steps = np.full(max(CHUNK, 1 << int(n).bit_length()) + 1, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        POWERS[base] = np.multiply.accumulate(steps)
    return POWERS[base]


#: For the two hashes: a seed of the byte values, an odd base for bytes and one for words.
BASES = ((1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (2, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _runs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run values[start:stop], equal for equal runs wherever they stand."""
    powers, inverse = _powers(base, len(values)), _powers(pow(base, -1, 2**64), len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=total[1:])
    return _mix((total[stops] - total[starts]) * inverse[starts])


def word_hashes(texts: list[bytes], which: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and for each text the number of its words."""
    seed, base, _ = BASES[which]
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = WHITE[buffer]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(buffer) and not white[0]:
        edges = np.concatenate(([0], edges))
    starts, stops = edges[0::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    return _runs(_byte_values(seed)[buffer], starts, stops, base), per_text


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """ids and texts of documents, in chunks of about CHUNK bytes."""
    for batch in batches:
        ids, texts, size, begun = batch["doc_id"].to_numpy(), [], 0, 0
        for i, text in enumerate(batch["text"]):
            texts.append(text.encode() if text else b"")
            size += len(texts[-1])
            if size >= CHUNK or i + 1 == len(ids):
                yield ids[begun : i + 1], texts
                texts, size, begun = [], 0, i + 1


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, step = values, 1
    while step < width:
        more = min(step, width - step)
        done = np.minimum(done[: len(done) - more], done[more:])
        step += more
    return done


def _windows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Over all whole windows of all texts: index of the text, start, minimiser; and the words' hashes and offsets."""
    words, counts = word_hashes(texts, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), words, offsets
    at = np.arange(n - GRAM + 1)
    grams = _runs(words, at, at + GRAM, BASES[0][2])
    low = _sliding_min(grams, WINDOW - GRAM + 1)
    doc = np.repeat(np.arange(len(texts)), counts)[: n - WINDOW + 1]
    start = np.arange(n - WINDOW + 1)
    whole = start + WINDOW <= offsets[doc + 1]
    return doc[whole], start[whole], low[whole], words, offsets


def _cells(minimisers: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each minimiser in a row of the sketch."""
    return (minimisers >> np.uint64(bits * row)).astype(np.uint32) & np.uint32((1 << bits) - 1)


def _occurrences(doc: np.ndarray, start: np.ndarray, low: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The minimiser of each place that is one: places are counted once, however many windows they stand for."""
    if not len(start):
        return low
    at = np.arange(len(words) - GRAM + 1)
    grams = _runs(words, at, at + GRAM, BASES[0][2])
    full = np.zeros(len(words) - WINDOW + 1, np.uint64)
    full[start] = low
    span = WINDOW - GRAM + 1
    padded = np.concatenate((np.zeros(span - 1, np.uint64), full, np.zeros(span - 1, np.uint64)))
    highest = ~_sliding_min(~padded, span)  # over the windows that hold the place
    return grams[highest == grams]


def _sketch(width_bits: int):
    block_bits = min(BLOCK_BITS, width_bits)

    def part(values: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        low = np.concatenate(values)
        for row in range(ROWS):
            cells, counts = np.unique(_cells(low, row, width_bits), return_counts=True)
            blocks = (cells >> np.uint32(block_bits)).astype(np.int32)
            first = np.flatnonzero(np.diff(blocks, prepend=-1))
            inside = (cells & np.uint32((1 << block_bits) - 1)).astype(np.uint16)
            twice = np.minimum(counts, 2) == 2
            packed = []
            for a, b in zip(first, [*first[1:], len(cells)]):
                steps = np.diff(inside[a:b], prepend=np.uint16(0))
                packed.append(
                    (steps.view(np.uint8).reshape(-1, 2).T.tobytes(), inside[a:b][twice[a:b]].tobytes())
                )
            yield pd.DataFrame(
                {
                    "row": np.int32(row),
                    "block": blocks[first],
                    "cells": [x for x, _ in packed],
                    "twice": [x for _, x in packed],
                }
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for _, texts in _chunks(batches):
            doc, start, low, words, _ = _windows(texts)
            held.append(_occurrences(doc, start, low, words))
            n += len(held[-1])
            if n >= PART:
                yield from part(held)
                held, n = [], 0
        if n:
            yield from part(held)

    return run


def _merge(width_bits: int):
    """Rows in order of (row, block): counters are added up to two; a bitmap of those that reach it."""
    size = 1 << min(BLOCK_BITS, width_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, counts = None, np.zeros(size, np.uint8)

        def done() -> Iterator[pd.DataFrame]:
            if now is not None and (counts > 1).any():
                yield pd.DataFrame({"row": [now[0]], "block": [now[1]], "bits": [np.packbits(counts > 1).tobytes()]})

        for batch in batches:
            for row, block, cells, twice in batch.itertuples(index=False):
                if now != (row, block):
                    yield from done()
                    now, counts = (row, block), np.zeros(size, np.uint8)
                steps = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(2, -1).T).view(np.uint16)
                at = np.cumsum(steps.ravel(), dtype=np.uint16)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(twice, np.uint16)] = 2
        yield from done()

    return run


def width_for(text_bytes: int) -> int:
    """Bits of the place of a counter, for a corpus of so many bytes of text."""
    return min(MAX_BITS, max(MIN_BITS, (COUNTERS * text_bytes // BYTES_OF_MINIMISER).bit_length()))


def repeated_counters(docs: DataFrame, width_bits: int) -> DataFrame:
    """row, block, bits: the counters that reach two in the sketch of all texts. ``docs``: doc_id, text."""
    parts = docs.mapInPandas(_sketch(width_bits), "row int, block int, cells binary, twice binary")
    ordered = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    return ordered.mapInPandas(_merge(width_bits), "row int, block int, bits binary")


def _pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Windows(NamedTuple):
    """Windows, column by column: hashes, document, what tells its text apart, start."""

    h1: np.ndarray
    h2: np.ndarray
    doc: np.ndarray
    turn: np.ndarray
    start: np.ndarray

    def take(self, at: np.ndarray) -> "Windows":
        return Windows(*[x[at] for x in self])

    def later(self) -> tuple["Windows", "Windows"]:
        """The first of each hash, by document and start, and all others; the first of a repeated row is no other."""
        rows = self.take(np.lexsort((self.start, self.turn, self.doc, self.h2, self.h1)))
        first = np.ones(len(rows.h1), bool)
        first[1:] = (rows.h1[1:] != rows.h1[:-1]) | (rows.h2[1:] != rows.h2[:-1])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        same = (rows.doc == rows.doc[begin]) & (rows.turn == rows.turn[begin]) & (rows.start == rows.start[begin])
        return rows.take(first), rows.take(~same)

    def by_document(self) -> tuple["Windows", np.ndarray]:
        """In order of documents and starts, and where each document begins."""
        rows = self.take(np.lexsort((self.start, self.turn, self.doc)))
        new = (np.diff(rows.doc) != 0) | (np.diff(rows.turn) != 0)
        return rows, np.concatenate(([0], np.flatnonzero(new) + 1)) if len(rows.doc) else np.zeros(0, np.int64)

    def runs(self) -> pd.DataFrame:
        """A row for each run of consecutive starts of a document: its first and its last start."""
        rows, begins = self.by_document()
        new = np.diff(rows.start, prepend=0) > 1
        new[begins] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1 if len(first) else first
        return pd.DataFrame(
            {"doc_id": rows.doc[first], "turn": rows.turn[first], "first": rows.start[first], "last": rows.start[last]}
        )

    def packed(self, bucket: int, known: bool) -> dict:
        """One row; of windows known to be repeats the hashes aren't needed."""
        rows, begins = self.by_document()
        steps = np.diff(rows.start, prepend=0).astype(np.int32)
        steps[begins] = rows.start[begins]
        return {
            "bucket": bucket,
            "docs": rows.doc[begins],
            "turns": rows.turn[begins],
            "sizes": np.diff(np.append(begins, len(rows.doc))).astype(np.int32),
            "starts": _pack(steps),
            "hashes": None if known else rows.h1.tobytes() + rows.h2.tobytes(),
        }

    @staticmethod
    def unpacked(docs, turns, sizes, starts, hashes) -> "Windows":
        steps = _unpack(starts, np.int32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        total = np.cumsum(steps)
        base = np.repeat(total[begins] - steps[begins], sizes)
        n = len(steps)
        h1 = np.frombuffer(hashes, np.uint64, n) if hashes else np.zeros(n, np.uint64)
        h2 = np.frombuffer(hashes, np.uint32, n, 8 * n) if hashes else np.zeros(n, np.uint32)
        return Windows(h1, h2, np.repeat(docs, sizes), np.repeat(turns, sizes), total - base)


PACKED = "bucket int, docs array<long>, turns array<long>, sizes array<int>, starts binary, hashes binary"


def _candidates(bitmaps, width_bits: int, n_buckets: int):
    """Windows to be compared, packed by bucket, and windows known to be repeats: a row of each part, bucket below 0."""
    block_bits = min(BLOCK_BITS, width_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = []
        for row in range(ROWS):
            full = np.zeros(1 << max(width_bits - 3, 0), np.uint8)
            for (r, block), bits in bitmaps.value.items():
                if r == row:
                    found = np.frombuffer(bits, np.uint8)
                    full[block << (block_bits - 3) : (block << (block_bits - 3)) + len(found)] = found
            tables.append(full)

        def repeated(low: np.ndarray) -> np.ndarray:
            hit = np.ones(len(low), bool)
            for row, full in enumerate(tables):
                cell = _cells(low, row, width_bits)
                hit &= (full[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
            return hit

        def part(held: list[tuple[Windows, np.ndarray]]) -> Iterator[pd.DataFrame]:
            rows = Windows(*[np.concatenate(x) for x in zip(*[w for w, _ in held])])
            bucket = np.concatenate([b for _, b in held])
            out, known = [], []
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                first, later = rows.take(at).later()  # equal windows are in one bucket
                out.append(first.packed(int(bucket[at[0]]), False))
                if len(later.doc):
                    known.append(later)
            if known:
                place = zlib.crc32(out[0]["docs"].tobytes() + out[0]["hashes"]) % n_buckets
                out.append(Windows(*[np.concatenate(x) for x in zip(*known)]).packed(-1 - place, True))
            yield pd.DataFrame(out)

        held, n = [], 0
        for ids, texts in _chunks(batches):
            doc, start, low, words, offsets = _windows(texts)
            hit = repeated(low)
            doc, start, low = doc[hit], start[hit], low[hit]
            if len(start):
                h1 = _runs(words, start, start + WINDOW, BASES[0][2])
                h2 = _runs(word_hashes(texts, 1)[0], start, start + WINDOW, BASES[1][2]).astype(np.uint32)
                used = np.bincount(doc, minlength=len(texts))
                turns = np.array([_turn(t) if k else 0 for t, k in zip(texts, used)], np.int64)
                bucket = (low % np.uint64(n_buckets)).astype(np.int32)
                held.append((Windows(h1, h2, ids[doc], turns[doc], start - offsets[doc]), bucket))
                n += len(start)
            if n >= PART:
                yield from part(held)
                held, n = [], 0
        if n:
            yield from part(held)

    return run


def _turn(text: bytes) -> int:
    """Tells apart rows that repeat an id with another text."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of buckets: the repeats of each document as runs of starts. Known repeats go on as they come."""
    now, held = None, []

    def done() -> Iterator[pd.DataFrame]:
        if held:
            yield Windows(*[np.concatenate(x) for x in zip(*held)]).later()[1].runs()

    for batch in batches:
        for bucket, *packed in batch.itertuples(index=False):
            if packed[-1] is None:
                yield Windows.unpacked(*packed).runs()
                continue
            if bucket != now:
                yield from done()
                now, held = bucket, []
            held.append(Windows.unpacked(*packed))
    yield from done()


def repeats(docs: DataFrame, *, width_bits: int | None = None, docs_per_bucket: int = 2000) -> DataFrame:
    """The windows of each document whose words start earlier, as runs of starts: doc_id, turn, firsts, lasts (of the
    runs, in any order). A run ends where its minimiser does at the latest, so their number follows that of the repeated
    words, whatever the number of tasks and buckets. ``docs``: doc_id, text."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    width_bits = width_for(size["bytes"] or 0) if width_bits is None else width_bits
    bitmaps = {(r["row"], r["block"]): bytes(r["bits"]) for r in repeated_counters(docs, width_bits).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)  # two rows of 2^MAX_BITS bits at most
    n_buckets = max(8, size["n"] // docs_per_bucket)
    windows = docs.mapInPandas(_candidates(sent, width_bits, n_buckets), PACKED)
    ordered = windows.repartition("bucket").sortWithinPartitions("bucket")
    later = ordered.mapInPandas(_later, "doc_id long, turn long, first int, last int")
    return later.groupBy("doc_id", "turn").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )


def _drop_covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for packed, firsts, lasts, copy in zip(batch["packed"], batch["firsts"], batch["lasts"], batch["copy"]):
            words = zlib.decompress(packed).split()
            n_words.append(len(words))
            if copy > 1 and len(words) >= WINDOW:
                n_removed.append(len(words))
                kept.append("")
                continue
            if firsts is None or not len(firsts):
                n_removed.append(0)
                kept.append(b" ".join(words).decode())
                continue
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, firsts, 1)
            np.add.at(edges, np.asarray(lasts) + WINDOW, -1)
            stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join([words[i] for i in stay]).decode())
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept_text": kept}
        )


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width_bits: int | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept words joined by one space)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = small_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = repeats(plain, width_bits=width_bits)
    keyed = plain.mapInPandas(_compressed, "doc_id long, turn long, packed binary")
    # Rows without an id are told apart by their number among equal texts; all but the first repeat it.
    unnamed = keyed.where(F.col("doc_id") == NO_ID).groupBy("doc_id", "turn")
    unnamed = unnamed.agg(F.first("packed").alias("packed"), F.count(F.lit(1)).cast("int").alias("n"))
    unnamed = unnamed.select("doc_id", "turn", "packed", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    keyed = keyed.where(F.col("doc_id") != NO_ID).withColumn("copy", F.lit(1)).unionByName(unnamed)
    kept = (
        keyed.join(found, ["doc_id", "turn"], "left")
        .select("doc_id", "packed", "firsts", "lasts", "copy")
        .mapInPandas(_drop_covered, "doc_id long, n_words long, n_removed long, kept_text string")
    )
    return kept.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)).cast(id_type))


def _compressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t.encode() for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "turn": [_turn(t) for t in texts],
                "packed": [zlib.compress(t, 1) for t in texts],
            }
        )
