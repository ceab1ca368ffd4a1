"""Alignment of two tokenizers' tokens over the same text, and how tokens of one correspond to tokens of the other.

A is a byte-level BPE vocabulary, B a SentencePiece model. Both encode a space and the text, so that both cut the same
bytes into tokens. For each batch, two tables of tokens (document, where a token starts, where it ends) are joined with
pandas' merge_asof by document: each token start of A finds the token of B that covers it, and the other way round. The
union of both directions is all pairs of tokens that overlap. Where two that overlap have equal ends, a group ends: the
groups are the smallest passages that both sides cut alike. All A tokens of a group are linked with all its B tokens.

An id pair's count is the number of documents that hold it linked. Tasks pack documents into blocks of bounded size: the
distinct id pairs of the block with the number of its documents that hold each, and the documents as numbers in that
list. Spark adds the numbers up by pair, takes the highest of each A id (no more rows than its vocabulary has), and
gives each block the counts of its own pairs back. So a pair travels once for a block, not once for a document, and no
task holds all documents of a frequent pair.

Within a group, repeated ids are counted before they are paired, if it has more than WIDE links: a group of many tokens
gives a pair for each two different ids.

Defined results: a null or empty text has no tokens, nor has one that B doesn't spell as it is (U+2581 stands for a
space in B's pieces); the strings of special tokens are plain text; repeated rows are documents each; a null id stays
null; a text of any length is one document; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, small_batches
from foliant.llm.pieces import MARK, _squeeze, _unsqueeze

#: Bytes of texts that are aligned together, and different links of documents in a block: they bound a task's memory.
CHUNK = 1 << 20
BLOCK_LINKS = 2_000_000
WIDE = 4096
#: Ids take so many bits in a pair's number; larger vocabularies aren't taken.
ID_BITS = 20
#: Words that a task remembers the pieces of, up to this length.
CACHE_WORDS, CACHE_LENGTH = 200_000, 40
#: Vocabulary files are sent to tasks; they are at most so large.
MAX_FILE = 1 << 26

#: What byte-level BPE vocabularies of this kind split text by before they merge (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile(r" +[^ ]*")


def _file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} has over {MAX_FILE} bytes")
    return data


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokens:
    """Ids by a byte-level BPE vocabulary file (JSON), and how many bytes each id stands for."""

    def __init__(self, data: bytes):
        import tiktoken

        file, byte_of = json.loads(data), byte_of_letter()
        model, split = file["model"], file.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or file.get("normalizer"):
            raise ValueError("not a plain byte-level vocabulary")
        self.spelled = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(model["vocab"][a + b] != 256 + n for n, (a, b) in enumerate(pairs)):
            raise ValueError("ids must be in the order of merges")
        ranks = {token: i for i, token in self.spelled.items()}
        self._encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = _sizes(self.spelled)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(" " + text)


class PieceTokens:
    """Ids by a SentencePiece model file, which puts a space before a text itself.

    No piece goes on into the space after a word (this is checked), so words are encoded each by itself, with the spaces
    before them, and known ones are looked up.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece goes on after a space")
        self.spelled = {
            i: bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(MARK, " ").encode()
            for i, name in enumerate(names)
            if not (model.is_control(i) or model.is_unknown(i))
        }
        self.sizes = _sizes(self.spelled)
        self.spelled |= {i: b"" for i in range(len(names)) if i not in self.spelled}
        self._known = {"": [model.piece_to_id(MARK)]}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; none where they don't spell a space and the text."""
        split = [
            t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " else [u[1:] for u in UNIT.findall(" " + t)]
            for t in texts
        ]
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = [self._model.piece_to_id(MARK)]
        new = [w for w in {*chain.from_iterable(split)} if w not in known]
        known.update(zip(new, self._model.encode(new, num_threads=1)))
        out = []
        for text, words in zip(texts, split):
            ids = [*chain.from_iterable(map(known.__getitem__, words))]
            spelled = b"".join(map(self.spelled.__getitem__, ids))
            out.append(ids if spelled == b" " + text.encode("utf-8", "replace") else [])
        for w in new:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return out


def _sizes(spelled: dict[int, bytes]) -> np.ndarray:
    if max(spelled) >> ID_BITS:
        raise ValueError(f"ids of {ID_BITS} bits at most")
    sizes = np.zeros(max(spelled) + 1, np.int64)
    sizes[[*spelled]] = [*map(len, spelled.values())]
    return sizes


@dataclass
class Aligned:
    """The tokens of some documents, one after another: ids and the group of each; and the pairs of tokens that overlap.

    Groups are numbered through all documents, in order; ``ends_a`` and ``ends_b`` are where each document's tokens end.
    """

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray

    @property
    def documents(self) -> range:
        return range(len(self.ends_a))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many A and B tokens each group has, and where the groups of each document end."""
        n = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        last = np.concatenate(([-1], self.group_a))[self.ends_a]
        return np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n), np.maximum.accumulate(last + 1)


def align(a: list[list[int]], b: list[list[int]], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Documents' ids by both tokenizers, which spell the same bytes of each."""
    sides = []
    for ids, sizes in ((a, sizes_a), (b, sizes_b)):
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
        stops = np.cumsum(sizes[flat])
        tokens = pd.DataFrame({"at": stops - sizes[flat], "doc": np.repeat(np.arange(len(ids)), counts)})
        sides.append((flat, np.cumsum(counts), tokens, stops))
    (flat_a, ends_a, left, stops_a), (flat_b, ends_b, right, stops_b) = sides
    at_a, at_b, index_a, index_b = left["at"].to_numpy(), right["at"].to_numpy(), np.arange(len(left)), np.arange(len(right))
    # Places go on from document to document, so that both tables are in order of them.
    covers_a = pd.merge_asof(left, right.assign(n=index_b), on="at", by="doc")["n"].to_numpy(np.int64)
    covers_b = pd.merge_asof(right, left.assign(n=index_a), on="at", by="doc")["n"].to_numpy(np.int64)
    later = at_a[covers_b] < at_b  # equal starts are found from A already
    over_a, over_b = np.concatenate((index_a, covers_b[later])), np.concatenate((covers_a, index_b[later]))
    ends = np.sort(stops_a[over_a[stops_a[over_a] == stops_b[over_b]]])
    group_a, group_b = (np.searchsorted(ends, at, "right") for at in (at_a, at_b))
    return Aligned(flat_a, flat_b, ends_a, ends_b, group_a, group_b, over_a, over_b)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << ID_BITS) | b


def links(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, pair, times: how many links of each document are of an id pair; documents and pairs in order."""
    n_a, n_b, ends = found.groups()
    doc_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))  # of each group
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    narrow = np.flatnonzero(~wide[found.group_a])
    group = found.group_a[narrow]
    other = found.b[_ranges(first_b[group], n_b[group])]
    docs = [np.repeat(doc_of[group], n_b[group])]
    pairs, times = [pair_number(np.repeat(found.a[narrow], n_b[group]), other)], [np.ones(len(other), np.int64)]
    for g in np.flatnonzero(wide):
        ids_a, times_a = np.unique(found.a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(found.b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs.append(pair_number(ids_a[:, None], ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
        docs.append(np.full(len(pairs[-1]), doc_of[g]))
    docs, pairs, times = map(np.concatenate, (docs, pairs, times))
    order = np.lexsort((pairs, docs)) if len(docs) and docs.max() >> (62 - 2 * ID_BITS) else np.argsort((docs << (2 * ID_BITS)) | pairs)
    docs, pairs = docs[order], pairs[order]
    firsts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])))) if len(docs) else np.zeros(0, np.int64)
    return docs[firsts], pairs[firsts], np.add.reduceat(times[order], firsts) if len(firsts) else times


class GroupText:
    """Groups as text: A ids and B ids of each, ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, most: int):
        self._strings = np.array([f"{i}{sign}" for i in range(most + 1) for sign in ",|;"], object)

    def of(self, found: Aligned) -> list[str]:
        n_a, n_b, _ = found.groups()
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        out = np.empty(len(found.a) + len(found.b), np.int64)
        index_a, index_b = np.arange(len(found.a)), np.arange(len(found.b))
        last_a, last_b = index_a + 1 == end_a[found.group_a], index_b + 1 == end_b[found.group_b]
        out[index_a + (end_b - n_b)[found.group_a]] = 3 * found.a + last_a
        out[index_b + end_a[found.group_b]] = 3 * found.b + 2 * last_b
        strings, ends = self._strings[out].tolist(), (found.ends_a + found.ends_b).tolist()
        return ["".join(strings[begin:end])[:-1] for begin, end in zip([0, *ends], ends)]


class _Tokenizers:
    """Both tokenizers, made once in a process from the bytes of their files."""

    made: tuple | None = None

    @classmethod
    def of(cls, files: tuple[bytes, bytes]) -> tuple[ByteTokens, PieceTokens, GroupText]:
        key = tuple(sha256(f).digest() for f in files)
        if cls.made is None or cls.made[0] != key:
            a, b = ByteTokens(files[0]), PieceTokens(files[1])
            cls.made = key, (a, b, GroupText(max(len(a.sizes), len(b.sizes))))
        return cls.made[1]


def aligned_chunks(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> Iterator[tuple[range, Aligned]]:
    """Texts in chunks of about CHUNK bytes: their places, and what is aligned of them."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK or i + 1 == len(texts):
            given = [t or "" for t in texts[begin : i + 1]]
            of_b = [ids if t else [] for t, ids in zip(given, b.encode_all(given))]
            of_a = [a.encode(t) if ids else [] for t, ids in zip(given, of_b)]
            yield range(begin, i + 1), align(of_a, of_b, a.sizes, b.sizes)
            begin, size = i + 1, 0


ALIGNMENT = "doc_id string, a array<int>, b array<int>, group_a array<int>, group_b array<int>, overlaps array<struct<a:int,b:int>>"


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))


def alignments(
    docs: DataFrame, *, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its ids by both (a, b), the group of each, and the places of all A and B that overlap."""
    sent = docs.sparkSession.sparkContext.broadcast((_file_bytes(byte_file), _file_bytes(piece_file)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, _ = _Tokenizers.of(sent.value)
        for batch in batches:
            keys = batch["doc_id"].tolist()
            for places, found in aligned_chunks(batch["text"].tolist(), a, b):
                rows = []
                order = np.lexsort((found.over_b, found.over_a))
                over_a, over_b = found.over_a[order], found.over_b[order]
                for i, key in zip(found.documents, keys[places.start : places.stop]):
                    of_a = slice(found.ends_a[i - 1] if i else 0, found.ends_a[i])
                    of_b = slice(found.ends_b[i - 1] if i else 0, found.ends_b[i])
                    met = slice(*np.searchsorted(over_a, (of_a.start, of_a.stop)))
                    pairs = zip((over_a[met] - of_a.start).tolist(), (over_b[met] - of_b.start).tolist())
                    first = found.group_a[of_a][:1].sum()
                    lists = found.a[of_a], found.b[of_b], found.group_a[of_a] - first, found.group_b[of_b] - first
                    rows.append((key, *lists, [{"a": x, "b": y} for x, y in pairs]))
                yield pd.DataFrame(rows, columns=["doc_id", "a", "b", "group_a", "group_b", "overlaps"])

    found = _text_rows(docs, id_col, text_col).mapInPandas(run, ALIGNMENT)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


BLOCK = (
    "block long, pairs array<long>, n_docs array<int>, ids array<string>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<int>, which binary, times binary"
)
FACTS = ("ids", "n_a", "n_b", "n_groups", "n_links", "groups")


def _pack(sent):
    """For each block its distinct pairs with the number of its documents that hold each; and its documents' facts,
    with their pairs as places in that list and how often each is linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, text_of = _Tokenizers.of(sent.value)
        block_id = TaskContext.get().partitionId() << 24
        facts, parts, held = {name: [] for name in FACTS}, [], 0

        def block() -> pd.DataFrame:
            n_pairs, pairs, times = (np.concatenate(x) for x in zip(*parts))
            known, which, n_docs = np.unique(pairs, return_inverse=True, return_counts=True)
            row = {"block": block_id, "pairs": known, "n_docs": n_docs} | facts
            packed = {"n_pairs": n_pairs, "which": _squeeze(which.astype(np.uint32)), "times": _squeeze(times)}
            return pd.DataFrame({k: [v] for k, v in (row | packed).items()})

        for batch in batches:
            facts["ids"] += batch["doc_id"].tolist()
            for _, found in aligned_chunks(batch["text"].tolist(), a, b):
                n_a, n_b, ends = found.groups()
                all_links = np.concatenate(([0], np.cumsum(n_a * n_b)))[ends]
                counts = (found.ends_a, found.ends_b, ends, all_links)
                for name, values in zip(FACTS[1:], counts):
                    facts[name] += np.diff(values, prepend=0).tolist()
                facts["groups"] += [sha256(t.encode()).hexdigest() if t else "" for t in text_of.of(found)]
                docs, pairs, times = links(found)
                parts.append((np.bincount(docs, minlength=len(ends)), pairs, times))
                held += len(pairs)
                if held >= BLOCK_LINKS and len(facts["groups"]) == len(facts["ids"]):
                    yield block()
                    block_id, facts, parts, held = block_id + 1, {name: [] for name in FACTS}, [], 0
        if facts["ids"]:
            yield block()

    return run


def _unpack(_, blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, with what is known of all documents of their pairs."""
    out = [pd.DataFrame({name: [] for name in DIGEST_COLUMNS})]
    n, best = np.zeros((2, len(counts)), np.int64)
    n[counts["place"]], best[counts["place"]] = counts["n"], counts["best"]
    for row in blocks.itertuples(index=False):
        which, times = _unsqueeze(row.which, np.uint32), _unsqueeze(row.times, np.int64)
        ends = np.concatenate(([0], np.cumsum(row.n_pairs)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (times * best[which], times * n[which])]
        facts = [list(getattr(row, name)) for name in FACTS]
        columns = [*facts[:5], *sums, facts[5]]
        out.append(pd.DataFrame(dict(zip(DIGEST_COLUMNS, columns))))
    return pd.concat(out[1:] or out)


DIGEST_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n, best: the number of documents that hold a pair linked, and whether it is the highest of its A id."""
    listed = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
    counts = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.n_docs").cast("long")).alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each A id, 2^ID_BITS at most
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_digests(
    docs: DataFrame, *, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id; n_a, n_b, n_groups, n_links; n_best (links whose pair has the highest count of its
    A id); count_sum (of the counts of all links' pairs); groups_sha256 (of the groups as text, '' without tokens)."""
    sent = docs.sparkSession.sparkContext.broadcast((_file_bytes(byte_file), _file_bytes(piece_file)))
    blocks = cut(_text_rows(docs, id_col, text_col).mapInPandas(_pack(sent), BLOCK))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    counts = asked.join(pair_counts(blocks), "pair").select("block", "place", "n", "best")
    facts = blocks.select(F.col("block").alias("of"), *FACTS, "n_pairs", "which", "times")
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = facts.groupBy("of").cogroup(counts.groupBy("block")).applyInPandas(_unpack, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
