"""Personal data: four kinds found by their form, and unseen identifiers found by the contexts of those.

By form (leftmost matches of each kind, that don't overlap): e-mail addresses, IPv4 addresses, card numbers with a
valid check digit, international phone numbers.

By context, as bootstrapping: what the forms find are seeds. A lexical pattern is the word before an identifier, of
whatever length, or the two words before it. Patterns and the identifiers that they extract (seeds, and other words with a digit) form a
graph with the number of their meetings. In turns, a pattern scores the share of its occurrences in the whole corpus
that extract identifiers, each weighted by its score; an identifier that is no seed scores 1 - product(1 - score of
its patterns). Identifiers that no form finds, in a pattern with at least MIN_SEEDS different seeds and a score of
ACCEPT or more, are added under the kind of most of the pattern's seeds.

Only patterns with enough seeds are counted over the corpus; their hashes mark a bitmap of fixed size, through which
each task counts its words, and exact sums by pattern follow. Patterns that can't reach ACCEPT even if all that they
extract were identifiers leave the graph before the turns.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows get
equal spans; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut, small_batches
from foliant.llm.substrings import BASES, WHITE, _byte_values, _chunks, _mix, _runs

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5
ACCEPT = 0.8
TURNS = 3
SHORTEST = 6
BROADCAST_ROWS = 1_000_000
#: Marks for pattern hashes: at most so many are collected and sent to tasks.
MARK_BITS = 20

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin only where a run of digits does, so that a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Tokens end at ASCII white space and after each = or : sign.
BREAK = re.compile(r"[\x20\x09-\x0D=:]")
#: Signs between a context and its identifier.
OPENING = frozenset("\"'([{<")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it, from the end of the last match on, and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        back = 0
        while at - back > done and text[at - back - 1] in LOCAL:
            back += 1
        domain = DOMAIN.match(text, at + 1) if back else None
        if domain:
            done = domain.end()
            yield at - back, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start and kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), 3))
    return sorted(found)


def other_identifiers(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit, without the signs around them, that touch no known span."""
    found, done = [], 0
    starts = [a for a, _, _ in known]
    reach = list(accumulate((b for _, b, _ in known), max))  # where the spans up to this one end
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not BREAK.match(text, start - 1):
            start -= 1
        stop = BREAK.search(text, m.end())
        done = stop.start() if stop else len(text)
        a, b = start, done
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        before = bisect_left(starts, b)
        if b - a >= SHORTEST and not (before and reach[before - 1] > a):
            found.append((a, b))
    return found


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of all bytes, in lower case (A-Z); where tokens start and stop; where the texts end. A text begins at 1."""
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    white = WHITE[buffer]
    ends = (buffer == 61) | (buffer == 58)
    starts = np.flatnonzero(~white[1:] & (white[:-1] | ends[:-1])) + 1
    stops = np.flatnonzero(~white[:-1] & (white[1:] | ends[:-1])) + 1
    lower = buffer + np.where((buffer >= 65) & (buffer <= 90), 32, 0).astype(np.uint8)
    return _byte_values(BASES[0][0])[lower], starts, stops, np.cumsum([len(t) + 1 for t in texts])


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the index of the text of each."""
    values, starts, stops, bounds = _tokens(texts)
    return _runs(values, starts, stops, BASES[0][1]), np.searchsorted(bounds, starts - 1, "right")


def _both(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + last)


def pattern_hashes(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token as the word before: the pattern of it, that of it and its predecessor, whether it has one."""
    one = _mix(hashes)
    two = np.zeros_like(one)
    two[1:] = _both(hashes[:-1], hashes[1:])
    has = np.zeros(len(one), bool)
    has[1:] = text[1:] == text[:-1]
    return one, two, has


def _fields(*names: str, **kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names] + [T.StructField(n, k) for n, k in kinds.items()]


SPAN = T.StructType(_fields("start", "stop", "kind"))
MET = T.StructType(_fields("start", "stop", "kind", value=T.StringType(), patterns=T.ArrayType(T.LongType())))
SCAN = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("met", T.ArrayType(MET))])


@F.pandas_udf(SCAN)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Base spans; and all identifiers (kind -1: found by no form) with their patterns."""
    for texts in batches:
        base, met = [], []
        for text in texts:
            text = text or ""
            spans = base_spans(text)
            base.append([dict(zip(("start", "stop", "kind"), s)) for s in spans])
            rows, ends = [], []
            for a, b, kind in [*spans, *[(a, b, -1) for a, b in other_identifiers(text, spans)]]:
                rows.append({"start": a, "stop": b, "kind": kind, "value": text[a:b]})
                while a and text[a - 1] in OPENING:
                    a -= 1
                ends.append(a)
            for row, patterns in zip(rows, _patterns_before(text, ends)):
                row["patterns"] = patterns
            met.append(rows)
        yield pd.DataFrame({"base": base, "met": met})


def _patterns_before(text: str, ends: list[int]) -> list[np.ndarray]:
    """The patterns of the last tokens before each place of a text; a token that goes on after it counts up to it."""
    if not ends:
        return []
    data, at = text.encode("utf-8", "replace"), np.array(ends)
    if len(data) > len(text):  # from characters to bytes
        at = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))[at]
    at = at + 1
    values, starts, stops, _ = _tokens([data])
    last = np.searchsorted(starts, at) - 1
    has_one, has_two = last >= 0, last >= 1
    if not len(starts):
        return [np.zeros(0, np.int64)] * len(ends)
    last, first = np.maximum(last, 0), np.maximum(last - 1, 0)
    one = _runs(values, starts[last], np.minimum(stops[last], at), BASES[0][1])
    before = _runs(values, starts[first], stops[first], BASES[0][1])
    both = np.stack((_mix(one), _both(before, one)), axis=1).view(np.int64)
    return [both[i, : int(has_one[i]) + int(has_two[i])] for i in range(len(ends))]


def _count_patterns(marks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.zeros(1 << MARK_BITS, bool)
        bitmap[marks.value] = True
        mask = np.uint64((1 << MARK_BITS) - 1)
        for _, texts in _chunks(batches):
            one, two, has = pattern_hashes(*token_hashes(texts))
            both = np.concatenate((one, two[has]))
            values, counts = np.unique(both[bitmap[(both & mask).astype(np.int64)]], return_counts=True)
            if len(values):
                yield pd.DataFrame({"pattern": values.view(np.int64), "n": counts})

    return run


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, base, met: what each text holds by form, and identifiers with their patterns."""
    return small_batches(docs).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), _scan(F.col(text_col)).alias("found")
    ).select("doc_id", "text_hash", "found.base", "found.met")


def score_patterns(docs: DataFrame, met: DataFrame, *, text_col: str = "text", turns: int = TURNS) -> DataFrame:
    """pattern, kind, score of the patterns that are accepted. ``met``: value, kind, pattern."""
    edges = cut(
        met.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    )
    seeds = edges.where("kind >= 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"))
    seeds = cut(seeds.where(F.col("seeds") >= MIN_SEEDS).select("pattern"))
    mark = F.pmod(F.col("pattern"), F.lit(1 << MARK_BITS)).alias("mark")
    marks = [r["mark"] for r in seeds.select(mark).distinct().collect()]  # 2^MARK_BITS at most
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(marks), np.int64))
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    total = texts.mapInPandas(_count_patterns(sent), "pattern long, n long").groupBy("pattern")
    total = total.agg(F.sum("n").alias("total")).join(seeds, "pattern", "left_semi")
    most = edges.groupBy("pattern").agg(F.sum("n").alias("most"))
    able = total.join(most, "pattern").where(F.col("most") >= ACCEPT * (F.col("total") + 2))
    graph = cut(edges.join(able.select("pattern", "total"), "pattern"))
    scores = graph.select("value", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0).alias("score")).distinct()
    for turn in range(turns):
        of_pattern = graph.join(scores, "value").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.max("total") + 2)).alias("score")
        )
        of_pattern = cut(of_pattern)
        if turn + 1 < turns:
            missed = F.exp(F.sum(F.ln(1 - F.least(F.col("score"), F.lit(1 - 1e-9)))))
            scores = cut(
                graph.join(of_pattern, "pattern")
                .groupBy("value")
                .agg(F.when(F.max("kind") >= 0, F.lit(1.0)).otherwise(1 - missed).alias("score"))
            )
    kinds = (
        graph.where("kind >= 0")
        .groupBy("pattern", "kind")
        .agg(F.sum("n").alias("n"))
        .groupBy("pattern")
        .agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
    )
    return of_pattern.where(F.col("score") >= ACCEPT).join(kinds, "pattern")


def added_spans(docs: DataFrame, found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, added: the identifiers that only their contexts show. ``found`` is what ``scan`` returns."""
    met = found.select("doc_id", "text_hash", F.explode("met").alias("m")).select(
        "doc_id", "text_hash", "m.start", "m.stop", "m.kind", "m.value", F.explode("m.patterns").alias("pattern")
    )
    accepted = score_patterns(docs, met.select("value", "kind", "pattern"), text_col=text_col)
    accepted = accepted.select("pattern", "score", F.col("kind").alias("as_kind"))
    return (
        met.where("kind < 0")
        .join(accepted, "pattern")
        .groupBy("doc_id", "text_hash", "start", "stop")
        .agg(F.max_by("as_kind", F.struct("score", -F.col("as_kind"))).alias("kind"))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind"))).alias("added"))
    )


def _with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    added = cut(added.withColumnsRenamed({"doc_id": "a_doc", "text_hash": "a_hash"}))
    n_spans = added.agg(F.sum(F.size("added"))).first()[0] or 0
    small = F.broadcast(added) if n_spans <= BROADCAST_ROWS else added
    same = F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("text_hash") == F.col("a_hash"))
    return rows.join(small, same, "left").drop("a_doc", "a_hash")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans found by form), spans (these and those found by context)."""
    found = cut(scan(docs, id_col=id_col, text_col=text_col))
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,stop:int,kind:int>>")))
    return _with_added(found, added_spans(docs, found, text_col=text_col)).select(
        "doc_id", "base", every.alias("spans")
    )


@F.pandas_udf(T.StringType())
def _redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, added in batches:
        out = []
        for text, more in zip(texts, added):
            if text is None:
                out.append(None)
                continue
            spans = base_spans(text) + [(s["start"], s["stop"], s["kind"]) for s in (more if more is not None else [])]
            parts, done = [], 0
            for a, b, kind in sorted(spans):
                if a >= done:
                    parts += [text[done:a], f"[{KINDS[kind].upper()}]"]
                done = max(done, b)
            out.append("".join([*parts, text[done:]]))
        yield pd.Series(out)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with [EMAIL], [IP], [CARD] or [PHONE] in place of each span."""
    found = cut(scan(docs, id_col=id_col, text_col=text_col))
    added = added_spans(docs, found, text_col=text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    changed = _with_added(rows, added).withColumn("new", _redact(F.col("row")[text_col], F.col("added")))
    return changed.select(*[F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
