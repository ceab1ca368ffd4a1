"""A learned toxicity score: subword-bag embeddings, averaged into a linear softmax.

A word is a run of letters and digits in lower case. Its subwords are the word itself and the runs of SIZES characters
of it between two marks, each a bucket by hash. The vector of a word is the mean of its buckets' vectors, and a passage
of SPAN words (the last one of a text ends with it, and may overlap the one before) is the mean of its words' vectors,
on which a linear softmax decides. Vectors and softmax are trained jointly in numpy. A word that was never seen, such as
a misspelling, has the vectors of the character runs that it shares with known ones.

A text is as toxic as its most toxic passage, so that a few words count in a text of any length. Training learns from
that passage: in each turn the passage of a document that is most toxic so far stands for it.

As means and softmax are linear, what a bucket's vector adds to the margin of toxic over not is one number; tasks sum
those numbers over whole arrays of characters.

What is learned from is bounded by ``train_rows`` documents and TRAIN_CHARS of their characters, in the order of a hash
of the id; half of the rows are toxic where there are as many. A fifth of them, which the vectors haven't seen, fits the
slope and the offset of the log-odds, each kind weighed by its share of all labels.

Defined results: a null or empty text, or one without words, has one passage whose words add nothing; without labels of
both kinds every score is the share of toxic labels (0 if there are none); a text of any length is read whole, in
pieces; rows that repeat an id are scored each, and the first of them by text is learned from; labels of an id count
once, as toxic if most of them are; null ids are scored, not learned from; equal texts have equal scores; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, small_batches
from foliant.llm.substrings import BASES, _mix, _runs

BUCKET_BITS = 20
DIMENSIONS = 8
SIZES = (3, 4, 5)
SPAN = 4
TRAIN_ROWS = 6_000
TRAIN_CHARS = 16_000_000
EPOCHS = 30
#: Characters that are looked at together; a longer text is cut between words.
PIECE = 1 << 20
#: Passages of a step.
STEP_ROWS = 256

BETWEEN = re.compile(r"[\W_]")
#: In place of all that is no letter or digit.
MARK = 32


class _Letters:
    """Whether each character is a letter or digit, made once in a process."""

    table: np.ndarray | None = None

    @classmethod
    def known(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        return cls.table


@dataclass
class Words:
    """The words of some texts: all characters, where words start and stop, and the text of each word."""

    codes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        joined = " " + " ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        inside = _Letters.known()[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, stops = edges[0::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return cls(np.where(inside, codes, MARK), starts, stops, np.searchsorted(ends, starts - 1, "right"))

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        values = _mix(self.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return _runs(values, self.starts, self.stops, BASES[0][1])

    def runs(self, size: int) -> np.ndarray:
        """The bucket of the run of that many characters from each place on."""
        n = max(0, len(self.codes) - size + 1)
        mixed = np.full(n, size, np.uint32)
        for i in range(size):
            mixed = (mixed ^ self.codes[i : i + n]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        return mixed >> np.uint32(32 - BUCKET_BITS)

    def counts(self, size: int) -> np.ndarray:
        """How many runs of that many characters each word has, with a mark before and after it."""
        return np.maximum(0, self.stops - self.starts + 3 - size)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_numbers(words: Words, values: np.ndarray) -> np.ndarray:
    """Of each word the mean of its buckets' values."""
    total, count = values[_bucket(words.whole())].astype(float), np.ones(len(words.starts))
    for size in SIZES:
        sums = np.concatenate(([0.0], np.cumsum(values[words.runs(size)], dtype=float)))
        n = words.counts(size)
        first = np.minimum(words.starts - 1, len(sums) - 1)
        total += sums[np.minimum(first + n, len(sums) - 1)] - sums[first]
        count += n
    return total / count


def pieces_of(text: str | None) -> Iterator[str]:
    """A text in lower case, whole, cut between words."""
    text, at = (text or "").lower(), 0
    while at < len(text) or not at:
        stop = BETWEEN.search(text, at + PIECE)
        stop = stop.start() if stop else len(text)
        yield text[at:stop]
        at = max(1, stop)


def _in_pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, or pieces of them, about PIECE characters together, and the place of the text of each."""
    places, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            places.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield places, pieces
                places, pieces, size = [], [], 0
    if pieces:
        yield places, pieces


def passage_starts(n: int) -> np.ndarray:
    """Where the passages of a text of n words begin."""
    return np.minimum(np.arange(0, max(1, n), SPAN), max(0, n - SPAN))


def passage_means(numbers: np.ndarray) -> np.ndarray:
    """The means of the passages of a text, of whose words these are the numbers."""
    n = len(numbers)
    if n <= SPAN:
        return numbers.mean(keepdims=True) if n else np.zeros(1)
    sums, begins = np.concatenate(([0.0], np.cumsum(numbers))), passage_starts(n)
    return (sums[begins + SPAN] - sums[begins]) / SPAN


@dataclass
class Scorer:
    """What each bucket adds to the margin of toxic over not, the margin of no words, and the calibration."""

    margins: np.ndarray
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, texts: list[str | None]) -> np.ndarray:
        """The margin of the most toxic passage of each text."""
        numbers: list[list[np.ndarray]] = [[] for _ in texts]
        for places, pieces in _in_pieces(texts):
            words = Words.of(pieces)
            parts = np.split(word_numbers(words, self.margins), np.searchsorted(words.text, range(1, len(places))))
            for i, part in zip(places, parts):
                numbers[i].append(part)
        return np.array([passage_means(np.concatenate(parts)).max() for parts in numbers]) + self.base

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def constant(share: float) -> Scorer:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Scorer(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Bags:
    """Documents as numbers of distinct words, one after another, and those words as buckets, one after another."""

    words: np.ndarray
    ends: np.ndarray
    buckets: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Bags:
        hashes, counts, seen = [], np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
        new, sizes, buckets = [], [], []
        for places, pieces in _in_pieces(texts):
            found = Words.of(pieces)
            whole = found.whole()
            hashes.append(whole)
            np.add.at(counts, np.array(places)[found.text], 1)
            distinct, first = np.unique(whole, return_index=True)
            first = first[~np.isin(distinct, seen, assume_unique=True)]
            seen = np.union1d(seen, distinct)
            chosen = Words(found.codes, found.starts[first], found.stops[first], found.text[first])
            n_runs = [chosen.counts(size) for size in SIZES]
            runs = [chosen.runs(size)[_ranges(chosen.starts - 1, n)] for size, n in zip(SIZES, n_runs)]
            word = np.concatenate([np.repeat(np.arange(len(first)), n) for n in (1, *n_runs)])
            of_word = np.concatenate([_bucket(whole[first]), *runs]).astype(np.int32)
            new.append(whole[first])
            sizes.append(1 + sum(n_runs))
            buckets.append(of_word[np.argsort(word, kind="stable")])
        known = np.concatenate(new)
        order = np.argsort(known)
        words = order[np.searchsorted(known, np.concatenate(hashes), sorter=order)]
        return cls(words, np.cumsum(counts), np.concatenate(buckets), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """Of each distinct word the mean of its buckets' values."""
        return np.add.reduceat(values[self.buckets], self.bounds[:-1]) / np.diff(self.bounds)

    def document(self, i: int) -> np.ndarray:
        return self.words[self.ends[i - 1] if i else 0 : self.ends[i]]


def _gradients(bags: Bags, passages: list[np.ndarray], y: np.ndarray, table: np.ndarray, soft: np.ndarray):
    """Of the mean log-loss of passages: the rows of the table that count, their gradients, and those of the softmax."""
    sizes = np.array([len(p) for p in passages])
    words, place = np.unique(np.concatenate(passages), return_inverse=True)
    counts = np.diff(bags.bounds)[words]
    buckets = bags.buckets[_ranges(bags.bounds[words], counts)]
    used, slot = np.unique(buckets, return_inverse=True)
    vectors = np.add.reduceat(table[used][slot], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    means = np.add.reduceat(vectors[place], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    logits = means @ soft[:-1] + soft[-1]
    shares = np.exp(logits - logits.max(axis=1, keepdims=True))
    error = shares / shares.sum(axis=1, keepdims=True)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = np.repeat((error @ soft[:-1].T) / sizes[:, None], sizes, axis=0)
    of_word = np.stack([np.bincount(place, c, len(words)) for c in back.T], axis=1) / counts[:, None]
    spread = np.repeat(of_word, counts, axis=0)
    of_bucket = np.stack([np.bincount(slot, c, len(used)) for c in spread.T], axis=1)
    return used, of_bucket, np.vstack((means.T @ error, error.sum(axis=0)))


def _most_toxic(bags: Bags, docs: np.ndarray, margins: np.ndarray) -> list[np.ndarray]:
    """The words of the passage of each document with the highest margin."""
    of_word, out = bags.word_means(margins), []
    for i in docs:
        words = bags.document(i)
        start = passage_starts(len(words))[passage_means(of_word[words]).argmax()]
        out.append(words[start : start + SPAN])
    return out


def fit(texts: list[str], y: np.ndarray, share: float, *, epochs: int = EPOCHS, seed: int = 11) -> Scorer:
    """Vectors and softmax from documents and their labels (0 or 1); ``share`` of all labels are toxic."""
    if not len(y) or y.min() == y.max():
        return constant(share)
    y, rng = y.astype(np.int64), np.random.default_rng(seed)
    bags, order = Bags.of(texts), rng.permutation(len(y))
    unseen, seen = order[: len(y) // 5], order[len(y) // 5 :]
    if len(np.unique(y[unseen])) < 2 or len(np.unique(y[seen])) < 2:
        unseen = seen = order
    sizes = np.diff(bags.ends, prepend=0)
    seen = seen[sizes[seen] > 0]
    if not len(seen):
        return constant(share)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIMENSIONS + 1, 2))
    squares, of_soft = np.full(len(table), 1e-5), np.full(soft.shape, 1e-8)
    for epoch in range(epochs):
        rng.shuffle(seen)
        if epoch < 4:  # any passage of a document, before it is known which ones are toxic
            starts = [rng.choice(passage_starts(n)) for n in sizes[seen]]
            passages = [bags.document(i)[s : s + SPAN] for i, s in zip(seen, starts)]
        else:
            passages = _most_toxic(bags, seen, table @ (soft[:-1, 1] - soft[:-1, 0]))
        rate = 0.3 * (1 - epoch / epochs)
        for at in range(0, len(seen), STEP_ROWS):
            some = slice(at, at + STEP_ROWS)
            used, of_bucket, of_softmax = _gradients(bags, passages[some], y[seen[some]], table, soft)
            squares[used] += np.square(of_bucket).mean(axis=1)
            table[used] -= rate * of_bucket / np.sqrt(squares[used])[:, None]
            of_soft += np.square(of_softmax)
            soft -= rate * of_softmax / np.sqrt(of_soft)
    margins = table @ (soft[:-1, 1] - soft[:-1, 0]).astype(np.float32)
    found = Scorer(margins, float(soft[-1, 1] - soft[-1, 0]))
    of_word = bags.word_means(margins)
    at = np.array([passage_means(of_word[bags.document(i)]).max() + found.base for i in unseen])
    weight = np.where(y[unseen] == 1, share / y[unseen].mean(), (1 - share) / (1 - y[unseen].mean()))
    found.slope, found.offset = calibration(at, y[unseen], weight)
    return found


def calibration(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The slope and offset of log-odds with the least weighed log-loss, kept from running off where kinds are apart."""
    best = (np.inf, 1.0, 0.0)
    for slope in np.geomspace(0.1, 4, 40):
        for offset in np.linspace(-12, 12, 97):
            odds = slope * margin + offset
            loss = float((weight * (np.logaddexp(0, odds) - y * odds)).mean() + 1e-4 * slope * slope)
            best = min(best, (loss, float(slope), float(offset)))
    return best[1:]


def sample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    train_rows: int = TRAIN_ROWS,
    train_chars: int = TRAIN_CHARS,
) -> tuple[list[str], np.ndarray, float]:
    """Texts to learn from, their labels, and the share of all labels that are toxic."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    known = known.where("doc_id is not null and label is not null").groupBy("doc_id")
    known = known.agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic = min(n.get(1, 0), max(train_rows // 2, train_rows - n.get(0, 0)))
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(m) for k, m in ((1, toxic), (0, train_rows - toxic))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # train_rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = cut(rows.withColumn("rank", F.xxhash64("doc_id")))
    sizes = rows.select("doc_id", "rank", F.length("text").alias("size")).orderBy("rank", "doc_id").toPandas()
    whole = sizes["doc_id"][sizes["size"].cumsum() <= train_chars].tolist()
    found = rows.where(F.col("doc_id").isin(whole)) if len(whole) < len(sizes) else rows
    learned = found.orderBy("rank", "doc_id").select("text", "label").toPandas()
    return learned["text"].tolist(), learned["label"].to_numpy(np.int64), n.get(1, 0) / max(1, sum(n.values()))


def score(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(scorer))  # one number for each bucket

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = Scorer(**sent.value)
        for texts in batches:
            yield pd.Series(fitted.probability(fitted.margin(texts.tolist())))

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", probability("text").alias("score"))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    train_rows: int = TRAIN_ROWS,
    train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """One row per document: doc_id, score. ``labels`` (id, label 0 or 1) are those that may be learned from."""
    columns = {"id_col": id_col, "text_col": text_col}
    bounds = {"train_rows": train_rows, "train_chars": train_chars}
    return score(docs, fit(*sample(docs, labels, label_col=label_col, **columns, **bounds)), **columns)
