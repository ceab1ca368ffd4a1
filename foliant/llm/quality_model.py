"""A learned quality score: random-indexing word vectors, pooled per document, and a small network.

Random indexing: each of VOCABULARY word buckets (words by hash) has a sparse index vector of +1 and -1 at fixed
random places. The vector of a word is the sum of the index vectors of its neighbours within two words, over all
documents: sums of whole numbers, so their order doesn't matter. Tasks add up their own table of fixed size
(VOCABULARY x DIMENSIONS numbers, 4 MB), Spark adds the tables by blocks of rows.

A document is the mean of its words' vectors (each scaled to length 1), with the mean of the products of neighbouring
words' vectors, which shows words that follow themselves or their like. A network of two layers is fitted in numpy on
at most TRAIN_ROWS labelled documents; a temperature fitted on labelled rows that it has not seen calibrates the
probabilities.

Words are runs of letters and digits, or of other signs, as written. Defined results: a null or empty text is the zero
vector and gets the network's score of it; without labels of both kinds every score is the share of good labels (0.5
if there are none); documents and labels may repeat: the label of an id is good if most of its labels are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, small_batches
from foliant.llm.substrings import BASES, _byte_values, _chunks, _mix, _runs

VOCABULARY = 1 << 14
DIMENSIONS = 64
MARKS = 4
REACH = 2
BLOCK_ROWS = 1 << 10
TRAIN_ROWS = 20_000
HIDDEN = 32
#: Numbers of a document: the pooled vectors and the pooled products.
POOLED = 2 * DIMENSIONS

#: Of each byte: 0 white space, 1 letter or digit (all bytes beyond ASCII are), 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[128:] = 1
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word buckets of all texts in order, and the index of the text of each."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = KIND[buffer]
    edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(buffer)]))
    starts, stops = edges[:-1], edges[1:]
    word = kind[starts] > 0
    starts, stops = starts[word], stops[word]
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes = _runs(_byte_values(BASES[0][0])[buffer], starts, stops, BASES[0][1])
    return (hashes & np.uint64(VOCABULARY - 1)).astype(np.int64), np.searchsorted(ends, starts, "right")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the marks of each bucket."""
    drawn = _mix(np.arange(1, VOCABULARY * MARKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = drawn.reshape(VOCABULARY, MARKS)
    return (drawn % np.uint64(DIMENSIONS)).astype(np.int64), 1.0 - 2.0 * ((drawn >> np.uint64(40)) & np.uint64(1))


def _count_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places, signs = index_vectors()
    total = np.zeros(VOCABULARY * DIMENSIONS)
    for _, texts in _chunks(batches):
        words, doc = tokens(texts)
        for apart in range(1, REACH + 1):
            near = doc[apart:] == doc[:-apart]
            left, right = words[:-apart][near], words[apart:][near]
            for one, other in ((left, right), (right, left)):
                at = (one[:, None] * DIMENSIONS + places[other]).ravel()
                total += np.bincount(at, signs[other].ravel(), len(total))
    table = total.astype(np.int64).reshape(-1, BLOCK_ROWS, DIMENSIONS)
    used = np.flatnonzero(table.any(axis=(1, 2)))
    if len(used):
        yield pd.DataFrame({"block": used.astype(np.int32), "sums": [table[b].astype(np.int32).tobytes() for b in used]})


def _add_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, total = None, None
    for batch in batches:
        for block, sums in batch.itertuples(index=False):
            if block != now:
                if now is not None:
                    yield pd.DataFrame({"block": [now], "sums": [total.tobytes()]})
                now, total = block, np.zeros(BLOCK_ROWS * DIMENSIONS, np.int64)
            total += np.frombuffer(sums, np.int32)
    if now is not None:
        yield pd.DataFrame({"block": [now], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets, of length 1 or zero. ``docs``: text."""
    parts = docs.select(F.lit(0).alias("doc_id"), "text").mapInPandas(_count_contexts, "block int, sums binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInPandas(_add_blocks, "block int, sums binary")
    vectors = np.zeros((VOCABULARY, DIMENSIONS))
    for row in blocks.collect():  # VOCABULARY x DIMENSIONS numbers
        at = row["block"] * BLOCK_ROWS
        vectors[at : at + BLOCK_ROWS] = np.frombuffer(row["sums"], np.int64).reshape(-1, DIMENSIONS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, vector: the pooled vectors and products of the words of each text. ``docs``: doc_id, text."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(texts: list[bytes]) -> np.ndarray:
        words, doc = tokens(texts)
        total = np.zeros((len(texts), POOLED), np.float32)
        counts = np.bincount(doc, minlength=len(texts))
        filled = np.flatnonzero(counts)
        if len(filled):
            begins = np.concatenate(([0], np.cumsum(counts[filled])[:-1]))
            found = sent.value[words]
            products = np.zeros_like(found)
            products[1:] = found[1:] * found[:-1] * (doc[1:] == doc[:-1])[:, None]
            total[filled] = np.add.reduceat(np.hstack((found, products)), begins, axis=0) / counts[filled, None]
        return total

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pd.DataFrame({"doc_id": 0, "text": texts})
            yield pd.Series([x for _, chunk in _chunks([rows]) for x in pool(chunk)])

    return docs.select("doc_id", vector("text").alias("vector"))


@dataclass
class Network:
    """sigmoid((w2 . tanh(w1 . (x - mean) / scale + b1) + b2) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def constant(share: float) -> Network:
    none = np.zeros(POOLED)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(none, none + 1, np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), np.log(share / (1 - share)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the rest chooses the epoch and the temperature."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    seen, unseen = order[len(y) // 5 :], order[: len(y) // 5]
    if not len(unseen):
        unseen = seen
    mean, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
    z = (x - mean) / scale
    d = x.shape[1]
    parts = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    best, step = (np.inf, None), 0
    for _ in range(epochs):
        rng.shuffle(seen)
        for at in range(0, len(seen), 128):
            rows = seen[at : at + 128]
            h = np.tanh(z[rows] @ parts[0] + parts[1])
            error = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * parts[2] * (1 - h * h)
            step += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ error, np.array([error.sum()]))):
                g = g + 1e-4 * parts[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                parts[i] = parts[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]))
        if (loss := _loss(net.logits(x[unseen]), y[unseen])) < best[0]:
            best = loss, net
    net = best[1]
    logits = net.logits(x[unseen])
    net.temperature = float(min(np.geomspace(0.25, 8, 141), key=lambda t: _loss(logits / t, y[unseen])))
    return net


def train(vectors: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Network:
    """``vectors``: doc_id, vector; ``labels``: doc_id, label. At most about ``train_rows`` rows come to the driver."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label")
    )
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = vectors.join(chosen, "doc_id").select("doc_id", "vector", "label").toPandas()
    rows = rows.sort_values("doc_id").drop_duplicates("doc_id")
    x = np.array(rows["vector"].tolist(), float).reshape(-1, POOLED)
    return fit(x, rows["label"].to_numpy(float))


def score(vectors: DataFrame, net: Network) -> DataFrame:
    """doc_id, score."""
    sent = vectors.sparkSession.sparkContext.broadcast(vars(net))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = Network(**sent.value)
        for rows in batches:
            yield pd.Series(fitted.probabilities(np.array(rows.tolist(), float).reshape(-1, POOLED)))

    return vectors.select("doc_id", probability("vector").alias("score"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per document: doc_id, score. ``labels`` (doc_id, label) are those that may be learned from."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vectors = cut(pooled(rows, word_vectors(rows)))
    return score(vectors, train(vectors, labels, train_rows=train_rows))
