"""Centroid clustering against a plain fold in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from foliant.llm import centroids

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("v", T.StringType()),
        T.StructField("cluster", T.StringType()),
    ]
)


def plain(rows, *, dims, k, rounds, scale=64):
    """(vec_id, cluster, distance) of the kept rows, and the centroids."""
    kept = [
        (i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * float(np.float32(x))))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]

    def name(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    places = [v for _, v in sorted(kept, key=name)[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        places = [
            [sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(places)
        ]
    return sorted(((i, best(v)[1], best(v)[0]) for i, v in kept), key=repr), places


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(3)
    out, places = centroids.clusters(df, **options)
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=repr), places.tolist(), out


def test_equals_a_plain_fold_with_ties_and_copies(spark):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(1000 + i, [0.0] * 8) for i in range(200)]  # one vector a third of all, and so equal centroids
    got, places, out = found(spark, rows, dims=8, k=6, leading=2)
    wanted, known = plain(rows, dims=8, k=6, rounds=3)
    assert got == wanted
    assert places == known
    about = centroids.with_inertia(out, np.array(places)).collect()
    assert {r["inertia"] for r in about} == {sum(d for _, _, d in wanted)}
    for r in about:
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, known[r["cluster"]])).encode()).hexdigest()


def test_odd_vectors(spark):
    rows = [
        (1, None),
        (2, []),
        (3, [1.0, 2.0, 3.0]),
        (4, [1.0, None]),
        (5, [math.nan, 1.0]),
        (6, [math.inf, 1.0]),
        (7, [-0.001, 0.001]),
        (7, [-0.001, 0.001]),
        (None, [5.0, 5.0]),
        (8, [3e38, -3e38]),
    ]
    got, places, _ = found(spark, rows, dims=2, k=16)
    wanted, known = plain(rows, dims=2, k=16, rounds=3)
    assert len(got) == 4
    assert got == wanted
    assert places == known


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_nothing_kept(spark, rows):
    got, places, out = found(spark, rows, dims=2)
    assert (got, places) == ([], [])
    assert centroids.with_inertia(out, np.zeros((0, 2), np.int64)).collect() == []


def test_the_bound_filters_and_loses_nothing():
    rng = np.random.default_rng(3)
    middles = rng.integers(-60, 60, (16, 64))
    v = middles[rng.integers(0, 16, 4000)] + rng.integers(-6, 7, (4000, 64))
    covariance = np.cov(v.T)
    turn = centroids.Rotation(v.mean(axis=0), np.linalg.eigh(covariance)[1][:, ::-1], 16)
    lead, rest = turn.apply(v.astype(float))
    cluster, distance, verified = centroids.nearest(v, lead, rest, middles, turn)
    every = np.square(v[:, None] - middles).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all()
    assert (distance == every.min(axis=1)).all()
    assert verified < 2 * len(v)  # of 16 distances a vector
