"""Centroid clustering on bit planes (11)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchlens.llm import bit_planes as bp

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, k=16, rounds=3, seed=1, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < bp.LIMIT for x in v)]
    cents = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sum(e for _, e, m in got if m == j), sum(e for _, e, _ in got), sha[j]) for i, d, j in got), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(n, seed=1, size=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, size, (5, 64))
    return [(int(i), (centre[i % 5] + rng.normal(0, size / 3, 64)).tolist()) for i in range(n)]


ODD = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63),
       (906, [float("inf")] + [0.1] * 63), (907, [-float("inf")] + [0.1] * 63), (908, [1e30] + [0.1] * 63), (909, [2.0 ** 21] + [0.1] * 63),
       (910, [-2.0 ** 21 + 0.5] + [2.0 ** 21 - 1] * 63), (None, [0.25] * 64), (911, [0.0] * 64), (911, [0.0] * 64), (911, [-1 / 64] * 64)]


@pytest.mark.parametrize("parts", [1, 7])
def test_brute_force(spark, parts):
    vectors = some(150) + ODD
    df = spark.createDataFrame(vectors, SCHEMA).repartition(parts)
    assert rows_of(bp.cluster(df)[1]) == brute(vectors)


def test_ties_and_hot_vectors(spark):
    vectors = [(1000 + i, [0.5 if (i % 3) else -0.5] * 64) for i in range(200)] + some(40, size=0.02)
    df = spark.createDataFrame(vectors, SCHEMA)
    for k, rounds in ((16, 3), (3, 0), (1, 2)):
        assert rows_of(bp.cluster(df, k=k, rounds=rounds)[1]) == brute(vectors, k, rounds)


def test_few_or_no_vectors(spark):
    for vectors in ([], ODD[:8], some(3), [(None, [0.5] * 64)]):
        df = spark.createDataFrame(vectors, SCHEMA)
        got = rows_of(bp.cluster(df)[1])
        if any(i is not None for i, _ in vectors):
            assert got == brute(vectors)
        else:
            assert got == []


def test_clashing_names_and_floats(spark):
    vectors = some(60)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    more = df.select("*", *[F.lit("x").alias(c) for c in ("planes", "cluster", "n", "total", "pos", "x", "inertia", "distance", "key")])
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    assert rows_of(bp.cluster(more)[1]) == rows_of(bp.cluster(df)[1]) == brute(as_float)


def test_planes_are_exact():
    rng = np.random.default_rng(2)
    for top in (1, 2, 64, 1000, 1 << 27):
        v = rng.integers(-top, top, (50, 64))
        p = bp.pack(v)
        assert p.shape[1] <= top.bit_length() + 1
        assert (bp.unpack(p) == v).all() and (bp.unpack(bp.widen(p, 40)) == v).all()
        assert (bp.dot(p, p) == (v * v).sum(axis=1)).all()
        small = rng.integers(-3, 4, 64)
        assert (bp.dot(p, bp.pack(small[None, :])[0]) == (v * small).sum(axis=1)).all()
    assert bp.pack(np.zeros((2, 64), np.int64)).shape == (2, 1)
