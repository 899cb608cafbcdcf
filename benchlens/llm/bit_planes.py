"""Centroid clustering on bit planes (operator 11).

A vector of 64 components becomes 64 integers, floor(scale * x), and these become bit
planes: plane b packs bit b of all components into one 64-bit word, the highest
plane is the sign (two's complement).  With weights 1, 2, 4, ... and a negative last
one, the dot product of two vectors is the sum over pairs of planes of
weight * weight * popcount(plane AND plane), exact in integers; a squared distance
is made of three of those.  Sums for new centroids come from the planes too.

The packed vectors are written once; every round reads them as a stream, each
task gives at most a row per centroid (count and sum of components), and only those
k rows, summed up by Spark, reach the driver.  A vector has as many planes as its
largest component needs; where more are wanted they repeat its sign.

Kept are vectors of exactly 64 components, none null, not a number or infinite, and
each below 2**21 in size, so that distances fit into a long; others are left out.
Null ids are kept and are never first centroids.  Rows with the same id are
vectors of their own; equal hashes are ordered by their planes.  With
fewer than ``k`` kept vectors there are fewer centroids; without any, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages

DIM = 64
LIMIT = 1 << 21


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def needed(v: np.ndarray) -> np.ndarray:
    """Planes that each vector needs, its sign included."""
    top = np.where(v < 0, ~v, v).max(axis=1, initial=0)
    return np.frexp(top.astype(np.float64))[1] + 1


def pack(v: np.ndarray) -> np.ndarray:
    """(n, 64) integers as (n, planes) words, the fewest planes that hold them all."""
    planes = int(needed(v).max(initial=1))
    bits = (v[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def widen(p: np.ndarray, planes: int) -> np.ndarray:
    """The same vectors on more planes: the sign repeats."""
    return np.concatenate([p, np.repeat(p[:, -1:], planes - p.shape[1], axis=1)], axis=1)


def unpack(p: np.ndarray) -> np.ndarray:
    """The integers again."""
    bits = np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(len(p), p.shape[1], 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits, weights(p.shape[1]))


def dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of the rows of p with q: one row, or as many as p has."""
    total = np.zeros(len(p), np.int64)
    for i, wi in enumerate(weights(p.shape[1])):
        for j, wj in enumerate(weights(q.shape[-1])):
            total += wi * wj * np.bitwise_count(p[:, i] & q[..., j]).astype(np.int64)
    return total


def assign(p: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the packed centroids (the first among equals) and the squared distance, by popcounts."""
    own, norm = dot(p, p), dot(centroids, centroids)
    best, dist = np.zeros(len(p), np.int64), np.full(len(p), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = own + norm[k] - 2 * dot(p, c)
        nearer = d < dist
        best[nearer], dist[nearer] = k, d[nearer]
    return best, dist


def packed_rows(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of at most ``rows`` rows and their planes, all of one width."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            b = batch.slice(at, rows)
            col = b.column("planes").cast(pa.large_binary())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
            data, size = np.frombuffer(col.buffers()[2], np.uint8), np.diff(off) // 8
            out = np.zeros((len(b), int(size.max())), np.uint64)
            for n in np.unique(size):
                of = np.flatnonzero(size == n)
                p = data[off[of][:, None] + np.arange(8 * n)].view("<u8")
                out[of] = widen(p, out.shape[1])
            yield b, out


def quantize(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, planes) of the kept vectors."""
    x = F.col(vector_col).cast("array<double>")
    ok = (F.size(x) == DIM) & F.forall(x, lambda v: F.coalesce((F.abs(v) < LIMIT) & ~F.isnan(v), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(ok, F.lit(False)))

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = np.floor(scale * np.asarray(b.column("x").flatten()).reshape(-1, DIM)).astype(np.int64)
                planes = [p[:n].tobytes() for p, n in zip(pack(v), needed(v).tolist(), strict=True)]
                yield pa.record_batch({"vec_id": b.column("vec_id"), "planes": pa.array(planes, pa.binary())})

    return rows.mapInArrow(run, "vec_id long, planes binary")


def first_centroids(packed: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integers of the k vectors with the smallest sha256 of 'seed:id'."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    got = packed.where("vec_id IS NOT NULL").select(key.alias("key"), "planes").orderBy("key", "planes").limit(k).collect()
    v = [unpack(np.frombuffer(r["planes"], "<u8")[None, :])[0] for r in got]
    return np.array(v, np.int64).reshape(-1, DIM)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    planes = pack(centroids)

    def run(batches):
        n, total = np.zeros(len(planes), object), np.zeros((len(planes), DIM), object)
        for _, p in packed_rows(batches):
            best, _ = assign(p, planes)
            order = np.argsort(best, kind="stable")
            at = np.flatnonzero(np.diff(best[order], prepend=-1))
            here = best[order][at]
            n[here] += np.diff(at, append=len(best)).astype(object)
            total[here] += np.add.reduceat(unpack(p)[order], at, axis=0).astype(object)
        some = [k for k in range(len(planes)) if n[k]]
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "pos": pa.array([list(range(DIM))] * len(some), pa.list_(pa.int32())),
                               "n": pa.array([int(n[k]) for k in some], pa.int64()),
                               "total": pa.array([[int(x) for x in total[k]] for k in some], pa.list_(pa.int64()))})

    part = packed.mapInArrow(run, "cluster int, pos array<int>, n long, total array<long>")
    big = "decimal(38,0)"
    rows = part.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(
        F.sum(F.col("n").cast(big)).alias("n"), F.sum(F.col("x").cast(big)).alias("x")).collect()
    out = centroids.copy()
    for r in rows:  # k * 64 rows
        out[r["cluster"], r["pos"]] = int(r["x"]) // int(r["n"])
    return out


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    planes = pack(centroids)

    def run(batches):
        for b, p in packed_rows(batches):
            best, dist = assign(p, planes)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "cluster": pa.array(best.astype(np.int32)), "distance": pa.array(dist)})

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """Centroids and (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    st = Stages(spark, "clusters")
    packed = st.write(quantize(vectors, scale, id_col, vector_col), "planes")
    centroids = first_centroids(packed, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(packed, centroids)
    rows = st.write(assigned(packed, centroids) if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long"), "assigned")
    st.drop(packed)
    sha = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # one row for each centroid
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = own.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = own.withColumn("inertia", every.scalar()).join(spark.createDataFrame(sha, "cluster int, centroid_sha256 string"), "cluster")
    out = rows.join(F.broadcast(facts), "cluster")
    return centroids, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
