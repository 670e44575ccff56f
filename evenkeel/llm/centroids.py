"""Centroid clustering of whole-number vectors in exact arithmetic.

Distances come from the expansion |x|^2 - 2 x.c + |c|^2, its products from blocked float64 BLAS. All terms are whole numbers;
where the magnitudes of a vector and the centroids keep them below 2^53, doubles hold them exactly, and the few vectors beyond
that go by integers without a bound. Vectors are packed into blocks where they lie, without a shuffle, and kept in the shared
folder, as every round reads them. A round is one RDD treeAggregate of the blocks' sums and counts, so the driver gets
k sums, in a tree; centroids are sent back with the tasks.

Defined results: vectors that are null, have another length than `DIM`, hold null or non-finite components, or don't stay
finite once scaled take no part. Starting centroids are those of the smallest hashes of ids, rows with a null id after all
others (they are assigned like any row), equal hashes, as of repeated ids, by their vectors; fewer than k vectors start fewer
clusters. Equal distances go to the smaller number, a centroid that no vector is assigned to stays. Distances and sums beyond a
long are held to its end. Empty tables give empty tables; only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import kit

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Vectors of a packed block, and of a product at a time.
BLOCK, STEP = 8192, 4096
EXACT, LONG = 1 << 53, 2**63 - 1


def kept(df: DataFrame, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return rows.where((F.size("v") == dim) & fine)


def packed(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(ids, cells): blocks of at most BLOCK ids and their whole-number vectors as bytes of doubles."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                own = b.slice(lo, BLOCK)
                x = np.floor(own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
                ids = own.column(0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], ["ids", "cells"])

    return rows.mapInArrow(kit.lean(run), f"ids array<{kind}>, cells binary")


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Each vector's nearest centroid, and the squared distance, exactly: an array of longs, or a list where one is beyond."""
    c = np.array([[float(v) for v in row] for row in centroids])
    most = max((abs(v) for row in centroids for v in row), default=0)
    # (|x| + |c|)^2 in every dimension bounds each of the three terms, their sums and the result
    limit = int((EXACT / x.shape[1]) ** 0.5) - 1 - most
    safe = np.abs(x).max(axis=1, initial=0.0) <= limit
    at, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.float64)
    cc = (c * c).sum(axis=1) if safe.any() else None
    for lo in range(0, len(x), STEP):
        own = lo + np.flatnonzero(safe[lo : lo + STEP])
        if len(own):
            part = x[own]
            d = (part * part).sum(axis=1)[:, None] - 2.0 * (part @ c.T) + cc[None, :]
            at[own] = d.argmin(axis=1)
            distance[own] = d[np.arange(len(own)), at[own]]
    if safe.all():
        return at, distance.astype(np.int64)
    exact = [int(v) for v in distance]
    for i in np.flatnonzero(~safe).tolist():
        row = [int(v) for v in x[i]]
        exact[i], at[i] = min((sum((a - b) ** 2 for a, b in zip(row, one, strict=True)), j) for j, one in enumerate(centroids))
    return at, exact


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> list[list[int]]:
    """The k clusters' componentwise sums, exactly."""
    if len(x) * np.abs(x).max(initial=0.0) < EXACT:
        one = np.zeros((k, len(x)))
        one[at, np.arange(len(x))] = 1.0
        return [[int(v) for v in row] for row in one @ x]
    return [[sum(int(v) for v in x[at == j, d]) for d in range(x.shape[1])] for j in range(k)]


def _cells(row, dim: int) -> np.ndarray:
    return np.frombuffer(row.cells, np.float64).reshape(-1, dim)


def _added(a: tuple, b: tuple) -> tuple:
    return [[x + y for x, y in zip(s, t, strict=True)] for s, t in zip(a[0], b[0], strict=True)], [x + y for x, y in zip(a[1], b[1], strict=True)]


def clustered(blocks: DataFrame, centroids: list[list[int]], rounds: int, dim: int) -> list[list[int]]:
    """The centroids after so many rounds over packed blocks."""
    cells = blocks.select("cells").rdd
    for _ in range(rounds):
        now = centroids

        def add(total, row, now=now):
            x = _cells(row, dim)
            at, _ = assigned(x, now)
            return _added(total, (_sums(x, at, len(now)), np.bincount(at, minlength=len(now)).tolist()))

        zero = ([[0] * dim for _ in now], [0] * len(now))
        sums, counts = cells.treeAggregate(zero, add, _added, depth=2)
        centroids = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, now, strict=True)]
    return centroids


def clusters(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark, rows = df.sparkSession, kept(df, vec_id, vector, dim, scale)
    kind = dict(rows.dtypes)["id"]
    shape = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], shape)
    blocks = kit.checkpointed(packed(rows, dim, scale))
    last = clustered(blocks, [[int(v) for v in np.floor(np.array(r.v) * scale)] for r in first], rounds, dim)

    def inertia(total, row):
        at, distance = assigned(_cells(row, dim), last)
        if not isinstance(distance, list) and len(distance) * int(distance.max(initial=0)) < EXACT:
            return [t + int(w) for t, w in zip(total, np.bincount(at, distance, minlength=len(total)), strict=True)]
        total = list(total)
        for j, d in zip(at.tolist(), distance if isinstance(distance, list) else distance.tolist(), strict=True):
            total[j] += d
        return total

    within = blocks.select("cells").rdd.treeAggregate([0] * len(last), inertia, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], depth=2)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    capped = [min(w, LONG) for w in within]
    total = min(sum(within), LONG)

    def label(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                x = np.frombuffer(one.column(1)[0].as_py(), np.float64).reshape(-1, dim)
                at, distance = assigned(x, last)
                distance = pa.array([min(d, LONG) for d in distance] if isinstance(distance, list) else distance, pa.int64())
                own = at.tolist()
                columns = [one.column(0).flatten(), pa.array(at.astype(np.int32)), distance, pa.array([capped[j] for j in own], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([named[j] for j in own], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in shape.split(", ")])

    return blocks.select("ids", "cells").mapInArrow(kit.lean(label), shape)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
