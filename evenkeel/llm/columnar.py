"""Exact top-k search by inner product over a vertical layout, by branch and bound.

Vectors are scaled to whole numbers and dealt into blocks, which are stored by dimension: each slab has `WIDTH` dimensions of all
the block's vectors, and beside it the vectors' mass (norm) in the dimensions that come after. A query adds up a slab at a
time. What the rest of a candidate can add is at most its remaining mass times the query's (Cauchy and Schwarz), so those
that can't reach the query's k-th best are dropped, and the survivors are compacted before the next slab. Dimensions come in
the order of their mass in a sample, so the remaining mass falls early.

The k-th best is at first that among `SEEDS` sampled vectors, which are sent to every task; a block that beats it raises it. A query
meets every block in which some vector's mass could reach it. Both sides are shuffled: a query once for each such block, a
block once for each `ASKS` queries; no task holds more than one of each. All pairs are considered, which exactness asks for;
what bounds save are slabs, pairs of queries and blocks of small vectors, and rows of results.

Sums are whole numbers below 2^53, so doubles hold them exactly; where the magnitudes of a query and a block don't allow that,
the query's scores there are added up in integers without a bound.

Defined results: vectors that are null or hold null or non-finite components (also once scaled) take no part, nor do those with a
null id. Vectors meet those of their own length only, empty ones too (score 0). Rows that share an id are no candidates
for each other; equal rows count once, and a query whose id has several vectors asks with the smallest. Ties go to smaller
ids. Scores beyond a long are held to its ends, and tie there. Empty tables give empty tables; only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evenkeel.llm import kit

SCALE, TOP = 256, 5
WIDTH, BLOCK, ASKS, CHUNK = 16, 16_384, 8192, 64
#: Vectors that give the first bounds, of so many dimensions at most.
SEEDS, SEED_DIM = 1024, 4096
#: Blocks whose masses are sent to every task at most; beyond, all blocks are met.
REACH = 65_536
EXACT = float(1 << 53)
#: Bounds are computed in doubles; so much is added to them.
SLACK = 1 + 1e-9


def usable(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v, d): ids, vectors of doubles that stay finite once scaled, and their lengths."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return rows.where(fine).withColumn("d", F.size("v"))


def whole(column, rows: int, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of arrays of doubles, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim) * scale)


class Slabs:
    """A block's vectors by dimension."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.n, self.dim = x.shape
        self.order = order
        self.cuts = [order[s : s + WIDTH] for s in range(0, self.dim, WIDTH)]
        self.slabs = [np.ascontiguousarray(x[:, c].T) for c in self.cuts]
        self.peak = float(np.abs(x).max()) if x.size else 0.0
        self.rest = masses(x, self.cuts)

    def packed(self) -> tuple[bytes, bytes, float]:
        return b"".join(s.tobytes() for s in self.slabs), self.rest.tobytes(), self.peak

    @classmethod
    def unpacked(cls, n: int, order: np.ndarray, cells: bytes, rest: bytes, peak: float) -> Slabs:
        out = cls.__new__(cls)
        out.n, out.dim, out.order, out.peak = n, len(order), order, peak
        out.cuts = [order[s : s + WIDTH] for s in range(0, out.dim, WIDTH)]
        all_ = np.frombuffer(cells, np.float64).reshape(out.dim, n)
        out.slabs = [all_[s : s + WIDTH] for s in range(0, out.dim, WIDTH)]
        out.rest = np.frombuffer(rest, np.float64).reshape(len(out.cuts) + 1, n)
        return out

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """The vectors at these places, dimensions in `order`."""
        return np.concatenate([s[:, at] for s in self.slabs]).T if self.slabs else np.empty((len(at), 0))


def masses(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each cut, and behind the last one, each row's norm over it and those that follow."""
    out = np.zeros((len(cuts) + 1, len(x)))
    with np.errstate(over="ignore"):
        for i in range(len(cuts) - 1, -1, -1):
            out[i] = np.hypot(out[i + 1], np.sqrt((x[:, cuts[i]] ** 2).sum(axis=1)))
    return out


def best(block: Slabs, q: np.ndarray, least: np.ndarray, own: list[np.ndarray], k: int):
    """(query, places, scores, cells) for each query: places of its k best that reach `least`, in order, and how many cells it added up.

    own: places that are no candidates for a query; places are in the order of ids, so ties go to smaller ones.
    """
    mass = masses(q, block.cuts)
    safe = np.abs(q).max(axis=1, initial=0.0) * block.peak * max(1, block.dim) < EXACT
    for lo in range(0, len(q), CHUNK):
        some = slice(lo, min(lo + CHUNK, len(q)))
        part = q[some][:, block.cuts[0]] @ block.slabs[0] if block.slabs else np.zeros((some.stop - lo, block.n))
        for i in range(some.stop - lo):
            j = lo + i
            if not safe[j]:
                at, score = _unbounded(block, q[j], own[j], k)
                yield j, at, score, block.n * block.dim
                continue
            row, bar = part[i], least[j]
            row[own[j]] = -np.inf
            cells = block.n * min(WIDTH, block.dim)
            n = min(k, block.n - len(own[j]))
            if n < 1:
                continue
            first = np.argpartition(-row, n - 1)[:n]
            if n == k:
                # the k that lead so far give a bound that holds
                bar = max(bar, (block.vectors(first) @ q[j][block.order]).min())
            alive = np.flatnonzero(row + mass[1][j] * block.rest[1] * SLACK >= bar) if len(block.cuts) > 1 else np.flatnonzero(row >= bar)
            row = row[alive]
            alive, row = alive[row > -np.inf], row[row > -np.inf]
            for b in range(1, len(block.cuts)):
                row = row + q[j][block.cuts[b]] @ block.slabs[b][:, alive]
                cells += len(alive) * len(block.cuts[b])
                keep = row + mass[b + 1][j] * block.rest[b + 1][alive] * SLACK >= bar
                alive, row = alive[keep], row[keep]
            at = np.lexsort((alive, -row))[:k]
            yield j, alive[at], row[at].astype(np.int64), cells


def _unbounded(block: Slabs, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `best` of one query, by integers that can't overflow."""
    at = np.setdiff1d(np.arange(block.n), own)
    total = np.zeros(len(at), object)
    for cut, slab in zip(block.cuts, block.slabs, strict=True):
        for d, row in zip(cut, slab, strict=True):
            total += np.array([int(v) for v in row[at].tolist()], object) * int(q[d])
    held = np.array([max(-(2**63), min(2**63 - 1, t)) for t in total], np.int64)
    first = sorted(range(len(at)), key=lambda i: (-int(held[i]), at[i]))[:k]
    return at[first], held[first]


def _ordered(ids: list, vectors: pa.ChunkedArray, dim: int, scale: int) -> tuple[list, np.ndarray]:
    """Ids in order and their vectors."""
    x = whole(vectors, len(ids), dim, scale)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    return [ids[i] for i in order], x[order]


def search(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` largest inner products of every row for which is_query(id column) holds."""
    spark, rows = df.sparkSession, usable(df, vec_id, vector, scale)
    kind = dict(rows.dtypes)["id"]
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("id")))).first()
    if not asked:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    # ids alone are shuffled for this; vectors a second time only where ids repeat
    repeated = bool(rows.groupBy("id").count().where("count > 1").limit(1).collect())
    rows = rows.dropDuplicates(["id", "v"]) if repeated else rows
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    # ids once, so that k seeds are k candidates
    sample = rows.where((F.col("d") <= SEED_DIM) & (share < int(min(1.0, SEEDS / n) * (1 << 30)))).limit(2 * SEEDS).groupBy("id").agg(F.min("v").alias("v")).toArrow()
    seeds: dict[int, list] = {}
    for i, v in zip(sample.column("id").to_pylist(), sample.column("v").to_pylist(), strict=True):
        seeds.setdefault(len(v), []).append((i, v))
    seeds = {d: ([i for i, _ in s], np.floor(np.array([v for _, v in s]).reshape(len(s), d) * scale)) for d, s in seeds.items()}
    held = spark.sparkContext.broadcast(seeds)
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked // ASKS))

    def order(dim: int) -> np.ndarray:
        """Dimensions by their mass among the seeds, largest first."""
        return np.argsort(-(held.value[dim][1] ** 2).sum(axis=0), kind="stable") if dim in held.value else np.arange(dim)

    def lay(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids, x = _ordered(t.column("id").to_pylist(), t.column("v"), dim, scale)
        block = Slabs(x, order(dim))
        cells, rest, peak = block.packed()
        return pa.table({"d": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids], pa.list_(t.schema.field("id").type)), "cells": pa.array([cells], pa.binary()), "rest": pa.array([rest], pa.binary()), "peak": pa.array([peak]), "mass": pa.array([float(block.rest[0].max(initial=0.0))])})

    laid = rows.withColumn("block", F.pmod(F.xxhash64("id", "v") if repeated else F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("d", "block").applyInArrow(lay, f"d int, block int, ids array<{kind}>, cells binary, rest binary, peak double, mass double")
    laid = kit.checkpointed(laid)

    def bounded(batches):
        for b in batches:
            ids, vectors, bars, norms = b.column(0).to_pylist(), b.column(1), [], []
            for i, v in zip(ids, vectors.to_pylist(), strict=True):
                q, bar = np.floor(np.array(v, np.float64) * scale), -np.inf
                own, x = held.value.get(len(v), ([], np.empty((0, len(v)))))
                if len(own) > top and np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, len(v)) < EXACT:
                    score = (x @ q)[[j for j, o in enumerate(own) if o != i]]
                    bar = float(np.partition(score, len(score) - top)[len(score) - top])
                bars.append(bar)
                norms.append(float(np.linalg.norm(q)))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors, b.column(2), pa.array(bars, pa.float64()), pa.array(norms, pa.float64())], ["id", "v", "d", "bar", "norm"])

    asks = rows.where(is_query(F.col("id"))).select("id", "v", "d")
    if repeated:
        asks = asks.groupBy("id").agg(F.min(F.struct("v", "d")).alias("x")).select("id", "x.v", "x.d")
    asks = asks.mapInArrow(kit.lean(bounded), f"id {kind}, v array<double>, d int, bar double, norm double")
    asks = asks.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))
    if blocks <= REACH:
        # which blocks a query meets, by a table of a checked size: some 30 bytes a block and length
        reach = F.broadcast(laid.select(F.col("d").alias("to"), F.col("block").alias("meets"), F.col("mass").alias("most")))
        met = asks.join(reach, (F.col("d") == F.col("to")) & (F.col("norm") * F.col("most") * F.lit(SLACK) >= F.col("bar")))
    else:
        met = asks.withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("id", "v", "d", "bar", "part", F.col("meets").alias("block"))
    arrow = to_arrow_type(rows.schema["id"].dataType)
    left = laid.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            one = left.to_pylist()[0]
            ids, dim = one["ids"], one["d"]
            block = Slabs.unpacked(len(ids), order(dim), one["cells"], one["rest"], one["peak"])
            place: dict = {}
            for i, x in enumerate(ids):
                place.setdefault(x, []).append(i)
            asks = right.column("id").to_pylist()
            own = [np.array(place.get(x, []), np.int64) for x in asks]
            q = whole(right.column("v"), len(asks), dim, scale)
            for j, at, score, _ in best(block, q, right.column("bar").to_numpy(), own, top):
                out[0].extend([asks[j]] * len(at))
                out[1].extend(ids[i] for i in at)
                out[2].extend(score.tolist())
        kinds = (arrow, arrow, pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    key = ["d", "block", "part"]
    found = left.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
