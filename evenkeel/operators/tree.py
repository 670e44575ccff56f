"""Exact Euclidean search by a partitioning tree over both sides, for references that are too many to send.

The tree's leaves are cells: of medians of the widest dimension ("kd_tree"), or of nearest centres that lie far apart
("cover_tree"), fitted on a sample of the references of a bounded size. Every reference is in one cell, of which two bounds are
known: the planes that part it from the rest, and the ball around its centre that holds its references. By the triangle
inequality a query is at least its distance to the centre less the radius away from all of them.

A query first meets its own cell, or those near it that hold k references, which gives its k-th distance, then those cells that could hold a
nearer reference, and no others: pairs of a query and a cell that can't are never shuffled. What is sent to every task is a
row of numbers for each cell, of a checked size. Cells that are large, as of a vector with very many copies, are dealt
into blocks. Results are those of brute force, ties included; where vectors have no structure, all cells are met.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.operators import knn
from evenkeel.sources import shared

KINDS = ("kd_tree", "cover_tree")
#: References of a cell on average; cells at most, of either kind; sampled references for each.
LEAF = 4096
CELLS = {"kd_tree": 16_384, "cover_tree": 1024}
SAMPLE = 8


class Cells:
    """Cells of a space, and lower bounds of the distances to what they hold."""

    def __init__(self, kind: str, sample: np.ndarray, cells: int):
        self.kind = kind
        self.dims = self.cuts = None
        if kind == "kd_tree":
            self.depth = max(0, (cells - 1).bit_length())
            self.dims, self.cuts = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
            groups = [np.arange(len(sample))]
            for node in range(len(self.dims)):
                own = groups[node]
                if len(own):
                    self.dims[node] = np.ptp(sample[own], axis=0).argmax()
                    self.cuts[node] = np.median(sample[own, self.dims[node]])
                right = sample[own, self.dims[node]] > self.cuts[node] if len(own) else np.zeros(0, bool)
                groups += [own[~right], own[right]]
            leaves = groups[-(1 << self.depth) :]
            # an empty leaf has no ball that would help; its planes bound it
            self.centres = np.array([sample[own].mean(axis=0) if len(own) else sample.mean(axis=0) for own in leaves])
        else:
            chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
            while len(chosen) < min(cells, len(sample)) and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
            self.centres = sample[chosen]
        self.radii = np.zeros(len(self.centres))

    def __len__(self) -> int:
        return len(self.centres)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        if self.dims is None:
            return knn._order(x, self.centres, 1)[:, 0] if len(x) else np.empty(0, np.int64)
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.dims[at]] > self.cuts[at])
        return at - len(self.dims)

    def radius(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How far each row is from the centre of its cell."""
        return np.sqrt(((x - self.centres[at]) ** 2).sum(axis=1))

    def below(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell a distance that no reference of the cell is nearer than."""
        qq, cc = (q * q).sum(axis=1)[:, None], (self.centres * self.centres).sum(axis=1)[None, :]
        d = qq + cc - 2 * q @ self.centres.T - 16e-16 * (q.shape[1] + 8) * (qq + cc)
        out = np.maximum(np.sqrt(np.maximum(d, 0)) * (1 - 1e-12) - self.radii * (1 + 1e-12), 0)
        if self.dims is None:
            return out
        plane = np.zeros((len(q), 1))
        for level in range(self.depth):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            over = q[:, self.dims[nodes]] - self.cuts[nodes]
            plane = np.stack([np.maximum(plane, over), np.maximum(plane, -over)], axis=2).reshape(len(q), 2 * plane.shape[1])
        return np.maximum(out, plane)


    def above(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell a distance that no reference of the cell is farther than."""
        qq, cc = (q * q).sum(axis=1)[:, None], (self.centres * self.centres).sum(axis=1)[None, :]
        d = qq + cc - 2 * q @ self.centres.T + 16e-16 * (q.shape[1] + 8) * (qq + cc)
        return np.sqrt(np.maximum(d, 0)) * (1 + 1e-12) + self.radii * (1 + 1e-12)


def _sent(spark: SparkSession, *held) -> Broadcast:
    """What `_held` gives in a task. It travels with its code as functions do, which a broadcast by itself doesn't."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(held))


def _held(sent: Broadcast) -> tuple:
    return pickle.loads(sent.value)


def fitted(refs: DataFrame, n: int, dim: int, kind: str, leaf: int) -> tuple[Cells, np.ndarray, DataFrame]:
    """The cells of n references, how many each holds, and (id, z, list), the references with their cells."""
    rk = dict(refs.dtypes)["id"]
    wanted = max(1, min(-(-n // leaf), CELLS[kind], knn.SMALL // (2 * SAMPLE * dim)))
    share = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30))
    sample = refs.where(share < min(1 << 30, -(-(SAMPLE * wanted << 30) // n))).limit(2 * SAMPLE * wanted).toArrow()
    tree = Cells(kind, knn._side(sample)[1] if len(sample) else np.zeros((1, dim)), wanted)
    sent = _sent(refs.sparkSession, tree)

    def dealt(batches):
        (tree,) = _held(sent)
        for b in batches:
            z = knn._matrix(b.column(1), dim) if b.num_rows else np.empty((0, dim))
            at = tree.place(z)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(tree.radius(z, at))], ["id", "z", "list", "far"])

    right = shared.checkpointed(refs.select("id", "z").mapInArrow(dealt, f"id {rk}, z array<double>, list int, far double"))
    counts = np.zeros(len(tree), np.int64)
    for r in right.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        counts[r["list"]], tree.radii[r["list"]] = r.n, r.far
    return tree, counts, right.drop("far")


def bounds(queries: DataFrame, tree: Cells, counts: np.ndarray, k: int, dim: int, squared: bool) -> DataFrame:
    """(id, z, lower, upper): between what the mean (squared) distance of each query to its k nearest references lies.

    The k nearest of all references are nowhere nearer than the nearest places of cells, filled as far as these hold references.
    """
    sent = _sent(queries.sparkSession, tree, counts)

    def mean(to: np.ndarray, counts: np.ndarray) -> np.ndarray:
        to = np.where(counts > 0, to * to if squared else to, np.inf)
        order = np.argsort(to, axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        take = np.clip(k - before, 0, counts[order])
        return np.where(take > 0, np.take_along_axis(to, order, 1) * take, 0).sum(axis=1) / k

    def run(batches):
        tree, counts = _held(sent)
        for b in batches:
            ends = [(mean(tree.below(z), counts), mean(tree.above(z), counts)) for z in _parts(b, dim, len(tree))]
            lower, upper = (np.concatenate([e[i] for e in ends]) if ends else np.empty(0) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lower), pa.array(upper)], ["id", "z", "lower", "upper"])

    return queries.select("id", "z").mapInArrow(run, f"id {dict(queries.dtypes)['id']}, z array<double>, lower double, upper double")


def searched(queries: DataFrame, refs: DataFrame, k: int, exclude: bool = False, decimals: int | None = None, sizes: tuple[int, int] | None = None, dim: int | None = None, kind: str = "kd_tree", leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(query_id, near), see `knn.lists`, and (query_id, cells, of): how many cells each query met of how many there are.

    queries and refs: (id, z).
    """
    if kind not in KINDS:
        raise BalanceError(f"a tree is one of {KINDS}, not {kind!r}")
    spark, queries, refs = queries.sparkSession, queries.select("id", "z"), refs.select("id", "z")
    n = sizes[1] if sizes else refs.count()
    if dim is None:
        one = refs.select(F.size("z").alias("d")).limit(1).collect()
        dim = one[0].d if one else 1
    qk, rk = dict(queries.dtypes)["id"], dict(refs.dtypes)["id"]
    if not n:
        near = queries.limit(0).select(F.col("id").alias("query_id"), F.lit(None).cast(f"array<struct<measure: double, neighbor_id: {rk}>>").alias("near"))
        return near, near.select("query_id", F.lit(0).alias("cells"), F.lit(0).alias("of"))
    tree, counts, right = fitted(refs, n, dim, kind, leaf)
    known, need = _sent(spark, tree, counts), min(n, k + exclude)

    def first(batches):
        tree, counts = _held(known)
        for b in batches:
            met = []
            for z in _parts(b, dim, len(tree)):
                own = tree.place(z)
                some = [np.array([c], np.int32) for c in own]
                # where the cell around a query holds too few
                scant = np.flatnonzero(counts[own] < need)
                below = np.where(counts > 0, tree.below(z[scant]), np.inf)
                order = np.argsort(below, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                for i, o, s in zip(scant, order, before, strict=True):
                    some[i] = o[(s < need) & (counts[o] > 0)].astype(np.int32)
                met += some
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(met, pa.list_(pa.int32()))], ["id", "z", "lists"])

    asked = shared.checkpointed(queries.mapInArrow(first, f"id {qk}, z array<double>, lists array<int>"))
    met = knn.met_in_lists(asked.select("id", "z", F.explode("lists").alias("list")), right, counts, k, "euclidean", exclude, decimals)
    met = shared.checkpointed(met)
    # the k-th measure so far, or none if there are fewer
    kth = knn._merged(met, k).select("query_id", F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["measure"]).alias("kth"))
    rest = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "z", "lists", "kth")
    slack = 0.0 if decimals is None else 10.0**-decimals

    def others(batches):
        tree, counts = _held(known)
        for b in batches:
            bar = b.column(3).fill_null(float("inf")).to_numpy(zero_copy_only=False)
            had, met, lo = b.column(2).to_pylist(), [], 0
            for z in _parts(b, dim, len(tree)):
                own = slice(lo, lo + len(z))
                near = (tree.below(z) ** 2 <= (bar[own] * (1 + 1e-9) + slack)[:, None]) & (counts > 0)
                for row, before in zip(near, had[own], strict=True):
                    row[before] = False
                    met.append(np.flatnonzero(row).astype(np.int32))
                lo += len(z)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) + len(y) for x, y in zip(had, met, strict=True)], pa.int32()), pa.array(met, pa.list_(pa.int32()))], ["id", "z", "cells", "lists"])

    rest = shared.checkpointed(rest.mapInArrow(others, f"id {qk}, z array<double>, cells int, lists array<int>"))
    more = knn.met_in_lists(rest.select("id", "z", F.explode("lists").alias("list")), right, counts, k, "euclidean", exclude, decimals)
    visits = rest.select(F.col("id").alias("query_id"), "cells", F.lit(int((counts > 0).sum())).alias("of"))
    return knn._merged(met.unionByName(more), k), visits


def _parts(batch: pa.RecordBatch, dim: int, cells: int):
    """A batch's vectors, so many at a time that their bounds to all cells are no large matrix."""
    z = knn._matrix(batch.column(1), dim) if batch.num_rows else np.empty((0, dim))
    step = max(1, knn.CELLS // cells)
    for lo in range(0, len(z), step):
        yield z[lo : lo + step]
