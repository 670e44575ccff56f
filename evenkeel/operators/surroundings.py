"""What surrounds each minority row, by one search: its nearest rows of either class, and its nearest minority rows.

One product of the minority and all rows gives both lists; each task keeps the best of both for a minority row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators import knn


def _both(q: np.ndarray, r: np.ndarray, minor: np.ndarray, own: np.ndarray, k: int, k_own: int, metric: str, decimals: int | None, single: bool):
    """For both lists (query places, reference places, measures)."""
    few, at = np.flatnonzero(minor), np.cumsum(minor) - 1
    found = [[(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] for _ in range(2)]
    for lo, part, d, slack in knn.tiles(q, r, own, metric, decimals, single):
        for which, (refs, cells, most) in enumerate(((r, d, k), (r[few], d[:, few], k_own))):
            if most and cells.shape[1]:
                qi, ri, key = knn.ranked(part, refs, cells, slack, most, metric, decimals)
                found[which].append((qi + lo, few[ri] if which else ri, key))
    return [[np.concatenate([p[i] for p in parts]) for i in range(3)] for parts in found]


def found(minor: DataFrame, rows: DataFrame, k: int, k_own: int, sizes: tuple[int, int], dim: int, metric: str = "euclidean", decimals: int | None = None, small: int = knn.SMALL, chunk: int | None = None, workers: int = 1, single: bool = False) -> DataFrame:
    """(id, c, near, from, tos): how many of each minority row's k nearest other rows are of the majority, the k_own nearest
    other minority rows' ids, its own vector and theirs.

    minor: (id, z), a part of rows: (id, z, minor). k or k_own of 0 leaves that list empty. chunk, workers and single: see `knn.lists`.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    from evenkeel.functions import vectors

    spark, kind = minor.sparkSession, dict(minor.dtypes)["id"]
    minor, rows = minor.select("id", "z"), rows.select("id", "z", "minor")
    # angles are between unit vectors, new rows between the vectors themselves
    unit = lambda d: d if metric == "euclidean" else d.withColumn("u", vectors.normalized(F.col("z")))
    at = 1 if metric == "euclidean" else -1
    wide = sizes[1] * dim * (1 if metric == "euclidean" else 2)
    if wide <= small:
        t = unit(rows).toArrow()
        ids = t.column("id").to_pylist()
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
        names = t.column("id").combine_chunks().take(pa.array(order))
        z = knn._matrix(t.column("z"), dim)[order]
        u = z if metric == "euclidean" else knn._matrix(t.column("u"), dim)[order]
        held = spark.sparkContext.broadcast((names, z, None if u is z else u, np.asarray(t.column("minor").combine_chunks().to_numpy(zero_copy_only=False), bool)[order]))

        def ask(batches):
            names, z, u, flags = held.value
            place = {x: i for i, x in enumerate(names.to_pylist())}
            for b in (part for b in batches for part in knn.parts(b, chunk)):
                own = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
                q = knn._matrix(b.column(at), dim) if b.num_rows else np.empty((0, dim))
                (qi, ri, _), (oi, near, _) = _both(q, z if u is None else u, flags, own, k, k_own, metric, decimals, single)
                c = np.bincount(qi[~flags[ri]], minlength=len(q))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(oi, minlength=len(q)))]).astype(np.int32))
                tos = pa.ListArray.from_arrays(pa.array(np.arange(0, len(near) * dim + 1, dim, dtype=np.int32)), pa.array(z[near].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), pa.ListArray.from_arrays(ends, names.take(pa.array(near))), b.column(1), pa.ListArray.from_arrays(ends, tos)], ["id", "c", "near", "from", "tos"])

        minor = minor.repartition(workers) if workers > 1 else minor
        return unit(minor).mapInArrow(ask, f"id {kind}, c long, near array<{kind}>, from array<double>, tos array<array<double>>")
    arrow = to_arrow_type(minor.schema["id"].dataType)
    shape = f"query_id {kind}, own boolean, measure double, neighbor_id {kind}, minor boolean"

    def met(qids: list, q: np.ndarray, t: pa.Table) -> pa.Table:
        rids = t.column(0).to_pylist()
        order = np.array(sorted(range(len(rids)), key=rids.__getitem__), np.int64)
        rids = [rids[i] for i in order]
        flags = np.asarray(t.column(2).to_numpy(), bool)[order]
        r = knn._matrix(t.column(at), dim)[order]
        parts = _both(q, r, flags, knn.places(qids, rids), k, k_own, metric, decimals, single)
        tables = [knn.table(qids, rids, *p, (arrow, arrow)) for p in parts]
        cells = [[t.column("query_id"), pa.array(np.full(len(t), bool(i))), t.column("measure"), t.column("neighbor_id"), pa.array(flags[p[1]])] for i, (t, p) in enumerate(zip(tables, parts, strict=True))]
        return pa.concat_tables([pa.table(c, names=["query_id", "own", "measure", "neighbor_id", "minor"]) for c in cells])

    if sizes[0] * dim <= small:
        few = spark.sparkContext.broadcast(knn._side(unit(minor).select("id", "z" if metric == "euclidean" else "u").toArrow()))

        def offer(batches):
            best = None
            for b in (part for b in batches for part in knn.parts(b, chunk)):
                t = met(*few.value, pa.Table.from_batches([b]))
                best = t if best is None else pa.concat_tables([best, t])
                if len(best) > 4 * (k + k_own) * len(few.value[0]):
                    best = _best(best, k, k_own)
            if best is not None:
                yield from _best(best, k, k_own).to_batches()

        parts = unit(rows.repartition(workers) if workers > 1 else rows).mapInArrow(offer, shape)
    else:
        nq, nr = (-(-n // (chunk or knn.BLOCK)) for n in sizes)
        block = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
        every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        left = unit(minor).select("*", block(nq, "qb")).select("*", every(nr, "rb"))
        # under other names, as grouping loses columns of a table that meets itself
        right = unit(rows).select(*[F.col(c).alias(f"__{c}") for c in unit(rows).columns], block(nr, "rb")).select("*", every(nq, "qb"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                # an empty side has no columns
                return pa.table([[], [], [], [], []], schema=pa.schema([("query_id", arrow), ("own", pa.bool_()), ("measure", pa.float64()), ("neighbor_id", arrow), ("minor", pa.bool_())]))
            b = b.select([0, 1, 2] + [3] * (metric != "euclidean"))
            return met(a.column(0).to_pylist(), knn._matrix(a.column(1 if metric == "euclidean" else 2), dim), b)

        left, right = (d.repartition(workers, "qb", "rb") if workers > 1 else d for d in (left, right))
        parts = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, shape)
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy("measure", "neighbor_id"))
    kept = parts.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("own"), k_own).otherwise(k))
    lists = kept.groupBy("query_id").agg(F.count_if(~F.col("own") & ~F.col("minor")).alias("c"), F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("rank", "neighbor_id")))).alias("near"))
    return _with_vectors(minor, lists)


def _best(t: pa.Table, k: int, k_own: int) -> pa.Table:
    """The first of each query and list."""
    t = t.sort_by([("query_id", "ascending"), ("own", "ascending"), ("measure", "ascending"), ("neighbor_id", "ascending")])
    return t.filter(pa.array(knn.nth(t.column("query_id"), t.column("own")) < np.where(t.column("own").to_numpy(), k_own, k)))


def _with_vectors(minor: DataFrame, lists: DataFrame) -> DataFrame:
    """A neighbour's vector is joined once for each list that names it, not for each new row."""
    named = lists.select("query_id", F.explode("near").alias("x")).select("query_id", "x.rank", F.col("x.neighbor_id").alias("neighbor_id"))
    to = minor.select(F.col("id").alias("o"), F.col("z").alias("to"))
    tos = named.join(to, F.col("neighbor_id") == F.col("o")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "to"))).alias("tos"))
    counts = lists.select(F.col("query_id").alias("l"), "c", "near")
    out = minor.join(counts, F.col("id") == F.col("l"), "left").join(tos, F.col("id") == F.col("query_id"), "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kind = dict(minor.dtypes)["id"]
    near, vectors = F.transform("near", lambda x: x["neighbor_id"]), F.transform("tos", lambda x: x["to"])
    return out.select("id", F.coalesce("c", F.lit(0)).cast("long").alias("c"), empty(near, f"array<{kind}>").alias("near"), F.col("z").alias("from"), empty(vectors, "array<array<double>>").alias("tos"))


def with_lists(minor: DataFrame, own: DataFrame, counts: DataFrame | None) -> DataFrame:
    """As `found`, from (query_id, near) among the minority, see `knn.lists`, and (id, c) of each row, if it is known."""
    ranked = F.transform("near", lambda x, i: F.struct((i + 1).alias("rank"), x["neighbor_id"].alias("neighbor_id"))).alias("near")
    lists = own.select("query_id", ranked)
    if counts is None:
        return _with_vectors(minor, lists.withColumn("c", F.lit(0).cast("long")))
    return _with_vectors(minor, lists.join(counts.select(F.col("id").alias("n"), "c"), F.col("query_id") == F.col("n")).drop("n"))
