"""k nearest neighbours: exact, in blocks or by trees, or approximate by layered graphs or coarse lists.

Exact search never makes a row for each pair. If one side is small (its size is checked), it is sent to every task;
else both sides are dealt into blocks, and each two blocks meet once. A task keeps the k best of what it sees; only
these are shuffled. The kernel finds candidates by a matrix product, within a bound of its error, and ranks them by
direct differences, so that no cancellation shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import checks
from evenkeel.sources import shared

#: Names of public nearest-neighbour libraries, with the metrics and algorithms that each may be asked for.
ENGINES = {
    "native": (("euclidean",), ("auto", "brute")),
    "FNN": (("euclidean",), ("auto", "kd_tree", "cover_tree", "brute")),
    "RcppHNSW": (("euclidean", "cosine", "ip"), ("auto",)),
    "KernelKnn": (("euclidean",), ("auto", "brute")),
    "bigKNN": (("euclidean",), ("auto", "brute")),
}
#: Engines of other names, for all metrics: brute force or trees, and approximate search by coarse lists.
OWN = {"exact": ("auto", "kd_tree", "cover_tree", "brute"), "lists": ("auto",)}
METRICS = ("euclidean", "cosine", "ip")
#: Numbers (rows times dimensions) of a side that may be sent to every task: 32 MB.
SMALL = 4_000_000
#: Rows of a block where both sides are large.
BLOCK = 50_000
#: Cells of a distance matrix at a time.
CELLS = 1 << 20
#: Pairs of a query and a reference beyond which only distinct vectors are searched.
MANY = 1 << 28
#: Where vectors have at most so many dimensions: references of a cell and queries of a group, at most.
LOW, GROUP = 8, 64
#: Pairs of distinct vectors of so few dimensions beyond which a tree deals out both sides.
DEALT = 1 << 34
#: Coarse lists of the approximate engine at most.
LISTS = 16_384


def resolved_engine(engine: str = "auto", metric: str = "euclidean", allow_approx: bool = False) -> str:
    """The engine to use; "auto" is exact, and approximate only for other metrics and if allowed."""
    if metric not in METRICS:
        raise BalanceError(f"metric must be one of {METRICS}, not {metric!r}")
    if engine == "auto":
        if metric == "euclidean":
            return "native"
        if allow_approx:
            return "RcppHNSW"
        raise BalanceError(f"exact search by itself is for euclidean distances only, not {metric!r}; allow approximation or name an engine")
    if engine not in (*ENGINES, *OWN):
        raise BalanceError(f"engine must be one of {('auto', *OWN, *ENGINES)}, not {engine!r}")
    if engine in ENGINES and metric not in ENGINES[engine][0]:
        raise BalanceError(f"engine {engine} doesn't know metric {metric!r}")
    return engine


def resolved_algorithm(algorithm: str = "auto", engine: str = "native") -> str:
    legal = OWN[engine] if engine in OWN else ENGINES[engine][1]
    if algorithm not in legal:
        raise BalanceError(f"engine {engine} doesn't know algorithm {algorithm!r}; it knows {legal}")
    if algorithm == "auto":
        return "kd_tree" if engine == "FNN" else "brute" if "brute" in legal else "auto"
    return algorithm


def tiles(q: np.ndarray, r: np.ndarray, own: np.ndarray | None, metric: str, decimals: int | None, single: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, queries, measures to all references, bound of their error by query), so many queries at a time.

    own: the place among the references that a query may not match, or -1. single: products in single precision, of half
    the memory; its errors are in the bound, so that what is ranked by it holds the same rows.
    """
    if not len(r) or not len(q):
        return
    rr = (r * r).sum(1)
    # beyond this, squares don't fit single precision
    single = single and max(rr.max(), (q * q).sum(1).max()) < 1e30
    step = max(1, CELLS // len(r)) * (2 if single else 1)
    # what is rounded, and what is lost below the smallest numbers
    unit, least = (2.0**-24, 1e-44 * (q.shape[1] + 8)) if single else (1e-16, 0.0)
    low = r.astype(np.float32).T if single else r.T
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        g = (part.astype(np.float32) if single else part) @ low
        if metric == "euclidean":
            qq = (part * part).sum(1)
            g *= -2
            g += qq[:, None].astype(g.dtype)
            g += rr[None, :].astype(g.dtype)
            d, slack = g, 4 * unit * (q.shape[1] + 8) * (qq + rr.max()) * 4
        else:
            d, slack = 1 - g, np.full(len(part), 4 * unit * (q.shape[1] + 8) * 4)
        if own is not None:
            mine = own[lo : lo + step]
            d[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
        slack = slack + least
        yield lo, part, d, slack if decimals is None else slack + 2 * 10.0**-decimals


def ranked(q: np.ndarray, r: np.ndarray, d: np.ndarray, slack: np.ndarray, k: int, metric: str, decimals: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, reference places, measures) of each row's k smallest of d, which holds within slack."""
    n = min(k, d.shape[1])
    bar = np.partition(d, n - 1, axis=1)[:, n - 1]
    qi, ri = np.nonzero((d <= (bar + slack)[:, None]) & (d < np.inf))
    if metric == "euclidean":
        diff = q[qi] - r[ri]
        exact = (diff * diff).sum(1)
    else:
        exact = 1 - (q[qi] * r[ri]).sum(1)
    return first_k(qi, ri, exact if decimals is None else np.round(exact, decimals), k)


def first_k(qi: np.ndarray, ri: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with the k smallest (key, reference) of each query, in order."""
    order = np.lexsort((ri, key, qi))
    qi, ri, key = qi[order], ri[order], key[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], ri[keep], key[keep]


def nearest(q: np.ndarray, r: np.ndarray, own: np.ndarray | None, k: int, metric: str, decimals: int | None, single: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, reference places, measures) of each query's k nearest, in order of (measure, place).

    The measure is the squared distance, or one less the inner product of what are unit vectors then; `decimals` rounds
    it before ranking. own and single: see `tiles`. Of many vectors of few dimensions only those meet that bounds by boxes leave.
    """
    if metric == "euclidean" and q.shape[1] <= LOW and len(q) * len(r) > CELLS and len(r) > 4 * GROUP:
        yield _by_boxes(q, r, own, k, decimals, single)
        return
    for lo, part, d, slack in tiles(q, r, own, metric, decimals, single):
        qi, ri, key = ranked(part, r, d, slack, k, metric, decimals)
        yield qi + lo, ri, key


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of x in groups of at most `most`, by medians of the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        order = np.argpartition(x[own, np.ptp(x[own], axis=0).argmax()], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _by_boxes(q: np.ndarray, r: np.ndarray, own: np.ndarray | None, k: int, decimals: int | None, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `nearest`, in one piece. A group of queries meets the cells of references that may hold any of the k nearest: those
    whose box is no farther than the boxes that hold k + 1 references can be."""
    cells = halved(r, GROUP)
    low, high, held = np.array([r[c].min(0) for c in cells]), np.array([r[c].max(0) for c in cells]), np.array([len(c) for c in cells])
    need, found = min(k + 1, len(r)), []
    for g in halved(q, GROUP):
        left, right = q[g].min(0), q[g].max(0)
        gap = (np.maximum(np.maximum(low - right, left - high), 0) ** 2).sum(1)
        far = (np.maximum(high - left, right - low) ** 2).sum(1)
        first = np.argpartition(far, min(need, len(far)) - 1)[:need]
        first = first[np.argsort(far[first])]
        bar = far[first[np.searchsorted(np.cumsum(held[first]), need)]]
        met = np.sort(np.concatenate([cells[c] for c in np.flatnonzero(gap <= bar * (1 + 1e-9) + (0 if decimals is None else 2 * 10.0**-decimals))]))
        mine = None
        if own is not None:
            at = np.minimum(np.searchsorted(met, own[g]), len(met) - 1)
            mine = np.where(met[at] == own[g], at, -1)
        for lo, part, d, slack in tiles(q[g], r[met], mine, "euclidean", decimals, single):
            qi, ri, key = ranked(part, r[met], d, slack, k, "euclidean", decimals)
            found.append((g[qi + lo], met[ri], key))
    qi, ri, key = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(qi, kind="stable")
    return qi[order], ri[order], key[order]


def mutual(a: np.ndarray, b: np.ndarray, k: int, metric: str, decimals: int | None, single: bool = False) -> tuple[tuple, tuple]:
    """As `nearest` of a among b, and of b among a, from one product."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    there, back = [none], [none]
    for lo, part, d, slack in tiles(a, b, None, metric, decimals, single):
        qi, ri, key = ranked(part, b, d, slack, k, metric, decimals)
        there.append((qi + lo, ri, key))
        qi, ri, key = ranked(b, part, d.T, np.full(len(b), slack.max()), k, metric, decimals)
        back.append((qi, ri + lo, key))
    joined = lambda parts: [np.concatenate([p[i] for p in parts]) for i in range(3)]
    return tuple(joined(there)), first_k(*joined(back), k)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _side(table) -> tuple[list, np.ndarray]:
    """Ids in order and their vectors."""
    ids = table.column(0).to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    dim = len(table.column(1)[0]) if ids else 1
    return [ids[i] for i in order], _matrix(table.column(1), dim)[order]


def places(qids: list, rids: list) -> np.ndarray:
    """Where each query's id is among the references, or -1."""
    at = {x: i for i, x in enumerate(rids)}
    return np.array([at.get(x, -1) for x in qids], np.int64)


def table(qids: list, rids: list, qi: np.ndarray, ri: np.ndarray, key: np.ndarray, kinds) -> pa.Table:
    """(query_id, neighbor_id, measure) of places."""
    return pa.table([pa.array([qids[i] for i in qi.tolist()], kinds[0]), pa.array([rids[i] for i in ri.tolist()], kinds[1]), pa.array(key)], names=["query_id", "neighbor_id", "measure"])


def _matched(qids, q, rids, r, k, exclude, metric, decimals, kinds, single=False):
    """How many neighbours each query has, and all of them as (query_id, neighbor_id, measure), in order."""
    own = places(qids, rids) if exclude else None
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *nearest(q, r, own, k, metric, decimals, single)]
    qi, ri, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return np.bincount(qi, minlength=len(qids)), table(qids, rids, qi, ri, key, kinds)


def lists(queries: DataFrame, refs: DataFrame, k: int, metric: str, exclude: bool, decimals: int | None, sizes: tuple[int, int], dim: int, small: int = SMALL, same: bool = False, chunk: int | None = None, workers: int = 1, single: bool = False) -> DataFrame:
    """(query_id, near): each query's k nearest as an array of (measure, neighbor_id), nearest first.

    With small references this takes no shuffle at all: each query's list is made where the query is. same: both sides
    are one table, so where it is large each two blocks meet once, for both. chunk: queries of a product at a time, and rows of
    a block; workers: tasks of the search, where it is over 1; single: see `tiles`.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    qk, rk = dict(queries.dtypes)["id"], dict(refs.dtypes)["id"]
    shape = f"query_id {qk}, neighbor_id {rk}, measure double"
    kinds = (to_arrow_type(queries.schema["id"].dataType), to_arrow_type(refs.schema["id"].dataType))
    queries, refs = queries.select("id", "z"), refs.select("id", "z")
    if sizes[1] * dim <= small:
        held = spark.sparkContext.broadcast(_side(refs.toArrow()))
        queries = queries.repartition(workers) if workers > 1 else queries

        def ask(batches):
            for b in (part for b in batches for part in parts(b, chunk)):
                qids = b.column(0).to_pylist()
                n, t = _matched(qids, _matrix(b.column(1), dim), *held.value, k, exclude, metric, decimals, kinds, single)
                near = pa.StructArray.from_arrays([t.column(i).combine_chunks() for i in (2, 1)], ["measure", "neighbor_id"])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), near)], ["query_id", "near"])

        return queries.mapInArrow(ask, f"query_id {qk}, near array<struct<measure: double, neighbor_id: {rk}>>")
    if sizes[0] * dim <= small:
        held = spark.sparkContext.broadcast(_side(queries.toArrow()))
        refs = refs.repartition(workers) if workers > 1 else refs

        def offer(batches):
            best = None
            for b in (part for b in batches for part in parts(b, chunk)):
                _, t = _matched(*held.value, *_side(b), k, exclude, metric, decimals, kinds, single)
                best = t if best is None else pa.concat_tables([best, t])
                if len(best) > 4 * k * len(held.value[0]):
                    best = _best(best, k)
            if best is not None:
                yield from _best(best, k).to_batches()

        met = refs.mapInArrow(offer, shape)
    elif same:
        met = _met_once(queries, k, metric, exclude, decimals, -(-sizes[0] // (chunk or BLOCK)), shape, kinds, workers, single)
    else:
        nq, nr = (-(-n // (chunk or BLOCK)) for n in sizes)
        block = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
        every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        left = queries.select("id", "z", block(nq, "qb")).select("*", every(nr, "rb"))
        right = refs.select("id", "z", block(nr, "rb")).select("*", every(nq, "qb"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                # an empty side has no columns
                return table([], [], *(np.empty(0, np.int64),) * 2, np.empty(0), kinds)
            pick = lambda t: t.select(["id", "z"])
            return _matched(*_side(pick(a)), *_side(pick(b)), k, exclude, metric, decimals, kinds, single)[1]

        left, right = (d.repartition(workers, "qb", "rb") if workers > 1 else d for d in (left, right))
        met = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, shape)
    return _merged(met, k)


def parts(batch: pa.RecordBatch, chunk: int | None) -> Iterator[pa.RecordBatch]:
    """The batch, at most `chunk` rows at a time."""
    step = chunk or max(1, batch.num_rows)
    for lo in range(0, max(1, batch.num_rows), step):
        yield batch.slice(lo, step)


def _met_once(rows: DataFrame, k: int, metric: str, exclude: bool, decimals: int | None, n: int, shape: str, kinds, workers: int, single: bool) -> DataFrame:
    """Each two of n blocks of a table in one task, which finds the neighbours of either's rows in the other.

    A row is shuffled n times; were the sides dealt apart, it would be 2 n times.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")
    pairs = rows.select("id", "z", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("o"))
    pairs = pairs.select("id", "z", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def meet(t: pa.Table) -> pa.Table:
        block = np.asarray(t.column("b").combine_chunks().to_numpy())
        sides = [_side(t.filter(pa.array(block == b)).select(["id", "z"])) for b in np.unique(block)]
        if len(sides) == 1:
            # a block with itself, or with one that has no row
            alone = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            return _matched(*sides[0], *sides[0], k, exclude, metric, decimals, kinds, single)[1] if alone else table([], [], *(np.empty(0, np.int64),) * 2, np.empty(0), kinds)
        (a, x), (b, y) = sides
        there, back = mutual(x, y, k, metric, decimals, single)
        return pa.concat_tables([table(a, b, *there, kinds), table(b, a, *back, kinds)])

    pairs = pairs.repartition(workers, "lo", "hi") if workers > 1 else pairs
    return pairs.groupBy("lo", "hi").applyInArrow(meet, shape)


def _best(t: pa.Table, k: int) -> pa.Table:
    t = t.sort_by([("query_id", "ascending"), ("measure", "ascending"), ("neighbor_id", "ascending")])
    return t.filter(pa.array(nth(t.column(0)) < k))


def nth(*keys: pa.ChunkedArray) -> np.ndarray:
    """How many rows with the same keys come before each, where these stand together."""
    at = np.arange(len(keys[0]))
    new = np.zeros(len(at), bool)
    new[:1] = True
    for c in keys:
        c = c.combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def knn(queries: DataFrame, refs: DataFrame, k: int, *, metric: str = "euclidean", exclude_self: bool = False, engine: str = "auto", algorithm: str = "auto", decimals: int | None = None, allow_approx: bool = False, small: int = SMALL, sizes: tuple[int, int] | None = None, dim: int | None = None, returns: str = "both", graph_m: int = 16, graph_ef: int = 200, query_is_data: bool = False, chunk_size: int | None = None, workers: int = 1, precision: str = "double") -> DataFrame:
    """(query_id, rank, neighbor_id, dist): each query's k nearest references by (distance, id).

    queries and refs have a unique `id` and an array `z`. exclude_self leaves out the reference with the query's id;
    fewer than k references give fewer rows. metric "cosine" and "ip" are one less the inner product of the vectors
    over their norms. `decimals` rounds squared distances (or the measure) before ranking. `sizes` and `dim` save
    the jobs that find them. returns: both, index, dist. graph_m and graph_ef: see `graph` and `approximate`. query_is_data: both
    sides are one table, see `lists`. algorithm "kd_tree" and "cover_tree" search by a tree (see `tree`), and so does
    engine "FNN" by itself where the references are too many to be sent. chunk_size and workers: see `lists`. precision
    "single" makes candidates by single-precision products, with the same results.
    """
    engine = resolved_engine(engine, metric, allow_approx)
    if returns not in ("both", "index", "dist"):
        raise BalanceError("returns must be both, index or dist")
    near = neighbour_lists(queries, refs, k, metric=metric, exclude_self=exclude_self, engine=engine, decimals=decimals, small=small, sizes=sizes, dim=dim, graph_m=graph_m, graph_ef=graph_ef, algorithm=algorithm, query_is_data=query_is_data, chunk_size=chunk_size, workers=workers, precision=precision)
    out = near.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.neighbor_id", distance(F.col("x.measure"), metric).alias("dist"))
    return {"both": out, "index": out.drop("dist"), "dist": out.drop("neighbor_id")}[returns]


def distance(measure: Column, metric: str) -> Column:
    return F.sqrt(measure) if metric == "euclidean" else measure


def neighbour_lists(queries: DataFrame, refs: DataFrame, k: int, *, metric: str = "euclidean", exclude_self: bool = False, engine: str = "native", decimals: int | None = None, small: int = SMALL, sizes: tuple[int, int] | None = None, dim: int | None = None, graph_m: int = 16, graph_ef: int = 200, algorithm: str = "auto", query_is_data: bool = False, chunk_size: int | None = None, workers: int = 1, precision: str = "double", leaf: int | None = None, distinct: bool = False) -> DataFrame:
    """As `knn`, a row for each query: (query_id, near), near an array of (measure, neighbor_id), nearest first.

    Exact search of more than MANY pairs is for distinct vectors (see `repeated`), which both sides have already if `distinct`.
    Very many pairs of these in few dimensions are left to a tree, whose work grows with the vectors. leaf: references of a tree's cell.
    """
    from evenkeel.operators import graph, repeated, tree

    resolved = resolved_algorithm(algorithm, engine)
    if chunk_size is not None:
        checks.chunk_size(chunk_size)
    checks.positive_integer(workers, "workers")
    if metric != "euclidean" and algorithm in tree.KINDS:
        raise BalanceError(f"a {algorithm} knows euclidean distances only, not {metric!r}")
    if not distinct and engine not in ("RcppHNSW", "lists"):
        sizes = sizes or (queries.count(), refs.count())
        if sizes[0] * sizes[1] > MANY:
            how = {"metric": metric, "engine": engine, "decimals": decimals, "small": small, "dim": dim, "algorithm": algorithm, "chunk_size": chunk_size, "workers": workers, "precision": precision, "leaf": leaf}
            return repeated.lists(queries, refs, k, exclude_self, query_is_data, **how)
    if metric != "euclidean":
        queries, refs = (d.withColumn("z", vectors.normalized(F.col("z"))) for d in (queries, refs))
    if engine == "RcppHNSW":
        return graph.searched(queries, refs, k, metric, exclude_self, decimals, graph_m, graph_ef)
    if engine == "lists":
        checks.graph_parameters(graph_m, graph_ef)
        return approximate(queries, refs, k, metric, exclude_self, decimals, graph_m, graph_ef)
    if dim is None:
        one = refs.select(F.size("z").alias("d")).limit(1).collect()
        dim = one[0].d if one else 1
    sizes = sizes or (queries.count(), refs.count())
    vast = distinct and metric == "euclidean" and dim <= LOW and sizes[0] * sizes[1] > DEALT
    if algorithm in tree.KINDS or vast or (resolved in tree.KINDS and metric == "euclidean" and sizes[1] * dim > small):
        return tree.searched(queries, refs, k, exclude_self, decimals, sizes, dim, resolved if resolved in tree.KINDS else "kd_tree", leaf or tree.LEAF)[0]
    return lists(queries, refs, k, metric, exclude_self, decimals, sizes, dim, small, query_is_data, chunk_size, workers, checks.precision(precision) == "single")


def _centroids(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of x by rounds of k-means from evenly chosen rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(np.int64)].copy()
    for _ in range(rounds):
        at = _order(x, c, 1)[:, 0]
        size = np.bincount(at, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _order(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The places of each row's n nearest centroids, nearest first."""
    out, cc, step = [], (c * c).sum(1), max(1, CELLS // len(c))
    for lo in range(0, len(x), step):
        d = cc[None, :] - 2 * (x[lo : lo + step] @ c.T)
        some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def approximate(queries: DataFrame, refs: DataFrame, k: int, metric: str, exclude: bool, decimals: int | None = None, m: int = 16, ef: int = 200) -> DataFrame:
    """As `neighbour_lists`, among the references of the coarse lists that are nearest to the query.

    References lie in the list of their nearest centroid, 16 m to a list on average (more beyond LISTS lists). A query
    meets the nearest lists that hold 8 ef references between them, or 8 k, so k are found where there are as many. A
    list that many rows lie in or ask for is dealt into blocks, each two of which meet in one task.
    """
    spark = queries.sparkSession
    queries, refs = queries.select("id", "z"), refs.select("id", "z")
    n, dim = refs.agg(F.count(F.lit(1)), F.max(F.size("z"))).first()
    qk, rk = dict(queries.dtypes)["id"], dict(refs.dtypes)["id"]
    if not n:
        return queries.limit(0).select(F.col("id").alias("query_id"), F.lit(None).cast(f"array<struct<measure: double, neighbor_id: {rk}>>").alias("near"))
    wanted = max(1, min(n // (16 * m), LISTS, SMALL // (4 * dim)))
    share = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    sample = refs.where(share < min(1 << 30, -(-(8 * wanted << 30) // n))).select("id", "z").limit(16 * wanted).toArrow()
    x = _side(sample)[1] if len(sample) else np.zeros((1, dim))
    held = spark.sparkContext.broadcast(_centroids(x, wanted))

    def place(batches):
        for b in batches:
            at = _order(_matrix(b.column(1), dim), held.value, 1)[:, 0] if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], ["id", "z", "list"])

    right = shared.checkpointed(refs.mapInArrow(place, f"id {rk}, z array<double>, list int"))
    sizes = np.zeros(wanted, np.int64)
    for r in right.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    counts, need = spark.sparkContext.broadcast(sizes), min(n, 8 * max(ef, k + 1))

    def ask(batches):
        for b in batches:
            z = _matrix(b.column(1), dim) if b.num_rows else np.empty((0, dim))
            some = min(wanted, 64)
            order = _order(z, held.value, some)
            if some < wanted and len(z) and counts.value[order].sum(1).min() < need:
                order = _order(z, held.value, wanted)
            before = np.cumsum(counts.value[order], axis=1) - counts.value[order]
            lists_ = [o[(s < need) & (counts.value[o] > 0)].astype(np.int32) for o, s in zip(order, before, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists_, pa.list_(pa.int32()))], ["id", "z", "lists"])

    left = shared.checkpointed(queries.mapInArrow(ask, f"id {qk}, z array<double>, lists array<int>"))
    left = left.select("id", "z", F.explode("lists").alias("list"))
    return _merged(met_in_lists(left, right, sizes, k, metric, exclude, decimals), k)


def met_in_lists(left: DataFrame, right: DataFrame, sizes: np.ndarray, k: int, metric: str, exclude: bool, decimals: int | None) -> DataFrame:
    """(query_id, neighbor_id, measure): the k nearest of each query in each list, from (id, z, list) of both sides.

    sizes: the references of each list. Lists that many rows lie in or ask for are dealt into blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, qk, rk = left.sparkSession, dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    # no more rows than there are lists
    blocks = [(r["list"], -(-r["count"] // BLOCK), int(-(-sizes[r["list"]] // BLOCK))) for r in left.groupBy("list").count().collect()]
    shape = F.broadcast(spark.createDataFrame(blocks, "l int, nq long, nr long"))
    block = lambda c: F.pmod(F.xxhash64("id", F.lit(23)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    in_list = F.col("list") == F.col("l")
    left = left.join(shape, in_list).select("id", "z", "list", block("nq").alias("qb"), every("nr").alias("rb"))
    right = right.join(shape, in_list).select("id", "z", "list", block("nr").alias("rb"), every("nq").alias("qb"))
    kinds = (to_arrow_type(left.schema["id"].dataType), to_arrow_type(right.schema["id"].dataType))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            # an empty side has no columns
            return table([], [], *(np.empty(0, np.int64),) * 2, np.empty(0), kinds)
        pick = lambda t: t.select(["id", "z"])
        return _matched(*_side(pick(a)), *_side(pick(b)), k, exclude, metric, decimals, kinds)[1]

    key = ["list", "qb", "rb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"query_id {qk}, neighbor_id {rk}, measure double")


def _merged(met: DataFrame, k: int) -> DataFrame:
    """(query_id, near) from the best of each block."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("measure", "neighbor_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("measure", "neighbor_id"))).alias("near"))


def drop_self(neighbors: DataFrame, k: int) -> DataFrame:
    """From (query_id, rank, neighbor_id) rows: without each query's own id, ranked anew, the first k; raises if fewer are left."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("old"))
    out = neighbors.where(F.col("query_id") != F.col("neighbor_id")).withColumnRenamed("rank", "old").withColumn("rank", rank).where(F.col("rank") <= k).drop("old")
    asked = neighbors.select("query_id").distinct().count()
    if out.groupBy("query_id").count().where(F.col("count") == k).count() < asked:
        raise BalanceError(f"a query has fewer than {k} neighbours besides itself")
    return out
