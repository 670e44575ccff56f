"""Approximate search by layered neighbour graphs, one for each shard of the references.

References that lie near each other share a shard of some `SHARD` rows, whose graph is built once, in the task that gathers the
shard, from its distinct vectors. Every vector is in the lowest layer, one in m of a layer in the next one. In its layers a
vector is joined to m others (2 m in the lowest): the nearest ones of which none is nearer to another of them than to it,
so that links also lead away, and then to those that chose it. A search goes down from the uppermost layer and
keeps the ef best vectors that it has met, going on from the nearest of them until none is left to go on from. Larger m and ef
find more of the true neighbours, by more distances; in each of n shards a search keeps ef / sqrt(n). A query goes to every shard whose border is no farther from it than its
k nearest references seem to be, by a sample: few where vectors lie in groups, nearly all where they have no structure. Copies of
a vector are one node with many ids, so very common vectors neither crowd a graph nor a list.

A task has a block of queries and a bundle of graphs, and keeps a query's k best of all its graphs. Both grow with the table, as
far as a task can hold them, so a query is sent once to each bundle, and a graph once to each block, not to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import checks, knn
from evenkeel.sources import shared

#: References of a shard on average; beyond twice that a shard is dealt into parts. Queries of a block at least.
SHARD, ASKS = 8192, 16_384
#: Graphs of a bundle at most, one bit of a long each. Blocks times bundles, before either is made larger.
BUNDLE, TASKS = 62, 96
#: Shards that may be told apart, and queries that go through a graph side by side.
SHARDS, SIDE = 16_384, 256
#: Nodes that a search goes on from at a time, and that it starts from in a layer.
STEP, STARTS = 4, 8


class Layers:
    """The graph of a shard's distinct vectors."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers, self.distances = x, layers, 0

    @classmethod
    def built(cls, x: np.ndarray, m: int) -> Layers:
        u = (np.arange(len(x), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64)
        level = np.floor(-np.log((u + 0.5) / 2**53) / np.log(m)).astype(np.int64)
        layers, nodes = [], np.arange(len(x))
        while True:
            # the uppermost layer is looked at as a whole
            if len(nodes) <= 2 * m and layers:
                layers.append((nodes, np.empty((0, 0), np.int32)))
                break
            layers.append((nodes, linked(x[nodes], 2 * m if not layers else m)))
            higher = nodes[level[nodes] >= len(layers)]
            nodes = higher if len(higher) else nodes[:1]
        return cls(x, layers)

    def packed(self) -> list[dict]:
        return [{"nodes": n.astype(np.int32).tobytes(), "links": e.tobytes(), "width": int(e.shape[1])} for n, e in self.layers]

    @classmethod
    def unpacked(cls, x: np.ndarray, rows: list[dict]) -> Layers:
        layers = [(np.frombuffer(r["nodes"], np.int32).astype(np.int64), np.frombuffer(r["links"], np.int32).reshape(-1, r["width"]) if r["width"] else np.empty((0, 0), np.int32)) for r in rows]
        return cls(x, layers)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes met last that are nearest to each query, and their squared distances; -1 and inf where there are fewer than ef."""
        top = self.layers[-1][0]
        near = ((q[:, None] - self.x[top][None]) ** 2).sum(axis=2)
        self.distances += near.size
        first = np.argsort(near, axis=1, kind="stable")[:, :STARTS]
        at, far = top[first], np.take_along_axis(near, first, 1)
        for i, (nodes, links) in reversed(list(enumerate(self.layers[:-1]))):
            # a group of vectors that no link of a layer leads to is found from above
            place = np.where(at >= 0, np.searchsorted(nodes, at), -1)
            at, far = self._beam(q, self.x[nodes], links, place, far, min(ef if i == 0 else 2 * STARTS, len(nodes)))
            at = np.where(at >= 0, nodes[at], -1)
            if i:
                at, far = at[:, :STARTS], far[:, :STARTS]
        return at, far

    def _beam(self, q, x, links, start, far, ef):
        at, d = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf)
        n = min(start.shape[1], ef)
        at[:, :n], d[:, :n] = start[:, :n], far[:, :n]
        gone = np.zeros(at.shape, bool)
        seen = np.zeros((len(q), len(x)), bool)
        i, j = np.nonzero(start >= 0)
        seen[i, start[i, j]] = True
        live = np.arange(len(q))
        while len(live):
            left = np.where(gone[live] | (at[live] < 0), np.inf, d[live])
            some = np.argsort(left, axis=1, kind="stable")[:, :STEP]
            fine = np.isfinite(np.take_along_axis(left, some, 1))
            keep = fine.any(axis=1)
            live, some, fine = live[keep], some[keep], fine[keep]
            if not len(live):
                break
            done = gone[live]
            np.put_along_axis(done, some, np.take_along_axis(done, some, 1) | fine, axis=1)
            gone[live] = done
            to = links[np.where(fine, np.take_along_axis(at[live], some, 1), 0)]
            to = np.where(fine[:, :, None], to, -1).reshape(len(live), -1)
            to = np.sort(to, axis=1)
            new = (to >= 0) & ~np.take_along_axis(seen[live], np.maximum(to, 0), 1)
            new[:, 1:] &= to[:, 1:] != to[:, :-1]
            qi, ci = np.nonzero(new)
            seen[live[qi], to[qi, ci]] = True
            e = np.full(to.shape, np.inf)
            e[qi, ci] = ((x[to[qi, ci]] - q[live[qi]]) ** 2).sum(axis=1)
            self.distances += len(qi)
            all_at, all_d = np.concatenate([at[live], np.where(new, to, -1)], axis=1), np.concatenate([d[live], e], axis=1)
            all_gone = np.concatenate([gone[live], np.zeros(to.shape, bool)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            at[live], d[live], gone[live] = (np.take_along_axis(v, order, 1) for v in (all_at, all_d, all_gone))
        return at, d


def linked(x: np.ndarray, width: int) -> np.ndarray:
    """For each row the places that it is joined to, -1 where there are fewer: `width` of its own choice, half as many that chose it."""
    n, c = len(x), min(len(x) - 1, 2 * width)
    if c < 1:
        return np.full((n, 1), -1, np.int32)
    near, far = np.empty((n, c), np.int64), np.empty((n, c))
    for qi, ri, key in knn.nearest(x, x, np.arange(n), c, "euclidean", None):
        rows = qi.reshape(-1, c)[:, 0]
        near[rows], far[rows] = ri.reshape(-1, c), key.reshape(-1, c)
    own = np.full((n, width), -1, np.int64)
    for lo in range(0, n, 512):
        part, count = slice(lo, min(lo + 512, n)), np.zeros(min(lo + 512, n) - lo, np.int64)
        mine, taken = np.full((len(count), width), -1, np.int64), np.zeros((len(count), c), bool)
        for j in range(c):
            to = near[part, j]
            gap = ((x[to][:, None] - x[np.maximum(mine, 0)]) ** 2).sum(axis=2)
            ok = ((gap >= far[part, j][:, None]) | (mine < 0)).all(axis=1) & (count < width)
            mine[ok, count[ok]] = to[ok]
            taken[:, j] = ok
            count += ok
        # what is left of a row's places goes to the nearest of the others
        for j in range(c):
            ok = ~taken[:, j] & (count < width)
            mine[ok, count[ok]] = near[part, j][ok]
            count += ok
        own[part] = mine
    i, j = np.nonzero(own >= 0)
    to = own[i, j]
    order = np.lexsort((((x[i] - x[to]) ** 2).sum(axis=1), to))
    i, to = i[order], to[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((n, max(1, width // 2)), -1, np.int64)
    few = nth < back.shape[1]
    back[to[few], nth[few]] = i[few]
    return np.concatenate([own, back], axis=1).astype(np.int32)


def reached(q: np.ndarray, centres: np.ndarray, sample: np.ndarray, nth: int) -> np.ndarray:
    """Which shards, of the rows nearest to their centres, may hold rows as near to each query as the nth nearest of the sample."""
    if nth > len(sample):
        return np.ones((len(q), len(centres)), bool)
    out, step = np.empty((len(q), len(centres)), bool), max(1, knn.CELLS // len(sample))
    cc, ss = (centres * centres).sum(1), (sample * sample).sum(1)
    between = np.sqrt(np.maximum(cc[:, None] + cc[None] - 2 * centres @ centres.T, 0))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        qq = (part * part).sum(1)[:, None]
        far = np.partition(qq + ss - 2 * part @ sample.T, nth - 1, axis=1)[:, nth - 1 : nth]
        d = qq + cc - 2 * part @ centres.T
        own = d.argmin(1)
        # twice the distance to the plane midway between the nearest centre and another, times that of the two
        border = d - np.take_along_axis(d, own[:, None], 1)
        slack = 1e-9 * (qq + cc.max() + ss.max())
        out[lo : lo + step] = border <= 2 * between[own] * np.sqrt(np.maximum(far, 0) + slack) + slack
    return out


def kept(ef: int, k: int, of: int) -> int:
    """How many vectors a search keeps in each of the shards that a query goes to: ef in one, more in all of several."""
    return max(min(ef, 4 * k), int(np.ceil(ef / np.sqrt(of))))


def bundled(counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """(shard, part, bundle, slot) of each graph, from each shard's references; graphs of some `size` references share a bundle."""
    out, bundle, slot, held = [], 0, 0, 0
    for shard, n in sorted(counts):
        parts = max(1, n // SHARD)
        for part in range(parts):
            if slot == BUNDLE or (slot and held + n / parts > size):
                bundle, slot, held = bundle + 1, 0, 0
            out.append((shard, part, bundle, slot))
            slot, held = slot + 1, held + n / parts
    return out


def sent(to: np.ndarray, graphs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, bundles, slots as bits), by query and bundle, from the shards that each query goes to (`reached`) and `bundled` graphs."""
    first = np.searchsorted(graphs[:, 0], np.arange(to.shape[1] + 1))
    qi, si = np.nonzero(to)
    many = np.diff(first)[si]
    at = np.repeat(first[si] - np.cumsum(many) + many, many) + np.arange(many.sum())
    qi = np.repeat(qi, many)
    order = np.lexsort((graphs[at, 2], qi))
    qi, bundle, bit = qi[order], graphs[at, 2][order], (1 << graphs[at, 3])[order]
    new = np.flatnonzero(np.r_[True, (qi[1:] != qi[:-1]) | (bundle[1:] != bundle[:-1])][: len(qi)])
    return qi[new], bundle[new], np.add.reduceat(bit, new) if len(new) else bit


def searched(queries: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", exclude: bool = False, decimals: int | None = None, m: int = 16, ef: int = 200) -> DataFrame:
    """(query_id, near), see `knn.lists`: k near references of each query by graphs with m links, ef vectors kept in a search.

    queries and refs: (id, z), unit vectors if the metric isn't Euclidean.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    checks.graph_parameters(m, ef)
    spark = queries.sparkSession
    queries, refs = queries.select("id", "z"), refs.select("id", "z")
    n, dim = refs.agg(F.count(F.lit(1)), F.max(F.size("z"))).first()
    qk, rk = dict(queries.dtypes)["id"], dict(refs.dtypes)["id"]
    if not n:
        return queries.limit(0).select(F.col("id").alias("query_id"), F.lit(None).cast(f"array<struct<measure: double, neighbor_id: {rk}>>").alias("near"))
    ef = min(max(ef, k + exclude), n)
    wanted = max(1, min(-(-n // SHARD), SHARDS, knn.SMALL // (8 * dim)))
    share = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30))
    sample = refs.where(share < min(1 << 30, -(-(64 * wanted << 30) // n))).limit(128 * wanted).toArrow()
    x = knn._side(sample)[1] if len(sample) else np.zeros((1, dim))
    held = spark.sparkContext.broadcast(knn._centroids(x, min(wanted, len(x))))
    wanted = len(held.value)

    # of the sample as many as k and the query itself are of all, and one more, since a sample errs
    few = x[np.linspace(0, len(x) - 1, min(len(x), max(1, knn.SMALL // dim))).astype(np.int64)]
    nth, probes = -(-k * len(few) // n) + 1 + exclude, spark.sparkContext.broadcast(few)

    def place(batches):
        for b in batches:
            z = knn._matrix(b.column(1), dim) if b.num_rows else np.empty((0, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(knn._order(z, held.value, 1)[:, 0].astype(np.int32))], ["id", "z", "shard"])

    def ask(batches):
        for b in batches:
            z = knn._matrix(b.column(1), dim) if b.num_rows else np.empty((0, dim))
            to = reached(z, held.value, probes.value, nth)
            qi, bundle, slots = sent(to, places.value)
            ends = pa.array(np.searchsorted(qi, np.arange(b.num_rows + 1)).astype(np.int32))
            there = pa.StructArray.from_arrays([pa.array(bundle), pa.array(slots)], ["bundle", "slots"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to.sum(axis=1)), pa.ListArray.from_arrays(ends, there)], ["id", "z", "of", "to"])

    dealt = refs.mapInArrow(place, f"id {rk}, z array<double>, shard int")
    dealt = shared.checkpointed(dealt)
    # no more rows than there are graphs
    counts = [(r.shard, r.n) for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    asks, most = queries.count(), knn.SMALL // dim
    block = max(1, -(-asks // max(ASKS, min(most, int(np.sqrt(n * asks / TASKS))))))
    bundles = bundled(counts, max(SHARD, min(most, n * block // TASKS)))
    places = spark.sparkContext.broadcast(np.array(bundles, np.int64))
    sizes = F.broadcast(spark.createDataFrame([(s, max(1, c // SHARD)) for s, c in counts], "s int, parts long"))
    dealt = dealt.join(sizes, F.col("shard") == F.col("s")).select("id", "z", "shard", F.pmod(F.xxhash64("id", F.lit(37)), F.col("parts")).alias("part"))
    arrow = (to_arrow_type(queries.schema["id"].dataType), to_arrow_type(refs.schema["id"].dataType))
    layer = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary()), ("width", pa.int32())]))

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, z = knn._side(t.select(["id", "z"]))
        raw: dict[bytes, list] = {}
        for i, v in zip(ids, z, strict=True):
            raw.setdefault((v + 0.0).tobytes(), []).append(i)
        cells = b"".join(raw)
        graph = Layers.built(np.frombuffer(cells, np.float64).reshape(-1, dim), m)
        row = [[key[0].as_py()], [key[1].as_py()], [list(raw.values())], [cells], [graph.packed()]]
        types = (pa.int32(), pa.int64(), pa.list_(pa.list_(arrow[1])), pa.binary(), layer)
        return pa.table([pa.array(c, ty) for c, ty in zip(row, types, strict=True)], names=["shard", "part", "ids", "cells", "layers"])

    graphs = dealt.groupBy("shard", "part").applyInArrow(build, f"shard int, part long, ids array<array<{rk}>>, cells binary, layers array<struct<nodes: binary, links: binary, width: int>>")
    graphs = shared.checkpointed(graphs)
    near = queries.mapInArrow(ask, f"id {qk}, z array<double>, of long, to array<struct<bundle: long, slots: long>>").select("id", "z", "of", F.explode("to").alias("to")).select("id", "z", "of", "to.*")
    near = near.withColumn("asks", F.pmod(F.xxhash64("id", F.lit(41)), F.lit(block)))
    spots = F.broadcast(spark.createDataFrame(bundles, "s int, p long, bundle long, slot int"))
    graphs = graphs.join(spots, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select("ids", "cells", "layers", "bundle", "slot")
    graphs = graphs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))).alias("asks"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "neighbor_id", "measure"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], arrow[0]), pa.array([], arrow[1]), pa.array([], pa.float64())], names=names)
        a = a.sort_by("of")
        qids, q, of, slots = a.column("id").to_pylist(), knn._matrix(a.column("z"), dim), a.column("of").to_numpy(), a.column("slots").to_numpy()
        # of a vector's copies only the k smallest ids can be in an answer
        copies = [[c[: k + 1] for c in ids.as_py()] for ids in b.column("ids")]
        rids = sorted({c for some in copies for ids in some for c in ids})
        place = {c: i for i, c in enumerate(rids)}
        best, far = np.full((len(q), k), len(rids)), np.full((len(q), k), np.nan)
        for g in range(len(b)):
            one = b.slice(g, 1)
            x = np.frombuffer(one.column("cells")[0].as_py(), np.float64).reshape(-1, dim)
            graph = Layers.unpacked(x, one.column("layers")[0].as_py())
            own = np.flatnonzero(slots >> one.column("slot")[0].as_py() & 1)
            for lo in range(0, len(own), SIDE):
                some = own[lo : lo + SIDE]
                at, _ = graph.search(q[some], min(kept(ef, k + exclude, int(of[some[0]])), len(x)))
                more, gap = np.full((len(some), k), len(rids)), np.full((len(some), k), np.nan)
                for i, row in enumerate(at):
                    row = row[row >= 0]
                    v, name = q[some[i]], qids[some[i]]
                    d = ((x[row] - v) ** 2).sum(axis=1) if metric == "euclidean" else 1 - (x[row] * v).sum(axis=1)
                    d = d if decimals is None else np.round(d, decimals)
                    found = sorted((y, place[c]) for y, node in zip(d.tolist(), row.tolist(), strict=True) for c in [c for c in copies[g][node] if not exclude or c != name][:k])[:k]
                    more[i, : len(found)], gap[i, : len(found)] = [c for _, c in found], [y for y, _ in found]
                more, gap = np.concatenate([best[some], more], axis=1), np.concatenate([far[some], gap], axis=1)
                order = np.lexsort((more, gap), axis=1)[:, :k]
                best[some], far[some] = np.take_along_axis(more, order, 1), np.take_along_axis(gap, order, 1)
        i, j = np.nonzero(best < len(rids))
        return pa.table([a.column("id").take(pa.array(i)), pa.array(rids, arrow[1]).take(pa.array(best[i, j])), pa.array(far[i, j])], names=names)

    # a block and a bundle to a task, as far as hashing goes
    key, tasks = ["bundle", "asks"], min(2000, 4 * block * (bundles[-1][2] + 1))
    near, graphs = (t.repartition(tasks, *key) for t in (near, graphs))
    return knn._merged(near.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInArrow(meet, f"query_id {qk}, neighbor_id {rk}, measure double"), k)
