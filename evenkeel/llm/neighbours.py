"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking.

A residual is coded as its length, in single precision, and its direction, so that vectors which lie close together, whose
residuals are short, are told apart as well as others. Centroids and code books are fitted on at most `SAMPLE` vectors (by the ids' hashes; documented bound); every vector is
indexed. Lists are found in a space with one more dimension, in which the nearest vector is the one with the largest
inner product. Lists that lie near each other share a cell of about `CHUNK` rows; a larger list, as of a vector with very
many copies, is dealt over cells of its own. A query goes to the cells that hold a list that it probes, and to no other;
there the estimates of these lists' rows are made, and the `RERANK` best for each one wanted are ranked again by their
vectors: as many rows of a cell, whatever its size and the table's. So what is shuffled
are the index, once for each `BLOCK` queries, and each query once for each cell that it probes; no task holds more than a
cell and a block. Of equal vectors in a cell only the TOP + 1 smallest ids can be in an answer; the others are left out
before anything is scored.

`PROBE` is the share of lists that a query reads. Vectors without structure have neighbours in most lists, so it is
high: recall against brute force on them is over 0.95; for clustered vectors a few hundredths do. Where the probed
lists hold too few candidates, further ones are read, so that no query gets fewer than `TOP` while there are more.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
with a null id or another length than most sampled vectors have. Rows that share an id are not neighbours of each
other; equal rows count once, and a query whose id has several vectors asks with the smallest. An empty table gives an empty table. Ties go to smaller ids. Only the id and vector
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm import kit

SAMPLE, LISTS, CODES, WIDTH = 16_384, 256, 256, 2
CHUNK, BLOCK = 8192, 16_384
PROBE, RERANK, TOP = 0.75, 5, 20
#: Queries, and rows, whose estimates are made at a time.
QUERIES, ROWS = 64, 1024


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(at, x[:, d], minlength=len(c)) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
    return c


def parted(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions of residuals; the direction of none is zero."""
    length = np.sqrt((rest * rest).sum(axis=1))
    return length.astype(np.float32), (rest / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


class Index:
    """Centroids (with the added dimension) and code books of the residuals."""

    def __init__(self, dim: int, square: float, centroids: np.ndarray | None = None, books=()):
        self.dim, self.square, self.centroids, self.books = dim, square, centroids, books

    def fit(self, sample: np.ndarray) -> Index:
        # copies of one vector would take up centroids and codes
        sample = np.unique(sample, axis=0)
        wide = self.widened(sample)
        self.centroids = k_means(wide, max(1, min(LISTS, int(len(sample) ** 0.5) * 2)))
        rest = sample - self.centroids[nearest(wide, self.centroids), : self.dim]
        # half of a full sample has 32 residuals for each code
        rest = parted(rest[:: max(1, len(rest) * 2 // SAMPLE)])[1]
        self.books = [k_means(rest[:, s : s + WIDTH], CODES) for s in range(0, self.dim, WIDTH)]
        return self

    def widened(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0.0))])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, lengths of the residuals and codes of their directions."""
        lists = nearest(self.widened(x), self.centroids)
        length, rest = parted(x - self.centroids[lists, : self.dim])
        codes = [nearest(rest[:, i * WIDTH : (i + 1) * WIDTH], b) for i, b in enumerate(self.books)]
        return lists.astype(np.int32), length, np.column_stack(codes).astype(np.uint8)

    def probed(self, q: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
        """For each query and list whether it is probed; `size` has the lists' rows.

        Further lists are probed until they hold `least` rows or none is left.
        """
        near = q @ self.centroids[:, : self.dim].T
        probes = max(1, int(np.ceil(PROBE * len(self.centroids))))
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
        short = np.flatnonzero((out * size).sum(axis=1) < least)
        if len(short):
            by = np.argsort(-near[short], axis=1, kind="stable")
            before = np.cumsum(size[by], axis=1) - size[by]
            more = np.zeros((len(short), len(size)), bool)
            np.put_along_axis(more, by, before < least, axis=1)
            out[short] |= more
        return out

    def search(self, lists: np.ndarray, length: np.ndarray, codes: np.ndarray, q: np.ndarray, probed: np.ndarray, depth: int):
        """For each query the places of the `depth` rows with the largest estimates in the lists that it probes."""
        near = (q @ self.centroids[:, : self.dim].T).astype(np.float32)
        codes = np.ascontiguousarray(codes.T).astype(np.intp)
        # queries of one list probe much the same lists
        order = np.argsort(near.argmax(axis=1), kind="stable")
        for lo in range(0, len(q), QUERIES):
            own = order[lo : lo + QUERIES]
            hit = probed[own].T
            rows = np.flatnonzero(hit.any(axis=1)[lists])
            # a row of a table has all queries' products with one code
            tables = [b.astype(np.float32) @ q[own, i * WIDTH : (i + 1) * WIDTH].T.astype(np.float32) for i, b in enumerate(self.books)]
            estimate = np.empty((len(own), len(rows)), np.float32)
            for s in range(0, len(rows), ROWS):
                part = rows[s : s + ROWS]
                x, one = np.zeros((len(part), len(own)), np.float32), np.empty((len(part), len(own)), np.float32)
                for i, t in enumerate(tables):
                    x += np.take(t, codes[i, part], axis=0, out=one, mode="clip")
                x *= length[part, None]
                x += near[own].T[lists[part]]
                x[~hit[lists[part]]] = -np.inf
                estimate[:, s : s + ROWS] = x.T
            n = min(depth, len(rows))
            for i, e in zip(own.tolist(), estimate, strict=True):
                best = np.argpartition(-e, n - 1)[:n] if n else np.empty(0, np.intp)
                yield i, rows[best[e[best] > -np.inf]]


def cells(centroids: np.ndarray, size: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first cell and how many cells it has: its own ones if it is large, else one that near lists share.

    Each next list is the nearest of those left, so a cell's lists tend to be probed together.
    """
    begin, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // chunk))
    left, at, cell, held = np.ones(len(size), bool), 0, 0, 0
    while left.any():
        left[at] = False
        if parts[at] > 1:
            begin[at] = cell + (held > 0)
            cell, held = begin[at] + parts[at], 0
        else:
            if held + size[at] > chunk:
                cell, held = cell + 1, 0
            begin[at] = cell
            held += size[at]
        if left.any():
            rest = np.flatnonzero(left)
            at = rest[np.argmin(((centroids[rest] - centroids[at]) ** 2).sum(axis=1))]
    return begin, parts


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col("__v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).alias("__id"), F.col(vector).cast("array<double>").alias("__v")).where(F.col("__id").isNotNull() & fine)


def search(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of every row for which is_query(id column) holds."""
    rows = usable(df, vec_id, vector)
    kind = dict(rows.dtypes)["__id"]
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double"
    spark = df.sparkSession
    sizes = rows.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], shape)
    dim = sizes[0].d
    rows = rows.where(F.size("__v") == dim)
    n, asked, square = rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("__id"))), F.max(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))).first()
    # by a threshold first, so that no task gathers SAMPLE rows of each other one
    likely = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * SAMPLE / n + 64 / n) * (1 << 30)))
    sample = rows.where(likely).orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)), "__id").limit(SAMPLE).select("__v").toArrow()
    sample = sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    fitted = Index(dim, float(square)).fit(sample)
    # plain arrays, of a size that the parameters fix
    held = spark.sparkContext.broadcast((dim, fitted.square, fitted.centroids, fitted.books))

    def encode(batches):
        index = Index(*held.value)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            lists, length, codes = index.encode(x) if len(x) else (np.empty(0, np.int32), np.empty(0, np.float32), np.empty((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists), pa.array(length), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["__id", "__list", "__length", "__code", "__vector"])

    lists_ = len(fitted.centroids)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        none = pa.table([pa.array([], right.schema.field("__id").type), pa.array([], left.schema.field("__id").type), pa.array([], pa.float64())], names=names)
        if not len(left) or not len(right):
            return none
        left = left.sort_by("__id")
        ids, raw = left.column("__id").to_pylist(), left.column("__vector").to_pylist()
        copies: dict[bytes, list[int]] = {}
        for i, v in enumerate(raw):
            own = copies.setdefault(v, [])
            if len(own) <= top:
                own.append(i)
        first = np.array([own[0] for own in copies.values()])
        x = np.frombuffer(b"".join(copies), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(left.column("__code").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(first), -1)
        lists, length = left.column("__list").to_numpy()[first], left.column("__length").to_numpy()[first]
        q = np.frombuffer(b"".join(right.column("__vector").to_pylist()), np.float64).reshape(-1, dim)
        probed = np.unpackbits(np.frombuffer(b"".join(right.column("__probed").to_pylist()), np.uint8).reshape(len(q), -1), axis=1, count=lists_).astype(bool)
        asks, groups, out = right.column("__id").to_pylist(), list(copies.values()), []
        for i, found in Index(*held.value).search(lists, length, codes, q, probed, RERANK * top):
            exact = (x[found] * q[i]).sum(axis=1)
            took = []
            for k in np.argsort(-exact, kind="stable"):
                if len(took) >= top and exact[k] < took[-1][0]:
                    break
                took += [(float(exact[k]), ids[j]) for j in groups[found[k]] if ids[j] != asks[i]]
            took.sort(key=lambda r: (-r[0], r[1]))
            out += [(asks[i], v, s) for s, v in took[:top]]
        return pa.table([pa.array([r[c] for r in out], none.schema.field(c).type) for c in range(3)], names=names)

    index = kit.checkpointed(rows.mapInArrow(kit.lean(encode), f"__id {kind}, __list int, __length float, __code binary, __vector binary"))
    # no more rows than there are lists
    size = np.zeros(len(fitted.centroids), np.int64)
    for r in index.groupBy("__list").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["__list"]] = r.n
    begin, parts = cells(fitted.centroids, size, CHUNK)
    cell = F.get(F.array(*[F.lit(int(x)) for x in begin]), F.col("__list")) + F.pmod(F.xxhash64("__id", F.lit(1)), F.get(F.array(*[F.lit(int(x)) for x in parts]), F.col("__list"))).cast("int")
    # a query's own rows are no candidates
    own = rows.where(is_query(F.col("__id"))).groupBy("__id").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__v"))
    least = top + (own.agg(F.max("n")).first()[0] or 0)
    goals = [np.arange(b, b + k, dtype=np.int32) for b, k in zip(begin.tolist(), parts.tolist(), strict=True)]

    def route(batches):
        index = Index(*held.value)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            probed = index.probed(x, size, least) if len(x) else np.zeros((0, len(size)), bool)
            to = [np.unique(np.concatenate([goals[c] for c in np.flatnonzero(p & (size > 0))])).tolist() for p in probed]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([np.packbits(p).tobytes() for p in probed], pa.binary()), pa.array(to, pa.list_(pa.int32()))], ["__id", "__vector", "__probed", "__to"])

    blocks = max(1, -(-asked // BLOCK))
    left = index.withColumn("cell", cell).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = own.select("__id", "__v").mapInArrow(kit.lean(route), f"__id {kind}, __vector binary, __probed binary, __to array<int>")
    right = right.select("__id", "__vector", "__probed", F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode("__to").alias("cell"))
    met = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
