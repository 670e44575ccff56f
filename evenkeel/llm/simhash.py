"""SimHash near-duplicates by BK-trees, whose children are keyed by the Hamming distance to their parent.

Trees are built over shards of fingerprints, and each tree goes to the task that holds all fingerprints which could
match in it. Sending every tree to every task would make what is sent grow with the corpus and the work with its
square. Two ways of sharding:

* by bits (`link_bits`): of radius + 2 blocks of a fingerprint, two fingerprints within the radius have at least two
  equal blocks, so shards of equal block pairs lose no link. A shard over `SHARD` fingerprints is linked without a
  tree: two fingerprints within two bits share one that differs from each by one bit or none, so all are grouped by
  their 65 such neighbours, which is exact and keeps groups at 65 rows.
* by shingle minima (`near_copies`), for a similarity of 0.8, at which fingerprints differ in ten bits on average and
  bits don't shard any more.

Defined results: null, empty and white texts have fingerprint zero and are linked to each other like any others.
Rows that share an id are one document. A null id has no say in what the smallest id is; a group of null ids only has
a null one. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import graph, kit, text

#: Largest shard that becomes one BK-tree.
SHARD = 4096
#: Bytes of text worked on at a time.
PIECE = 1 << 20


class BKTree:
    """Values under the Hamming distance; a child's key is its distance to its parent."""

    def __init__(self):
        self.root = None

    def add(self, value: int, tag=None) -> None:
        node = (value, tag, {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            if d not in at[2]:
                at[2][d] = node
                return
            at = at[2][d]

    def within(self, value: int, radius: int):
        """(value, tag) of all members at most `radius` bits away, along edges of d - radius to d + radius only."""
        todo = [self.root] if self.root else []
        while todo:
            v, tag, children = todo.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                yield v, tag
            todo += [c for k, c in children.items() if d - radius <= k <= d + radius]


class Forest:
    """Union-find over the members of one shard."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def fingerprinted(df: DataFrame, id_col: str, text_col: str, k: int, seed: int = 42) -> DataFrame:
    """(__id, __fp) of every row: SimHash of the lower-cased k-word shingles, repeats included."""

    def run(batches):
        for b in batches:
            for lo, hi in text.runs(pa.compute.binary_length(b.column(1)).fill_null(0).to_pylist(), PIECE):
                part = b.slice(lo, hi - lo)
                fp = text.fingerprints(*text.shingles(part.column(1).to_pylist(), k, seed))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["__id", "__fp"])

    import pyarrow.compute  # noqa: F401

    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(kit.lean(run), f"__id {dict(rows.dtypes)['__id']}, __fp long")


def block_pairs(radius: int) -> list[int]:
    """Masks of two blocks each, of radius + 2 blocks of the 64 bits."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _trees(radius: int):
    """From (route, key, fp) rows in order of (route, key): edges that span each shard's links."""

    def run(batches):
        key, members = None, []

        def links():
            tree, forest = BKTree(), Forest()
            for v in members:
                for w, _ in tree.within(v, radius):
                    if forest.union(v, w):
                        yield _signed(v), _signed(w)
                tree.add(v)

        for b in batches:
            out = []
            for r, k, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (r, k) != key:
                    if len(members) > 1:
                        out += links()
                    key, members = (r, k), []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(members) > 1:
            out = list(links())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def link_bits(fps: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `__fp` just as all links within the radius would."""
    if radius > 2:
        raise ValueError("sharding by bits is for a radius of 2 at the most")
    routes = F.array(*[F.struct(F.lit(i).alias("r"), F.col("__fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block_pairs(radius))])
    routed = fps.select("__fp", F.explode(routes).alias("x")).select(F.col("x.r").alias("r"), F.col("x.k").alias("k"), "__fp")
    large = kit.checkpointed(routed.groupBy("r", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select("r", "k"))
    some = large.count()
    if some:
        hint = F.broadcast(large) if some <= 100_000 else large
        rest = routed.join(hint, ["r", "k"], "left_semi").select("__fp").distinct()
        routed = routed.join(hint, ["r", "k"], "left_anti")
    edges = routed.repartition(F.col("r"), F.col("k")).sortWithinPartitions("r", "k").mapInArrow(kit.lean(_trees(radius)), "a long, b long")
    if some:
        near = F.array(F.col("__fp"), *[F.col("__fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
        balls = rest.select("__fp", F.explode(near).alias("ball"))
        low = balls.groupBy("ball").agg(F.min("__fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = edges.union(balls.join(low, "ball").where("__fp <> low").select("__fp", "low").distinct())
    return edges


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(__id, __fp, __component) of every row: the smallest id that links within the radius reach."""
    rows = kit.checkpointed(fingerprinted(df, id_col, text_col, k))
    return grouped(rows, "__fp", lambda d: link_bits(d.select("__fp"), radius, shard))


def grouped(rows: DataFrame, node: str, link) -> DataFrame:
    """rows with `__component`, the smallest `__id` over the nodes that link(distinct nodes) connects."""
    distinct = kit.checkpointed(rows.groupBy(node).agg(F.min("__id").alias("__low"), *[F.min(c).alias(c) for c in rows.columns if c not in ("__id", node)]))
    root = graph.components(link(distinct))
    rooted = distinct.select(node, "__low").join(root, F.col(node) == F.col("node"), "left").select(F.col(node).alias("__n"), "__low", F.coalesce("root", node).alias("__root"))
    least = rooted.groupBy("__root").agg(F.min("__low").alias("__component"))
    named = rooted.join(least, "__root").select("__n", "__component")
    return rows.join(named, F.col(node) == F.col("__n")).drop("__n")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(kit.documents(spark, sf_dir))
    return out.select(F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("__component").alias("component_id"))


#: Near copies: independent minima of a text's shingle hashes, put together to keys of three; each minimum is in two keys.
MINIMA, SKETCH = 30, 128
TRIPLES = np.concatenate([np.arange(MINIMA).reshape(-1, 3), np.arange(MINIMA).reshape(3, -1).T])
BANDS = len(TRIPLES)
#: At a similarity of 0.8 five-word shingles' fingerprints differ in 9.7 bits on average, at a deviation of 2.9.
NEAR_RADIUS = 24
#: For sets larger than the sketch the estimate has a deviation of 0.035 at 0.8; pairs four of them below are let through
#: to the comparison of whole sets.
SLACK = 0.15
#: Shingles of whole sets that are compared in one block; a larger group is dealt into blocks.
CUT = 1 << 20


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _named(u: np.ndarray) -> int:
    """The name of a set of distinct shingle hashes."""
    with np.errstate(over="ignore"):
        return _mixed(u).sum(dtype=np.uint64) + np.uint64(len(u))


def _profiles(k: int):
    """id, set of shingles (hash of it), SimHash, band keys and SKETCH smallest hashes of each text's distinct shingles."""
    rng = np.random.default_rng(5)
    odd = rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in batches:
            for lo, hi in text.runs([len(t or b"") for t in b.column(1).to_pylist()], PIECE):
                part = b.slice(lo, hi - lo)
                n = len(part)
                h, o = text.shingles(part.column(1).to_pylist(), k, 42)
                own = [np.unique(h[o[i] : o[i + 1]]) for i in range(n)]
                h, o = np.concatenate([h[:0], *own]), np.cumsum([0, *map(len, own)])
                fp = text.fingerprints(h, o)
                sets, keys, sketch = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64), []
                with np.errstate(over="ignore"):
                    some = np.flatnonzero(np.diff(o))
                    if len(some):
                        minima = np.stack([np.minimum.reduceat(_mixed(h * a), o[some]) for a in odd])
                        m1, m2, m3 = (minima[t] for t in TRIPLES.T)
                        keys[some] = _mixed(_mixed(m1) + m2 * np.uint64(3) + m3 * np.uint64(5)).T
                    for i, u in enumerate(own):
                        sets[i] = _named(u)
                        m = (_mixed(u) >> np.uint64(32)).astype(np.uint32)
                        sketch.append(np.sort(m[np.argpartition(m, SKETCH - 1)[:SKETCH]] if len(m) > SKETCH else m).tobytes())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                size = pa.array(np.diff(o).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets.view(np.int64)), pa.array(fp.view(np.int64)), bands, pa.array(sketch, pa.binary()), size], ["__id", "__set", "__fp", "__bands", "__sketch", "__size"])

    return run


def _whole(k: int):
    """id, set (as in _profiles) and the sorted distinct shingle hashes of each text."""

    def run(batches):
        for b in batches:
            for lo, hi in text.runs([len(t or b"") for t in b.column(1).to_pylist()], PIECE):
                part = b.slice(lo, hi - lo)
                h, o = text.shingles(part.column(1).to_pylist(), k, 42)
                own = [np.unique(h[s:e]) for s, e in itertools.pairwise(o)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_named(u) for u in own], pa.uint64()).view(pa.int64()), pa.array([u.tobytes() for u in own], pa.binary())], ["__id", "__set", "__shingles"])

    return run


def _same(sets: list[int], shingles: list[np.ndarray], similarity: float):
    """Edges that connect the sets just as all pairs of at least the similarity would, from the whole sets."""
    n = np.array([len(x) for x in shingles])
    begin = np.concatenate([[0], np.cumsum(n)])
    names, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    group, marked = np.arange(len(sets)), np.zeros(len(names), bool)
    for i in range(len(sets) - 1):
        at = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        at = at[np.minimum(n[at], n[i]) >= similarity * np.maximum(n[at], n[i])]
        if not len(at):
            continue
        own = flat[begin[i] : begin[i + 1]]
        marked[own] = True
        first = np.cumsum(n[at]) - n[at]
        met = np.add.reduceat(marked[flat[np.repeat(begin[at] - first, n[at]) + np.arange(n[at].sum())]], first, dtype=np.int64)
        marked[own] = False
        for j in at[met >= similarity * (n[i] + n[at] - met)].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                yield sets[i], sets[j]


def _confirmed(similarity: float):
    """From (key, set, shingles) rows in order of key: edges that span each group's pairs."""

    def run(batches):
        key, members = None, {}

        def links():
            return _same(list(members), [np.frombuffer(x, np.uint64) for x in members.values()], similarity)

        for b in batches:
            out = []
            for k, s, x in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if k != key:
                    if len(members) > 1:
                        out += links()
                    key, members = k, {}
                members[s] = x
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(members) > 1:
            out = list(links())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def confirm(sets: DataFrame, loose: DataFrame, rows: DataFrame, k: int, similarity: float, cut: int = CUT) -> DataFrame:
    """Edges (a, b) that connect, within the groups that the loose edges make, all pairs of at least the similarity.

    Whole sets are made again from the texts of one row of each grouped set, found by its id before anything is hashed,
    and each goes to its group's task once; a group over `cut` shingles is dealt into blocks, and each two blocks make a
    shard.
    """
    root = kit.checkpointed(graph.components(loose))
    some = root.count()
    root = root.union(root.select("root", "root").distinct())
    member = sets.select("__set", "__low", "__size").join(root, F.col("__set") == F.col("node")).select("__set", "__low", "__size", "root")
    blocks = member.groupBy("root").agg(F.ceil(F.greatest(F.sum("__size"), F.lit(1)) / F.lit(float(cut))).alias("blocks"))
    own = F.pmod(F.xxhash64("__set"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("root", F.least(own, j), F.greatest(own, j)))
    member = kit.checkpointed(member.join(blocks, "root").select(F.col("__set").alias("__s"), "__low", F.array_distinct(pairs).alias("met")))
    sent = F.broadcast if some <= 100_000 else lambda d: d
    hint = sent(member)
    chosen = rows.join(sent(member.select("__low").distinct()), F.col("__id").eqNullSafe(F.col("__low")), "left_semi")
    texts = chosen.mapInArrow(kit.lean(_whole(k)), f"__id {dict(rows.dtypes)['__id']}, __set long, __shingles binary")
    met = texts.join(hint, (F.col("__set") == F.col("__s")) & F.col("__id").eqNullSafe(F.col("__low"))).select(F.explode("met").alias("k"), "__set", "__shingles")
    return met.repartition("k").sortWithinPartitions("k", "__set").mapInArrow(kit.lean(_confirmed(similarity)), "a long, b long")


def resembles(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets' Jaccard similarity may be high enough, from their smallest hashes, or whole sets if small."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = np.concatenate([a, b])
    both.sort()
    if max(len(a), len(b)) >= SKETCH:
        similarity -= SLACK
        both = both[both <= both[np.flatnonzero(np.diff(both, prepend=both[0] ^ 1))[:SKETCH][-1]]]
    met = int((both[1:] == both[:-1]).sum())
    return met >= similarity * (len(both) - met)


def _near(radius: int, similarity: float):
    """From (key, set, fp, sketch) rows in order of key: edges that span each shard's links."""

    def run(batches):
        key, members = None, []

        def links():
            tree, forest = BKTree(), Forest()
            for s, v, sk in members:
                mine = np.frombuffer(sk, np.uint32)
                for _, (t, other) in tree.within(v, radius):
                    if forest.find(s) != forest.find(t) and resembles(mine, other, similarity):
                        forest.union(s, t)
                        yield s, t
                tree.add(v, (s, mine))

        for b in batches:
            out = []
            for k, *x in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if k != key:
                    if len(members) > 1:
                        out += links()
                    key, members = k, []
                members.append((x[0], x[1] & 0xFFFFFFFFFFFFFFFF, x[2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(members) > 1:
            out = list(links())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def link_near(sets: DataFrame, similarity: float, radius: int = NEAR_RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between the distinct shingle sets `__set` that may have the similarity, enough to connect them.

    At a similarity of 0.8 a pair shares none of the band keys with a probability of 0.00004. The members of a key that more than `shard` sets hold are dealt into blocks, and each two blocks make a shard, so that every pair
    still meets and no task holds more than two blocks.
    """
    keys = sets.select("__set", F.explode("__bands").alias("k"))
    shared = lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = kit.checkpointed(shared(keys))
    met = keys.join(counts.where(F.col("n") <= shard), "k").select("__set", "k")
    large = counts.where(F.col("n") > shard)
    if not large.isEmpty():
        blocks = F.ceil(F.col("n") / F.lit(float(shard)))
        own = F.pmod(F.xxhash64("__set"), blocks)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("k", F.least(own, j), F.greatest(own, j)))
        met = met.union(keys.join(large, "k").select("__set", F.explode(pairs).alias("k")))
    met = met.groupBy("__set").agg(F.collect_set("k").alias("met"))
    routed = sets.join(met, "__set").select("__set", "__fp", "__sketch", F.explode("met").alias("k")).select("k", "__set", "__fp", "__sketch")
    return routed.repartition("k").sortWithinPartitions("k", "__set").mapInArrow(kit.lean(_near(radius, similarity)), "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, shard: int = SHARD, cut: int = CUT) -> DataFrame:
    """(__id, __component) of every row, over texts whose k-word shingles have at least the similarity."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    profiles = kit.checkpointed(rows.mapInArrow(kit.lean(_profiles(k)), f"__id {kind}, __set long, __fp long, __bands array<long>, __sketch binary, __size long"))
    named = grouped(profiles, "__set", lambda d: confirm(d, link_near(d, similarity, shard=shard), rows, k, similarity, cut))
    return named.select("__id", "__component")


def distinct_texts(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of df without those of which a near copy has a smaller id."""
    drop = near_copies(df, id_col, **how).where("__id > __component").select("__id").distinct()
    return kit.whole(df).join(drop, kit.of_row(id_col) == F.col("__id"), "left_anti").select("__row.*")
