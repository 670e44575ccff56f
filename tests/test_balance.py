import os
import pickle
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel import BalanceError
from evenkeel.operators import balance, checks, graph, knn, repeated, roles, scaling, schema, select, steps, synthesis, tree, undersampling
from evenkeel.sources import generated
from evenkeel.streaming import batches

RNG = np.random.default_rng(42)


def table(spark, n_min, n_maj, whole=False, labels=("min", "maj")):
    n = n_min + n_maj
    x = [(i, i + 1 if whole else float(RNG.normal()), float(RNG.normal()), labels[0] if i < n_min else labels[1]) for i in range(n)]
    return spark.createDataFrame(x, f"id long, x1 {'int' if whole else 'double'}, x2 double, y {'boolean' if isinstance(labels[0], bool) else 'int' if isinstance(labels[0], int) else 'string'}")


def counts(result):
    return result.class_counts()


def test_uniform_ratios(spark):
    df = table(spark, 4, 10)
    total = lambda r: sum(counts(r).values())
    assert total(balance.adasyn_uniform(df, "y", 0.5, id_col="id")) == 16
    assert total(balance.adasyn_uniform(df, "y", 1, id_col="id")) == 18
    assert total(balance.nearmiss_uniform(df, "y", 1, id_col="id")) == 8
    assert total(balance.nearmiss_uniform(df, "y", 0.5, id_col="id")) == 6
    assert counts(balance.adanear_uniform(df, "y", 0.5, 1, id_col="id")) == {"min": 6, "maj": 6}
    assert counts(balance.adanear_uniform(df, "y", 1, 0.5, id_col="id")) == {"min": 8, "maj": 4}
    assert counts(balance.adanear_uniform(df, "y", 0, 0, id_col="id")) == {"min": 4, "maj": 10}


@pytest.mark.parametrize("ratio", [0, -1, float("nan"), float("inf"), "1", True])
def test_ratio_rejected(spark, ratio):
    df = table(spark, 4, 10)
    with pytest.raises(BalanceError):
        balance.adasyn(df, "y", ratio, id_col="id")
    with pytest.raises(BalanceError):
        balance.nearmiss(df, "y", ratio, id_col="id")


def test_counts(spark):
    df = table(spark, 6, 24)
    assert counts(balance.adasyn(df, "y", 0.5, id_col="id")) == {"min": 9, "maj": 24}
    df = table(spark, 8, 32)
    assert counts(balance.nearmiss(df, "y", 0.5, id_col="id")) == {"min": 8, "maj": 4}
    out = balance.adanear(table(spark, 10, 20), "y", 1.5, 1.0, id_col="id")
    assert counts(out)["min"] == 25 and counts(out)["maj"] <= 20 and out.roles.minority == "min"


def test_hybrid_skips(spark):
    df = table(spark, 5, 15)
    assert counts(balance.adanear(df, "y", 0, 1, id_col="id")) == {"min": 5, "maj": 5}
    assert counts(balance.adanear(df, "y", 0.2, 0, id_col="id")) == {"min": 6, "maj": 15}
    assert balance.adanear(df, "y", 0, 0, id_col="id").data.exceptAll(df.select("id", "x1", "x2", "y")).isEmpty()


def test_originals_untouched_and_whole_columns_restored(spark):
    df = table(spark, 8, 24, whole=True)
    out = balance.adasyn(df, "y", 0.5, id_col="id", seed=3)
    assert out.data.where("id IS NOT NULL").exceptAll(df).isEmpty() and df.exceptAll(out.data).isEmpty()
    assert dict(out.data.dtypes)["x1"] == "int" and out.data.columns == df.columns
    made = out.data.where("id IS NULL").agg(F.min("x1"), F.max("x1"), F.count("*")).first()
    assert 1 <= made[0] <= made[1] <= 32 and made[2] == 4
    kept = balance.nearmiss(df, "y", 1, id_col="id").data
    assert kept.exceptAll(df).isEmpty()


def test_target_types_and_name(spark):
    for labels in (("a", "b"), (True, False), (1, 0)):
        out = balance.adasyn(table(spark, 5, 15, labels=labels), "y", 0.4, id_col="id", target_out="TARGET")
        assert out.data.columns[-1] == "TARGET" and counts(out)[labels[0]] == 7


def test_rejected_tables(spark):
    df = table(spark, 5, 15)
    for bad in (df.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), df.withColumn("x1", F.lit(float("inf"))), df.withColumn("x1", F.lit(float("nan"))), df.withColumn("x1", F.lit(1.0)), df.withColumn("x1", F.lit("a")), df.withColumnRenamed("x1", "TARGET"), df.withColumn("y", F.when(F.col("id") == 0, "other").otherwise(F.col("y"))), df.withColumn("y", F.when(F.col("id") > 0, F.col("y"))), df.withColumn("y", F.lit("one")), df.withColumn("id", F.lit(1)), df.limit(0), table(spark, 1, 9), table(spark, 5, 5)):
        with pytest.raises(BalanceError):
            balance.adasyn(bad, "y", 0.5, id_col="id").data.collect()
    with pytest.raises(BalanceError):
        balance.adasyn(df, "z")
    with pytest.raises(BalanceError):
        balance.nearmiss(df, "y", 0.1, id_col="id")
    with pytest.raises(BalanceError, match="limit"):
        balance.adasyn(df, "y", 5, id_col="id", max_output_rows=30)
    with pytest.raises(BalanceError, match="limit"):
        balance.adasyn(df, "y", 5, id_col="id", max_dense_gb=1e-9)


def test_tied_classes(spark):
    df = table(spark, 5, 5)
    assert counts(balance.nearmiss(df, "y", 0.4, id_col="id")) == {"min": 5, "maj": 5}
    assert balance.adasyn_uniform(df, "y", 1, id_col="id").roles.minority == "maj"
    assert balance.nearmiss(df, "y", 0.4, id_col="id", minority="min", majority="maj").roles.minority == "min"


def test_constant_column_in_uniform_variant(spark):
    df = table(spark, 4, 10).withColumn("x1", F.lit(3.0))
    assert counts(balance.adasyn_uniform(df, "y", 1, id_col="id")) == {"min": 8, "maj": 10}


def test_seed_and_partitions(spark):
    df = table(spark, 20, 80)
    rows = lambda d, s: sorted(balance.adasyn(d, "y", 0.7, seed=s, id_col="id", decimals=9, provenance=True).data.where("id IS NULL").select(F.round("x1", 9), F.round("x2", 9)).collect())
    assert rows(df, 1) == rows(df.repartition(7), 1) != rows(df, 2)
    ids = lambda s: sorted(balance.nearmiss(df, "y", 0.5, seed=s, id_col="id").data.select("id").collect())
    assert ids(10) == ids(999)


def test_large_ratio_and_k(spark):
    out = balance.adasyn(table(spark, 3, 17), "y", 50, 50, id_col="id").data
    assert out.count() == 170 and out.where("x1 IS NULL OR isnan(x1) OR abs(x1) = double('inf')").isEmpty()


def test_made_ids_with_repeated_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0, "a")] * 2 + [(float(i // 2), 1.0, "b") for i in range(4)], "p double, q double, y string")
    assert counts(balance.nearmiss(df, "y", 1, 2)) == {"a": 2, "b": 2}
    assert balance.adasyn(df, "y", 0.5, 2).data.columns == ["p", "q", "y"]


def test_audit(spark):
    df = table(spark, 5, 15)
    assert balance.adasyn(df, "y", id_col="id").diagnostics == {}
    assert balance.adasyn(df, "y", id_col="id", audit_level="light").diagnostics["rows_generated"] == 1
    full = balance.adanear(df, "y", 0.5, 1, id_col="id", audit=True)
    assert full.synthetic.count() == 2 and full.scaled.count() == 22 and full.diagnostics["rows_removed"] == 8


def test_strategies(spark):
    df = table(spark, 5, 15)
    for s in ("none", "weight"):
        out = balance.balance(df, "y", s)
        assert out.data is df and out.diagnostics["scale_pos_weight"] == 3
    assert counts(balance.balance(df, "y", "adasyn", adasyn_ratio=0.4, id_col="id")) == {"min": 7, "maj": 15}
    assert counts(balance.balance(df, "y", "nearmiss", id_col="id")) == {"min": 5, "maj": 5}
    assert balance.balance(df, "y", "adanear_weight", adasyn_ratio=0.4, nearmiss_ratio=2, id_col="id").diagnostics["scale_pos_weight"] == 2
    with pytest.raises(BalanceError):
        balance.balance(df, "y", "other")
    with pytest.raises(BalanceError):
        balance.balance(df.withColumn("x1", F.lit(None).cast("double")), "y", "none", validate=True)


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(i), float(i + 4), "a" if i < 2 else "b") for i in range(4)], "id long, p double, q double, y string")
    s = scaling.parameters(schema.facts(df, "y", ["p", "q"]), ["p", "q"])
    assert s.centers == (1.5, 5.5) and np.allclose(s.scales, 1.2909944487358056)
    back = scaling.revert(scaling.apply(df, ["p", "q"], s), ["p", "q"], s)
    assert np.allclose([[r.p, r.q] for r in back.orderBy("id").collect()], [[i, i + 4] for i in range(4)])
    zero = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "p double, q double")
    assert [tuple(r) for r in scaling.l2_normalize(zero, ["p", "q"]).collect()] == [(0, 0), (0.6, 0.8)]
    for bad in (((0.0,), (1.0,)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, float("nan")), (1.0, 1.0))):
        with pytest.raises(BalanceError):
            balance.nearmiss(df, "y", 1, id_col="id", scaling=scaling.Scaling(*bad))
    with pytest.raises(BalanceError):
        balance.nearmiss(df, "y", 1, id_col="id", already_scaled=True)


def points(spark, rows):
    return spark.createDataFrame([(i + 1, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, z array<double>")


def test_knn_duplicates_and_lines(spark):
    x = points(spark, [(0, 0), (0, 0), (1, 0), (2, 0), (3, 0)])
    first = {r.query_id: (r.neighbor_id, r.dist) for r in knn.knn(x, x, 2, exclude_self=True).where("rank = 1").collect()}
    assert first[1] == (2, 0) and first[2] == (1, 0)
    line = points(spark, [(i, 0) for i in range(5)])
    got = [(r.query_id, r.rank, r.neighbor_id) for r in knn.knn(line, line, 2, exclude_self=True).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 4), (4, 1, 3), (4, 2, 5), (5, 1, 4), (5, 2, 3)]


def test_knn_cancellation(spark):
    r = knn.knn(points(spark, [(1e8, 1e8)]), points(spark, [(1e8 + 1e-3, 1e8), (1e8 + 1e-4, 1e8)]), 1).first()
    assert r.neighbor_id == 2 and r.dist == (1e8 + 1e-4) - 1e8


@pytest.mark.parametrize("small", [knn.SMALL, 70, 0])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_routes_equal_brute_force(spark, monkeypatch, small, metric):
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "CELLS", 40)
    refs, q = RNG.normal(size=(30, 4)), RNG.normal(size=(17, 4))
    got = knn.knn(points(spark, q), points(spark, refs), 3, metric=metric, engine="exact", small=small).collect()
    if metric == "cosine":
        refs, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (refs, q))
        d = 1 - q @ refs.T
    else:
        d = np.sqrt(((q[:, None] - refs[None]) ** 2).sum(-1))
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert len(got) == 51
    for r in got:
        assert r.neighbor_id == want[r.query_id - 1][r.rank - 1] + 1 and abs(r.dist - d[r.query_id - 1, r.neighbor_id - 1]) < 1e-9


def test_knn_engines(spark):
    x = points(spark, RNG.normal(size=(12, 3)))
    rows = lambda e, a="auto": sorted((r.query_id, r.rank, r.neighbor_id) for r in knn.knn(x, x, 3, exclude_self=True, engine=e, algorithm=a).collect())
    assert rows("native") == rows("FNN", "kd_tree") == rows("KernelKnn", "brute") == rows("bigKNN") == rows("auto")
    assert knn.resolved_engine("auto", "ip", True) == "RcppHNSW" and knn.resolved_engine("auto") == "native"
    for e, m in (("auto", "cosine"), ("FNN", "cosine"), ("native", "ip"), ("other", "euclidean"), ("native", "other")):
        with pytest.raises(BalanceError):
            knn.resolved_engine(e, m)
    with pytest.raises(BalanceError):
        knn.resolved_algorithm("kd_tree", "native")
    assert set(knn.knn(x, x, 2, returns="index").columns) == {"query_id", "rank", "neighbor_id"}
    assert set(knn.knn(x, x, 2, returns="dist").columns) == {"query_id", "rank", "dist"}


def test_drop_self(spark):
    rows = [[1, 2, 3, 4], [5, 2, 3, 4], [3, 2, 1, 4], [4, 5, 1, 2]]
    near = spark.createDataFrame([(q + 1, k + 1, v) for q, r in enumerate(rows) for k, v in enumerate(r)], "query_id long, rank int, neighbor_id long")
    got = {}
    for r in knn.drop_self(near, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    assert list(got.values()) == [[2, 3, 4], [5, 3, 4], [2, 1, 4], [5, 1, 2]]
    with pytest.raises(BalanceError):
        knn.drop_self(near.where("query_id = 1 AND rank = 1"), 2)


def test_ranking_of_scores(spark):
    s = spark.createDataFrame([(10, 0.15), (20, 0.15), (30, 0.10), (40, 0.15)], "id long, score double")
    assert [r.id for r in undersampling.kept(s, 3).orderBy("score", "id").collect()] == [30, 10, 20]
    many = spark.range(5000).select("id", (F.col("id") * 37 % 50).cast("double").alias("score"))
    want = sorted((r.score, r.id) for r in many.collect())
    for m in (1, 99, 100, 101, 2500, 4999, 5000, 6000):
        assert sorted((r.score, r.id) for r in select.smallest(many, m, "score", "id", few=10).collect()) == want[:m]


def test_ranking_of_tied_strings(spark):
    names = [f"row-{i * 7919 % 3000:05d}" for i in range(3000)] + ["row-", "row-\0", "row-" + "\0" * 9, "é", "row-" + "0" * 30] + ["row-" + "0" * 20 + f"{i:03d}" for i in range(200)]
    many = spark.createDataFrame([(x, 0.5) for x in names], "id string, score double").repartition(7)
    want = sorted(names, key=str.encode)
    for m in (1, 99, 150, 1001, 3204):
        assert sorted((r.id for r in select.smallest(many, m, "score", "id", few=10).collect()), key=str.encode) == want[:m]


def test_segments(spark):
    df = table(spark, 5, 40)
    for small in (knn.SMALL, 0):
        out = balance.adanear(df, "y", 0.5, 2, id_col="id", segments=True, small=small).data.collect()
        assert sorted(r["__segment"] for r in out) == [0] * 14 + [1] * 5 + [2] * 2
        assert all((r["__ord"] is not None) == (r["__segment"] == 0) for r in out)
        assert all((r["id"] is None) == (r["__segment"] == 2) for r in out)
        plain = balance.adanear(df, "y", 0.5, 2, id_col="id", segments=False, small=small).data
        assert sorted(r["id"] for r in plain.where("id IS NOT NULL").collect()) == sorted(r["id"] for r in out if r["id"] is not None)
        if small:
            first = sorted((r["__ord"], r["id"]) for r in out if r["__segment"] == 0)
        else:
            assert [i for _, i in first] == [i for _, i in sorted((r["__ord"], r["id"]) for r in out if r["__segment"] == 0)]


@pytest.mark.parametrize("engine, m", [("lists", 2), ("RcppHNSW", 4)])
def test_approximate_engines(spark, monkeypatch, engine, m):
    """A vector with many copies, parts and shards, tables smaller than k, empty ones."""
    monkeypatch.setattr(graph, "SHARD", 300)
    monkeypatch.setattr(graph, "ASKS", 700)
    x = RNG.normal(size=(1500, 6))
    x[:400] = x[0]
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>").repartition(5)
    monkeypatch.setattr(knn, "BLOCK", 150)
    true = {(r.query_id, r.rank): r.dist for r in knn.knn(refs, refs, 5, engine="exact", exclude_self=True).collect()}
    got = {(r.query_id, r.rank): r.dist for r in knn.knn(refs, refs, 5, engine=engine, exclude_self=True, graph_m=m, graph_ef=40).collect()}
    assert got.keys() == true.keys() and sum(abs(got[q] - d) < 1e-9 for q, d in true.items()) >= 0.9 * len(true)
    few = refs.where("id < 4")
    assert knn.knn(few, few, 9, engine=engine, exclude_self=True).count() == 12
    assert knn.knn(refs, refs.limit(0), 5, engine=engine).count() == 0 == knn.knn(refs.limit(0), refs, 5, engine=engine).count()


def test_graphs_in_many_shards(spark, monkeypatch):
    """Points without structure lose no neighbours by being dealt into shards; in groups a query goes to few shards."""
    monkeypatch.setattr(graph, "SHARD", 60)
    x = RNG.normal(size=(1200, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>").repartition(3)
    true, got = ({(r.query_id, r.neighbor_id) for r in knn.knn(df, df, 10, engine=e, exclude_self=True).collect()} for e in ("exact", "RcppHNSW"))
    assert len(got) == len(true) and len(got & true) >= 0.98 * len(true)
    centres = 20 * RNG.normal(size=(30, 24))
    groups = centres[RNG.integers(0, 30, 3000)] + RNG.normal(size=(3000, 24))
    met = graph.reached(groups, centres, groups[::3], 5)
    own, near = knn._order(groups, centres, 1)[:, 0], np.argsort(((groups[:200, None] - groups[None]) ** 2).sum(2), axis=1)[:, :6]
    assert met.mean() < 0.1 and np.take_along_axis(met[:200], own[near], 1).all() and graph.reached(groups, centres, groups[:4], 5).all()


def test_graphs_and_queries_are_sent_in_blocks(spark, monkeypatch):
    """Queries that go to every shard are shuffled by bundles of graphs, not by graphs; the neighbours are the same."""
    monkeypatch.setattr(graph, "SHARD", 60)
    monkeypatch.setattr(graph, "ASKS", 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(1200, 24)))], "id long, z array<double>").repartition(3)
    status, near, wrote = spark.sparkContext._jsc.sc().statusStore(), [], []
    for tasks in (400, 4):
        monkeypatch.setattr(graph, "TASKS", tasks, raising=False)
        before = status.executorSummary("driver").totalShuffleWrite()
        near.append(sorted(knn.knn(df, df, 10, engine="RcppHNSW", exclude_self=True).collect()))
        wrote.append(status.executorSummary("driver").totalShuffleWrite() - before)
    assert near[0] == near[1] and len(near[0]) == 12_000
    assert wrote[1] < wrote[0] / 3


def test_graphs_in_bundles(monkeypatch):
    """Each graph has a place, no bundle has more than fit in a long, and a query goes once to a bundle, for the graphs it asks."""
    monkeypatch.setattr(graph, "SHARD", 10)
    graphs = graph.bundled([(0, 35), (2, 9), (3, 9), *((s, 1) for s in range(4, 200))], 25)
    assert graphs[:5] == [(0, 0, 0, 0), (0, 1, 0, 1), (0, 2, 1, 0), (2, 0, 1, 1), (3, 0, 2, 0)]
    assert max(slot for *_, slot in graphs) < 62 and len({g[2:] for g in graphs}) == len(graphs) == 201
    to = np.zeros((4, 200), bool)
    to[0, [0, 3]] = to[2, 1] = to[3, 2:4] = True
    sent = [x.tolist() for x in graph.sent(to, np.array(graphs))]
    assert sent == [[0, 0, 0, 3, 3], [0, 1, 2, 1, 2], [3, 1, 1, 2, 1]]
    assert [len(x) for x in graph.sent(to[1:3], np.array(graphs))] == [0, 0, 0]


def test_graphs_find_neighbours_by_few_distances():
    """Groups that no link joins, and points without groups, of which coarse lists with as many rows hold fewer neighbours."""
    rng = np.random.default_rng(7)
    for x, least in ((rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] * 4 + rng.normal(size=(3000, 24)), 0.97), (rng.random((3000, 16)), 0.99)):
        q = x[:100] + 0.01 * rng.normal(size=(100, x.shape[1]))
        want = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
        g, spent = graph.Layers.built(x, 16), []
        assert len(g.layers) > 1 and all(len(n) > len(m) for (n, _), (m, _) in zip(g.layers, g.layers[1:], strict=False))
        for ef in (20, 200):
            g.distances = 0
            at, d = g.search(q, ef)
            assert (np.diff(np.where(np.isfinite(d), d, 1e300), axis=1) >= 0).all()
            assert sum(len(set(a[:10]) & set(w)) for a, w in zip(at.tolist(), want.tolist(), strict=True)) >= least * 1000
            spent.append(g.distances / 100)
        assert spent[0] < spent[1] and spent[0] < 700
        if least == 0.99:
            centres = knn._centroids(x, 3000 // 256)
            size, own, order = np.bincount(knn._order(x, centres, 1)[:, 0], minlength=len(centres)), knn._order(x, centres, 1)[:, 0], knn._order(q, centres, len(centres))
            met = (np.cumsum(size[order], axis=1) - size[order]) < spent[0]
            assert sum(len(set(w) & set(np.flatnonzero(np.isin(own, o[f])))) for w, o, f in zip(want.tolist(), order, met, strict=True)) < 0.9 * 1000
        again = graph.Layers.unpacked(x, g.packed()).search(q, 20)
        assert all(np.array_equal(a, b) for a, b in zip(again, g.search(q, 20), strict=True))


def test_generated_families(spark):
    rows = spark.range(4000)
    mean = {("monetary", "uniform"): 20500, ("integer", "poisson"): 2, ("integer", "geometric"): 7 / 3, ("integer", "negative_binomial"): 4, ("integer", "binomial"): 1, ("ratio", "beta"): 2 / 7, ("ratio", "uniform"): 0.5}
    for kind, shapes in generated.FAMILIES.items():
        for shape in shapes:
            v = [r[0] for r in rows.select(generated.column(kind, F.col("id"), "a", 3, shape)).collect()]
            some = [x for x in v if x]
            assert all(x >= 0 for x in v)
            if kind == "monetary":
                assert min(some) >= 1000 and max(v) <= 40000 and abs(len(some) / 4000 - 0.2) < 0.03
            if kind == "binary":
                assert set(v) == {0, 1} and 0 < len(some) / 4000 < 0.2
            if (kind, shape) in mean:
                assert abs(sum(v) / 4000 / generated.FILLED[kind] / mean[kind, shape] - 1) < 0.15
    with pytest.raises(BalanceError):
        generated.column("ratio", F.col("id"), "a", 1, "poisson")


def test_apportionment(spark):
    for _ in range(4):
        c = RNG.integers(0, 6, 30) * int(RNG.integers(0, 2))
        g = int(RNG.integers(1, 200))
        d = spark.createDataFrame([(i, int(v), 5) for i, v in enumerate(c)], "id long, c long, k long")
        own = c if c.sum() else np.ones(30, int)
        base, rem = g * own // own.sum(), g * own % own.sum()
        for i in sorted(range(30), key=lambda i: (-rem[i], i))[: g - base.sum()]:
            base[i] += 1
        assert [r.n for r in synthesis.apportioned(d, g).orderBy("id").collect()] == base.tolist()
        assert sum(r.n for r in synthesis.even(d, g, 30).collect()) == g


@pytest.mark.parametrize("check, bad", [(checks.seed, 1.5), (checks.seed, -1), (lambda x: checks.positive_integer(x, "k"), 2.5), (lambda x: checks.positive_integer(x, "k"), 0), (lambda x: checks.flag(x, "f"), 1), (checks.chunk_size, 0), (lambda x: checks.graph_parameters(x, 10), 1), (checks.backend, "fork"), (lambda x: checks.audit_level(False, x), "some")])
def test_parameter_checks(check, bad):
    with pytest.raises(BalanceError):
        check(bad)
    assert checks.chunk_size(None) == 1000 and checks.audit_level(True, "none") == "full"
    assert roles.expansion(3, 0.1) == 1 and roles.retention(8, 32, 0.5) == 4 and roles.retention(1, 9, 0.5, 1) == 1


def test_steps(spark):
    df = table(spark, 10, 30).drop("id")
    step = steps.step_adasyn("y", ratio=0.5, seed=1)
    model = step.fit(df)
    new = df.select("*")
    assert model.transform(new) is new and model.training().data.count() == 45 and step.fit_resample(df).count() == 45
    assert steps.step_nearmiss("y", ratio=1, skip=False).fit(df).transform(df).count() == 20
    assert step.tidy(spark).first().trained is False and model.tidy(spark).first().terms == "y"
    for make in (steps.step_adanear, steps.step_adasyn_uniform, steps.step_nearmiss_uniform, steps.step_adanear_uniform):
        assert {r[0] for r in make("y").fit_resample(df).select("y").distinct().collect()} == {"min", "maj"}
    for bad in (["y", "x1"], [], "z"):
        with pytest.raises(BalanceError):
            steps.step_adasyn(bad).fit(df)
    with pytest.raises(BalanceError):
        steps.step_adasyn("y", ratio=-1)
    with pytest.raises(BalanceError):
        steps.BalanceStep("adasyn", "y", skip=False).fit(df).transform(df.drop("y"))
    assert steps.runtime_report(spark)["runtime"] == "spark"


def test_pipeline_of_steps(spark):
    from pyspark.ml import Pipeline

    df = table(spark, 10, 30).drop("id")
    assert Pipeline(stages=[steps.step_nearmiss("y", ratio=1, skip=False)]).fit(df).transform(df).count() == 20


def test_later_stages_are_fitted_on_balanced_rows(spark, tmp_path):
    """And new rows, or the training rows when scored, pass unchanged; params are copied, steps saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = table(spark, 10, 30).drop("id")
    step = steps.step_adasyn("y", ratio=2.0, seed=1, k=3, decimals=9)
    later = [StringIndexer(inputCol="y", outputCol="label"), VectorAssembler(inputCols=["x1", "x2"], outputCol="v"), LogisticRegression(featuresCol="v")]
    model = steps.BalancedPipeline(stages=[step, *later]).fit(df)
    # any other loop would go on with unbalanced rows
    for way in (lambda: Pipeline(stages=[step, *later]).fit(df), lambda: step.fit(df).transform(df)):
        with pytest.raises(BalanceError, match="BalancedPipeline"):
            way()
    assert model.stages[1].labelsArray == [("maj", "min")] or model.stages[-1].summary.predictions.count() == 60
    assert model.stages[-1].summary.predictions.count() == 60 and model.transform(df).count() == 40
    other = step.copy({step.ratio: 1.0})
    assert other.fit_resample(df).count() == 50 and step.fit_resample(df).count() == 60 and other.value("options") == {"decimals": 9}
    step.save(str(tmp_path / "step"))
    assert steps.BalanceStep.load(str(tmp_path / "step")).fit_resample(df).exceptAll(step.fit_resample(df)).isEmpty()
    model.save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    assert back.transform(df).count() == 40 and back.stages[0].value("outcome") == "y"
    with pytest.raises(BalanceError, match="loaded"):
        back.stages[0].training()
    with pytest.raises(BalanceError):
        step.copy({step.ratio: -1.0}).fit(df)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_all_routes_give_the_same_rows(spark, monkeypatch, metric):
    """All rows sent, the minority sent, both sides in blocks; ranges of copies."""
    monkeypatch.setattr(knn, "BLOCK", 11)
    df = table(spark, 20, 70).withColumn("y", F.when(F.col("id") % 9 < 2, "min").otherwise("maj")).withColumn("s", F.col("id").cast("string"))
    for call, more in ((balance.adasyn, {"ratio": 0.7}), (balance.nearmiss, {"ratio": 1.3}), (balance.adanear, {}), (balance.adanear_uniform, {"adasyn_ratio": 0.7})):
        for key in ("id", "s") if call is balance.adasyn else ("id",):
            out = [call(df, "y", seed=3, id_col=key, features=["x1", "x2"], decimals=9, metric=metric, engine="exact", small=small, provenance=True, **more).data for small in (knn.SMALL, 60, 0)]
            a, b, c = (sorted(map(str, d.select(key, "y", *[F.round(c, 9) for c in ("x1", "x2")], *[c for c in d.columns if c.startswith("__")]).collect())) for d in out)
            assert a == b == c and len(a) > 20


def test_trees_in_balancing(spark):
    df = table(spark, 20, 70)
    rows = lambda **how: sorted(map(str, balance.adanear(df, "y", 0.5, 0.5, id_col="id", decimals=9, engine="FNN", **how).data.collect()))
    assert rows(algorithm="kd_tree") == rows(algorithm="cover_tree") == rows(algorithm="brute")


def clusters(n, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 10 + 0.2 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", tree.KINDS)
@pytest.mark.parametrize("decimals", [None, 1])
def test_trees_equal_brute_force(spark, monkeypatch, kind, decimals):
    """Clusters, a vector with many copies, ties by rounding, more neighbours than a cell holds; few cells are met."""
    monkeypatch.setattr(knn, "BLOCK", 50)
    x = np.concatenate([clusters(500), np.repeat(clusters(1), 120, axis=0)])
    df = points(spark, x)
    for k, exclude in ((3, True), (60, False)):
        near, visits = tree.searched(df, df, k, exclude, decimals, kind=kind, leaf=20)
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        d = d if decimals is None else np.round(d, decimals)
        if exclude:
            np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :k] + 1
        assert {r.query_id: [n.neighbor_id for n in r.near] for r in near.collect()} == {i + 1: w.tolist() for i, w in enumerate(want)}
        met, of = visits.agg(F.sum("cells"), F.sum("of")).first()
        assert visits.count() == 620 and met < of * (0.25 if k == 3 else 0.6)


def test_trees_of_small_tables(spark):
    one = points(spark, np.ones((1, 2)))
    for kind in tree.KINDS:
        near = lambda q, r, **how: {r.query_id: [n.neighbor_id for n in r.near] for r in tree.searched(q, r, 3, kind=kind, **how)[0].collect()}
        assert near(one, one) == {1: [1]} and near(one, one.limit(0)) == {} and near(one.limit(0), one) == {}
        assert near(points(spark, np.ones((6, 2))), points(spark, np.ones((6, 2))), exclude=True, leaf=2)[2] == [1, 3, 4]
    with pytest.raises(BalanceError):
        tree.searched(one, one, 1, kind="ball_tree")
    with pytest.raises(BalanceError):
        knn.knn(one, one, 1, metric="cosine", engine="exact", algorithm="kd_tree")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_blocks_of_one_table_meet_once(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "BLOCK", 13)
    monkeypatch.setattr(knn, "CELLS", 40)
    x = points(spark, np.round(RNG.normal(size=(60, 3)), 1))
    how = {"metric": metric, "engine": "exact", "decimals": 6}
    for exclude in (True, False):
        once, apart, sent = (sorted(map(tuple, knn.knn(x, x, 4, exclude_self=exclude, small=small, query_is_data=same, **how).collect())) for small, same in ((0, True), (0, False), (knn.SMALL, False)))
        assert once == apart == sent and len(once) == 240
    plans = [knn.knn(x, x, 4, small=0, query_is_data=same, engine="exact").select("query_id") for same in (True, False)]
    once, apart = (p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for p in plans)
    assert once == apart - 1


def test_copies_of_one_row_are_dealt_out(spark):
    """A row that starts very many new rows: no task makes more than its ranges' share."""
    df = spark.createDataFrame([(1, 1_000_000), (2, 3), (3, 0)], "base_id long, n long").where("n > 0")
    rows = synthesis.copies(df, width=1000).persist()
    assert rows.groupBy("base_id").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.count_distinct("copy").alias("d")).orderBy("base_id").collect() == [(1, 1_000_000, 1, 1_000_000, 1_000_000), (2, 3, 1, 3, 3)]
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        dealt = synthesis.copies(df, most=1_000_000, width=1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert max(r["count"] for r in dealt) <= 1_000_003 / 2
    few = synthesis.copies(df.where("n < 10"), most=3)
    assert few.count() == 3 and "Exchange" not in few._jdf.queryExecution().toString()


def test_bounds_of_long_columns(spark):
    big = 2**62
    df = spark.createDataFrame([(i, big + 1 + (0 if i < 3 else i << 55), float(i), "a" if i < 3 else "b") for i in range(12)], "id long, x long, w double, y string")
    facts = schema.facts(df, "y", ["x", "w"])
    assert facts.low[0] == big + 1 and facts.high[0] == big + 1 + (11 << 55)
    made = balance.adasyn(df, "y", 2, id_col="id").data.where("id IS NULL")
    assert {r.x for r in made.collect()} == {big + 1} and made.count() == 6


def test_other_than_two_classes(spark):
    df = spark.createDataFrame([(float(i), c) for i, c in enumerate("abcabcd")], "x double, y string")
    for call in (lambda d: balance.weighted(d, "y"), lambda d: balance.balance(d, "y", "none"), lambda d: balance.balance(d, "y", "weight")):
        for d in (df, df.where("y = 'a'")):
            with pytest.raises(BalanceError, match="exactly two"):
                call(d)


def test_generated(spark):
    m = generated.matrix_frame(spark, [[1.0, 2.0], [3.0, 4.0]], ["a", "b"])
    assert m.columns == ["id", "V1", "V2", "y"]
    for x, y in (([[1.0]], ["a"]), ([[1.0], [2.0]], ["a"])):
        with pytest.raises(BalanceError):
            generated.matrix_frame(spark, x, y)
    with pytest.raises(BalanceError):
        generated.column("other", F.col("id"), "a")


def test_stream_batches(spark, tmp_path):
    df = table(spark, 5, 15)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = batches.balanced_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "y", lambda b, n: seen.append(b.count()), "nearmiss", id_col="id").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [10]
    with pytest.raises(BalanceError):
        batches.balanced_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "y", None, "nearmis")
    why, one = [], df.where("y = 'maj'")
    one.coalesce(1).write.parquet(str(tmp_path / "one"))
    q = batches.balanced_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "one")), "y", lambda b, n: seen.append(b.count()), "nearmiss", id_col="id", passed=lambda n, w: why.append(w)).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [10, 15] and why == ["fewer than two classes"]


def test_chunks_and_workers(spark):
    """Batches of at most so many queries, and so many tasks, with the same rows."""
    x = points(spark, RNG.normal(size=(90, 3)))
    plain = sorted(map(tuple, knn.knn(x, x, 3, exclude_self=True).collect()))
    for small in (knn.SMALL, 0):
        out = knn.knn(x, x, 3, exclude_self=True, small=small, chunk_size=20, workers=7)
        assert sorted(map(tuple, out.collect())) == plain
    near = knn.neighbour_lists(x, x, 3, exclude_self=True, chunk_size=20, workers=7)
    assert near.rdd.getNumPartitions() == 7
    batch = __import__("pyarrow").RecordBatch.from_pydict({"a": list(range(90))})
    assert [b.num_rows for b in knn.parts(batch, 20)] == [20] * 4 + [10] and [b.num_rows for b in knn.parts(batch, None)] == [90]
    df = table(spark, 20, 70)
    for how in ({"workers": 3, "chunk_size": 8}, {"workers": 3, "chunk_size": 8, "small": 0}):
        rows = [sorted(map(str, balance.adanear(df, "y", 0.5, 0.5, id_col="id", decimals=9, **h).data.collect())) for h in ({}, how)]
        assert rows[0] == rows[1]
    with pytest.raises(BalanceError):
        knn.knn(x, x, 3, workers=0)


def test_formulas(spark):
    names = ["y", "a", "b.c", "d e", "id"]
    assert schema.formula("y ~ . - `d e`", names, "id") == ("y", ["a", "b.c"])
    assert schema.formula("`d e` ~ b.c + a - 1", names) == ("d e", ["b.c", "a"])
    assert schema.formula("y~.", names) == ("y", ["a", "b.c", "d e", "id"])
    for bad in ("y", "~ a", "y ~ ", "y ~ a + ", "y ~ a b", "y ~ a:b", "y ~ I(a)", "y ~ a^2", "y + a ~ .", ". ~ a", "y ~ x", "x ~ a", "y ~ y", "y ~ a - a", "y ~ a ~ b", "y ~ 1"):
        with pytest.raises(BalanceError):
            schema.formula(bad, names)
    df = table(spark, 10, 30)
    whole = lambda target, **how: sorted(map(str, balance.adanear(df, target, 0.5, 0.5, id_col="id", **how).data.collect()))
    assert whole("y ~ x1 + x2") == whole("y ~ .") == whole("y", features=["x1", "x2"])
    assert balance.nearmiss(df, "y ~ x2", id_col="id").data.columns == ["id", "x2", "y"]
    assert balance.balance(df, "y ~ .", "weight", validate=True, id_col="id").diagnostics["scale_pos_weight"] == 3
    assert balance.weighted(df, "y ~ x1").count() == 40
    with pytest.raises(BalanceError, match="already"):
        balance.adasyn(df, "y ~ x1", features=["x2"])


def test_repeated_vectors_equal_brute_force(spark):
    """Most queries and references share few vectors, one of them over a third of all."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (300, 2)).astype(float)
    x[::3] = x[0]
    df = points(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for exclude in (True, False):
        e = d + np.where(np.eye(len(x), dtype=bool) & exclude, np.inf, 0)
        want = {i + 1: (np.argsort(r, kind="stable")[:4] + 1).tolist() for i, r in enumerate(e)}
        for small in (knn.SMALL, 0):
            assert {r.query_id: [n.neighbor_id for n in r.near] for r in repeated.lists(df, df, 4, exclude, engine="exact", small=small).collect()} == want
    plan = repeated.lists(df, df, 4, True, engine="exact", small=0, sizes=(16, 80), dim=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("algorithm", ["auto", "kd_tree", "cover_tree"])
def test_many_pairs_are_searched_by_distinct_vectors(spark, monkeypatch, algorithm):
    rng = np.random.default_rng(3)
    df = points(spark, rng.integers(0, 5, (240, 2)).astype(float))
    how = {"exclude_self": True, "engine": "exact", "decimals": 9, "algorithm": algorithm, "leaf": 4}
    routes = [{"small": knn.SMALL}, {"small": 0, "chunk_size": 20, "workers": 3}, {"small": 0, "chunk_size": 20, "query_is_data": True}]
    got = lambda more: {r.query_id: [tuple(n) for n in r.near] for r in knn.neighbour_lists(df, df, 4, **how, **more).collect()}
    want = got(routes[0])
    monkeypatch.setattr(knn, "MANY", 0)
    assert all(got(more) == want for more in routes) and len(want) == 240
    # 25 vectors are searched, and 240 rows meet them by a join
    assert "Join" in knn.neighbour_lists(df, df, 4, **how)._jdf.queryExecution().executedPlan().toString()


def test_very_many_pairs_in_few_dimensions_go_by_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df, asked = points(spark, np.round(rng.random((200, 2)), 2)), []
    got = lambda: {r.query_id: [tuple(n) for n in r.near] for r in knn.neighbour_lists(df, df, 4, exclude_self=True, decimals=9, leaf=8).collect()}
    want, searched = got(), tree.searched
    monkeypatch.setattr(tree, "searched", lambda *a, **k: asked.append(a) or searched(*a, **k))
    monkeypatch.setattr(knn, "MANY", 0)
    monkeypatch.setattr(knn, "DEALT", 0, raising=False)
    assert got() == want and len(want) == 200 and asked


def test_trees_need_no_installed_copy(spark, monkeypatch, tmp_path):
    """What a tree search and its bounds send can be read where the package isn't."""
    df, sent, context = points(spark, np.round(RNG.random((60, 2)), 2)), [], type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    assert tree.searched(df, df, 3, leaf=8)[0].count() == 60
    assert undersampling.pruned(df, df, 3, 7, sizes=(60, 60), dim=2, leaf=8)[1] >= 7
    files = [tmp_path / str(i) for i in range(len(sent))]
    for f, x in zip(files, sent, strict=True):
        f.write_bytes(pickle.dumps(x))
    read = "import pickle, sys\nfor f in sys.argv[1:]:\n    x = pickle.load(open(f, 'rb'))\n    print(len(pickle.loads(x) if isinstance(x, bytes) else x))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", read, *map(str, files)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and len(out.stdout.split()) == len(sent) >= 4, out.stderr


@pytest.mark.parametrize("call", [balance.adasyn, balance.nearmiss, balance.adanear, balance.adanear_uniform])
def test_balancing_of_many_pairs(spark, monkeypatch, call):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 2)).tolist()
    df = spark.createDataFrame([(i, *map(float, v), "min" if i % 6 == 0 else "maj") for i, v in enumerate(x)], "id long, x1 double, x2 double, y string")
    made = lambda small: sorted(map(str, call(df, "y", seed=3, id_col="id", features=["x1", "x2"], decimals=9, small=small, chunk_size=40, provenance=True).data.collect()))
    want = made(knn.SMALL)
    monkeypatch.setattr(knn, "MANY", 0)
    assert made(knn.SMALL) == made(0) == want


@pytest.mark.parametrize("decimals", [None, 2])
def test_few_distances_in_few_dimensions(monkeypatch, decimals):
    """The same neighbours as from all distances, ties and own places too, from less than half of them."""
    rng = np.random.default_rng(5)
    q, r = np.round(rng.normal(size=(3000, 2)), 2), np.round(rng.normal(size=(4000, 2)), 2)
    r[:3000] = q
    own, made, tiles = np.where(np.arange(3000) % 2, np.arange(3000), -1), [], knn.tiles

    def counted(*args):
        for t in tiles(*args):
            made.append(t[2].size)
            yield t

    monkeypatch.setattr(knn, "tiles", counted)
    found = lambda: [np.concatenate(p).tolist() for p in zip(*knn.nearest(q, r, own, 5, "euclidean", decimals), strict=True)]
    few, n = found(), sum(made)
    monkeypatch.setattr(knn, "LOW", 0)
    made.clear()
    assert found() == few and sum(made) == len(q) * len(r) and n < 0.5 * len(q) * len(r)


def test_numbered_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "id long, z array<double>")
    assert [tuple(r) for r in generated.numbered(df, "z", 2).orderBy("id").collect()] == [(1, 1.0, 2.0), (2, 3.0, None)]
    with pytest.raises(BalanceError):
        generated.numbered(df.withColumn("v1", F.lit(1)), "z", 2)


@pytest.mark.parametrize("score", ["mean", "mean_sq"])
def test_bounds_keep_all_that_score_low(spark, monkeypatch, score):
    """Whatever cells hold, no row among the m smallest is left out, and in clusters most others are."""
    refs, q = clusters(400, 3, 4), np.concatenate([clusters(300, 3, 4) + 0.3, 60 * RNG.normal(size=(500, 3))])
    d = np.sort(((q[:, None] - refs[None]) ** 2).sum(-1), axis=1)[:, :5]
    s = (np.sqrt(d) if score == "mean" else d).mean(axis=1)
    for m, leaf in ((1, 10), (40, 10), (300, 25), (799, 10)):
        left, n = undersampling.pruned(points(spark, q), points(spark, refs), 5, m, score, 9, sizes=(800, 400), dim=3, leaf=leaf)
        ids = {r.id for r in left.select("id").collect()}
        assert len(ids) == n and {int(i) + 1 for i in np.argsort(s, kind="stable")[:m]} <= ids
        assert n < 500 or m == 799
    tie = points(spark, np.ones((30, 2)))
    assert undersampling.pruned(tie, tie, 3, 7, score, None, sizes=(30, 30), dim=2, leaf=4)[1] == 30


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_single_precision_loses_nothing(spark, metric):
    """Far from the origin, where single-precision products tell hardly any of these rows apart."""
    x = np.round(RNG.normal(size=(80, 6)), 2) + (1000 if metric == "euclidean" else 0)
    df = points(spark, x)
    rows = lambda **how: sorted(map(tuple, knn.knn(df, df, 4, metric=metric, engine="exact", exclude_self=True, **how).collect()))
    for small, same in ((knn.SMALL, False), (0, False), (0, True)):
        assert rows(small=small, query_is_data=same, precision="single") == rows(small=small, query_is_data=same)
    d = next(knn.tiles(x, x, None, metric, None, True))
    assert d[2].dtype == np.float32
    for scale in (1e-25, 1e25):
        far = np.round(RNG.normal(size=(40, 3)), 1) * scale
        one, two = (np.concatenate([np.stack(t[:2]) for t in knn.nearest(far, far, np.arange(40), 3, "euclidean", None, single)], axis=1) for single in (True, False))
        assert np.array_equal(one, two)
    with pytest.raises(BalanceError):
        knn.knn(df, df, 4, precision="half")
