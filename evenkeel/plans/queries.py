"""One query for each operator over the given tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import balance, knn, repeated, restore, roles, scaling, schema, steps, synthesis, undersampling
from evenkeel.plans import sql
from evenkeel.sources import generated, tables

FEATURES = ["p_size", "p_retailprice"]
#: Squared distances and scores are rounded before ranking, so that no order of sums decides between equals.
PART = {"id_col": "p_partkey", "features": FEATURES, "decimals": 9}


def _prepared(spark: SparkSession, folder: str, **options) -> balance.Prepared:
    return balance.prepared(tables.parts(spark, folder), "cls", balance.Options(**(PART | options)))


def _rounded(df: DataFrame, **to: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in to.items()})


def class_counts(spark, folder):
    return roles.class_counts(tables.parts(spark, folder), "cls")


def class_ratio(spark, folder):
    counts = roles.class_counts(tables.parts(spark, folder), "cls")
    low, high = (f(F.col("label"), F.struct("n", "label")) for f in (F.min_by, F.max_by))
    out = counts.agg(low.alias("minority"), high.alias("majority"), F.min("n").alias("n_min"), F.max("n").alias("n_maj"))
    return out.withColumn("class_ratio", F.round(F.col("n_maj") / F.col("n_min"), 9))


def zscore_params(ddof: int):
    return lambda spark, folder: _rounded(scaling.parameter_table(tables.parts(spark, folder), FEATURES, ddof), center=6, scale=6)


def zscore_apply(spark, folder):
    p = _prepared(spark, folder)
    return _rounded(scaling.apply(p.df, FEATURES, p.scaling).drop("cls"), p_size=6, p_retailprice=6)


def zscore_single(spark, folder):
    p = _prepared(spark, folder, ddof=0)
    out = scaling.apply(p.df, FEATURES, p.scaling, "single").drop("cls")
    return out.select("p_partkey", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in FEATURES])


def zscore_roundtrip(spark, folder):
    p = _prepared(spark, folder)
    return _rounded(scaling.revert(scaling.apply(p.df, FEATURES, p.scaling), FEATURES, p.scaling).drop("cls"), p_size=6, p_retailprice=6)


def zscore_given(spark, folder):
    """The scaling call by itself, on another table."""
    out, _ = scaling.zscore(tables.purchases(spark, folder), "cls", ["value", "hour"])
    return _rounded(out.drop("cls"), value=6, hour=6)


def l2_normalize(spark, folder):
    return _rounded(scaling.l2_normalize(tables.parts(spark, folder).drop("cls"), FEATURES), p_size=9, p_retailprice=9)


def covariance(spark, folder):
    return _rounded(vectors.covariances(tables.parts(spark, folder), FEATURES), covariance=4)


def knn_minority_all(spark, folder):
    p = _prepared(spark, folder)
    return _rounded(p.knn(p.vectors("rare"), p.vectors(), 5, (p.roles.n_min, p.facts.rows), exclude_self=True), dist=6)


def knn_self(spark, folder):
    p = _prepared(spark, folder)
    minor = p.vectors("rare")
    return _rounded(p.knn(minor, minor, 5, (p.roles.n_min, p.roles.n_min), exclude_self=True), dist=6)


def knn_dropped_self(spark, folder):
    """As knn_self, by one neighbour more and dropping the query itself."""
    p = _prepared(spark, folder)
    minor = p.vectors("rare")
    return knn.drop_self(p.knn(minor, minor, 6, (p.roles.n_min, p.roles.n_min), returns="index"), 5)


def knn_blocks(spark, folder):
    """Majority to minority with neither side sent whole: both are dealt into blocks."""
    p = _prepared(spark, folder, small=0)
    return _rounded(p.knn(p.vectors("common"), p.vectors("rare"), 3, (p.roles.n_maj, p.roles.n_min)), dist=6)


def _ranked(near: DataFrame) -> DataFrame:
    out = near.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.neighbor_id", F.round(F.sqrt("x.measure"), 6).alias("dist"))


def knn_tree(spark, folder):
    """All rows among all others by a tree of medians, in cells of some 64."""
    p = _prepared(spark, folder, algorithm="kd_tree", engine="exact")
    rows = p.vectors()
    return _ranked(p.lists(rows, rows, 5, (p.facts.rows, p.facts.rows), exclude_self=True, leaf=64))


def knn_cover_tree(spark, folder):
    """Common rows among all others by centres that lie far apart."""
    p = _prepared(spark, folder, algorithm="cover_tree", engine="exact")
    return _ranked(p.lists(p.vectors("common"), p.vectors(), 3, (p.roles.n_maj, p.facts.rows), exclude_self=True, leaf=64))


def knn_self_blocks(spark, folder):
    """All rows among all others, in blocks of which each two meet once."""
    p = _prepared(spark, folder, small=0, chunk_size=500)
    rows = p.vectors()
    return _rounded(p.knn(rows, rows, 5, (p.facts.rows, p.facts.rows), exclude_self=True, query_is_data=True), dist=6)


def knn_repeated(spark, folder):
    """All events among all others by hour and tens of their value, of which many are alike."""
    x = tables.purchases(spark, folder).select(F.col("event_id").alias("id"), F.array(F.col("hour").cast("double"), F.floor(F.col("value") / 10).cast("double")).alias("z"))
    return _ranked(repeated.lists(x, x, 5, True, engine="exact"))


def vector_columns(spark, folder):
    """Embeddings as numbered columns of doubles."""
    return _rounded(generated.numbered(tables.points(spark, folder), "z", 64), **{f"V{j}": 6 for j in range(1, 65)})


def step_checks(spark, folder):
    """Which selections, flags and features a step takes over a table, how it shows itself then, and how many rows it gives."""
    from pyspark.ml.feature import VectorAssembler

    df = tables.parts(spark, folder)
    dense = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(df)
    cases = {
        "one outcome": lambda: steps.step_adasyn("cls", ratio=0.5, **PART).fit(df),
        "one in a list": lambda: steps.step_nearmiss(["cls"], ratio=1.0, **PART).fit(df),
        "two outcomes": lambda: steps.step_adasyn(["cls", "p_size"], **PART).fit(df),
        "no outcome": lambda: steps.step_adasyn([], **PART).fit(df),
        "unknown outcome": lambda: steps.step_adasyn("nothing", **PART).fit(df),
        "flag": lambda: steps.step_adasyn("cls", ratio=0.5, audit=True, skip=False, **PART).fit(df),
        "number for a flag": lambda: steps.step_adasyn("cls", audit=1, **PART).fit(df),
        "text for a flag": lambda: steps.step_adasyn("cls", skip="no", **PART).fit(df),
        "flag of the call": lambda: balance.Options(restore_types="yes"),
        "vector feature": lambda: schema.resolved(dense, "cls", ["v"], "p_partkey"),
    }
    rows = []
    for name, make in cases.items():
        model = make() if _accepted(make) else None
        rows.append((name, model is not None, model and repr(model), model and model.training().data.count()))
    return spark.createDataFrame(rows, "name string, accepted boolean, said string, n long")


def knn_cosine(spark, folder):
    x = tables.points(spark, folder)
    return _rounded(knn.knn(x.where("label = 0"), x, 5, metric="cosine", engine="exact", exclude_self=True, decimals=9), dist=6)


def knn_ip(spark, folder):
    x = tables.points(spark, folder)
    return _rounded(knn.knn(x.where("label = 1"), x.where("label = 0"), 3, metric="ip", engine="exact", decimals=9), dist=6)


def knn_projections(spark, folder):
    """Approximate by nature."""
    x = tables.points(spark, folder)
    return knn.knn(x.where("label = 0"), x, 5, metric="cosine", allow_approx=True, exclude_self=True)


def knn_lists_recall(spark, folder):
    """What share of the true neighbours the approximate engine finds, and whether all lists are full."""
    x = tables.points(spark, folder)
    how = {"metric": "cosine", "exclude_self": True}
    near, true = (knn.knn(x.where("label = 0"), x, 5, engine=e, **how).select("query_id", "neighbor_id") for e in ("lists", "exact"))
    found = near.join(true, ["query_id", "neighbor_id"], "left_semi")
    n = [t.agg(F.count(F.lit(1)).alias(c)) for t, c in ((near, "n_near"), (true, "n_true"), (found, "n_found"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).select((F.col("n_near") == F.col("n_true")).alias("whole"), (F.col("n_found") >= 0.9 * F.col("n_true")).alias("near"))


def knn_graph_recall(spark, folder):
    """By label of the query: neighbours found by graphs, and whether at least 0.95 of the true ones are among them."""
    x = tables.points(spark, folder)
    how = {"metric": "cosine", "exclude_self": True, "decimals": 9}
    near, true = (knn.knn(x, x, 10, engine=e, **how).select("query_id", "neighbor_id") for e in ("RcppHNSW", "exact"))
    both = near.withColumn("found", F.lit(1)).join(true.withColumn("true", F.lit(1)), ["query_id", "neighbor_id"], "full")
    by = both.join(x.select(F.col("id").alias("query_id"), "label"), "query_id").groupBy("label")
    return by.agg(F.count("found").alias("n"), (F.count_if(F.col("found").isNotNull() & F.col("true").isNotNull()) >= 0.95 * F.count("true")).alias("near"))


def _difficulty(p: balance.Prepared) -> DataFrame:
    minor = p.vectors("rare")
    return synthesis.difficulty(p.lists(minor, p.vectors(), 5, (p.roles.n_min, p.facts.rows), exclude_self=True), minor)


def adasyn_difficulty(spark, folder):
    return _difficulty(_prepared(spark, folder))


def adasyn_weights(spark, folder):
    return _rounded(synthesis.weights(_difficulty(_prepared(spark, folder))).drop("k"), weight=9)


def adasyn_allocation(spark, folder):
    p = _prepared(spark, folder)
    return synthesis.apportioned(_difficulty(p), roles.expansion(p.roles.n_min, 0.5))


def adasyn_synthetic(spark, folder):
    p = _prepared(spark, folder)
    made, _ = balance._generated(p, 0.5, 5, 7)
    z = F.col("z")
    return made.select("base_id", "copy", "neighbor_id", F.round("share", 9).alias("share"), F.round(F.get(z, F.lit(0)), 6).alias("z1"), F.round(F.get(z, F.lit(1)), 6).alias("z2"))


def restore_types(spark, folder):
    """Quotients of lineitem's prices as whole numbers within 10 and 40."""
    from pyspark.sql import types as T

    x = restore.restored("CAST(l_extendedprice AS double) / 1000", T.IntegerType(), 10, 40)
    half = restore.restored("CAST(l_quantity AS double) / 2", T.LongType(), 0, 1000)
    return tables.read(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{x} AS x", f"{half} AS half")


def _part_rows(df: DataFrame) -> DataFrame:
    return _rounded(df, p_retailprice=6)


def adasyn_full(spark, folder):
    return _part_rows(balance.adasyn(tables.parts(spark, folder), "cls", 0.5, 5, 7, **PART).data)


def adasyn_events(spark, folder):
    """No random draw decides how many rows each one starts: new rows by the row they start from."""
    p = balance.prepared(tables.purchases(spark, folder), "cls", balance.Options(id_col="event_id", decimals=9))
    made, _ = balance._generated(p, 0.1, 5, 3)
    return made.groupBy("base_id").agg(F.count(F.lit(1)).alias("n"))


#: Neither side is sent whole: all searches are in blocks of at most some 500 rows, which three tasks deal out.
DEALT = {"small": 0, "chunk_size": 500, "workers": 3}


def knn_single(spark, folder):
    """Candidates by products in single precision, ranked as doubles are."""
    p = _prepared(spark, folder, precision="single")
    return _rounded(p.knn(p.vectors("common"), p.vectors(), 5, (p.roles.n_maj, p.facts.rows), exclude_self=True), dist=6)


def adanear_single(spark, folder):
    return _part_rows(balance.adanear(tables.parts(spark, folder), "cls", 0.3, 0.5, 5, 5, 7, precision="single", **PART).data)


def adasyn_blocks(spark, folder):
    return _part_rows(balance.adasyn(tables.parts(spark, folder), "cls", 0.5, 5, 7, **PART, **DEALT).data)


def nearmiss_blocks(spark, folder):
    return balance.nearmiss(tables.parts(spark, folder), "cls", 1.0, 5, **PART, **DEALT).data


def nearmiss_pruned(spark, folder):
    """The 40 common rows that lie nearest to those of size 45 and over, of those that bounds by cells leave."""
    df = tables.parts(spark, folder).withColumn("cls", F.when(F.col("p_size") >= 45, "rare").otherwise("common"))
    p = balance.prepared(df, "cls", balance.Options(**PART))
    sizes = (p.roles.n_maj, p.roles.n_min)
    left, n = undersampling.pruned(p.vectors("common"), p.vectors("rare"), 5, 40, decimals=9, sizes=sizes, dim=2, leaf=16)
    kept = undersampling.kept(undersampling.scored(p.lists(left, p.vectors("rare"), 5, (n, sizes[1]))), 40, 9)
    return kept.select("id", F.round("score", 6).alias("score"))


def adanear_blocks(spark, folder):
    return _part_rows(balance.adanear(tables.parts(spark, folder), "cls", 0.3, 0.5, 5, 5, 7, **PART, **DEALT).data)


def oversample_uniform_blocks(spark, folder):
    return _part_rows(balance.adasyn_uniform(tables.parts(spark, folder), "cls", 0.5, 3, 7, **PART, **DEALT).data)


def adanear_uniform_blocks(spark, folder):
    return _part_rows(balance.adanear_uniform(tables.parts(spark, folder), "cls", 0.3, 0.5, seed=7, **PART, **DEALT).data)


def copies_in_ranges(spark, folder):
    """A row for each unit of each line of lineitem, dealt out in ranges of 16."""
    lines = tables.read(spark, folder, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("base_id"), F.col("l_quantity").cast("long").alias("n"))
    return synthesis.copies(lines, width=16).groupBy("base_id").agg(F.count(F.lit(1)).alias("copies"), F.sum("copy").alias("total"))


def nearmiss_formula(spark, folder):
    """The columns named by a formula."""
    how = {k: v for k, v in PART.items() if k != "features"}
    return balance.nearmiss(tables.parts(spark, folder), "cls ~ . - p_partkey", 1.0, 5, **how).data


#: Formulas over part's columns.
FORMULAS = ("cls ~ .", "cls ~ . - p_size", "cls~p_size+p_retailprice", "cls ~ `p_size`", "cls ~ p_retailprice + . - p_size - 1", "cls ~ p_size + p_size", "cls ~ cls", "cls ~ . - .", "cls ~ log(p_size)", "cls ~ p_size:p_retailprice", "cls ~ p_size * 2", "cls ~ nothing", "nothing ~ .", "cls + p_size ~ .", "~ p_size", "cls ~", "cls ~ p_size p_retailprice", "cls ~ p_size ~ .", "cls")


def formulas(spark, folder):
    """What each formula chooses of the table's columns and their least values, or null."""
    df = tables.parts(spark, folder)
    chosen = {f: schema.formula(f, df.columns, "p_partkey")[1] if _accepted(schema.formula, f, df.columns, "p_partkey") else None for f in FORMULAS}
    least = df.agg(*[F.min(c).cast("double").alias(c) for c in FEATURES])
    rows = [F.struct(F.lit(f).alias("formula"), F.lit(c and ",".join(c)).cast("string").alias("features"), F.round(sum((F.col(x) for x in c or []), F.lit(0.0)), 6).alias("least")) for f, c in chosen.items()]
    return least.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def nearmiss_ids(spark, folder):
    p = _prepared(spark, folder)
    return balance._majority_kept(p, 1.0, 5, None, 0).select("id")


def nearmiss_scores(spark, folder):
    p = _prepared(spark, folder)
    near = p.lists(p.vectors("common"), p.vectors("rare"), 5, (p.roles.n_maj, p.roles.n_min))
    return _rounded(undersampling.scored(near), score=6)


def nearmiss_rows(spark, folder):
    return balance.nearmiss(tables.parts(spark, folder), "cls", 1.0, 5, **PART).data


def nearmiss_toxic(spark, folder):
    return balance.nearmiss(tables.toxic(spark, folder), "toxic", 2.0, 3, id_col="doc_id", decimals=9).data


def nearmiss_sq(spark, folder):
    return balance.nearmiss_uniform(tables.parts(spark, folder), "cls", 1.5, **PART).data


def adanear_full(spark, folder):
    return _part_rows(balance.adanear(tables.parts(spark, folder), "cls", 0.3, 0.5, 5, 5, 7, **PART).data)


def oversample_uniform(spark, folder):
    return _part_rows(balance.adasyn_uniform(tables.parts(spark, folder), "cls", 0.5, 3, 7, **PART).data)


def adanear_uniform(spark, folder):
    return _part_rows(balance.adanear_uniform(tables.parts(spark, folder), "cls", 0.3, 0.5, seed=7, **PART).data)


def balance_none(spark, folder):
    return balance.balance(tables.parts(spark, folder), "cls", "none").data


def balance_weight(spark, folder):
    return _rounded(balance.weighted(tables.parts(spark, folder), "cls"), weight=9)


def balance_adanear(spark, folder):
    """By name, with the target renamed as for model input."""
    return _part_rows(balance.balance(tables.parts(spark, folder), "cls", "adanear", adasyn_ratio=0.3, nearmiss_ratio=0.5, seed=7, target_out="TARGET", **PART).data)


def step_nearmiss(spark, folder):
    return steps.step_nearmiss("cls", ratio=1.0, **PART).fit_resample(tables.parts(spark, folder))


def step_skipped(spark, folder):
    """New rows pass through a fitted step."""
    return steps.step_adasyn("cls", seed=7, **PART).fit(tables.parts(spark, folder)).transform(tables.parts(spark, folder))


def contents_ids(spark, folder):
    """How often each row occurs, by ids made from contents."""
    rows = schema.identified(tables.read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), "made")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct("made").alias("ids"))


def generated_table(spark, folder):
    out = generated.rare_class_table(spark, 2000, 12, 0.05)
    return _rounded(out, **{c: 6 for c, kind in out.dtypes if kind == "double"})


def balance_adasyn(spark, folder):
    return _part_rows(balance.balance(tables.parts(spark, folder), "cls", "adasyn", adasyn_ratio=0.5, over_k=5, seed=7, **PART).data)


def balance_nearmiss(spark, folder):
    return balance.balance(tables.parts(spark, folder), "cls", "nearmiss", nearmiss_ratio=1.0, under_k=5, **PART).data


def balance_adanear_weight(spark, folder):
    """The class ratio that is left, for use as a weight, with the rows by class."""
    out = balance.balance(tables.parts(spark, folder), "cls", "adanear_weight", adasyn_ratio=0.3, nearmiss_ratio=2.0, seed=7, **PART)
    return out.data.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumn("scale_pos_weight", F.round(F.lit(out.diagnostics["scale_pos_weight"]), 9))


def step_adanear(spark, folder):
    return _part_rows(steps.step_adanear("cls", adasyn_ratio=0.3, nearmiss_ratio=0.5, over_k=5, under_k=5, seed=7, **PART).fit_resample(tables.parts(spark, folder)))


def step_adasyn_uniform(spark, folder):
    return _part_rows(steps.step_adasyn_uniform("cls", ratio=0.5, seed=7, **PART).fit_resample(tables.parts(spark, folder)))


def step_nearmiss_uniform(spark, folder):
    return steps.step_nearmiss_uniform("cls", ratio=1.5, **PART).fit_resample(tables.parts(spark, folder))


def step_adanear_uniform(spark, folder):
    return _part_rows(steps.step_adanear_uniform("cls", adasyn_ratio=0.3, nearmiss_ratio=0.5, seed=7, **PART).fit_resample(tables.parts(spark, folder)))


def step_in_pipeline(spark, folder):
    """How many rows of each class a stage after a step is fitted on, and how many new rows pass."""
    from pyspark.ml.feature import StringIndexer

    df = tables.parts(spark, folder)
    model = steps.BalancedPipeline(stages=[steps.step_adasyn("cls", ratio=40.0, seed=7, **PART), StringIndexer(inputCol="cls", outputCol="place")]).fit(df)
    passed = model.transform(tables.parts(spark, folder)).groupBy("cls").agg(F.count(F.lit(1)).alias("passed"))
    # the most frequent class is the first one
    return passed.withColumn("place", F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(model.stages[1].labels) for x in (c, i)]), F.col("cls")))


def step_tidy(spark, folder):
    """Tables of parameters, before and after fitting, of a step of each kind."""
    df, out = tables.parts(spark, folder), []
    for make, p in ((steps.step_adasyn, {"ratio": 0.5}), (steps.step_nearmiss, {"ratio": 1.5, "skip": False}), (steps.step_adanear, {"adasyn_ratio": 0.3, "nearmiss_ratio": 0.5})):
        step = make("cls", id=make.__name__, **p)
        out += [step.tidy(spark), step.fit(df).tidy(spark)]
    for d in out[1:]:
        out[0] = out[0].union(d)
    return out[0]


def runtime(spark, folder):
    r = steps.runtime_report(spark)
    return spark.createDataFrame([(r["runtime"], r["cores"] > 0, bool(r["version"]))], "runtime string, has_cores boolean, has_version boolean")


def tied_classes(spark, folder):
    """Of classes of one size the first is the minority, in the uniform variant, and a fixed pair decides in the other."""
    df = tables.read(spark, folder, "nation").where("n_nationkey < 24").select("n_nationkey", F.col("n_regionkey").cast("double").alias("x"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("cls"))
    how = {"id_col": "n_nationkey", "features": ["x"]}
    count = lambda r, name: r.data.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumn("variant", F.lit(name))
    out = count(balance.adasyn_uniform(df, "cls", 0.5, **how), "uniform")
    out = out.union(count(balance.adasyn(df, "cls", 0.5, minority="odd", majority="even", **how), "fixed"))
    return out.union(count(balance.nearmiss(df, "cls", 0.25, **how), "nearmiss"))


def audit(spark, folder):
    """Diagnostics as numbers: rows in, made, removed and out, and class ratios before and after."""
    out = balance.adanear(tables.parts(spark, folder), "cls", 0.3, 0.5, 5, 5, 7, audit_level="light", **PART)
    d = out.diagnostics | {"class_ratio_out": out.class_ratio_out()}
    names = ("rows_in", "rows_generated", "rows_removed", "rows_out", "class_ratio_in", "class_ratio_out")
    return spark.createDataFrame([(n, round(float(d[n]), 9)) for n in names], "name string, value double")


def column_types(spark, folder):
    """Kinds and ranges of columns, as they decide how new values are rounded and clamped."""
    df = tables.read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").cast("double").alias("l_extendedprice"), (F.col("l_linenumber") == 1).alias("first"))
    names = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    rows = restore.inferred(df, names, schema.facts(df, "first", names))
    return spark.createDataFrame([(n, k, lo, hi) for n, k, lo, hi in rows], "feature string, kind string, low long, high long")


#: Numbers that parameters are tried with.
TRIED = (-1.0, 0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 1000.0, 2147483647.0, 2147483648.0, float("inf"))


def _accepted(check, *x) -> bool:
    try:
        check(*x)
    except BalanceError:
        return False
    return True


def parameter_checks(spark, folder):
    """Which numbers each parameter takes."""
    from evenkeel.operators import checks

    known = {
        "positive_integer": lambda x: checks.positive_integer(x, "k"),
        "workers": lambda x: balance.Options(workers=x),
        "chunk_size": checks.chunk_size,
        "seed": checks.seed,
        "ratio": lambda x: checks.ratio(x, "ratio"),
        "hybrid_ratio": lambda x: checks.ratio(x, "ratio", zero=True),
        "graph_m": lambda x: checks.graph_parameters(x, 200),
        "graph_ef": lambda x: checks.graph_parameters(16, x),
        "scale": lambda x: checks.scaling(scaling.Scaling((0.0,), (x,)), ["a"]),
        "center": lambda x: checks.scaling(scaling.Scaling((x,), (1.0,)), ["a"]),
        "output_rows": lambda x: checks.output_rows(1000, x),
        "dense_budget": lambda x: checks.dense_budget(10_000_000, 100, 2, x, "it"),
        "retention": lambda x: roles.retention(3, 9, checks.ratio(x, "ratio")),
    }
    return spark.createDataFrame([(name, x, _accepted(f, x)) for name, f in known.items() for x in TRIED], "name string, value double, accepted boolean")


def choice_checks(spark, folder):
    """Which names of levels, backends, flags and columns are taken, and what an audit flag does to a level."""
    from evenkeel.operators import checks

    rows = [("level", str(a), v, checks.audit_level(a, v) if _accepted(checks.audit_level, a, v) else None) for a in (True, False) for v in ("none", "light", "full", "other")]
    rows += [("backend", v, "", checks.backend(v) if _accepted(checks.backend, v) else None) for v in ("parallel", "RcppParallel", "other")]
    df = tables.parts(spark, folder)
    for target, features in (("cls", "p_size"), ("cls", "nothing"), ("nothing", "p_size"), ("cls", "cls"), ("cls", "p_size,p_size"), ("cls", "p_size,p_retailprice")):
        names = features.split(",")
        rows.append(("columns", target, features, ",".join(schema.resolved(df, target, names, "p_partkey")) if _accepted(schema.resolved, df, target, names, "p_partkey") else None))
    return spark.createDataFrame(rows, "name string, a string, b string, result string")


def row_checks(spark, folder):
    """Which tables are taken: nulls, infinite values, one class, three classes, classes of one row, no row."""
    df = tables.parts(spark, folder).select("p_partkey", F.col("p_size").cast("double").alias("x"), "cls")
    first = F.col("p_partkey") == 1
    cases = {
        "plain": df,
        "null feature": df.withColumn("x", F.when(~first, F.col("x"))),
        "infinite feature": df.withColumn("x", F.when(first, float("inf")).otherwise(F.col("x"))),
        "no number": df.withColumn("x", F.when(first, float("nan")).otherwise(F.col("x"))),
        "null target": df.withColumn("cls", F.when(~first, F.col("cls"))),
        "one class": df.where("cls = 'common'"),
        "three classes": df.withColumn("cls", F.when(first, "third").otherwise(F.col("cls"))),
        "one row in a class": df.withColumn("cls", F.when(first, "rare").otherwise("common")),
        "no row": df.limit(0),
        "text": df.withColumn("x", F.col("x").cast("string")),
    }
    said = [(name, _accepted(lambda d: schema.facts(d, "cls", schema.resolved(d, "cls", ["x"], "p_partkey")), d)) for name, d in cases.items()]
    return spark.createDataFrame(said, "name string, accepted boolean")


def engine_choice(spark, folder):
    """The engine and algorithm that each request resolves to, or null."""
    rows = []
    for engine in ("auto", "exact", *knn.ENGINES, "other"):
        for metric in knn.METRICS:
            for approx in (False, True):
                got = knn.resolved_engine(engine, metric, approx) if _accepted(knn.resolved_engine, engine, metric, approx) else None
                rows.append((engine, metric, approx, got, got and knn.resolved_algorithm("auto", got)))
    return spark.createDataFrame(rows, "engine string, metric string, approximate boolean, resolved string, algorithm string")


def _sql_rows(body: str, kept: str, with_syn: bool, target: str = "cls") -> str:
    inner = sql.rows(kept, with_syn, whole="1")
    return f"{body} SELECT id AS p_partkey, f1::INTEGER AS p_size, {'round(f2, 6)' if with_syn else 'f2'} AS p_retailprice, CASE WHEN rare THEN 'rare' ELSE 'common' END AS {target} FROM ({inner})"


def _cases() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    part = sql.scaled(sql.PARTS[0])
    pop = sql.scaled(sql.PARTS[0], 0)
    cls = "CASE WHEN p_brand = 'Brand#11' THEN 'rare' ELSE 'common' END"
    listed = "SELECT query_id, rank, neighbor_id, round(sqrt(d2), 6) AS dist FROM"
    syn = sql.synthetic(0.5, 5, 7, True)
    near = sql.nearest("kn", sql.MAJOR, sql.MINOR, 5, False)
    params = lambda body: f"{body} SELECT 'p_size' AS feature, round(m1, 6) AS center, round(s1, 6) AS scale FROM s UNION ALL SELECT 'p_retailprice', round(m2, 6), round(s2, 6) FROM s"
    hybrid = f"{part}, {sql.synthetic(0.3, 5, 7, True)}, {sql.retained(0.5, 5, True)}"
    alike = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v))"

    def angular(queries: str, refs: str, k: int, exclude: bool) -> str:
        return f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, round(1 - {alike}, 9) AS d FROM e a, e b WHERE a.{queries} {f"AND b.{refs}" if refs else ""} {"AND a.id <> b.id" if exclude else ""}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, round(d, 6) AS dist FROM k WHERE rank <= {k}"""

    return {
        "class_counts": (class_counts, f"SELECT {cls} AS label, count(*) AS n FROM part GROUP BY 1"),
        "class_ratio": (class_ratio, f"WITH c AS (SELECT {cls} AS label, count(*) AS n FROM part GROUP BY 1) SELECT arg_min(label, n) AS minority, arg_max(label, n) AS majority, min(n) AS n_min, max(n) AS n_maj, round(max(n)::DOUBLE / min(n), 9) AS class_ratio FROM c"),
        "zscore_params_sample": (zscore_params(1), params(part)),
        "zscore_params_pop": (zscore_params(0), params(pop)),
        "zscore_apply": (zscore_apply, f"{part} SELECT id AS p_partkey, round(z1, 6) AS p_size, round(z2, 6) AS p_retailprice FROM z"),
        "zscore_single": (zscore_single, f"{pop} SELECT id AS p_partkey, round(z1::FLOAT::DOUBLE, 4) AS p_size, round(z2::FLOAT::DOUBLE, 4) AS p_retailprice FROM z"),
        "zscore_roundtrip": (zscore_roundtrip, "SELECT p_partkey, p_size::DOUBLE AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part"),
        "zscore_given": (zscore_given, f"{sql.scaled(sql.EVENTS[0])} SELECT id AS event_id, round(z1, 6) AS value, round(z2, 6) AS hour FROM z"),
        "l2_normalize": (l2_normalize, "SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS p_retailprice FROM part"),
        "covariance": (covariance, "SELECT 'p_size' AS a, 'p_size' AS b, round(covar_samp(p_size, p_size), 4) AS covariance FROM part UNION ALL SELECT 'p_size', 'p_retailprice', round(covar_samp(p_size, p_retailprice), 4) FROM part UNION ALL SELECT 'p_retailprice', 'p_retailprice', round(covar_samp(p_retailprice, p_retailprice), 4) FROM part"),
        "knn_exact_minority_all": (knn_minority_all, f"{part}, {sql.nearest('k', sql.MINOR, sql.ALL, 5)} {listed} k"),
        "knn_exact_self": (knn_self, f"{part}, {sql.nearest('k', sql.MINOR, sql.MINOR, 5)} {listed} k"),
        "knn_dropped_self": (knn_dropped_self, f"{part}, {sql.nearest('k', sql.MINOR, sql.MINOR, 5)} SELECT query_id, rank, neighbor_id FROM k"),
        "knn_exact_blocks": (knn_blocks, f"{part}, {sql.nearest('k', sql.MAJOR, sql.MINOR, 3, False)} {listed} k"),
        "knn_tree": (knn_tree, f"{part}, {sql.nearest('k', sql.ALL, sql.ALL, 5)} {listed} k"),
        "knn_cover_tree": (knn_cover_tree, f"{part}, {sql.nearest('k', sql.MAJOR, sql.ALL, 3)} {listed} k"),
        "knn_self_blocks": (knn_self_blocks, f"{part}, {sql.nearest('k', sql.ALL, sql.ALL, 5)} {listed} k"),
        "knn_repeated": (knn_repeated, f"""WITH v AS (SELECT event_id AS id, hour(ts)::DOUBLE AS h, floor(value / 10) AS f FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY id) AS nth FROM v), d AS (SELECT DISTINCT h, f FROM v),
k AS (SELECT d.h, d.f, r.id, (d.h - r.h) * (d.h - r.h) + (d.f - r.f) * (d.f - r.f) AS d2 FROM d, r WHERE nth <= 6),
t AS (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY d2, id) AS nth FROM k),
o AS (SELECT v.id AS query_id, t.id AS neighbor_id, d2, row_number() OVER (PARTITION BY v.id ORDER BY d2, t.id) AS rank FROM v JOIN t USING (h, f) WHERE t.nth <= 6 AND v.id <> t.id)
{listed} o WHERE rank <= 5"""),
        "vector_columns": (vector_columns, f"SELECT vec_id AS id, label, {', '.join(f'round(embedding[{j}]::DOUBLE, 6) AS V{j}' for j in range(1, 65))} FROM embeddings"),
        "step_checks": (step_checks, f"{part}, a AS (SELECT unnest(['one outcome', 'one in a list', 'two outcomes', 'no outcome', 'unknown outcome', 'flag', 'number for a flag', 'text for a flag', 'flag of the call', 'vector feature']) AS name) SELECT name, name IN ('one outcome', 'one in a list', 'flag') AS accepted, CASE WHEN name IN ('one outcome', 'flag') THEN 'BalanceStep(adasyn of cls) [trained]' WHEN name = 'one in a list' THEN 'BalanceStep(nearmiss of cls) [trained]' END AS said, CASE WHEN name IN ('one outcome', 'flag') THEN n_min + n_maj + greatest(1, floor(n_min * 0.5))::BIGINT WHEN name = 'one in a list' THEN 2 * n_min END AS n FROM a, n"),
        "knn_cosine_exact": (knn_cosine, angular("label = 0", "", 5, True)),
        "knn_ip_exact": (knn_ip, angular("label = 1", "label = 0", 3, False)),
        "knn_projections": (knn_projections, None),
        "knn_lists_recall": (knn_lists_recall, "SELECT true AS whole, true AS near"),
        "knn_graph_recall": (knn_graph_recall, "WITH n AS (SELECT count(*) AS all_rows FROM embeddings) SELECT label, sum(least(10, all_rows - 1))::BIGINT AS n, true AS near FROM embeddings, n GROUP BY label"),
        "adasyn_difficulty": (adasyn_difficulty, f"{part}, {sql.allocation(0.5, 5, True)} SELECT id, c, k FROM c"),
        "adasyn_weights": (adasyn_weights, f"{part}, {sql.allocation(0.5, 5, True)} SELECT id, c, round(CASE WHEN t > 0 THEN c / t::DOUBLE ELSE 1 / rows::DOUBLE END, 9) AS weight FROM c, t"),
        "adasyn_allocation": (adasyn_allocation, f"{part}, {sql.allocation(0.5, 5, True)} SELECT id, c, n FROM a"),
        "adasyn_synthetic": (adasyn_synthetic, f"{part}, {syn} SELECT base_id, copy, neighbor_id, round(share, 9) AS share, round(z1, 6) AS z1, round(z2, 6) AS z2 FROM syn"),
        "restore_types": (restore_types, "SELECT l_orderkey, l_linenumber, least(greatest(round_even(l_extendedprice::DOUBLE / 1000, 0), 10), 40)::INTEGER AS x, round_even(l_quantity::DOUBLE / 2, 0)::BIGINT AS half FROM lineitem"),
        "adasyn_full": (adasyn_full, _sql_rows(f"{part}, {syn}", "true", True)),
        "adasyn_events": (adasyn_events, f"{sql.scaled(sql.EVENTS[0])}, {sql.allocation(0.1, 5, True)} SELECT id AS base_id, n FROM a WHERE n > 0"),
        "knn_single": (knn_single, f"{part}, {sql.nearest('k', sql.MAJOR, sql.ALL, 5)} {listed} k"),
        "adanear_single": (adanear_single, _sql_rows(hybrid, "rare OR id IN (SELECT id FROM r)", True)),
        "adasyn_blocks": (adasyn_blocks, _sql_rows(f"{part}, {syn}", "true", True)),
        "nearmiss_blocks": (nearmiss_blocks, _sql_rows(f"{part}, {sql.retained(1, 5, False)}", "rare OR id IN (SELECT id FROM r)", False)),
        "nearmiss_pruned": (nearmiss_pruned, f"{sql.scaled(sql.OLD)}, {sql.nearest('kn', sql.MAJOR, sql.MINOR, 5, False)}, sc AS (SELECT query_id AS id, round(avg(sqrt(d2)), 9) AS score FROM kn GROUP BY 1) SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score, id LIMIT 40"),
        "adanear_blocks": (adanear_blocks, _sql_rows(hybrid, "rare OR id IN (SELECT id FROM r)", True)),
        "oversample_uniform_blocks": (oversample_uniform_blocks, _sql_rows(f"{pop}, {sql.synthetic(0.5, 3, 7, False)}", "true", True)),
        "adanear_uniform_blocks": (adanear_uniform_blocks, _sql_rows(f"{pop}, {sql.synthetic(0.3, 3, 7, False)}, {sql.retained(0.5, 7, True, True, True)}", "rare OR id IN (SELECT id FROM r)", True)),
        "copies_in_ranges": (copies_in_ranges, "SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS base_id, sum(n)::BIGINT AS copies, sum(n * (n + 1) // 2)::BIGINT AS total FROM (SELECT *, l_quantity::BIGINT AS n FROM lineitem) GROUP BY 1"),
        "nearmiss_formula": (nearmiss_formula, _sql_rows(f"{part}, {sql.retained(1, 5, False)}", "rare OR id IN (SELECT id FROM r)", False)),
        "formulas": (formulas, f"WITH f AS (SELECT unnest([{', '.join(repr(f) for f in FORMULAS)}]) AS formula), m AS (SELECT min(p_size)::DOUBLE AS s, min(p_retailprice)::DOUBLE AS r FROM part), c AS (SELECT formula, CASE WHEN formula IN ('cls ~ .', 'cls~p_size+p_retailprice') THEN 'p_size,p_retailprice' WHEN formula IN ('cls ~ `p_size`', 'cls ~ p_size + p_size') THEN 'p_size' WHEN formula IN ('cls ~ . - p_size', 'cls ~ p_retailprice + . - p_size - 1') THEN 'p_retailprice' END AS features FROM f) SELECT formula, features, round(CASE WHEN features LIKE '%p_size%' THEN s ELSE 0 END + CASE WHEN features LIKE '%price%' THEN r ELSE 0 END, 6) AS least FROM c, m"),
        "nearmiss_ids": (nearmiss_ids, f"{part}, {sql.retained(1, 5, False)} SELECT id FROM r"),
        "nearmiss_scores": (nearmiss_scores, f"{part}, {near} SELECT query_id AS id, round(avg(sqrt(d2)), 6) AS score FROM kn GROUP BY 1"),
        "nearmiss_rows": (nearmiss_rows, _sql_rows(f"{part}, {sql.retained(1, 5, False)}", "rare OR id IN (SELECT id FROM r)", False)),
        "nearmiss_toxic": (nearmiss_toxic, f"{sql.scaled(sql.TOXIC[0])}, {sql.retained(2, 3, False)} SELECT id AS doc_id, f1::BIGINT AS n_chars, f2::INTEGER AS quality, rare::INTEGER AS toxic FROM b WHERE rare OR id IN (SELECT id FROM r)"),
        "nearmiss_sq": (nearmiss_sq, _sql_rows(f"{pop}, {sql.retained(1.5, 7, False, True, True)}", "rare OR id IN (SELECT id FROM r)", False)),
        "adanear_full": (adanear_full, _sql_rows(hybrid, "rare OR id IN (SELECT id FROM r)", True)),
        "oversample_uniform": (oversample_uniform, _sql_rows(f"{pop}, {sql.synthetic(0.5, 3, 7, False)}", "true", True)),
        "adanear_uniform": (adanear_uniform, _sql_rows(f"{pop}, {sql.synthetic(0.3, 3, 7, False)}, {sql.retained(0.5, 7, True, True, True)}", "rare OR id IN (SELECT id FROM r)", True)),
        "balance_none": (balance_none, f"SELECT p_partkey, p_size, p_retailprice, {cls} AS cls FROM part"),
        "balance_weight": (balance_weight, f"{part} SELECT p_partkey, p_size, p_retailprice, {cls} AS cls, CASE WHEN p_brand = 'Brand#11' THEN round(n_maj::DOUBLE / n_min, 9) ELSE 1.0::DOUBLE END AS weight FROM part, n"),
        "balance_adanear": (balance_adanear, _sql_rows(hybrid, "rare OR id IN (SELECT id FROM r)", True, "TARGET")),
        "step_nearmiss": (step_nearmiss, _sql_rows(f"{part}, {sql.retained(1, 5, False)}", "rare OR id IN (SELECT id FROM r)", False)),
        "step_skipped": (step_skipped, f"SELECT p_partkey, p_size, p_retailprice, {cls} AS cls FROM part"),
        "contents_ids": (contents_ids, "SELECT l_orderkey, l_linenumber, count(*) AS ids FROM lineitem GROUP BY 1, 2"),
        "generated_table": (generated_table, sql.generated(2000, 12, 0.05, 1)),
        "balance_adasyn": (balance_adasyn, _sql_rows(f"{part}, {syn}", "true", True)),
        "balance_nearmiss": (balance_nearmiss, _sql_rows(f"{part}, {sql.retained(1, 5, False)}", "rare OR id IN (SELECT id FROM r)", False)),
        "balance_adanear_weight": (balance_adanear_weight, f"{part}, m AS (SELECT n_min + greatest(1, floor(n_min * 0.3::DOUBLE))::BIGINT AS a, n_maj FROM n), k AS (SELECT a, least(n_maj, floor(a * 2.0::DOUBLE))::BIGINT AS b FROM m) SELECT 'rare' AS cls, a AS n, round(greatest(a, b)::DOUBLE / least(a, b), 9) AS scale_pos_weight FROM k UNION ALL SELECT 'common', b, round(greatest(a, b)::DOUBLE / least(a, b), 9) FROM k"),
        "step_adanear": (step_adanear, _sql_rows(hybrid, "rare OR id IN (SELECT id FROM r)", True)),
        "step_adasyn_uniform": (step_adasyn_uniform, _sql_rows(f"{pop}, {sql.synthetic(0.5, 3, 7, False)}", "true", True)),
        "step_nearmiss_uniform": (step_nearmiss_uniform, _sql_rows(f"{pop}, {sql.retained(1.5, 7, False, True, True)}", "rare OR id IN (SELECT id FROM r)", False)),
        "step_adanear_uniform": (step_adanear_uniform, _sql_rows(f"{pop}, {sql.synthetic(0.3, 3, 7, False)}, {sql.retained(0.5, 7, True, True, True)}", "rare OR id IN (SELECT id FROM r)", True)),
        "step_in_pipeline": (step_in_pipeline, f"{part}, k AS (SELECT 'rare' AS cls, n_min AS passed, n_min + floor(n_min * 40) AS fitted FROM n UNION ALL SELECT 'common', n_maj, n_maj FROM n) SELECT cls, passed, (row_number() OVER (ORDER BY fitted DESC, cls) - 1)::INTEGER AS place FROM k"),
        "step_tidy": (step_tidy, "SELECT CASE WHEN true THEN 'cls' END AS terms, m AS method, r AS ratio, nr AS nearmiss_ratio, sk AS skip, t AS trained, 'step_' || m AS id FROM (VALUES ('adasyn', 0.5::DOUBLE, NULL::DOUBLE, true), ('nearmiss', 1.5, NULL, false), ('adanear', 0.3, 0.5, true)) v(m, r, nr, sk), (VALUES (false), (true)) w(t)"),
        "runtime": (runtime, "SELECT 'spark' AS runtime, true AS has_cores, true AS has_version"),
        "tied_classes": (tied_classes, "WITH c AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS cls, count(*) AS n FROM nation WHERE n_nationkey < 24 GROUP BY 1) SELECT cls, (n + CASE WHEN (v = 'uniform' AND cls = (SELECT min(cls) FROM c)) OR (v = 'fixed' AND cls = 'odd') THEN greatest(1, floor(n * 0.5)) ELSE 0 END)::BIGINT AS n, v AS variant FROM c, (VALUES ('uniform'), ('fixed'), ('nearmiss')) w(v)"),
        "audit": (audit, f"{part}, k AS (SELECT n_min + n_maj AS rows_in, greatest(1, floor(n_min * 0.3::DOUBLE)) AS g, n_min, n_maj FROM n), m AS (SELECT *, least(n_maj, floor((n_min + g) * 0.5::DOUBLE)) AS kept FROM k) SELECT name, round(value::DOUBLE, 9) AS value FROM (SELECT unnest(['rows_in', 'rows_generated', 'rows_removed', 'rows_out', 'class_ratio_in', 'class_ratio_out']) AS name, unnest([rows_in::DOUBLE, g::DOUBLE, n_maj - kept, n_min + g + kept, n_maj::DOUBLE / n_min, greatest(kept, n_min + g)::DOUBLE / least(kept, n_min + g)]) AS value FROM m)"),
        "column_types": (column_types, "SELECT 'l_orderkey' AS feature, 'integer' AS kind, min(l_orderkey)::BIGINT AS low, max(l_orderkey)::BIGINT AS high FROM lineitem UNION ALL SELECT 'l_linenumber', 'integer', min(l_linenumber), max(l_linenumber) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'double', NULL, NULL"),
        "parameter_checks": (parameter_checks, f"""WITH v AS (SELECT unnest([{', '.join("'inf'::DOUBLE" if x == float('inf') else f'{x!r}::DOUBLE' for x in TRIED)}]) AS value),
w AS (SELECT value, value < 'inf'::DOUBLE AS fin, value = floor(value) AND value < 2147483648 AS whole FROM v)
SELECT name, value, CASE WHEN name IN ('positive_integer', 'workers', 'chunk_size', 'graph_ef') THEN whole AND value >= 1 WHEN name = 'seed' THEN whole AND value >= 0 WHEN name IN ('ratio', 'scale') THEN fin AND value > 0
  WHEN name = 'hybrid_ratio' THEN fin AND value >= 0 WHEN name = 'graph_m' THEN whole AND value >= 2 WHEN name = 'center' THEN fin WHEN name = 'output_rows' THEN 1000 <= value
  WHEN name = 'dense_budget' THEN 10000000::DOUBLE * 100 * 8 * 2 / 1e9 <= value ELSE fin AND 3 * value >= 1 END AS accepted
FROM w, (SELECT unnest(['positive_integer', 'workers', 'chunk_size', 'seed', 'ratio', 'hybrid_ratio', 'graph_m', 'graph_ef', 'scale', 'center', 'output_rows', 'dense_budget', 'retention']) AS name)"""),
        "choice_checks": (choice_checks, "SELECT 'level' AS name, a, b, CASE WHEN b = 'other' THEN NULL WHEN a = 'True' THEN 'full' ELSE b END AS result FROM (SELECT unnest(['True', 'False']) AS a), (SELECT unnest(['none', 'light', 'full', 'other']) AS b) UNION ALL SELECT 'backend', a, '', CASE WHEN a <> 'other' THEN a END FROM (SELECT unnest(['parallel', 'RcppParallel', 'other']) AS a) UNION ALL SELECT 'columns', a, b, CASE WHEN ok THEN b END FROM (VALUES ('cls', 'p_size', true), ('cls', 'nothing', false), ('nothing', 'p_size', false), ('cls', 'cls', false), ('cls', 'p_size,p_size', false), ('cls', 'p_size,p_retailprice', true)) v(a, b, ok)"),
        "row_checks": (row_checks, f"WITH c AS (SELECT {cls} AS cls, count(*) AS n FROM part GROUP BY 1) SELECT name, name = 'plain' AND (SELECT count(*) = 2 AND min(n) >= 2 FROM c) AS accepted FROM (SELECT unnest(['plain', 'null feature', 'infinite feature', 'no number', 'null target', 'one class', 'three classes', 'one row in a class', 'no row', 'text']) AS name)"),
        "engine_choice": (engine_choice, "WITH r AS (SELECT engine, metric, approximate, CASE WHEN engine = 'auto' THEN CASE WHEN metric = 'euclidean' THEN 'native' WHEN approximate THEN 'RcppHNSW' END WHEN engine IN ('exact', 'RcppHNSW') OR (metric = 'euclidean' AND engine <> 'other') THEN engine END AS resolved FROM (SELECT unnest(['auto', 'exact', 'native', 'FNN', 'RcppHNSW', 'KernelKnn', 'bigKNN', 'other']) AS engine), (SELECT unnest(['euclidean', 'cosine', 'ip']) AS metric), (SELECT unnest([true, false]) AS approximate)) SELECT *, CASE WHEN resolved = 'FNN' THEN 'kd_tree' WHEN resolved = 'RcppHNSW' THEN 'auto' WHEN resolved IS NOT NULL THEN 'brute' END AS algorithm FROM r"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _cases().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _cases().items() if s}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return nearmiss_rows(spark, folder)

