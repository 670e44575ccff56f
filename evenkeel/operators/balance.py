"""The public calls: adasyn, nearmiss, adanear, their uniform variants, and balance, which picks one by name.

Original rows are never computed with: they are kept, or filtered by id. Only synthetic rows are scaled back and cast
to their columns' types. One aggregation checks the data and gives counts and scaling; all else is planned lazily.

Parameters that all calls share: `features` (None: all other columns), `id_col` (unique; without one, ids are made
from rows' contents), `metric`, `engine`, `algorithm` (see `knn`), `decimals` (rounds squared distances and scores
before ranking, so that results don't depend on the order of floating-point sums), `scaling` and `already_scaled`,
`ddof` and `constant` (see `scaling.parameters`), `target_out` (another name for the target), `provenance` (adds
`__base_id` and `__copy`, null in original rows), `audit` or `audit_level`, `max_output_rows`, `max_dense_gb`.
`workers` (tasks of the searches, if over 1) and `chunk_size` (queries of a product at a time, rows of a block) have no effect on
results, nor have `precision` (see `knn`) and `backend`, which is checked; `graph_m` and `graph_ef` set how much the approximate engine searches.
The target may be a formula, "y ~ a + b" or "y ~ . - c" (see `schema.formula`), in place of a name and features. `segments` adds `__segment` (0: retained majority, 1: minority, 2: synthetic) and `__ord` (the
score of a majority row; null in others, and where all are kept unscored): ordered by both and the id, rows stand as an
assembled table has them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import checks, knn, restore, roles, scaling, schema, select, surroundings, synthesis, tree, undersampling
from evenkeel.operators.result import BalanceResult
from evenkeel.sources import shared

STRATEGIES = ("none", "weight", "adasyn", "nearmiss", "adanear", "adanear_weight")


@dataclass
class Options:
    features: list[str] | None = None
    id_col: str | None = None
    metric: str = "euclidean"
    engine: str = "auto"
    algorithm: str = "auto"
    allow_approx: bool = False
    decimals: int | None = None
    scaling: scaling.Scaling | None = None
    already_scaled: bool = False
    ddof: int = 1
    constant: str = "abort"
    ties: str = "abort"
    minority: object = None
    majority: object = None
    allocation: str = "adaptive"
    score: str = "mean"
    least: int | None = None
    restore_types: bool = True
    return_scaled: bool = False
    original_scale: bool = True
    target_out: str | None = None
    provenance: bool = False
    segments: bool = False
    check_ids: bool = True
    audit: bool = False
    audit_level: str = "none"
    max_output_rows: float = float("inf")
    max_dense_gb: float = float("inf")
    workers: int = 1
    chunk_size: int | None = None
    backend: str = "parallel"
    graph_m: int = 16
    graph_ef: int = 200
    small: int = knn.SMALL
    precision: str = "double"

    def __post_init__(self):
        checks.positive_integer(self.workers, "workers")
        checks.chunk_size(self.chunk_size)
        checks.backend(self.backend)
        checks.precision(self.precision)
        checks.graph_parameters(self.graph_m, self.graph_ef)
        for name in ("already_scaled", "restore_types", "return_scaled", "original_scale", "provenance", "segments", "check_ids", "audit"):
            checks.flag(getattr(self, name), name)
        self.level = checks.audit_level(self.audit, self.audit_level)
        self.engine = knn.resolved_engine(self.engine, self.metric, self.allow_approx)
        self.asked = self.algorithm
        self.algorithm = knn.resolved_algorithm(self.algorithm, self.engine)

    def by_brute_force(self) -> bool:
        return self.engine not in ("RcppHNSW", "lists") and self.asked not in tree.KINDS


#: What the uniform family does otherwise: shares rows evenly, population deviations, squared distances, no aborts.
UNIFORM = {"allocation": "uniform", "ddof": 0, "constant": "one", "score": "mean_sq", "least": 1, "ties": "first"}


@dataclass
class Prepared:
    df: DataFrame
    target: str
    features: list[str]
    id: str
    facts: schema.Facts
    roles: roles.Roles
    scaling: scaling.Scaling
    o: Options
    columns: list[str] = field(default_factory=list)

    def _z(self) -> Column:
        return vectors.packed(self.features) if self.o.already_scaled else vectors.standardized(self.features, self.scaling.centers, self.scaling.scales)

    def vectors(self, label=None) -> DataFrame:
        """(id, z) of all rows or of one class."""
        rows = self.df if label is None else self.df.where(F.col(f"`{self.target}`") == F.lit(label))
        return rows.select(F.col(f"`{self.id}`").alias("id"), self._z().alias("z"))

    def _how(self, sizes) -> dict:
        o = self.o
        return {"metric": o.metric, "engine": o.engine, "decimals": o.decimals, "small": o.small, "sizes": sizes, "dim": len(self.features), "graph_m": o.graph_m, "graph_ef": o.graph_ef, "algorithm": o.asked, "chunk_size": o.chunk_size, "workers": o.workers, "precision": o.precision}

    def knn(self, queries, refs, k, sizes, **more) -> DataFrame:
        return knn.knn(queries, refs, k, allow_approx=self.o.allow_approx, **self._how(sizes), **more)

    def lists(self, queries, refs, k, sizes, **more) -> DataFrame:
        return knn.neighbour_lists(queries, refs, k, **self._how(sizes), **more)

    def marked(self) -> DataFrame:
        """(id, z, minor) of all rows."""
        return self.df.select(F.col(f"`{self.id}`").alias("id"), self._z().alias("z"), (F.col(f"`{self.target}`") == F.lit(self.roles.minority)).alias("minor"))

    def class_rows(self, label) -> DataFrame:
        return self.df.where(F.col(f"`{self.target}`") == F.lit(label))


def prepared(df: DataFrame, target: str, o: Options, ties: str | None = None) -> Prepared:
    target, o.features = schema.chosen(df, target, o.features, o.id_col)
    features = schema.resolved(df, target, o.features, o.id_col)
    columns = [c for c in df.columns if c in features or c == target or c == o.id_col]
    rows = vectors.chosen(df, columns)
    if o.id_col is None:
        rows = schema.identified(rows, "__id")
    elif o.check_ids:
        schema.check_ids(rows, o.id_col)
    facts = schema.facts(rows, target, features)
    who = roles.assigned(facts.counts, o.minority, o.majority, ties or o.ties)
    if o.scaling is not None:
        checks.scaling(o.scaling, features)
        s = o.scaling
    elif o.already_scaled:
        raise BalanceError("already_scaled needs the scaling")
    else:
        s = scaling.parameters(facts, features, o.ddof, o.constant)
    checks.dense_budget(facts.rows, len(features), 2, o.max_dense_gb, "the table")
    return Prepared(rows, target, features, o.id_col or "__id", facts, who, s, o, columns)


def _generated(p: Prepared, ratio: float, k: int, seed: int) -> tuple[DataFrame, int]:
    """(base_id, copy, neighbor_id, share, z) of the synthetic rows, and how many there are."""
    g = roles.expansion(p.roles.n_min, ratio)
    checks.output_rows(p.facts.rows + g, p.o.max_output_rows)
    checks.dense_budget(p.facts.rows + g, len(p.features), 2, p.o.max_dense_gb, "the result")
    n_min, n = p.roles.n_min, p.facts.rows
    minor, k_all, k_own = p.vectors(p.roles.minority), min(k, n - 1), min(k, n_min - 1)
    adaptive = p.o.allocation == "adaptive"
    if p.o.by_brute_force() and n_min * (n if adaptive else n_min) <= knn.MANY:
        how = {"dim": len(p.features), "metric": p.o.metric, "decimals": p.o.decimals, "small": p.o.small, "chunk": p.o.chunk_size, "workers": p.o.workers, "single": p.o.precision == "single"}
        around = surroundings.found(minor, p.marked() if adaptive else minor.withColumn("minor", F.lit(True)), k_all if adaptive else 0, k_own, (n_min, n if adaptive else n_min), **how)
    else:
        own = p.lists(minor, minor, k_own, (n_min, n_min), exclude_self=True)
        around = surroundings.with_lists(minor, own, synthesis.difficulty(p.lists(minor, p.vectors(), k_all, (n_min, n), exclude_self=True), minor) if adaptive else None)
    # read to share out g, and to make the rows, so the search behind it is run once
    around = shared.checkpointed(around)
    counts, most = synthesis.shared_out(around.select("id", "c"), g) if adaptive else (synthesis.even(around, g, n_min), -(-g // n_min))
    wanted = around.join(counts.select(F.col("id").alias("w"), "n"), F.col("id") == F.col("w"))
    return synthesis.between(wanted.select(F.col("id").alias("base_id"), "n", "near", "from", "tos"), seed, most), g


def _typed(p: Prepared, made: DataFrame, kinds: dict) -> DataFrame:
    """Synthetic rows in the original columns; their ids are null."""
    out, place = [], {c: i for i, c in enumerate(p.features)}
    for c in p.columns:
        if c == p.target:
            value = f"CAST(__label AS {kinds[c].simpleString()})"
        elif c in place:
            i = place[c]
            value = vectors.reverted("z", i, p.scaling.centers[i], p.scaling.scales[i]) if p.o.original_scale else f"get(z, {i})"
            if p.o.restore_types and p.o.original_scale:
                value = restore.restored(value, kinds[c], p.facts.low[i], p.facts.high[i])
        else:
            value = f"CAST(NULL AS {kinds[c].simpleString()})"
        out.append(f"{value} AS {vectors.quoted(c)}")
    return made.withColumn("__label", F.lit(p.roles.minority)).selectExpr(*out, "base_id AS __base_id", "copy AS __copy")


def _finished(p: Prepared, originals: DataFrame, made: DataFrame | None) -> DataFrame:
    """Original rows, scaled only if asked for, then synthetic ones; their columns and the target's name as asked for."""
    o = p.o
    marks = []
    if o.segments:
        if taken := {"__segment", "__ord"} & set(p.columns):
            raise BalanceError(f"there is a column {min(taken)!r} already")
        segment = (F.col(vectors.quoted(p.target)) == F.lit(p.roles.minority)).cast("int")
        score = F.when(segment == 0, F.col("__score")) if "__score" in originals.columns else F.lit(None).cast("double")
        originals, marks = originals.withColumns({"__segment": segment, "__ord": score}), ["__segment", "__ord"]
    rows = originals if originals.columns == p.columns else vectors.chosen(originals, p.columns + marks)
    if not o.original_scale and not o.already_scaled:
        rows = scaling.apply(rows, p.features, p.scaling)
    if made is not None:
        kinds, own = {f.name: f.dataType for f in p.df.schema.fields}, set(p.features)
        base = kinds[p.id].simpleString()
        kept_types = o.restore_types and o.original_scale
        names = [vectors.quoted(c) if kept_types or c not in own else f"CAST({vectors.quoted(c)} AS double) AS {vectors.quoted(c)}" for c in p.columns]
        extra = [f"CAST(NULL AS {base}) AS __base_id", "CAST(NULL AS bigint) AS __copy"] if o.provenance else []
        typed = _typed(p, made, kinds)
        new = ["2 AS __segment", "CAST(NULL AS double) AS __ord"] if marks else []
        own_ids = ["__base_id", "__copy"] if o.provenance else []
        rows = rows.selectExpr(*names, *marks, *extra).union(typed.selectExpr(*map(vectors.quoted, p.columns), *new, *own_ids))
    if o.target_out and o.target_out != p.target:
        if o.target_out in rows.columns:
            raise BalanceError(f"there is a column {o.target_out!r} already")
        rows = rows.withColumnRenamed(p.target, o.target_out)
    return rows


def _result(p: Prepared, method: str, data: DataFrame, **more) -> BalanceResult:
    out = BalanceResult(data, p.o.target_out or p.target, p.roles, p.scaling)
    out.retained_ids = more.pop("retained_ids", None)
    made = more.pop("made", None)
    if p.o.level != "none":
        out.diagnostics = {"method": method, "rows_in": p.facts.rows, "scale": "original" if p.o.original_scale else "z_score", "engine": p.o.engine, "algorithm": p.o.algorithm, "minority": p.roles.minority, "majority": p.roles.majority, "class_ratio_in": p.roles.ratio, "counts_in": dict(p.facts.counts)} | more
    if p.o.level == "full":
        out.synthetic = made
        out.parts["types"] = restore.inferred(p.df, p.features, p.facts)
    if p.o.level == "full" or p.o.return_scaled:
        out.scaled = p.vectors() if made is None else p.vectors().unionByName(made.select(F.lit(None).cast(p.df.schema[p.id].dataType).alias("id"), "z"))
    return out


def adasyn(df: DataFrame, target: str, ratio: float = 0.2, k: int = 5, seed: int = 0, **options) -> BalanceResult:
    """Adds max(1, floor(ratio * minority)) minority rows, more where majority rows are near."""
    ratio, k, seed = checks.ratio(ratio, "ratio"), checks.positive_integer(k, "k"), checks.seed(seed)
    p = prepared(df, target, Options(**options))
    made, g = _generated(p, ratio, k, seed)
    return _result(p, "adasyn", _finished(p, p.df, made), made=made, rows_generated=g, rows_out=p.facts.rows + g)


def _majority_kept(p: Prepared, ratio: float, k: int, made: DataFrame | None, g: int) -> DataFrame | None:
    """(id, score) of majority rows to keep, or None for all."""
    n_min, n_maj = p.roles.n_min + g, p.roles.n_maj
    if n_min == n_maj and p.o.least is None:
        return None
    m = roles.retention(n_min, n_maj, ratio, p.o.least)
    if m >= n_maj:
        return None
    refs = p.vectors(p.roles.minority)
    queries = p.vectors(p.roles.majority)
    if made is not None:
        # the distance is all that counts, so ids only have to differ; originals come first, as in the result
        tag = lambda n, c: F.concat(F.lit(n), c.cast("string"))
        refs = refs.select(tag("0", F.col("id")).alias("id"), "z").unionByName(made.select(F.concat_ws("|", F.lit("1"), F.col("base_id").cast("string"), F.col("copy").cast("string")).alias("id"), "z"))
    k, dim = min(k, n_min), len(p.features)
    if p.o.metric == "euclidean" and p.o.engine not in ("RcppHNSW", "lists") and n_min * dim > p.o.small:
        # a search in blocks is for those only that may be kept
        how = {"sizes": (n_maj, n_min), "dim": dim} | ({} if p.o.chunk_size is None else {"leaf": max(1, p.o.chunk_size // 16)})
        queries, n_maj = undersampling.pruned(queries, refs, k, m, p.o.score, p.o.decimals, **how)
    near = p.lists(queries, refs, k, (n_maj, n_min))
    return undersampling.kept(undersampling.scored(near, p.o.score, p.o.metric), m, p.o.decimals)


def _with_majority(p: Prepared, ids: DataFrame | None, m: int) -> DataFrame:
    """The minority and the m majority rows of ids (id, score); with `__score` if segments are asked for."""
    if ids is None:
        return p.df
    score = [F.col("score").alias("__score")] if p.o.segments else []
    if m <= select.FEW:
        # so few ids are sent to the rows, which are read once
        few = F.broadcast(ids.select(F.col("id").alias("__kept"), *score))
        minor = F.col(f"`{p.target}`") == F.lit(p.roles.minority)
        return p.df.join(few, F.col(f"`{p.id}`") == F.col("__kept"), "left").where(minor | F.col("__kept").isNotNull()).drop("__kept")
    kept = p.class_rows(p.roles.majority).join(ids.select(F.col("id").alias("__kept"), *score), F.col(f"`{p.id}`") == F.col("__kept"), "inner" if score else "left_semi")
    return p.class_rows(p.roles.minority).unionByName(kept.drop("__kept"), allowMissingColumns=True)


def nearmiss(df: DataFrame, target: str, ratio: float = 1.0, k: int = 5, seed: int = 0, **options) -> BalanceResult:
    """Keeps min(majority, floor(ratio * minority)) majority rows, those nearest to minority rows; the seed isn't used.

    Classes of one size are kept whole, whatever the ratio (but not in the uniform variant).
    """
    ratio, k = checks.ratio(ratio, "ratio"), checks.positive_integer(k, "k")
    checks.seed(seed)
    p = prepared(df, target, Options(**options), ties="first")
    ids = _majority_kept(p, ratio, k, None, 0)
    m = p.roles.n_maj if ids is None else roles.retention(p.roles.n_min, p.roles.n_maj, ratio, p.o.least)
    rows = _with_majority(p, ids, m)
    return _result(p, "nearmiss", _finished(p, rows, None), retained_ids=rows.select(p.id), rows_removed=p.roles.n_maj - m, rows_out=p.roles.n_min + m)


def adanear(df: DataFrame, target: str, adasyn_ratio: float = 0.2, nearmiss_ratio: float = 1.0, over_k: int = 5, under_k: int = 5, seed: int = 0, **options) -> BalanceResult:
    """adasyn, then nearmiss with the enlarged minority, in one scaling and with the original roles; a ratio of 0 skips."""
    a, n = checks.ratio(adasyn_ratio, "adasyn_ratio", zero=True), checks.ratio(nearmiss_ratio, "nearmiss_ratio", zero=True)
    over_k, under_k, seed = checks.positive_integer(over_k, "over_k"), checks.positive_integer(under_k, "under_k"), checks.seed(seed)
    o = Options(**options)
    if not a and not n:
        # nothing is scaled, so constant columns do no harm
        target, o.features = schema.chosen(df, target, o.features, o.id_col)
        o.scaling = o.scaling or scaling.Scaling(*[(x,) * len(schema.resolved(df, target, o.features, o.id_col)) for x in (0.0, 1.0)])
        p = prepared(df, target, o)
        return _result(p, "adanear", _finished(p, p.df, None), rows_out=p.facts.rows, retained_ids=p.df.select(p.id))
    p = prepared(df, target, o)
    made, g = _generated(p, a, over_k, seed) if a else (None, 0)
    ids = _majority_kept(p, n, under_k, made, g) if n else None
    m = p.roles.n_maj if ids is None else roles.retention(p.roles.n_min + g, p.roles.n_maj, n, o.least)
    rows = _with_majority(p, ids, m)
    return _result(p, "adanear", _finished(p, rows, made), made=made, retained_ids=rows.select(p.id), rows_generated=g, rows_removed=p.roles.n_maj - m, rows_out=p.roles.n_min + g + m)


def adasyn_uniform(df: DataFrame, target: str, ratio: float = 0.2, k: int = 3, seed: int = 0, **options) -> BalanceResult:
    """As adasyn, with the new rows dealt evenly over the minority rows."""
    return adasyn(df, target, ratio, k, seed, **(UNIFORM | options))


def nearmiss_uniform(df: DataFrame, target: str, ratio: float = 1.0, k: int = 7, seed: int = 0, **options) -> BalanceResult:
    """As nearmiss, by mean squared distances, and with one majority row at least."""
    return nearmiss(df, target, ratio, k, seed, **(UNIFORM | options))


def adanear_uniform(df: DataFrame, target: str, adasyn_ratio: float = 0.2, nearmiss_ratio: float = 1.0, over_k: int = 3, under_k: int = 7, seed: int = 0, **options) -> BalanceResult:
    return adanear(df, target, adasyn_ratio, nearmiss_ratio, over_k, under_k, seed, **(UNIFORM | options))


def _roles(df: DataFrame, target: str) -> roles.Roles:
    """Roles by count; of a target with other than two classes only three are fetched to say so."""
    counts = {r.label: r.n for r in roles.class_counts(df.where(F.col(f"`{target}`").isNotNull()), target).limit(3).collect()}
    if len(counts) != 2:
        raise BalanceError(f"the target must have exactly two classes, not {'over two' if len(counts) > 2 else len(counts)}")
    return roles.assigned(counts, ties="first")


def weighted(df: DataFrame, target: str, weight: str = "weight") -> DataFrame:
    """df with a weight for each row: the class ratio for minority rows, 1 for others."""
    target, _ = schema.chosen(df, target)
    who = _roles(df, target)
    return df.withColumn(weight, F.when(F.col(f"`{target}`") == F.lit(who.minority), F.lit(who.ratio)).otherwise(F.lit(1.0)))


def balance(df: DataFrame, target: str, strategy: str = "none", *, adasyn_ratio: float = 0.2, nearmiss_ratio: float = 1.0, over_k: int = 5, under_k: int = 5, seed: int = 0, validate: bool = False, **options) -> BalanceResult:
    """One of STRATEGIES. "none" and "weight" pass rows through unchecked (unless `validate`) with their class ratio;
    "adanear_weight" adds to adanear the ratio of what is left, as a class weight."""
    if strategy not in STRATEGIES:
        raise BalanceError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy in ("none", "weight"):
        target, features = schema.chosen(df, target, options.get("features"), options.get("id_col"))
        if validate:
            schema.facts(df, target, schema.resolved(df, target, features, options.get("id_col")))
        who = _roles(df, target)
        return BalanceResult(df, target, who, diagnostics={"method": strategy, "data_changed": False, "rows_in": who.n_min + who.n_maj, "rows_out": who.n_min + who.n_maj, "scale_pos_weight": who.ratio})
    if strategy == "adasyn":
        return adasyn(df, target, adasyn_ratio, over_k, seed, **options)
    if strategy == "nearmiss":
        return nearmiss(df, target, nearmiss_ratio, under_k, seed, **options)
    out = adanear(df, target, adasyn_ratio, nearmiss_ratio, over_k, under_k, seed, **options)
    if strategy == "adanear_weight":
        out.diagnostics["scale_pos_weight"] = out.class_ratio_out()
    return out
