"""Standardization of features and its inverse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import checks
from evenkeel.operators.schema import Facts


@dataclass(frozen=True)
class Scaling:
    centers: tuple[float, ...]
    scales: tuple[float, ...]


def parameters(facts: Facts, features: list[str], ddof: int = 1, constant: str = "abort") -> Scaling:
    """Means with sample (ddof 1) or population (0) deviations; constant columns abort, or get scale 1 ("one")."""
    sd = facts.sample_sd if ddof else facts.population_sd
    still = [c for c, s, lo, hi in zip(features, sd, facts.low, facts.high, strict=True) if not s or s != s or s == float("inf") or lo == hi]
    if still and constant == "abort":
        raise BalanceError(f"constant columns can't be standardized: {', '.join(still)}")
    return Scaling(tuple(facts.means), tuple(1.0 if c in still else s for c, s in zip(features, sd, strict=True)))


def parameter_table(df: DataFrame, features: list[str], ddof: int = 1) -> DataFrame:
    """(feature, center, scale), by one aggregation."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    one = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", sd))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("center"), F.col(f"s{i}").alias("scale")) for i, c in enumerate(features)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _each(df: DataFrame, features: list[str], s: Scaling, form: str) -> DataFrame:
    """df with `form` of each feature, as text: {x}, {m} and {s} stand for the value, its center and its scale."""
    p = dict(zip(features, zip(s.centers, s.scales, strict=True), strict=True))
    one = lambda c, x: form.format(x=x, m=f"{float(p[c][0])!r}D", s=f"{float(p[c][1])!r}D") + f" AS {x}"
    return df.selectExpr(*[one(c, vectors.quoted(c)) if c in p else vectors.quoted(c) for c in df.columns])


def apply(df: DataFrame, features: list[str], s: Scaling, precision: str = "double") -> DataFrame:
    """df with its features standardized in place, as doubles or rounded to single precision."""
    return _each(df, features, s, f"CAST((CAST({{x}} AS double) - {{m}}) / {{s}} AS {'double' if checks.precision(precision) == 'double' else 'float'})")


def revert(df: DataFrame, features: list[str], s: Scaling) -> DataFrame:
    return _each(df, features, s, "{x} * {s} + {m}")


def l2_normalize(df: DataFrame, features: list[str]) -> DataFrame:
    """df with each row's features over their Euclidean norm; zero rows stay zero."""
    n = vectors.norm(vectors.packed(features))
    return df.withColumn("__norm", n).select(*[F.when(F.col("__norm") > 0, F.col(f"`{c}`") / F.col("__norm")).otherwise(F.col(f"`{c}`").cast("double")).alias(c) if c in features else F.col(f"`{c}`") for c in df.columns])


def zscore(df: DataFrame, target: str, features: list[str] | None = None, ddof: int = 1) -> tuple[DataFrame, Scaling]:
    """df standardized, and with which parameters."""
    from evenkeel.operators import schema

    own = schema.resolved(df, target, features)
    s = parameters(schema.facts(df, target, own), own, ddof)
    return apply(df, own, s), s
