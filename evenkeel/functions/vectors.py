"""Column expressions over feature arrays, counter-based uniforms and covariances; all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(*map(quoted, columns))


def packed(features: list[str]) -> Column:
    """Features as one array of doubles."""
    return F.expr(f"array({', '.join(f'cast({quoted(c)} AS double)' for c in features)})")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def standardized(features: list[str], centers: list[float], scales: list[float]) -> Column:
    """One expression as text: with hundreds of features, building it call by call takes longer than running it."""
    one = [f"(cast({quoted(c)} AS double) - {float(m)!r}D) / {float(s)!r}D" for c, m, s in zip(features, centers, scales, strict=True)]
    return F.expr(f"array({', '.join(one)})")


def reverted(z: str, i: int, center: float, scale: float) -> str:
    """As text, see `standardized`."""
    return f"get({z}, {i}) * {float(scale)!r}D + {float(center)!r}D"


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(z: Column) -> Column:
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x))


def normalized(z: Column) -> Column:
    """A vector over its Euclidean norm; zero vectors stay as they are."""
    return F.when(norm(z) > 0, F.transform(z, lambda x: x / norm(z))).otherwise(z)


def interpolated(base: Column, other: Column, share: Column) -> Column:
    return F.zip_with(base, other, lambda b, v: b + share * (v - b))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts, alike in every partitioning and engine."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def covariances(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, covariance) of each two features with a <= b in the list's order, by one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = df.agg(*[F.covar_samp(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")
