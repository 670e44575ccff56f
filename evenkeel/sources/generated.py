"""Generated tables with a rare class, for tests and benchmarks; alike in every partitioning."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import checks

KINDS = ("monetary", "ratio", "integer", "binary")
#: The distributions that a column of a kind may have; the first of each is that of signal columns.
FAMILIES = {
    "monetary": ("uniform", "normal", "lognormal", "gamma", "weibull", "exponential", "chisq"),
    "ratio": ("uniform", "beta", "exponential", "folded_normal"),
    "integer": ("poisson", "geometric", "negative_binomial", "binomial"),
    "binary": ("bernoulli",),
}
#: The share of a column's rows that aren't set to zero.
FILLED = {"monetary": 0.2, "ratio": 0.3, "integer": 0.4, "binary": 1.0}


def poisson_steps(mean: float, n: int = 20) -> list[float]:
    """Probabilities of values up to 0, 1 and so on."""
    out, p = [], math.exp(-mean)
    for i in range(n):
        out.append((out[-1] if out else 0.0) + p)
        p *= mean / (i + 1)
    return out


def binomial_steps(n: int, p: float) -> list[float]:
    out = []
    for i in range(n):
        out.append((out[-1] if out else 0.0) + math.comb(n, i) * p**i * (1 - p) ** (n - i))
    return out


def drawn(seed: int, name: str, what: str) -> float:
    """A number in [0, 1) for a whole column."""
    return int(hashlib.md5(f"{seed}|{name}|{what}".encode()).hexdigest()[:8], 16) / 2**32


def family(kind: str, name: str, seed: int) -> str:
    """The distribution that the seed gives a column."""
    return FAMILIES[kind][int(drawn(seed, name, "family") * len(FAMILIES[kind]))]


def chance(name: str, seed: int) -> float:
    """How often a flag is set, from 0.01 to 0.15."""
    return 0.01 + 0.14 * drawn(seed, name, "chance")


def _normal(seed: int, row: Column, name: str) -> Column:
    u, v = vectors.uniform(seed, row, name + "u"), vectors.uniform(seed, row, name + "v")
    return F.sqrt(-2 * F.log(F.lit(1.0) - u)) * F.cos(u * 0 + v * 6.283185307179586)


def column(kind: str, row: Column, name: str, seed: int = 1, distribution: str | None = None, negative: bool = False, often: float | None = None) -> Column:
    """A random value of the kind for each row number: amounts of 1000 to 40000, shares, counts or flags, most of them zero.

    distribution: one of the kind's FAMILIES; None: the one that seed and name give. often: of flags, how often they are
    set; None: as seed and name give. negative is accepted and has no effect: no kind has negative values.
    """
    if kind not in KINDS:
        raise BalanceError(f"kind must be one of {KINDS}, not {kind!r}")
    checks.flag(negative, "negative")
    shape = distribution or family(kind, name, seed)
    if shape not in FAMILIES[kind]:
        raise BalanceError(f"distribution of {kind} must be one of {FAMILIES[kind]}, not {shape!r}")
    u = vectors.uniform(seed, row, name)
    if kind == "binary":
        return (u < F.lit(chance(name, seed) if often is None else often)).cast("int")
    z, waits = _normal(seed, row, name), -F.log(F.lit(1.0) - u)
    steps = lambda at: F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= u))
    value = {
        ("monetary", "uniform"): lambda: 1000 + 39000 * u,
        ("monetary", "normal"): lambda: F.abs(20000 + 15000 * z),
        ("monetary", "lognormal"): lambda: F.exp(9.5 + z),
        ("monetary", "gamma"): lambda: 10000 * (waits - F.log(F.lit(1.0) - vectors.uniform(seed, row, name + "w"))),
        ("monetary", "weibull"): lambda: 20000 * F.pow(waits, F.lit(1 / 1.5)),
        ("monetary", "exponential"): lambda: 20000 * waits,
        ("monetary", "chisq"): lambda: 5000 * (z * z + 2 * waits),
        ("ratio", "uniform"): lambda: u,
        # the second smallest of six uniform numbers has the beta distribution of shapes 2 and 5
        ("ratio", "beta"): lambda: F.get(F.array_sort(F.array(*[vectors.uniform(seed, row, f"{name}b{i}") for i in range(6)])), F.lit(1)),
        ("ratio", "exponential"): lambda: waits / 5,
        ("ratio", "folded_normal"): lambda: F.abs(0.2 + 0.3 * z),
        ("integer", "poisson"): lambda: steps(poisson_steps(2.0)),
        ("integer", "geometric"): lambda: F.floor(waits / F.lit(-math.log(0.7))),
        ("integer", "negative_binomial"): lambda: F.floor(waits / F.lit(-math.log(0.8))),
        ("integer", "binomial"): lambda: steps(binomial_steps(10, 0.1)),
    }[kind, shape]()
    if kind == "monetary":
        value = F.least(F.greatest(value, F.lit(1000.0)), F.lit(40000.0))
    elif kind == "ratio":
        value = F.least(value, F.lit(1.0))
    filled = vectors.uniform(seed, row, name + "zero") < FILLED[kind]
    return F.when(filled, value).otherwise(F.lit(0)).cast("int" if kind == "integer" else "double")


def rare_class_table(spark: SparkSession, rows: int, features: int = 250, prevalence: float = 0.0013, signals: int = 20, seed: int = 1) -> DataFrame:
    """ID, TARGET_CLASS (Yes for the top share of a noisy sum of products of signal features, else No), f000 and on.

    The noise has 0.4 times the deviation of the sum. Signal columns have the first distribution of their kind.
    """
    row = F.col("id")
    names = [f"f{i:03d}" for i in range(features)]
    own = names[: min(signals, features)]
    kinds = {c: KINDS[i % 4] for i, c in enumerate(names)}
    how = {c: {"distribution": FAMILIES[kinds[c]][0], "often": 0.05} if c in own else {} for c in names}
    df = spark.range(rows).select(row.alias("ID"), *[column(kinds[c], row, c, seed, **how[c]).alias(c) for c in names])
    stats = df.agg(*[f(c).alias(f"{k}{c}") for c in own for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = {c: (F.col(c) - F.lit(stats[f"m{c}"])) / F.lit((stats[f"s{c}"] or 0.0) + 1e-6) for c in own}
    signal = sum((z[a] * z[b] for a, b in zip(own[::2], own[1::2], strict=False)), F.lit(0.0))
    df = df.withColumn("__signal", signal)
    noise = 0.4 * (df.agg(F.stddev_samp("__signal")).first()[0] or 0.0)
    scored = df.withColumn("__signal", F.col("__signal") + F.lit(noise) * _normal(seed, F.col("ID"), "noise"))
    bar = scored.agg(F.percentile_approx("__signal", 1 - prevalence, 100_000)).first()[0]
    return scored.select("ID", F.when(F.col("__signal") > F.lit(bar), "Yes").otherwise("No").alias("TARGET_CLASS"), *names)


def numbered(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """df with the array column's numbers as columns V1 to V`dim` in its place; names that are taken abort."""
    names = [f"V{j + 1}" for j in range(dim)]
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns if c != vector}:
        raise BalanceError(f"there is a column {min(taken)!r} already")
    out = []
    for c in df.columns:
        out += [F.get(vector, F.lit(j)).cast("double").alias(n) for j, n in enumerate(names)] if c == vector else [F.col(f"`{c}`")]
    return df.select(*out)


def matrix_frame(spark: SparkSession, x, y, id_col: str = "id") -> DataFrame:
    """A dense 2-d array and its labels as a table with columns V1 and on, `y` and row numbers."""
    import numpy as np

    x = np.asarray(x, float)
    if x.ndim != 2 or x.shape[0] < 2 or x.shape[1] < 1:
        raise BalanceError("a matrix must have at least two rows and one column")
    if len(y) != len(x):
        raise BalanceError("there must be one label for each row")
    rows = [(i, *map(float, r), t) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    kind = "int" if all(isinstance(t, int) and not isinstance(t, bool) for t in y) else "boolean" if all(isinstance(t, bool) for t in y) else "string"
    return spark.createDataFrame(rows, f"{id_col} long, " + ", ".join(f"V{j + 1} double" for j in range(x.shape[1])) + f", y {kind}")
