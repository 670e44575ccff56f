"""Columns of a table to balance, and one aggregation that checks its rows and gathers all that planning needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.sources import shared

RESERVED = "TARGET"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def resolved(df: DataFrame, target: str, features: list[str] | None = None, id_col: str | None = None) -> list[str]:
    """The features: those named, or all other columns. All must be plain numeric columns of df."""
    names = df.columns
    if len(set(names)) != len(names):
        raise BalanceError("column names must differ")
    if target not in names:
        raise BalanceError(f"the target {target!r} isn't a column")
    if id_col is not None and id_col not in names:
        raise BalanceError(f"the id {id_col!r} isn't a column")
    own = [c for c in names if c not in (target, id_col)] if features is None else list(features)
    if not own:
        raise BalanceError("there must be at least one feature")
    if len(set(own)) != len(own) or target in own:
        raise BalanceError("features must differ from each other and from the target")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in own:
        if c not in kinds:
            raise BalanceError(f"the feature {c!r} isn't a column; compute it first")
        if c == RESERVED:
            raise BalanceError(f"no feature may be called {RESERVED}")
        if type(kinds[c]).__name__ == "VectorUDT":
            raise BalanceError(f"the feature {c!r} is a vector; balancing needs one dense column for each feature")
        if not isinstance(kinds[c], T.NumericType):
            raise BalanceError(f"all features must be numeric; {c!r} is {kinds[c].simpleString()}")
    if not isinstance(kinds[target], (T.StringType, T.BooleanType, *WHOLE, T.DoubleType, T.FloatType, T.DecimalType)):
        raise BalanceError(f"the target can't be {kinds[target].simpleString()}")
    return own


#: A formula's pieces: names in backquotes, names, numbers, signs.
PIECES = re.compile(r"`([^`]+)`|([A-Za-z.][\w.]*)|(\d+)|([~+\-])|(\S)")


def formula(text: str, columns: list[str], id_col: str | None = None) -> tuple[str, list[str]]:
    """The target and the features that "target ~ a + b" names.

    A dot stands for all other columns (without the id), a minus takes a column out again, backquotes hold names with other
    signs; +0, -1 and the like, which set an intercept elsewhere, choose nothing. A formula only chooses columns:
    transformations, interactions and offsets must be columns first.
    """
    found = [m.groups() for m in PIECES.finditer(text)]
    if any(other for *_, other in found):
        raise BalanceError(f"a formula only names columns; compute {text!r}'s terms first")
    at = [i for i, f in enumerate(found) if f[3] == "~"]
    if len(at) != 1:
        raise BalanceError(f"a formula has the form target ~ features, not {text!r}")
    left, right = found[: at[0]], found[at[0] + 1 :]
    name = lambda f: f[0] or f[1]
    if len(left) != 1 or not name(left[0]) or left[0][1] == ".":
        raise BalanceError("a formula has exactly one target")
    target, chosen_, take, wait = name(left[0]), {}, True, True
    if target not in columns:
        raise BalanceError(f"the target {target!r} isn't a column")
    for f in right:
        if f[3]:
            take, wait = f[3] == "+", True
            continue
        if not wait:
            raise BalanceError(f"there must be + or - between the terms of {text!r}")
        wait = False
        if f[2]:
            continue
        dot = f[1] == "."
        if not dot and name(f) not in columns:
            raise BalanceError(f"the feature {name(f)!r} isn't a column; compute it first")
        for c in [c for c in columns if c != id_col] if dot else [name(f)]:
            chosen_.pop(c, None) if not take else chosen_.setdefault(c)
    if wait:
        raise BalanceError(f"{text!r} ends within a term")
    features = [c for c in chosen_ if c != target]
    if not features:
        raise BalanceError("there must be at least one feature")
    return target, features


def chosen(df: DataFrame, target: str, features: list[str] | None = None, id_col: str | None = None) -> tuple[str, list[str] | None]:
    """target and features as they are, or those of a formula in the target's place."""
    if target in df.columns or "~" not in target:
        return target, features
    if features is not None:
        raise BalanceError("a formula names the features already")
    return formula(target, df.columns, id_col)


def identified(df: DataFrame, name: str) -> DataFrame:
    """df with an id of its own: the row's hash and its number among equal rows, without a global order.

    Equal rows are counted, before the shuffle first, and made anew from one of them, so a very common row is no burden
    to the task that it lands in until it is written out. The result is kept in the shared folder, as it is read often.
    """
    row = F.struct(*[F.col(quoted) for quoted in map(vectors.quoted, df.columns)])
    how = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    digest = F.md5(F.to_json(row, how).cast("binary"))
    once = df.select(digest.alias("d"), row.alias("r")).groupBy("d").agg(F.first("r").alias("r"), F.count(F.lit(1)).alias("n"))
    each = once.select("r", "d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return shared.checkpointed(each.select("r.*", F.concat_ws("-", "d", F.col("copy").cast("string")).alias(name)))


@dataclass
class Facts:
    """What one aggregation tells of a table: class counts, and by feature mean, deviations and range."""

    counts: dict
    rows: int = 0
    means: list[float] = field(default_factory=list)
    sample_sd: list[float] = field(default_factory=list)
    population_sd: list[float] = field(default_factory=list)
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)


def facts(df: DataFrame, target: str, features: list[str], checked: bool = True) -> Facts:
    """Counts by class and statistics over all rows, by one grouping over packed features; raises on unusable rows.

    The statistics are merged on the driver from those of the classes, of which there are two; so the plan's size
    doesn't grow with the number of features.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    x = vectors.packed(features)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    # bounds of long columns are not taken from doubles, which don't have them all
    longs = [i for i, c in enumerate(features) if isinstance(kinds[c], T.LongType)]
    exact = F.expr(f"array({', '.join(vectors.quoted(features[i]) for i in longs)})") if longs else F.array().cast("array<bigint>")
    rows = df.select(F.col(vectors.quoted(target)).alias("t"), x.alias("x"), exact.alias("l"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    filled = array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    summary = Summarizer.metrics("mean", "variance", "min", "max").summary(filled)
    ends = [f(F.get("l", F.lit(j))).alias(f"{name}{j}") for j in range(len(longs)) for name, f in (("low", F.min), ("high", F.max))]
    by = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), summary.alias("s"), *ends).limit(4).collect()
    counts = {r.t: r.n for r in by}
    if not counts:
        raise BalanceError("the table has no rows")
    if checked:
        if None in counts:
            raise BalanceError("the target has nulls")
        if any(r.bad for r in by):
            raise BalanceError("features must not have nulls, NaN or infinite values")
        if len(counts) != 2:
            raise BalanceError(f"the target must have exactly two classes, not {'over two' if len(counts) > 2 else len(counts)}")
        if min(counts.values()) < 2:
            raise BalanceError("each class, and so the minority, must have at least two rows")
    n = np.array([r.n for r in by], float)[:, None]
    means, variances, low, high = (np.array([r.s[k].toArray() for r in by]) for k in ("mean", "variance", "min", "max"))
    rows_, mean = int(n.sum()), (n * means).sum(0) / n.sum()
    square = ((n - 1) * variances + n * (means - mean) ** 2).sum(0)
    ranged = lambda v: [int(e) if isinstance(kinds[c], WHOLE) else float(e) for c, e in zip(features, v, strict=True)]
    least, most = ranged(low.min(0)), ranged(high.max(0))
    for j, i in enumerate(longs):
        least[i], most[i] = (f(r[f"{name}{j}"] for r in by if r[f"{name}{j}"] is not None) for name, f in (("low", min), ("high", max))) if checked else (least[i], most[i])
    return Facts(counts, rows_, mean.tolist(), np.sqrt(square / max(1, rows_ - 1)).tolist(), np.sqrt(square / rows_).tolist(), least, most)


def check_ids(df: DataFrame, id_col: str) -> None:
    """Raises if ids are null or repeat; one shuffle of ids, combined before it."""
    c = F.col(f"`{id_col}`")
    if df.groupBy(c.alias("i")).count().where("count > 1 OR i IS NULL").limit(1).collect():
        raise BalanceError(f"{id_col} must be unique and not null")
