"""The m smallest rows of a table in an order, without sorting it all into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many rows Spark's own top-k is used, which gathers m rows of each task in one.
FEW = 10_000
BINS = 1024
#: Bytes of a string that are looked at together.
WIDTH = 6
_NUMBER = "__number"


def smallest(df: DataFrame, m: int, score: str, tie: str, few: int = FEW) -> DataFrame:
    """The m rows with the smallest (score, tie); ties must be unique for one result.

    For large m the m-th score is found by histograms over ever narrower ranges. Rows below it are a plain filter;
    only rows that share its last bin are ranked, by their ties if they have one score.
    """
    if m <= few:
        return df.orderBy(score, tie).limit(max(m, 0))
    x = F.col(score).cast("double")
    low, high, n = df.agg(F.min(x), F.max(x), F.count(F.lit(1))).first()
    if n <= m:
        return df
    below, within = 0, n
    while low < high and within > few:
        width = (high - low) / BINS
        at = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).cast("int")
        bins = df.where((x >= low) & (x <= high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        for r in sorted(bins.collect()):
            if below + r.n >= m:
                low, high, within = r.lo, r.hi, r.n
                break
            below += r.n
    rest = df.where((x >= low) & (x <= high))
    if low < high or within <= few:
        last = rest.orderBy(score, tie).limit(m - below)
    elif isinstance(df.schema[tie].dataType, T.NumericType) and score != tie:
        last = smallest(rest, m - below, tie, tie, few)
    elif isinstance(df.schema[tie].dataType, T.StringType):
        last = _smallest_names(rest, m - below, tie, few)
    else:
        last = rest.orderBy(tie).limit(m - below)
    return df.where(x < low).unionByName(last)


def _smallest_names(df: DataFrame, m: int, name: str, few: int) -> DataFrame:
    """The m rows with the smallest strings, which must be unique, in the order of their bytes.

    Six bytes behind what all of them start with make a whole number that orders as they do; rows below the m-th one's
    number are a plain filter, and those that share it are told apart by the bytes that follow.
    """
    low, high = df.agg(F.min(name), F.max(name)).first()
    low, high = low.encode(), high.encode()
    alike = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    part = F.substring(F.col(name).cast("binary"), alike + 1, WIDTH)
    # where a string ends, it comes before those that go on with zero bytes
    numbered = df.withColumn(_NUMBER, F.conv(F.rpad(F.hex(part), 2 * WIDTH, "0"), 16, 10).cast("long") * 8 + F.octet_length(part))
    low, high, at, below, within = 0, 8 * 256**WIDTH - 1, F.col(_NUMBER), 0, None
    while low < high and (within is None or within > few):
        width = -(-(high - low + 1) // BINS)
        bins = numbered.where(at.between(low, high)).groupBy(F.expr(f"({_NUMBER} - {low}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
        for r in sorted(bins.collect()):
            if below + r.n >= m:
                low, high, within = r.lo, r.hi, r.n
                break
            below += r.n
    rest = numbered.where(at.between(low, high)).drop(_NUMBER)
    if within <= few or m - below >= within:
        last = rest.orderBy(name).limit(m - below) if m - below < within else rest
    else:
        last = _smallest_names(rest, m - below, name, few)
    return numbered.where(at < low).drop(_NUMBER).unionByName(last)
