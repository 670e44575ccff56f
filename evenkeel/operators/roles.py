"""Classes, their roles, and how many rows to make or keep."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.errors import BalanceError


@dataclass(frozen=True)
class Roles:
    minority: object
    majority: object
    n_min: int
    n_maj: int

    @property
    def ratio(self) -> float:
        return self.n_maj / self.n_min


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, n) of each class."""
    return df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def assigned(counts: dict, minority=None, majority=None, ties: str = "abort") -> Roles:
    """Roles by count, or as fixed. Classes of one size abort, or the first in order is the minority (ties="first")."""
    labels = sorted(counts)
    if (minority is None) != (majority is None):
        raise BalanceError("fixed labels come as a pair")
    if minority is not None:
        if minority == majority or minority not in counts or majority not in counts:
            raise BalanceError("fixed labels must be two different classes of the target")
        return Roles(minority, majority, counts[minority], counts[majority])
    a, b = labels
    if counts[a] == counts[b]:
        if ties == "abort":
            raise BalanceError("both classes have as many rows; there is no minority")
        return Roles(a, b, counts[a], counts[b])
    low, high = (a, b) if counts[a] < counts[b] else (b, a)
    return Roles(low, high, counts[low], counts[high])


def expansion(n_min: int, ratio: float) -> int:
    return max(1, math.floor(n_min * ratio))


def retention(n_min: int, n_maj: int, ratio: float, least: int | None = None) -> int:
    """Majority rows to keep; below 1 it aborts unless there is a least number."""
    m = min(n_maj, math.floor(n_min * ratio))
    if m < 1:
        if least is None:
            raise BalanceError("the ratio keeps no majority row")
        m = min(least, n_maj)
    return m
