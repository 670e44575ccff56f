"""Checks of parameters, all on the driver and before any job."""

from __future__ import annotations

import math

from evenkeel.errors import BalanceError

INT_MAX = 2**31 - 1
LEVELS = ("none", "light", "full")
PRECISIONS = ("double", "single")
BACKENDS = ("parallel", "RcppParallel")


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x)


def positive_integer(x, name: str) -> int:
    if not is_number(x) or math.isinf(x) or x != int(x) or not 1 <= x <= INT_MAX:
        raise BalanceError(f"{name} must be an integer from 1 to {INT_MAX}, not {x!r}")
    return int(x)


def flag(x, name: str) -> bool:
    if not isinstance(x, bool):
        raise BalanceError(f"{name} must be True or False, not {x!r}")
    return x


def seed(x) -> int:
    if not is_number(x) or math.isinf(x) or x != int(x) or not 0 <= x <= INT_MAX:
        raise BalanceError(f"seed must be an integer from 0 to {INT_MAX}, not {x!r}")
    return int(x)


def ratio(x, name: str, zero: bool = False) -> float:
    if not is_number(x) or math.isinf(x) or x < 0 or (x == 0 and not zero):
        raise BalanceError(f"{name} must be a finite number {'of at least' if zero else 'above'} 0, not {x!r}")
    return float(x)


def chunk_size(x) -> int:
    return 1000 if x is None else positive_integer(x, "chunk_size")


def graph_parameters(m, ef) -> tuple[int, int]:
    m, ef = positive_integer(m, "graph_m"), positive_integer(ef, "graph_ef")
    if m < 2:
        raise BalanceError("graph_m must be at least 2")
    return m, ef


def backend(x: str) -> str:
    if x not in BACKENDS:
        raise BalanceError(f"backend must be one of {BACKENDS}, not {x!r}")
    return x


def precision(x: str) -> str:
    if x not in PRECISIONS:
        raise BalanceError(f"precision must be one of {PRECISIONS}, not {x!r}")
    return x


def audit_level(audit: bool, level: str) -> str:
    if level not in LEVELS:
        raise BalanceError(f"audit_level must be one of {LEVELS}, not {level!r}")
    return "full" if audit else level


def dense_budget(rows: int, columns: int, extra: float, most_gb: float, what: str) -> None:
    if (gb := rows * columns * 8 * extra / 1e9) > most_gb:
        raise BalanceError(f"{what} would take {gb:.3g} GB of dense doubles; the limit is {most_gb:g} GB")


def output_rows(rows: int, most: float) -> None:
    if rows > most:
        raise BalanceError(f"the result would have {rows} rows; the limit is {most:g}")


def scaling(info, features: list[str]) -> None:
    c, s = list(info.centers), list(info.scales)
    if len(c) != len(features) or len(s) != len(features):
        raise BalanceError(f"scaling must have a center and a scale for each of {len(features)} features")
    if not all(is_number(x) and math.isfinite(x) for x in c + s) or min(s) <= 0:
        raise BalanceError("scaling needs finite centers and finite scales above 0")
