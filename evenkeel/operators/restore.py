"""Types of synthetic values: whole columns are rounded half to even and kept in the observed range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenkeel.operators.schema import WHOLE, Facts


def inferred(df: DataFrame, features: list[str], facts: Facts) -> list[tuple]:
    """(name, "integer" or "double", low, high) of each feature; the range only of whole ones."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(c, "integer", lo, hi) if isinstance(kinds[c], WHOLE) else (c, "double", None, None) for c, lo, hi in zip(features, facts.low, facts.high, strict=True)]


def restored(value: str, kind: T.DataType, low, high) -> str:
    """The expression of a double as one of the kind, both as SQL text, of which hundreds are planned quickly.

    A whole value is clamped as a double and, since long bounds may not be doubles, once more as what it is then.
    """
    name = kind.simpleString()
    if not isinstance(kind, WHOLE):
        return f"CAST({value} AS {name})"
    inner = f"CAST(least(greatest(bround({value}), {float(low)!r}D), {float(high)!r}D) AS {name})"
    return f"least(greatest({inner}, CAST('{low}' AS {name})), CAST('{high}' AS {name}))" if isinstance(kind, T.LongType) else inner
