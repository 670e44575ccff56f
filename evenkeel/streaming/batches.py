"""Balancing of a stream, one micro-batch at a time.

Class counts and neighbours need bounded input, so a stream has no balance as a whole; each batch is balanced by
itself and handed on. A batch that has rows of one class only, or none, is handed on as it is, and so is one whose classes
are too small or as large as each other, if `lenient`; every other error, and every wrong parameter, stops the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evenkeel.errors import BalanceError
from evenkeel.functions import vectors
from evenkeel.operators import balance, checks, schema


def balanced_batches(stream: DataFrame, target: str, sink: Callable[[DataFrame, int], None], strategy: str = "adanear", lenient: bool = True, passed: Callable[[int, str], None] | None = None, **options) -> DataStreamWriter:
    """A writer, not yet started, that gives sink(balanced batch, batch id); passed(batch id, why) tells of others."""
    if strategy not in balance.STRATEGIES:
        raise BalanceError(f"strategy must be one of {balance.STRATEGIES}, not {strategy!r}")
    own = dict(options)
    for name, zero in (("adasyn_ratio", True), ("nearmiss_ratio", True)):
        if name in own:
            checks.ratio(own.pop(name), name, zero=zero)
    for name in ("over_k", "under_k"):
        if name in own:
            checks.positive_integer(own.pop(name), name)
    checks.seed(own.pop("seed", 0))
    own.pop("validate", None)
    schema.resolved(stream, target, own.get("features"), own.get("id_col"))
    balance.Options(**own)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            n = sorted(r[1] for r in batch.where(F.col(vectors.quoted(target)).isNotNull()).groupBy(vectors.quoted(target)).count().limit(3).collect())
            why = "fewer than two classes" if len(n) < 2 else "a class has one row" if lenient and n[0] < 2 else "classes of one size" if lenient and len(n) == 2 and n[0] == n[1] else None
            if why:
                if passed:
                    passed(number, why)
                sink(batch, number)
            else:
                sink(balance.balance(batch, target, strategy, **options).data, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)
