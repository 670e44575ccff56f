"""What the operators share: words, folds, shared-folder checkpoints, ranks that no single task gathers."""

from __future__ import annotations

import hashlib
import pickle
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.sources.shared import checkpointed, folder  # noqa: F401

#: ASCII white space 0x20 and 0x09-0x0D, which parts words; `bytes.split()` parts at exactly these.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def whole(df: DataFrame) -> DataFrame:
    """df's rows as one column, `__row`, so that no name that is added to them can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def of_row(name: str) -> Column:
    return F.col("__row")[name]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null, empty or white texts."""
    bare = F.trim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE_RUN)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, rest: int) -> Column:
    """Whether no model may learn from the row; rows without an id are held out too."""
    return F.coalesce(fold(doc_id, n) == rest, F.lit(True))


def kept_in_worker(name: str, make):
    """A worker process's own copy of what `make` returns; tasks of plans that name it alike share it.

    Only the last name is kept, so that what earlier plans used doesn't fill the worker's memory.
    """
    held = sys.__dict__.setdefault("_evenkeel_worker", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def lean(run, name: str | None = None):
    """run, for mapInArrow, in a worker that forgets what other names keep before, and gives memory back after."""

    def task(batches):
        import ctypes
        import gc

        import pyarrow as pa

        held = sys.__dict__.setdefault("_evenkeel_worker", {})
        for other in [k for k in held if k != name]:
            del held[other]
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def digest(*parts) -> str:
    """A name for what the parts hold, alike in every run."""
    return hashlib.md5(pickle.dumps(parts)).hexdigest()


def gapless(df: DataFrame, within: list[str], order: list[Column], name: str, spread: Column, slices: int = 256) -> DataFrame:
    """A number from 0 for each row of each combination of `within`, without gaps, in `name`.

    Rows are dealt to `slices` slices by `spread` (a long column's hash) and numbered within their slice;
    offsets come from the slices' counts, so that even a combination with all rows is spread over many tasks.
    `within` must have few combinations: their number times `slices` is what is broadcast.
    """
    cut = df.withColumn("__slice", F.pmod(spread, F.lit(slices)).cast("int"))
    key = [*within, "__slice"]
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*[F.col(k).alias(f"__o_{k}") for k in key], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = cut.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in key]
    joined = numbered.join(F.broadcast(offsets), same, "inner")
    return joined.withColumn(name, (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__slice", "__at", "__before", *[f"__o_{k}" for k in key])
