"""Mixing sources to target weights, with built-in functions only.

Each source gets a target number of words; a document is taken floor(rate) times, where rate is target over the
source's words, and once more when its hash-seeded uniform number lies below the rate's fraction.

Targets need no rounds: sources in order of cap over weight are those that stop at their caps, up to some place; the
first place at which the level of the others no longer exceeds the next cap is found from running sums, which no single
task gathers. What is kept of the sources (a row each) is sent to the documents, so no text is shuffled.

Defined results: a null text has size 0 and is taken with its source's rate (0 words); a null source is a source,
ordered last; a null id has a hash of its own; rows that share an id share the draw, and each is taken at its own
source's rate. If no text has a word all targets and rates are 0. Very long texts are counted whole, as any other. Ties
of sources' caps don't matter, since they reach the level together. An empty table gives an empty table. Only id, text
and source columns are read by `plan`, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm import kit

#: Sources up to this number, with names of so many bytes in all, are sent to every task; more are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 32 << 20


def running(df: DataFrame, order: list[Column], **of: Column) -> DataFrame:
    """df with the sum of each column of `of` over the rows before a row in order, by ranges of the order."""
    dealt = kit.checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in of.items()])
    before = parts.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__b{n}") for n in of])
    joined = dealt.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in of.items()}).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return joined.withColumns({n: F.col(n) + F.col(f"__b{n}") for n in of}).drop("__p", "__part", *[f"__b{n}" for n in of])


def with_targets(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """`__target` of each source: share of all words by weight, at most `most` times its own, the excess reshared."""
    place = F.col("__source").asc_nulls_last()
    ranked = running(sizes, [place], __rank=F.lit(1))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights)).cast("int"))
    t = ranked.withColumn("__weight", w).withColumn("__cap", F.col("__source_size") * F.lit(float(most)))
    t = kit.checkpointed(running(t, [F.col("__cap") / F.col("__weight"), place], __caps=F.col("__cap"), __weights=F.col("__weight")))
    words, all_weights = t.agg(F.sum("__source_size"), F.sum("__weight")).first()
    if not words:
        return t.withColumn("__target", F.lit(0.0))
    level = (F.lit(share * words) - F.col("__caps")) / (F.lit(all_weights) - F.col("__weights"))
    # the first place whose level holds; where none does, every source is at its cap
    holds = t.withColumn("__level", level).where(F.col("__level") * F.col("__weight") <= F.col("__cap")).agg(F.max("__level")).first()[0]
    at = F.lit(float("inf") if holds is None else holds) * F.col("__weight")
    return t.withColumn("__target", F.least(at, F.col("__cap")))


def uniform(doc_id: Column, seed: int, k: int | Column) -> Column:
    """The k-th of a family of uniform numbers in [0, 1) that the id's md5 gives."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    k = F.lit(k) if isinstance(k, int) else k
    return ((word(1) + k * word(9)) % F.lit(1 << 32)) / F.lit(float(1 << 32))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """`__id`, `__source` and `__size` of every row, read once."""
    return kit.checkpointed(df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), kit.n_words(F.col(f"`{text_col}`")).alias("__size")))


def rates(sizes: DataFrame, weights, share: float, most: float, seed: int, tries: int) -> tuple[DataFrame, bool]:
    """(`__s`, `__source_size`, `__target`, `__whole`, `__part`, `__k`) of each source, and whether they may be sent."""
    sources = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    target = with_targets(sources, weights, share, most)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    target = kit.checkpointed(target.select(F.col("__source").alias("__s"), "__source_size", "__target", F.floor(rate).alias("__whole"), (rate - F.floor(rate)).alias("__part")))
    n, names = target.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("__s").cast("string"))), F.lit(0))).first()
    few = n <= BROADCAST_SOURCES and names <= BROADCAST_BYTES
    near = F.broadcast if few else (lambda t: t)
    drawn = sizes.join(near(target), F.col("__source").eqNullSafe(F.col("__s")))
    extra = [F.sum(F.when(uniform(F.col("__id"), seed, k) < F.col("__part"), F.col("__size")).otherwise(0)).alias(f"__x{k}") for k in range(tries)]
    taken = drawn.groupBy(F.col("__source").alias("__t")).agg(*extra)
    off = F.array(*[F.struct(F.abs(F.col("__whole") * F.col("__source_size") + F.col(f"__x{k}") - F.col("__target")).alias("off"), F.lit(k).alias("k")) for k in range(tries)])
    chosen = target.join(near(taken), F.col("__s").eqNullSafe(F.col("__t"))).withColumn("__k", F.array_min(off)["k"])
    return kit.checkpointed(chosen.drop("__t", *[f"__x{k}" for k in range(tries)])), few


def copies(doc_id: Column, seed: int) -> Column:
    return (F.col("__whole") + F.when(uniform(doc_id, seed, F.col("__k")) < F.col("__part"), 1).otherwise(0)).cast("long")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, tries: int = 32) -> DataFrame:
    """id, `__source`, `__size`, `__source_size`, `__target`, `__copies` of every row.

    Of `tries` hash families each source uses the one whose copies come nearest to its target, so that few long
    documents don't drive a small source off it.
    """
    sizes = sized(df, id_col, text_col, source_col)
    chosen, few = rates(sizes, weights, share, most, seed, tries)
    out = sizes.join(F.broadcast(chosen) if few else chosen, F.col("__source").eqNullSafe(F.col("__s")))
    return out.select("__id", "__source", "__size", "__source_size", "__target", copies(F.col("__id"), seed).alias("__copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, tries: int = 32) -> DataFrame:
    """df with each row repeated as `plan` says, where it lies."""
    chosen, few = rates(sized(df, id_col, text_col, source_col), weights, share, most, seed, tries)
    out = kit.whole(df).join(F.broadcast(chosen) if few else chosen, kit.of_row(source_col).eqNullSafe(F.col("__s")))
    return out.select("__row", F.explode(F.array_repeat(F.lit(0), copies(kit.of_row(id_col), seed).cast("int")))).select("__row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(kit.documents(spark, sf_dir))
    return p.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
