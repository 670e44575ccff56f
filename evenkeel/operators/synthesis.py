"""How many synthetic rows each minority row starts, and the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import vectors
from evenkeel.operators import select

#: Copies of a row that one task makes.
RANGE = 10_000


def difficulty(lists: DataFrame, minor: DataFrame) -> DataFrame:
    """(id, c, k): how many of each query's k neighbours are of the majority.

    lists: (query_id, near), see `knn`; minor: the `id` of every minority row, which the queries are among.
    """
    m = minor.select(F.col("id").alias("neighbor_id"), F.lit(1).alias("is_minor"))
    joined = lists.select("query_id", F.explode("near.neighbor_id").alias("neighbor_id")).join(m, "neighbor_id", "left")
    return joined.groupBy(F.col("query_id").alias("id")).agg(F.count_if(F.col("is_minor").isNull()).alias("c"), F.count(F.lit(1)).alias("k"))


def weights(counts: DataFrame) -> DataFrame:
    """counts with `weight`: c over the sum of all c, or one over the rows if that is 0."""
    total, rows = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    return counts.withColumn("weight", F.col("c") / F.lit(float(total)) if total else F.lit(1.0 / max(1, rows)))


def apportioned(counts: DataFrame, g: int, few: int = select.FEW) -> DataFrame:
    """(id, c, n): g rows shared by c in whole numbers; what is left goes to the largest remainders, then smaller ids.

    All in integers: n = g * c div C, and one more for the largest g * c mod C. If C is 0 every c counts as 1.
    """
    return shared_out(counts, g, few)[0]


def shared_out(counts: DataFrame, g: int, few: int = select.FEW) -> tuple[DataFrame, int]:
    """As `apportioned`, and the largest n.

    Rows of one c differ by their ids alone, and there are no more values of c than neighbours, so a histogram of c tells what
    each value gets; of the one remainder at which g runs out, the smallest ids get one more.
    """
    by = {r.c: r.n for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(c * n for c, n in by.items())
    own = {c: c if total else 1 for c in by}
    whole = total or sum(by.values())
    if not by:
        return counts.select("id", "c", F.lit(0).cast("long").alias("n")), 0
    n = {c: g * x // whole for c, x in own.items()}
    rem = {c: g * x % whole for c, x in own.items()}
    left, part = g - sum(n[c] * by[c] for c in by), []
    for r in sorted(set(rem.values()), reverse=True):
        level = [c for c in by if rem[c] == r]
        size = sum(by[c] for c in level)
        if size > left:
            part = level if left else []
            break
        n |= {c: n[c] + 1 for c in level}
        left -= size
    most = max(n.values()) + bool(part)
    table = F.array(*[F.lit(n.get(c, 0)).cast("long") for c in range(max(by) + 1)])
    out = counts.select("id", "c", F.get(table, F.col("c").cast("int")).alias("n"))
    if part:
        extra = select.smallest(counts.where(F.col("c").isin(part)).select("id"), left, "id", "id", few).select(F.col("id").alias("x"), F.lit(1).alias("one"))
        extra = F.broadcast(extra) if left <= few else extra
        out = out.join(extra, F.col("id") == F.col("x"), "left").select("id", "c", (F.col("n") + F.coalesce("one", F.lit(0))).alias("n"))
    return out, most


def even(minor: DataFrame, g: int, n_min: int, few: int = select.FEW) -> DataFrame:
    """(id, n): g rows dealt in turn over the minority rows in order of their ids."""
    base, left = divmod(g, n_min)
    if not left:
        return minor.select("id", F.lit(base).cast("long").alias("n"))
    extra = select.smallest(minor.select("id"), left, "id", "id", few).select(F.col("id").alias("x"), F.lit(1).alias("one"))
    extra = F.broadcast(extra) if left <= few else extra
    return minor.select("id").join(extra, F.col("id") == F.col("x"), "left").select("id", (F.lit(base) + F.coalesce("one", F.lit(0))).cast("long").alias("n"))


def between(wanted: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """(base_id, copy, neighbor_id, share, z) of every synthetic row, between a minority row and one of its neighbours.

    wanted: (base_id, n, near, from, tos), n rows to start, the neighbours' ids, the row's vector and theirs; most: the
    largest n, if known. Which neighbour and how far are numbers from the seed, the row's id and the copy's number. A row
    that has copies but no neighbour fails the job.
    """
    near = F.when(F.size("near") > 0, F.col("near")).otherwise(F.raise_error(F.lit("a row that starts new rows has no neighbour")))
    drawn = copies(wanted.where("n > 0").withColumn("near", near), most).select("base_id", "copy", "from", F.get("near", _pick(seed)).alias("neighbor_id"), F.get("tos", _pick(seed)).alias("to"), _share(seed).alias("share"))
    return drawn.select("base_id", "copy", "neighbor_id", "share", vectors.interpolated(F.col("from"), F.col("to"), F.col("share")).alias("z"))


def copies(wanted: DataFrame, most: int | None = None, width: int = RANGE) -> DataFrame:
    """wanted's rows n times each, with `copy` from 1 to n. No task makes more than `width` of a row's copies by itself.

    A row with more is first dealt out as ranges of that many, ranges of ranges if need be. most: the largest n, if known.
    """
    if most is None:
        most = wanted.agg(F.max("n")).first()[0] or 0
    steps = [width]
    while most > steps[-1] * width:
        steps.append(steps[-1] * width)
    rows = wanted.withColumns({"__from": F.lit(1).cast("long"), "__to": F.col("n")})
    for step in reversed(steps if most > width else []):
        starts = F.explode(F.sequence(F.col("__from"), F.col("__to"), F.lit(step).cast("long")))
        rows = rows.withColumn("__at", starts).withColumns({"__to": F.least("__to", F.col("__at") + (step - 1)), "__from": F.col("__at")}).drop("__at").repartition("base_id", "__from")
    return rows.withColumn("copy", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")


def _pick(seed: int) -> Column:
    k = F.size("near")
    return F.least(F.floor(vectors.uniform(seed, F.col("base_id"), F.col("copy"), "pick") * k).cast("int"), k - 1)


def _share(seed: int) -> Column:
    return vectors.uniform(seed, F.col("base_id"), F.col("copy"), "share")
