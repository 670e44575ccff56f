"""Shards of even size that keep linked documents together, by balanced label propagation; built-in functions only.

Documents with equal texts are linked. They start in shards by hash. In each round every group finds the shard where
most of it lies (a large group: as many as it needs to fit, among those with room left), and its other members ask to
move there; quotas between each two shards let through as many as fit. Members of one group with one hash bucket of
`BUCKETS` move together as a cell, so rounds work on counts and a group of any size is at most `BUCKETS` cells. At last
the shards are evened to counts at most one apart: rows beyond a shard's quota, unlinked ones first, fill the others,
the rows of a small group side by side.

Defined results: a null text has no bytes and is linked to other null and empty texts; a null id is hashed like any
other; rows that share an id are rows of their own; an empty table gives an empty table. A very long text counts by all its
bytes, as one row; it is hashed where it is read and not shuffled. Only the id and text columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm import kit

SHARDS, BUCKETS, ROUNDS = 40, 640, 6


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`__id`, `__size` (UTF-8 bytes and 16), `__crc`, `__key` (what equal texts share) and `__bucket` of every row."""
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    bucket = F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(BUCKETS)).cast("int")
    return rows.select("__id", (F.octet_length("t") + 16).cast("long").alias("__size"), F.crc32("t").alias("__crc"), F.md5("t").alias("__key"), bucket.alias("__bucket"))


def _chances(flows: list, load: dict[int, int], cap: int) -> dict[tuple[int, int], float]:
    """The share of what asks to move from i to j that may: what j sends to i, and of the rest what j has room for."""
    asked = {(r.i, r.j): r.n for r in flows}
    swap = {(i, j): min(n, asked.get((j, i), 0)) for (i, j), n in asked.items()}
    coming: dict[int, int] = {}
    for (i, j), n in asked.items():
        coming[j] = coming.get(j, 0) + n - swap[i, j]
    room = {j: min(1.0, max(0, cap - load.get(j, 0)) / n) if n else 1.0 for j, n in coming.items()}
    return {(i, j): (swap[i, j] + (n - swap[i, j]) * room[j]) / n for (i, j), n in asked.items()}


def large(total: Column, cap: int) -> Column:
    """Whether a group of so many rows is moved in parts."""
    return total * 8 > cap


def propagated(cells: DataFrame, shards: int, cap: int, rounds: int = ROUNDS) -> DataFrame:
    """(key, bucket, n, total, label) cells of linked documents with the labels of the last round."""
    for turn in range(rounds):
        load = {r.label: r.n for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        full = [j for j in range(shards) if load.get(j, 0) >= cap]
        has_room = ~F.col("label").isin(full) if full else F.lit(True)
        by = cells.groupBy("key", "label").agg(F.sum("n").alias("c"), F.max("total").alias("total"))
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), F.xxhash64("key", "label"), "label"))
        need = F.ceil(F.col("total") / F.lit(float(cap)))
        goals = by.where(has_room | ~large(F.col("total"), cap)).withColumn("place", place).where(F.col("place") <= need).groupBy(F.col("key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "label", "c"))).alias("goals"))
        held = by.select(F.col("key").alias("k"), F.col("label").alias("l"), F.col("c").alias("own"))
        moving = cells.join(goals, F.col("key") == F.col("k"), "left").drop("k").join(held, (F.col("key") == F.col("k")) & (F.col("label") == F.col("l"))).drop("k", "l")
        goal = F.get("goals", F.pmod(F.xxhash64("key", "bucket"), F.size("goals")).cast("int"))
        asks = F.col("goals").isNotNull() & ~F.exists("goals", lambda g: g["label"] == F.col("label")) & (goal["c"] >= F.col("own"))
        moving = kit.checkpointed(moving.select("key", "bucket", "n", "total", "label", F.when(asks, goal["label"]).alias("want")))
        flows = moving.where("want IS NOT NULL").groupBy(F.col("label").alias("i"), F.col("want").alias("j")).agg(F.sum("n").alias("n")).collect()
        if not flows:
            break
        may = _chances(flows, load, cap)
        # one constant array, so that a row finds its number by place
        chance = F.from_json(F.lit(json.dumps([may.get((i, j), 0.0) for i in range(shards) for j in range(shards)])), "array<double>")
        # small groups move whole, large ones cell by cell
        drawn = F.when(large(F.col("total"), cap), F.xxhash64("key", "bucket", F.lit(turn))).otherwise(F.xxhash64("key", F.lit(turn)))
        u = (F.pmod(drawn, F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
        moves = F.col("want").isNotNull() & (u < F.get(chance, F.col("label") * shards + F.col("want")))
        cells = moving.select("key", "bucket", "n", "total", F.when(moves, F.col("want")).otherwise(F.col("label")).alias("label"))
    return cells


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """`__id`, `__size`, `__crc`, `__key`, `__shard` and `__slot` (gapless from 0 in each shard) of every row."""
    rows = kit.checkpointed(measured(df, id_col, text_col))
    total = rows.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    cells = rows.groupBy(F.col("__key").alias("key"), F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1")
    cells = kit.checkpointed(cells.withColumn("label", F.col("bucket") % shards))
    cells = propagated(cells, shards, max(1, total // shards))
    labels = cells.select("key", "bucket", "label", large(F.col("total"), max(1, total // shards)).alias("large"))
    joined = rows.join(labels, (F.col("__key") == F.col("key")) & (F.col("__bucket") == F.col("bucket")), "left")
    linked = F.col("label").isNotNull()
    # linked rows stand in the lower half of the slices and so come first; small groups stand, and are evened out, together
    by = F.when(linked & ~F.col("large"), F.xxhash64("__key", F.lit(31))).otherwise(F.xxhash64("__id", F.lit(31)))
    placed = kit.checkpointed(joined.select("__id", "__size", "__crc", "__key", F.coalesce("label", F.col("__bucket") % shards).alias("__shard"), by.alias("__by"), linked.alias("__linked")))
    spread = F.pmod(F.col("__by"), F.lit(128)) + F.when(F.col("__linked"), 0).otherwise(128)
    placed = kit.gapless(placed, ["__shard"], [F.col("__by"), F.col("__id")], "__slot", spread)
    count = {r["__shard"]: r["n"] for r in placed.groupBy("__shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    upto = [0]
    for j in range(shards):
        upto.append(upto[-1] + max(0, quota[j] - count.get(j, 0)))
    stays = F.col("__slot") < F.get(F.array(*[F.lit(q) for q in quota]), F.col("__shard"))
    surplus = kit.checkpointed(placed.where(~stays))
    moved = kit.gapless(surplus.drop("__slot"), [], [F.col("__by"), F.col("__id")], "__turn", F.xxhash64("__by", F.lit(37)))
    to = F.size(F.filter(F.array(*[F.lit(x) for x in upto[1:]]), lambda x: x <= F.col("__turn")))
    starts = F.array(*[F.lit(count.get(j, 0) - upto[j]) for j in range(shards)])
    moved = moved.withColumn("__shard", to.cast("int")).withColumn("__slot", (F.get(starts, F.col("__shard")) + F.col("__turn")).cast("long"))
    names = ["__id", "__size", "__crc", "__key", "__shard", "__slot"]
    return placed.where(stays).select(*names).unionByName(moved.select(*names))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(kit.documents(spark, sf_dir))
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
