"""Which majority rows to keep: those with the nearest minority rows on average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import knn, repeated, select, tree
from evenkeel.sources import shared


def scored(lists: DataFrame, score: str = "mean", metric: str = "euclidean") -> DataFrame:
    """(id, score): the mean distance to the neighbours in a row's list, or the mean squared distance ("mean_sq")."""

    def one(x):
        d = knn.distance(x["measure"], metric)
        return d if score == "mean" else x["measure"] if metric == "euclidean" else d * d

    total = F.aggregate("near", F.lit(0.0), lambda s, x: s + one(x))
    return lists.select(F.col("query_id").alias("id"), (total / F.size("near")).alias("score"))


def kept(scores: DataFrame, m: int, decimals: int | None = None, few: int = select.FEW) -> DataFrame:
    """(id, score) of the m rows with the smallest (score, id)."""
    if decimals is not None:
        scores = scores.withColumn("score", F.round("score", decimals))
    if m > few:
        # scores are read more than once then, and cost a search
        scores = shared.checkpointed(scores)
    return select.smallest(scores, m, "score", "id", few)


def pruned(queries: DataFrame, refs: DataFrame, k: int, m: int, score: str = "mean", decimals: int | None = None, *, sizes: tuple[int, int], dim: int, leaf: int = tree.LEAF) -> tuple[DataFrame, int]:
    """The queries (id, z) that may be among the m with the smallest scores, by bounds of the scores from cells of the references.

    A query's score lies between two bounds that cells' planes and balls give without its neighbours. At least m have an upper
    bound of at most some bar; those whose lower bound is beyond it needn't be scored. Returns them and how many they are.
    """
    n, queries, asked = sizes[0], queries.select("id", "z"), None
    if n * sizes[1] > knn.MANY:
        # as in `repeated`: k references of a vector are enough, and a vector's queries share their bounds
        refs = shared.checkpointed(repeated.distinct(refs, k).select(F.explode("ids").alias("id"), "z"))
        sizes, asked = (n, refs.count()), queries
        queries = queries.groupBy("z").agg(F.min("id").alias("id"))
    cells, counts, _ = tree.fitted(refs, sizes[1], dim, "kd_tree", leaf)
    rows = tree.bounds(queries, cells, counts, k, dim, score != "mean")
    if asked is not None:
        rows = asked.join(rows.select(F.col("z").alias("v"), "lower", "upper"), F.col("z") == F.col("v")).drop("v")
    rows = shared.checkpointed(rows)
    # a rank that errs by a ten-thousandth of all rows; what it gives is a bar only if m rows are below it
    bar, top = rows.agg(F.percentile_approx("upper", min(1.0, m / n + 2e-4), 10_000), F.max("upper")).first()
    below = rows.agg(F.count_if(F.col("upper") <= F.lit(bar))).first()[0]
    bar = bar if below >= m else top
    slack = 0.0 if decimals is None else 10.0 ** (-decimals / 2 if score == "mean" else -decimals)
    left = rows.where(F.col("lower") <= F.lit(bar * (1 + 1e-9) + slack)).select("id", "z")
    return left, left.count()
