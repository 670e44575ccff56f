"""The corpus pipeline: rules, classifier, near copies, mixing and encoding, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: null and empty texts fail the rules, so the first stage drops them; given to a later stage by themselves,
they get the classifier's bias alone, are near copies of nobody (each stays), have size 0 in mixing and no ids. Null ids
and sources stay what they are; rows that share an id are rows of their own, but for near copies, where equal ones among them
are copies. Ties go to the smaller id. Empty tables give empty tables of the same columns. Further columns of docs, whatever
their names, pass through all stages but the last. Very long texts are handled whole, each in the task that reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import kit, mixing, pieces, quality, rules, simhash
from evenkeel.sources import shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among all of them, scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.learnable(kit.documents(spark, sf_dir), labels))
    score = kit.fresh(docs, "__quality")
    kept = quality.scored(docs, model, score=score).where(F.col(score) >= 0.5)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8)."""
    return simhash.distinct_texts(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents, repeated to its target."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str, seen: Observation | str = "encoding") -> DataFrame:
    """Ids of every text, decoded again in the same pass; `seen` observes the numbers of texts and of those come back."""
    import public_tokenizers

    out = pieces.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), check="round_trip", keep_text=False)
    out = out.observe(seen, F.count(F.lit(1)).alias("texts"), F.count_if("round_trip").alias("round_trips"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near copies", near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Stages 2, 3 and 5 can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, seen: Observation | str = "encoding") -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again.

    A stage's rows are deleted once the next one's are written; those that the result reads stay.
    """
    docs, before = kit.documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        path = f"{shared.folder(spark)}/pipeline-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            shared.removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir, seen)
