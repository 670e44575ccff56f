"""Labelled tables to balance, read from a folder of parquet tables with only the columns that are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def parts(spark: SparkSession, folder: str, brand: str = "Brand#11") -> DataFrame:
    """p_partkey, p_size, p_retailprice and `cls`: rare for one brand, else common."""
    cls = F.when(F.col("p_brand") == brand, "rare").otherwise("common").alias("cls")
    return read(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", cls)


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, value, hour and `cls`: whether the event is a purchase."""
    return read(spark, folder, "events").select("event_id", "value", F.hour("ts").alias("hour"), (F.col("event_type") == "purchase").alias("cls"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_chars, quality and `toxic` of the labelled documents."""
    docs = read(spark, folder, "documents").select("doc_id", "n_chars")
    return read(spark, folder, "labels").join(docs, "doc_id").select("doc_id", "n_chars", "quality", "toxic")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """id, z and label of the embeddings."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"), "label")
