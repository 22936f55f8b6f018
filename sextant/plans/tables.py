"""The driver's tables in the shape of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.access import DOMAINS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text functions cost more than its move: dealt to all cores if its files give fewer splits.

    Only the bare scan is asked for its splits, which runs nothing.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def privacy_of(quality: Column, toxic: Column) -> Column:
    return (
        F.when((quality == 1) & (toxic == 0), "public").when((quality == 0) & (toxic == 0), "internal")
        .when((quality == 1) & (toxic == 1), "sensitive").when((quality == 0) & (toxic == 1), "student-private")
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, description, metadata, body, privacy: documents with a class where labels give one."""
    docs, labels = dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("description"), F.col("lang").alias("metadata"),
        F.col("text").alias("body"), privacy_of(F.col("quality"), F.col("toxic")).alias("privacy"), F.lit(None).cast("string").alias("reason"), "toxic",
    )


def domain_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(key, F.lit(len(DOMAINS))) + 1).cast("int"))
