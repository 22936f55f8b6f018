"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of the scratch blocks that are open, the innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset (tests), below the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block go when it ends, except those stored with ``keep``."""
    folder = work_dir(spark)
    token = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: its lineage ends at a durable table that survives executors.

    ``keep``: the table outlives the innermost scratch block.
    """
    folders = _OPEN.get()[: -1 if keep else None]
    path = f"{folders[-1]}/{uuid.uuid4().hex}" if folders else work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 1, in the order of columns that tell all rows apart; by ranges, not in one task."""
    ordered = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))  # a row a partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_at") - F.col("_low") + F.col("_before") + 1).drop("_at", "_part", "_low", "_before")
