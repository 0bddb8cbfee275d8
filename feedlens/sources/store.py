"""F1/F9 over a store: items kept by day and category, so filters read only the folders they need.

The look-back window prunes days when the plan is made. Categories are not written into the plan: they come
from the active rows of the registry, and the join with it prunes the category folders while the
query runs (dynamic partition pruning).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators.report import checked_broadcast

PARTITIONS = ("day", "source_category")


def write_items(items: DataFrame, path: str, mode: str = "append") -> None:
    """Add items to the store: one folder per day (of ``published``) and category."""
    days = items.withColumn("day", F.to_date("published"))
    days.repartition(*PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_items(spark: SparkSession, path: str, now=None, hours: float | None = None) -> DataFrame:
    """Items of the store, of the last ``hours`` before ``now`` if given."""
    items = spark.read.parquet(path)
    if hours is not None:
        now = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
        first = (now - dt.timedelta(hours=hours)).date()
        items = FL.lookback(items.where(F.col("day") >= F.lit(first)), now, hours)
    return items.withColumn("published", F.col("published").cast("timestamp")).drop("day")


def of_active_categories(items: DataFrame, registry: DataFrame) -> DataFrame:
    """F9 driven by the registry: items whose category has an enabled source. ``registry``: category, enabled."""
    # a comparison, as Spark prunes by joined tables only where their filter looks selective to it
    active = registry.where(F.coalesce(F.col("enabled").cast("int"), F.lit(1)) == 1).select(F.col("category").alias("source_category")).distinct()
    return items.join(checked_broadcast(active), "source_category", "left_semi")


def drop_days(spark: SparkSession, path: str, before: dt.date) -> list[str]:
    """Delete the folders of days before ``before``; returns the days that went."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "day=*")) or []:
        day = found.getPath().getName()[len("day=") :]
        if day < before.isoformat():  # ISO days sort as text
            fs.delete(found.getPath(), True)
            gone.append(day)
    return sorted(gone)
