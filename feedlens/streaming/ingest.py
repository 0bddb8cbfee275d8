"""Structured Streaming re-aims of the scheduled batch runs (ST1, ST2).

The batch tool is re-run by a scheduler over a look-back window. On Spark
the same work is an incremental stream over a landing folder:

* ST1 ``stream_ingest_dedup`` — new item files are read as they land,
  fingerprinted, and exact duplicates are dropped inside the look-back
  horizon with ``dropDuplicatesWithinWatermark`` (state is bounded by the
  watermark, so it does not grow with history);
* ST2 ``stream_report_refresh`` — each micro-batch is appended to the
  de-duplicated store and the incident report is recomputed over the
  store's look-back slice with the batch operators (``foreachBatch``), so
  the tier-aware exact dedup and the fuzzy pass keep their batch semantics.

Both use ``trigger(availableNow=True)`` (process what has landed, then
stop) and a checkpoint location inside the session's checkpoint folder, so
a restarted job resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.similarity import similar_title_pairs
from ..session import checkpoint_dir, cut_lineage


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def land(items: DataFrame, path: str) -> None:
    """Write an item table as landed parquet files (one folder per category)."""
    items.write.mode("overwrite").partitionBy("source_category").parquet(path)


def dedup_stream(spark: SparkSession, landing: str, schema, horizon: str = "720 hours") -> DataFrame:
    """ST1 as a streaming DataFrame: fingerprint + first arrival within the horizon."""
    src = spark.readStream.schema(schema).parquet(landing)
    return (
        src.withColumn("published", F.col("published").cast("timestamp"))
        .withColumn("fp", T.fingerprint("title", "url"))
        .withWatermark("published", horizon)
        .dropDuplicatesWithinWatermark(["fp"])
    )


def stream_ingest_dedup(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, horizon: str = "720 hours") -> None:
    q = (
        dedup_stream(spark, landing, schema, horizon)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


class WindowPairs:
    """Similar title pairs of the look-back window, kept up to date from batch to batch (J1 under ST2).

    After each batch a folder holds the window's titles and their pairs. The next batch compares only titles
    that the last window didn't have with all titles of its own, and takes over the stored pairs of titles
    that are still there. What leaves the window leaves the store, so it doesn't grow. A batch writes folders of its
    own number, so a replayed one reads what it read before. ``compared`` counts new titles of the last call.
    """

    def __init__(self, spark: SparkSession, path: str, epoch: int):
        self.spark, self.path, self.epoch = spark, path, epoch
        self.compared = 0

    def stored(self, what: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/batch={self.epoch - 1}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(folder.toString()) if there else self.spark.createDataFrame([], schema)

    def __call__(self, titles: DataFrame, threshold: float) -> DataFrame:
        old = self.stored("titles", "tid bigint").withColumn("_old", F.lit(True))
        marked = cut_lineage(titles.join(old, "tid", "left").select("tid", "nt", F.col("_old").isNull().alias("fresh")))
        self.compared = marked.where("fresh").count()
        here = marked.where(~F.col("fresh")).select("tid")
        kept = self.stored("pairs", "a bigint, b bigint").join(here.withColumnRenamed("tid", "a"), "a", "left_semi").join(here.withColumnRenamed("tid", "b"), "b", "left_semi")
        found = similar_title_pairs(marked, threshold, new_col="fresh")
        now = f"{self.path}/pairs/batch={self.epoch}"
        kept.select("a", "b").unionByName(found).write.mode("overwrite").parquet(now)
        marked.select("tid").write.mode("overwrite").parquet(f"{self.path}/titles/batch={self.epoch}")
        drop_folders(self.spark, f"{self.path}/*/batch=*", lambda n: int(n.rpartition("=")[2]) < self.epoch - 1)
        return self.spark.read.schema("a bigint, b bigint").parquet(now)


def drop_folders(spark: SparkSession, pattern: str, gone: Callable[[str], bool]) -> list[str]:
    """Delete the folders of a pattern whose name ``gone`` accepts; returns their names."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for found in fs.globStatus(glob) or []:
        if gone(found.getPath().getName()):
            fs.delete(found.getPath(), True)
            names.append(found.getPath().getName())
    return sorted(names)


def stream_report_refresh(
    spark: SparkSession, landing: str, schema, store: str, report: str, checkpoint: str, now, days: int = 14, **kw
) -> None:
    """ST2: add each micro-batch to the store, then rebuild the report.

    The store has one folder per batch and day. A replayed batch overwrites its own
    folder, so rows are never doubled; the report reads only the days of the
    look-back window, days before it are deleted, and each batch writes its report to a folder of its own.
    Title pairs, the dear part, are kept from batch to batch (``WindowPairs``).
    """
    from ..plans.incidents import incident_report

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        days_of = batch.withColumn("day", F.to_date("published"))
        days_of.write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={epoch_id}")
        first = F.date_sub(F.to_date(F.lit(now).cast("timestamp")), days)
        # a folder's day is after all of its rows' look-back once it lies before the first day
        oldest = spark.range(1).select(first.cast("string")).first()[0]
        drop_folders(spark, f"{store}/batch=*/day=*", lambda n: n[len("day=") :] < oldest)
        stored = spark.read.schema(f"{batch.schema.toDDL()}, batch int, day date").parquet(store).where(F.col("day") >= first)
        pairs = WindowPairs(spark, f"{store}-pairs", epoch_id)
        rep = incident_report(stored.drop("batch", "day"), now, days=days, pairs_of=pairs, **kw)
        rep.rows.write.mode("overwrite").parquet(f"{report}/batch={epoch_id}")

    q = (
        spark.readStream.schema(schema)
        .parquet(landing)
        .withColumn("published", F.col("published").cast("timestamp"))
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest_report(spark: SparkSession, report: str) -> DataFrame:
    """The report of the newest batch."""
    every = spark.read.parquet(report)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(newest)).drop("batch")


def run_ingest_dedup(items: DataFrame, horizon: str = "720 hours") -> DataFrame:
    """Land ``items``, stream them through ST1, return the sink as a table."""
    spark = items.sparkSession
    base = _scratch(spark, "stream-dedup")
    land(items, f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    stream_ingest_dedup(spark, f"{base}/landing", schema, f"{base}/sink", f"{base}/state", horizon)
    return spark.read.parquet(f"{base}/sink")


def run_report_refresh(items: DataFrame, now, days: int = 14, **kw) -> DataFrame:
    """Land ``items``, run ST2 over them, return the refreshed report."""
    spark = items.sparkSession
    base = _scratch(spark, "stream-report")
    land(items, f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    stream_report_refresh(spark, f"{base}/landing", schema, f"{base}/store", f"{base}/report", f"{base}/state", now, days, **kw)
    return latest_report(spark, f"{base}/report")
