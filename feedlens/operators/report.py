"""Ordering, ranking and report tables (O1, O3, W1, W4, A9, A11, U1, U2, SNK1–2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

from .. import constants as C

def score_order() -> list[Column]:
    """O1: score desc, ties in scan order (tier, newest first, first arrival)."""
    return [F.desc("score"), F.asc("r_tier"), F.asc("r_neg_pub"), F.asc("r_pos")]

# Broadcast a table only below this many rows (checked with a count first).
BROADCAST_MAX_ROWS = 1_000_000


def order_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """1-based position of each row in a total order, without a global window.

    The rows are range-partitioned by the sort; each partition is numbered
    locally and shifted by the row count of the partitions before it (one
    small row per partition). Nothing funnels through a single task.
    """
    sorted_df = cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id()
    ))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (
        sorted_df.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid")
        .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
        .drop("_pid", "_mid", "_off", "_m0")
    )


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_sources(raw: DataFrame) -> DataFrame:
    """The set of source names seen."""
    return raw.select("source_name").distinct()


def source_item_counts(raw: DataFrame) -> DataFrame:
    """Items per source (partial aggregate)."""
    return raw.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_items"))


def funnel(raw: DataFrame, shown: DataFrame) -> DataFrame:
    """Total fetched, shown, removed and distinct sources — one row."""
    r = raw.agg(F.count(F.lit(1)).alias("total_raw"), F.count_distinct("source_name").alias("sources_hit"))
    s = shown.agg(F.count(F.lit(1)).alias("items_shown"))
    return r.crossJoin(s).select(
        "total_raw", "items_shown", (F.col("total_raw") - F.col("items_shown")).alias("removed"), "sources_hit"
    )


def first_sources(attribution: DataFrame, n: int = C.DUP_SOURCES_SHOWN) -> DataFrame:
    """The first ``n`` duplicate-source names per surviving item, in list order.

    ``row_number() <= n`` lets Spark keep only the top ``n`` per group on the
    map side before the shuffle, so even a group of millions of copies
    ships at most ``n`` rows per task.
    """
    w = Window.partitionBy("fp").orderBy("stage", "ord")
    top = attribution.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("_rn", "source_name"))).alias("_s")).select(
        "fp", F.col("_s.source_name").alias("also")
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group (map-side limited before the shuffle)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count proves it small; otherwise leave
    the join to a shuffle (AQE splits skewed partitions)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def write_report(df: DataFrame, path: str, fmt: str = "parquet", order: list[str] | None = None) -> None:
    """SNK1/SNK2: persist a report table.

    The ordering columns (cluster_rank/item_rank or idx) are kept as data,
    so readers sort on them; rows are range-partitioned on them so each
    output file holds a contiguous slice of the report.
    """
    out = df.repartitionByRange(*order) if order else df
    out.write.mode("overwrite").format(fmt).save(path)


def skew_safe_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_fraction: float = 0.001,
) -> DataFrame:
    """Join ``big`` to ``small`` (at most one row per key) so that no hot
    key lands in a single task.

    Keys holding more than ``hot_fraction`` of ``big``'s rows are found with
    a partial aggregate; there are at most ``1 / hot_fraction`` of them, so
    that list has a proven size and is broadcast. A hot key gets as many
    sub-keys as it holds such shares, so the rows of one sub-key stay at about
    ``hot_fraction`` of all, however hot the key is; its rows are spread by a
    hash of the row and the matching ``small`` row is replicated once per
    sub-key. Cold keys join as usual.
    """
    total = big.count()
    limit = max(1, int(total * hot_fraction))
    hot = (
        big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts"))
    )
    hash_of_row = F.xxhash64(*[F.col(c) for c in big.columns])
    b = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(hash_of_row, F.col("_salts")).cast("int")).otherwise(F.lit(0))
    ).drop("_salts")
    s = small.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return b.join(s, keys + ["_salt"], how).drop("_salt")
