"""A1/A2 as a stream: the best-tier copy of every fingerprint, kept up to date (ST1 with the tier rule).

Keyed state (``transformWithState``) holds, per fingerprint, the canonical item's tier, arrival number and source.
A newcomer of a strictly better tier replaces it; the displaced name is recorded at the newcomer's arrival. Any
other newcomer is recorded at its own arrival. These are the rows of ``exact_dedup`` and ``exact_attribution``, for
batches that arrive in order of ``seq``.

The output is a log of events, so every batch only appends:

* ``winner``: an item that became canonical (the last one of a fingerprint has its lowest tier),
* ``copy``: a recorded name, with ``seq`` of its item and ``ord``, the arrival that recorded it.

A timer per fingerprint, moved on by every arrival, drops its state when the watermark passes ``horizon`` after the
latest copy, so state is bounded by the look-back window; a copy that comes later starts a story of its own.
One fingerprint's arrivals of one micro-batch are ordered in its task as small tuples beside the rows;
``maxFilesPerTrigger`` bounds a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "tier int, seq bigint, name string, latest bigint"


class Winners(StatefulProcessor):
    """Canonical item of one fingerprint; ``columns`` are those of an item."""

    def __init__(self, columns: list[str], horizon_ms: int):
        self.columns, self.horizon_ms = columns, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("canonical", STATE)

    def event(self, fp: str, kind: str, seq: int, ord_: int, name: str, item: Row | None) -> Row:
        rest = [None if item is None else item[c] for c in self.columns]
        return Row("fp", "kind", "e_seq", "ord", "name", *self.columns)(fp, kind, seq, ord_, name, *rest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fp = key[0]
        held = self.state.get()
        was = None if held is None else held[3]
        now = None if held is None else (held[0], held[1], held[2])
        latest = was
        for r in sorted(rows, key=lambda r: r["seq"]):
            at = int(r["published_ms"])
            latest = at if latest is None else max(latest, at)
            if now is None or r["source_tier"] < now[0]:
                if now is not None:
                    yield self.event(fp, "copy", now[1], r["seq"], now[2], None)
                yield self.event(fp, "winner", r["seq"], r["seq"], r["source_name"], r)
                now = (r["source_tier"], r["seq"], r["source_name"])
            else:
                yield self.event(fp, "copy", r["seq"], r["seq"], r["source_name"], None)
        self.state.update((*now, latest))
        if latest != was:
            if was is not None:
                self.handle.deleteTimer(was + self.horizon_ms)
            self.handle.registerTimer(latest + self.horizon_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle

    pkg = sys.modules[__package__.split(".")[0]]
    if pkg.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
        cloudpickle.register_pickle_by_value(pkg)


def winner_events(items: DataFrame, horizon_hours: int = 720) -> DataFrame:
    """The event log of a stream of items (streaming or not): fp, kind, e_seq, ord, name and an item's columns."""
    _ship_by_value()
    columns = items.columns
    out = T.StructType(
        [T.StructField("fp", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("e_seq", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("name", T.StringType())]
        + [T.StructField(f.name, f.dataType) for f in items.schema.fields]
    )
    keyed = (
        items.withColumn("fp", X.fingerprint("title", "url"))
        .withColumn("published_ms", F.unix_millis("published"))
        .withWatermark("published", f"{horizon_hours} hours")
    )
    return keyed.groupBy("fp").transformWithState(
        statefulProcessor=Winners(columns, horizon_hours * 3_600_000), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def run_winners(spark: SparkSession, landing: str, schema, log: str, checkpoint: str, horizon_hours: int = 720) -> None:
    """Process what has landed since the last run, append its events to ``log``, and stop."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # the state store that keyed state with timers needs
    try:
        src = spark.readStream.schema(schema).parquet(landing).withColumn("published", F.col("published").cast("timestamp"))
        q = (
            winner_events(src, horizon_hours)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .option("path", log)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def current_winners(events: DataFrame) -> DataFrame:
    """A1 from the log: the canonical item of every fingerprint, ``pos`` (its first arrival) and ``n_copies``."""
    item = [c for c in events.columns if c not in ("fp", "kind", "e_seq", "ord", "name")]
    is_winner = F.col("kind") == "winner"
    agg = events.groupBy("fp").agg(
        F.min_by(F.when(is_winner, F.struct(*item)), F.when(is_winner, F.col("source_tier"))).alias("w"),
        F.min(F.when(is_winner, F.col("e_seq"))).alias("pos"),
        (F.count(F.when(~is_winner, F.lit(1))) + 1).alias("n_copies"),
    )
    return agg.select("fp", "w.*", "pos", "n_copies")


def recorded_copies(events: DataFrame) -> DataFrame:
    """A2 from the log: (fp, seq, ord, source_name) of every recorded name."""
    return events.where("kind = 'copy'").select("fp", F.col("e_seq").alias("seq"), "ord", F.col("name").alias("source_name"))


def stream_in_parts(items: DataFrame, base: str, parts: int = 3, horizon_hours: int = 1440) -> DataFrame:
    """Land ``items`` in ``parts`` ranges of arrival, run the stream after each as a scheduler would; the log."""
    spark = items.sparkSession
    items = cut_lineage(items)  # every part reads them: they are derived once
    low, high = items.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // parts + 1 if high is not None else 1
    for k in range(parts):
        part = items if high is None else items.where((F.col("seq") >= low + k * width) & (F.col("seq") < low + (k + 1) * width))
        part.write.mode("append").parquet(f"{base}/landing")
        run_winners(spark, f"{base}/landing", items.schema, f"{base}/log", f"{base}/state", horizon_hours)
    return spark.read.parquet(f"{base}/log")
