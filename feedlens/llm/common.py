"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def ship_by_value() -> None:
    """Pickle the package's task code by value, so executors need no installed copy."""
    import sys

    from pyspark import cloudpickle

    pkg = sys.modules[__package__.split(".")[0]]
    if pkg.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
        cloudpickle.register_pickle_by_value(pkg)


#: Rows and bytes that a Python worker gets at a time: whole texts are long, so fewer than Spark's default.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers small and alike for short and for very long texts.

    The two settings stay in the session: jobs run after this call returns, so they can't be set back here.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that every executor and the driver see."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage like a checkpoint, but keeps column pruning and sizes; a lost
    executor costs only the tasks it was running.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text (fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(mod)


def text_list(batch: pa.RecordBatch, col: str) -> list[str]:
    """A batch's texts, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def score_rows(df: DataFrame, text_col: str, make_scorer: Callable, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Every column of ``df`` but the text, plus what the scorer returns per text.

    ``make_scorer()`` runs once per task and returns ``list[str] -> dict of arrays``.
    ``schema`` is the DDL of the added fields.
    """
    ship_by_value()
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for b in batches:
            got = score(text_list(b, text_col))
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(got[n], type=t) for n, t in fields.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *fields])

    return df.mapInArrow(run, ddl)


def keep_rows(df: DataFrame, text_col: str, make_keeper: Callable) -> DataFrame:
    """The rows of ``df`` whose text the keeper accepts, all columns unchanged.

    The decision is taken next to the row, so no join brings texts back and no
    helper column can clash with a column of ``df``.
    """
    ship_by_value()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = make_keeper()
        for b in batches:
            mask = np.asarray(keeper(text_list(b, text_col)), dtype=bool)
            yield b.filter(pa.array(mask))

    return df.mapInArrow(run, df.schema)


def smallest_hashes(df: DataFrame, cap: int, *keys: str) -> DataFrame:
    """``cap`` rows (all, if fewer) with the smallest hashes of ``keys``, in that order.

    Rows far above the hash that ``cap`` rows are expected to stay under are left out before the sort, so what
    reaches the one task that cuts the sample is bounded by ``cap``, not by the table.
    """
    n, by = df.count(), F.xxhash64(*keys)
    share = (cap + 8 * cap**0.5 + 16) / max(n, 1)
    if share < 1:
        df = df.where(by <= F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(by, *keys).limit(cap)


def bounded_label_sample(labels: DataFrame, label: str, fold: Column, cap: int) -> DataFrame:
    """At most ``cap`` learnable rows of each class of a 0/1 label, chosen by id hash.

    (doc_id, y). Contradicting labels of one id count as the larger. The result
    has at most 2 * cap rows, so it may be broadcast.
    """
    one = (
        labels.where(fold & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    pick = [smallest_hashes(one.where(F.col("y") == v), cap, "doc_id") for v in (0, 1)]
    return pick[0].unionByName(pick[1])


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text) of a bounded, broadcast id list; repeated rows of an id count once."""
    hit = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return hit.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
