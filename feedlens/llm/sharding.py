"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the doc_id, hash of the row's place), so
equal texts stand together. The exact bytes and rows below candidate boundaries are
counted over all partitions; the first round counts 4096 equal key ranges, later rounds
only cut the ranges that still hold a splitter outside its tolerance, or more rows
than one task should sort. Once all splitters meet the tolerance, rows are exchanged
once, by key range; a row's slot is its place in the range plus the counted rows
of the shard's earlier ranges, so no task ever sees a whole shard.

Law ``bytes``: every shard gets nearly the same bytes. Copies of one text stay
in one shard unless that would move a boundary by more than ``copy_tolerance`` of a
shard; then the copies are cut, too.

Defined results: a null text has size 1 and checksum 0; repeated rows each get a slot; null
ids sort as any other; an empty table gives no rows. Of carried columns, those that are
named like a result column are replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS = 8
#: Share of a shard's bytes by which a boundary may miss its place.
TOLERANCE = 0.0005
COPY_TOLERANCE = 0.01
#: Rows that one task sorts at most: this, or a 512th of all.
RANGE_ROWS = 4096

#: Digits of the key, from the first: (key column, bits to the right, width).
DIGITS = (
    [("k1", 52, 12)] + [("k1", s, 8) for s in (44, 36, 28, 20, 12, 4)] + [("k1", 0, 4)]
    + [(k, s, 8) for k in ("k2", "k3") for s in (56, 48, 40, 32, 24, 16, 8, 0)]
)
TEXT_DIGITS = 8


def digit(level: int) -> Column:
    key, right, width = DIGITS[level]
    return F.shiftrightunsigned(F.col(key), right).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias(f"d{level}")


def histogram(rows: DataFrame, level: int, within: list[tuple] | None) -> dict[tuple, tuple[int, int]]:
    """Exact (rows, bytes) of every key range of ``level`` inside the given ranges of the level before."""
    keys = [f"d{i}" for i in range(level + 1)]
    part = rows.select(*[digit(i) for i in range(level + 1)], "size")
    if within is not None:
        ddl = ", ".join(f"d{i} int" for i in range(level))
        part = part.join(F.broadcast(rows.sparkSession.createDataFrame(within, ddl)), keys[:-1])
    got = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    return {tuple(r[: level + 1]): (r["n"], r["bytes"]) for r in got}


def plan_ranges(rows: DataFrame, shards: int, tolerance: float, copy_tolerance: float, range_rows: int) -> list[tuple[tuple, int, int]]:
    """Key ranges in order, each with its shard and the rows of that shard before it."""
    leaves = histogram(rows, 0, None)
    total_rows, total = sum(n for n, _ in leaves.values()), sum(b for _, b in leaves.values())
    if not total_rows:
        return []
    most_rows = max(range_rows, total_rows // 512)
    targets = [total * j // shards for j in range(1, shards)]
    level = 0
    while True:
        order = sorted(leaves)
        edges = [0]
        for p in order:
            edges.append(edges[-1] + leaves[p][1])
        allowed = (tolerance if level + 1 < TEXT_DIGITS else copy_tolerance) * total / shards
        cut = {p for p in order if len(p) == level + 1 and leaves[p][0] > most_rows}
        for t in targets:
            i = bisect_left(edges, t)  # edges[i - 1] < t <= edges[i]
            p = order[i - 1]
            if len(p) == level + 1 and leaves[p][0] > 1 and min(edges[i] - t, t - edges[i - 1]) > allowed:
                cut.add(p)
        if not cut or level + 1 == len(DIGITS):
            break
        level += 1
        finer = histogram(rows, level, sorted(cut))
        for p in cut:
            del leaves[p]
        leaves.update(finer)
    # a splitter is the counted boundary next to its target
    splits = []
    for t in targets:
        i = bisect_left(edges, t)
        splits.append(i if edges[i] - t <= t - edges[i - 1] else i - 1)
    out, shard, before = [], 0, 0
    for i, p in enumerate(order):
        now = sum(s <= i for s in splits)
        if now != shard:
            shard, before = now, 0
        out.append((p, shard, before))
        before += leaves[p][0]
    return out


def shard_rows(
    docs: DataFrame, carry: list[str] | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE,
    copy_tolerance: float = COPY_TOLERANCE, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``carry`` columns (default: all) plus size, text_crc32, law, shard, slot, grown_shard."""
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = staged(
        docs.select(
            F.struct(*carry).alias("row"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64("doc_id").alias("k2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
        ),
        "keys",
    )
    ranges = plan_ranges(rows, shards, tolerance, copy_tolerance, range_rows)
    spark = docs.sparkSession
    depth = max((len(p) for p, _, _ in ranges), default=1)
    keyed = rows.select("*", *[digit(i) for i in range(depth)])
    # where a row belongs: one lookup per level of detail that was needed, in tables of bounded size
    for d in range(1, depth + 1):
        mine = [(*p, k, shard, before) for k, (p, shard, before) in enumerate(ranges) if len(p) == d]
        ddl = ", ".join([f"d{i} int" for i in range(d)] + [f"range{d} int, shard{d} int, before{d} bigint"])
        keyed = keyed.join(F.broadcast(spark.createDataFrame(mine, ddl)), [f"d{i}" for i in range(d)], "left")
    pick = lambda name: F.coalesce(*[F.col(f"{name}{d}") for d in range(1, depth + 1)])
    placed = keyed.select("row", "size", "text_crc32", "k1", "k2", "k3", pick("range").alias("range"), pick("shard").alias("shard"), pick("before").alias("before"))
    w = Window.partitionBy("range").orderBy("k1", "k2", "k3")
    return placed.select(
        "row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.row_number().over(w) - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
