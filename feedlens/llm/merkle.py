"""Merkle manifest of a dataset, with every level of a block kept as one hex string.

Rows are leaves. Within a group (a source) they are numbered in order and cut into
aligned blocks of ``fan ** BLOCK_LEVELS`` leaves. A block keeps each of its levels as one
string of concatenated 64-character digests: a parent is the hash of a fixed-width
substring of the level below, and the siblings of a node are the two substrings that
flank it within its run. Block roots are the nodes of the next tier, in blocks of their
own, until a group has one node, its subroot. The subroots are the nodes of one last
tree. Proofs go the other way: a tier hands each of its nodes the siblings above it,
so every join is of one row to one row and no source lands in one task.

A run of ``fan`` consecutive nodes (the last run of a level may be shorter, even one node)
becomes the hash of its digests, while a group has more than one node.

Defined results: a null field hashes as ``-``; a null group is a group of its own and the
first; rows of equal key ascend by leaf, and repeated rows are leaves of their own; a null key
comes first; an empty table has no rows and no root; texts are hashed whole; columns that
are not named as fields or carried are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FAN = 3
#: Levels inside a block: 3 ** 5 leaves are a string of 15,552 characters.
BLOCK_LEVELS = 5
WIDTH = 64
#: A table of group offsets is broadcast only below this many bytes (counted).
BROADCAST_BYTES = 16 << 20

PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value; null as ``-``."""
    parts = []
    for f in fields:
        v = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A non-null text that sorts like the group: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` plus ``rank``, its gapless place in its group ``g`` from 0, and ``n``, the group's size.

    A range shuffle sorts all groups at once; places come from the place within a partition and
    the counts of the partitions before, so no window runs over a group's rows.
    """
    keys = ["g", *order]
    # the row number tells equal rows apart, so that copies of one row spread over partitions too
    base = staged(nodes.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    dealt = base.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    # one row per group and partition that has rows of it: partitions + groups at most
    whole, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(
        runs.select("g", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")),
        "offsets",
    )
    n_bytes = runs.agg(F.sum(F.octet_length("g") + F.lit(64))).first()[0] or 0
    side = F.broadcast(runs) if n_bytes <= BROADCAST_BYTES else runs
    return placed.join(side, ["g", "_part"]).select(*nodes.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def parents(level: Column, fan: int) -> Column:
    """The next level: each fixed-width run of digests hashed, in order, as one string again."""
    run = WIDTH * fan
    runs = F.ceil(F.length(level) / F.lit(run)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substr(level, i * run + 1, F.lit(run)), 256))
    return F.array_join(hashed, "")


def blocks_of(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """One row per block of a tier: its level strings ``l0 ..``, its depth, root and the nodes' payloads.

    ``nodes``: g, rank, n, digest, payload. A block of a larger group is hashed through all its levels, that of a
    group of one block until one node is left.
    """
    span = fan**levels
    kids = F.array_sort(F.collect_list(F.struct("rank", "digest", "payload")))
    b = nodes.groupBy("g", F.floor(F.col("rank") / F.lit(span)).alias("block")).agg(kids.alias("kids"), F.first("n").alias("n"))
    depth = F.lit(levels)
    for k in reversed(range(levels)):
        depth = F.when(F.col("n") <= fan**k, F.lit(k)).otherwise(depth)
    b = b.select(
        "g", "block", "n", depth.alias("depth"),
        F.transform("kids", lambda x: x["payload"]).alias("payloads"),
        F.array_join(F.transform("kids", lambda x: x["digest"]), "").alias("l0"),
    )
    for k in range(levels):
        b = b.withColumn(f"l{k + 1}", F.when(F.col("depth") > k, parents(F.col(f"l{k}"), fan)))
    return b.withColumn("root", F.coalesce(*[F.col(f"l{k}") for k in reversed(range(levels + 1))]))


def siblings(i: Column, fan: int, levels: int) -> Column:
    """The flanking substrings of node ``i``'s ancestors, one pair per level of its block."""
    pairs = []
    for k in range(levels):
        j = F.floor(i / F.lit(fan**k)).cast("int")
        r = j % F.lit(fan)
        left = F.substr(F.col(f"l{k}"), (j - r) * WIDTH + 1, r * WIDTH)
        right = F.substr(F.col(f"l{k}"), (j + 1) * WIDTH + 1, (F.lit(fan - 1) - r) * WIDTH)
        pairs.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*pairs), F.lit(1), F.col("depth"))


def expand(blocks: DataFrame, above: DataFrame, fan: int, levels: int, keep: list[str]) -> DataFrame:
    """Every node of the tier with all siblings up to the root: g, rank, digest, payload, path and ``keep`` of above."""
    joined = blocks.join(above.withColumnRenamed("rank", "block"), ["g", "block"])

    def node(i: Column) -> Column:
        return F.struct(
            (F.col("block") * F.lit(fan**levels) + i).alias("rank"),
            F.substr(F.col("l0"), i * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
            F.get("payloads", i).alias("payload"),
            F.concat(siblings(i, fan, levels), F.col("path")).alias("path"),
        )

    nodes = F.transform(F.sequence(F.lit(0), F.size("payloads") - 1), node)
    return joined.select("g", *keep, F.explode(nodes).alias("x")).select("g", *keep, "x.*")


def tiers(nodes: DataFrame, fan: int, levels: int, name: str) -> list[DataFrame]:
    """Block tables from the nodes up, the last with one block per group."""
    out = []
    while True:
        out.append(staged(blocks_of(nodes, fan, levels), name))
        done = out[-1]
        nodes = done.select(
            "g", F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(fan**levels)).alias("n"),
            F.col("root").alias("digest"), F.struct("block").alias("payload"),
        )
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return out


def manifest(rows: DataFrame, group: str, order: str, leaf: str, carry: list[str], fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per leaf: the carried columns, ``leaf``, ``subroot``, ``root`` and ``path``.

    ``path`` holds the (left, right) siblings of every level from the leaf to the root, as concatenated
    digests; ``fold`` and ``proof_digest`` take it. ``rows`` need the columns named and no others.
    """
    nodes = rows.select(
        group_key(F.col(group)).alias("g"), F.col(order).alias("o"), F.col(leaf).alias("digest"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("_")).alias("payload"),
    )
    low = tiers(ranked(nodes, ["o", "digest"]).drop("o"), fan, levels, "blocks")
    subroots = low[-1].select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("root").alias("digest"), F.struct(F.col("g").alias("of")).alias("payload"))
    high = tiers(ranked(subroots, ["o"]).drop("o"), fan, levels, "tops")

    above = high[-1].select("g", "block", F.col("root").alias("top")).select("g", F.col("block").alias("rank"), "top", F.array().cast(PATH).alias("path"))
    for t in reversed(high):
        above = expand(t, above.select("g", "rank", "top", "path"), fan, levels, ["top"])
    above = above.select(F.col("payload.of").alias("g"), F.lit(0).cast("bigint").alias("rank"), "top", F.col("digest").alias("sub"), "path")
    for t in reversed(low):
        above = expand(t, above.select("g", "rank", "top", "sub", "path"), fan, levels, ["top", "sub"])
    return above.select(
        *[F.col(f"payload.c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("digest").alias("leaf"), F.col("sub").alias("subroot"), F.col("top").alias("root"), "path",
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
