"""Exact and fuzzy de-duplication with source attribution (A1–A4, O2).

Attribution is kept in *long form*: one row per absorbed copy,
``(fp, stage, ord, source_name)``, where ``fp`` identifies the surviving
item, ``stage`` 0/1 = exact/fuzzy and ``ord`` orders the names inside a
stage. The reference's ordered ``duplicate_sources`` list is exactly these
rows sorted by (stage, ord). Long form keeps a group of millions of copies
spread over many tasks; lists are only assembled for the rows a report
shows (see ``report.first_sources``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

from .. import constants as C
from ..functions import text as T
from .graph import greedy_leaders
from .report import order_index, skew_safe_join
from .similarity import similar_title_pairs

ITEM_COLS = [
    "seq", "title", "url", "source_name", "source_category", "source_tier",
    "published", "description", "cvss_score", "cve_ids", "hn_points",
]


def with_fingerprint(items: DataFrame) -> DataFrame:
    return items.withColumn("fp", T.fingerprint("title", "url"))


def exact_dedup(items: DataFrame) -> DataFrame:
    """A1: one row per fingerprint.

    Winner = lowest tier, then earliest arrival; ``pos`` = the group's first
    arrival (its place for later tie-breaks); ``n_copies`` = group size.
    All three are partial aggregates, so a hot fingerprint is combined
    map-side and never gathered in one task.
    """
    x = with_fingerprint(items)
    cols = [c for c in x.columns if c != "fp"]
    agg = x.groupBy("fp").agg(
        F.min_by(F.struct(*cols), F.struct("source_tier", "seq")).alias("w"),
        F.min("seq").alias("pos"),
        F.count(F.lit(1)).alias("n_copies"),
    )
    return agg.select("fp", "w.*", "pos", "n_copies")


def exact_attribution(items: DataFrame) -> DataFrame:
    """A2: names of the absorbed copies and when each stopped being canonical.

    The sequential rule appends a newcomer at its arrival, or — when the
    newcomer has a strictly better tier — the displaced canonical at the
    newcomer's arrival. A row was ever canonical iff it is the first row of
    its tier and every lower tier first appears later; it is displaced by
    the first later row of a lower tier. Both facts come from the small
    table of first arrival per (fp, tier), so no window runs over a group.

    Returns (fp, seq, ord, source_name): ``ord`` is the time the row's name
    was appended; the winner has no row.
    """
    x = with_fingerprint(items).select("fp", "seq", "source_tier", "source_name")
    first = x.groupBy("fp", "source_tier").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy("fp").orderBy("source_tier").rowsBetween(Window.unboundedPreceding, -1)
    chain = (
        first.withColumn("lower_first", F.min("first_seq").over(w))
        .where(F.col("lower_first").isNull() | (F.col("first_seq") < F.col("lower_first")))
        .select("fp", F.col("first_seq").alias("seq"), F.col("lower_first").alias("displaced_at"), F.lit(True).alias("was_canonical"))
    )
    return (
        x.join(chain, ["fp", "seq"], "left")
        .where(~(F.coalesce(F.col("was_canonical"), F.lit(False)) & F.col("displaced_at").isNull()))
        .select("fp", "seq", F.coalesce("displaced_at", "seq").alias("ord"), "source_name")
    )


def scan_rank_cols(df: DataFrame) -> DataFrame:
    """O2: fuzzy scan order = (tier asc, published desc, pos asc)."""
    return df.withColumn("r_tier", F.col("source_tier")).withColumn(
        "r_neg_pub", -F.unix_micros("published")
    ).withColumn("r_pos", F.col("pos"))


RANK_COLS = ["r_tier", "r_neg_pub", "r_pos"]


#: (titles (tid, nt), threshold) -> similar pairs (a, b)
PairFinder = Callable[[DataFrame, float], DataFrame]


#: Titles of which all pairs are looked for at once; later ones are compared with the leaders of those before them first.
FIRST_BLOCK = 1 << 15


def title_leaders(titles: DataFrame, threshold: float, pairs_of: PairFinder = similar_title_pairs) -> DataFrame:
    """(id, is_leader, leader) of every title: the greedy leader pass over similar titles. ``titles``: tid, nt and ranks.

    A larger table is scanned in blocks of the scan's order. A block's titles meet the leaders found so far
    (J1 between old and new titles); one near a leader joins the first of them, and only titles near
    none are compared with one another. Pairs of two absorbed titles, of which there
    may be far more than titles, are neither looked for nor written.
    """
    # a finder of one's own keeps all pairs
    if pairs_of is not similar_title_pairs or titles.count() <= FIRST_BLOCK:
        pairs = pairs_of(titles.select("tid", "nt"), threshold)
        return greedy_leaders(titles.select(F.col("tid").alias("id"), *RANK_COLS), pairs, RANK_COLS)
    ranked = cut_lineage(order_index(titles.select("tid", "nt", *RANK_COLS), [F.asc(c) for c in [*RANK_COLS, "tid"]], "k").select("k", "tid", "nt"))
    n, end = ranked.count(), 0
    leaders, assigned = None, []
    while end < n:
        start, end = end, min(n, max(FIRST_BLOCK, 2 * end))
        block = ranked.where(F.col("k").between(start + 1, end)).select("k", "nt")
        if leaders is not None:
            met = leaders.withColumn("new", F.lit(False)).unionByName(block.withColumn("new", F.lit(True)))
            near = similar_title_pairs(met, threshold, "k", "nt", new_col="new", across=True)
            # every leader comes before the block, so a is the leader
            joined = cut_lineage(near.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("lead_k")))
            assigned.append(joined)
            block = cut_lineage(block.join(joined, "k", "left_anti"))
        found = greedy_leaders(block.select(F.col("k").alias("id"), F.col("k").alias("r")), similar_title_pairs(block, threshold, "k", "nt"), ["r"])
        found = cut_lineage(found.select(F.col("id").alias("k"), F.col("leader").alias("lead_k")))
        assigned.append(found)
        if end < n:
            led = block.join(found.where(F.col("k") == F.col("lead_k")), "k", "left_semi")
            leaders = cut_lineage(led if leaders is None else leaders.unionByName(led))
    every = reduce(DataFrame.unionByName, assigned)
    named = every.join(ranked.select("k", F.col("tid").alias("id")), "k").join(
        ranked.select(F.col("k").alias("lead_k"), F.col("tid").alias("leader")), "lead_k"
    )
    return named.select("id", (F.col("id") == F.col("leader")).alias("is_leader"), "leader")


def fuzzy_groups(canon: DataFrame, threshold: float = C.DEFAULT_SIMILARITY_THRESHOLD, pairs_of: PairFinder = similar_title_pairs) -> DataFrame:
    """A3: greedy leader assignment over exact-dedup survivors.

    Items are compared through their normalised titles. Identical titles
    are always similar, so the scan's outcome is decided per distinct
    title: the title's first item (scan order) stands for it, the title
    graph (J1 pairs) gets the greedy leader pass, and every other item
    follows the first item of its title's leader. A title is known by the
    hash of its text, so items of several sources may share ``seq`` values.

    Returns canon's columns plus ``nt``, ranks, ``leader_fp`` and
    ``is_leader``.
    """
    c = scan_rank_cols(canon).withColumn("nt", T.normalize_title("title"))
    first = F.min(F.struct(*[F.col(k) for k in RANK_COLS], F.col("fp")))
    titles = c.groupBy("nt").agg(first.alias("f")).select(
        "nt", F.xxhash64("nt").alias("tid"), *[F.col(f"f.{k}").alias(k) for k in RANK_COLS], F.col("f.fp").alias("first_fp")
    )
    titles = cut_lineage(titles)
    lead = title_leaders(titles, threshold, pairs_of)
    # leader title -> its first item's fingerprint
    title_lead = (
        titles.join(lead, titles["tid"] == lead["id"])
        .select("nt", "tid", "first_fp", F.col("leader").alias("leader_tid"), F.col("is_leader").alias("title_leads"))
    )
    lead_fp = titles.select(F.col("tid").alias("leader_tid"), F.col("first_fp").alias("leader_fp"))
    title_map = title_lead.join(lead_fp, "leader_tid").select("nt", "first_fp", "leader_fp")
    return c.join(title_map, "nt").withColumn("is_leader", F.col("fp") == F.col("leader_fp")).drop("first_fp")


def deduplicate(
    items: DataFrame, threshold: float = C.DEFAULT_SIMILARITY_THRESHOLD, pairs_of: PairFinder = similar_title_pairs
) -> tuple[DataFrame, DataFrame]:
    """A1–A4. Returns (survivors, attribution).

    survivors: one row per fuzzy leader, with ``fp``, ``pos``, scan ranks
    and ``n_dup`` (length of its duplicate-source list).
    attribution: (fp, stage, ord, source_name) for every survivor.
    """
    canon = cut_lineage(exact_dedup(items))
    grouped = cut_lineage(fuzzy_groups(canon, threshold, pairs_of))
    survivors = grouped.where("is_leader").drop("is_leader", "leader_fp")
    # a fingerprint can hold a large share of all copies: keep the rows of
    # surviving fingerprints with a join that splits hot keys
    exact = skew_safe_join(
        cut_lineage(exact_attribution(items)), survivors.select("fp").withColumn("_keep", F.lit(True)), ["fp"]
    ).select(
        "fp", F.lit(0).alias("stage"), F.struct(F.col("ord").alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3")).alias("ord"), "source_name"
    )
    fuzzy = grouped.where(~F.col("is_leader")).select(
        F.col("leader_fp").alias("fp"),
        F.lit(1).alias("stage"),
        F.struct(F.col("r_tier").cast("long").alias("o1"), F.col("r_neg_pub").alias("o2"), F.col("r_pos").alias("o3")).alias("ord"),
        "source_name",
    )
    attribution = exact.unionByName(fuzzy)
    counts = attribution.groupBy("fp").agg(F.count(F.lit(1)).alias("n_dup"))
    survivors = survivors.join(counts, "fp", "left").withColumn("n_dup", F.coalesce("n_dup", F.lit(0)))
    return survivors, attribution
