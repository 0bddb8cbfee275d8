"""Graph operators on edge DataFrames.

Graphs and components up to a documented number of edges are solved in one grouped task each; only
what is larger goes through rounds of joins and partial aggregates. Each round is written to the
session's checkpoint folder, so lineage stays short and a lost executor only costs the current round.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .report import order_index, skew_safe_join

log = logging.getLogger(__name__)

# Broadcast per-node tables below this many rows (checked by a count).
BROADCAST_MAX_ROWS = 2_000_000
#: Edges that one task solves by itself (two longs each: 32 MB).
LOCAL_EDGES = 2_000_000
#: Rounds after which the undecided rest of a larger graph is cut into components.
ROUNDS = 8


def _ship_by_value() -> None:
    """Pickle this module's task code by value, so executors need no installed copy of the package."""
    import sys

    from pyspark import cloudpickle

    mod = sys.modules[__name__]
    if mod.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
        cloudpickle.register_pickle_by_value(mod)


def _side(n_rows: int):
    return (lambda df: F.broadcast(df)) if n_rows <= BROADCAST_MAX_ROWS else (lambda df: df)

UNDECIDED, LEADER, ABSORBED = 0, 1, 2


def scan_leaders(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(absorbed node, its leader): the sequential scan over nodes in ascending order; edges have u < v.

    A node with a leader among its earlier neighbours joins the first of them; any other is a leader.
    """
    order = np.lexsort((u, v))
    u, v = u[order], v[order]
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    pu, pv = place[: len(u)], place[len(u) :]
    leads = np.ones(len(nodes), bool)
    first = np.flatnonzero(np.diff(pv, prepend=-1))
    out_v, out_u = [], []
    for s, e in zip(first.tolist(), np.append(first[1:], len(pv)).tolist()):
        near = leads[pu[s:e]]
        if near.any():
            leads[pv[s]] = False
            out_v.append(v[s])
            out_u.append(u[s + int(near.argmax())])
    return np.array(out_v, np.int64), np.array(out_u, np.int64)


def local_leaders(edges: DataFrame, bucket) -> DataFrame:
    """(v, leader) of the absorbed nodes, every bucket of whole components scanned in one task. ``edges``: u, v."""
    _ship_by_value()

    def run(group: pa.Table) -> pa.Table:
        v, leader = scan_leaders(group["u"].to_numpy(), group["v"].to_numpy())
        return pa.table({"v": pa.array(v, pa.int64()), "leader": pa.array(leader, pa.int64())})

    return edges.select("u", "v", bucket.alias("_b")).groupBy("_b").applyInArrow(run, "v bigint, leader bigint")


def leaders_by_rounds(edges: DataFrame, local_edges: int = LOCAL_EDGES, most_rounds: int = ROUNDS) -> DataFrame:
    """(v, leader) of the absorbed nodes, for graphs of any size. ``edges``: u, v with u < v.

    An undecided node whose earlier neighbours are all absorbed becomes a leader; one with an earlier
    leader is absorbed. Each round decides at least the lowest undecided node of every component, and where a title has
    many neighbours most edges end at a decided node soon. The edges that still matter are scanned
    once ``local_edges`` or fewer are left, or by components after ``most_rounds`` rounds.
    """
    touched = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    status = cut_lineage(touched.withColumn("st", F.lit(UNDECIDED)))
    # the status table has one row per touched node; when a count proves it
    # small it is broadcast, so the edge table is never shuffled for lookups
    side = _side(status.count())
    active = edges.select("u", "v")
    rounds = 0
    while True:
        rounds += 1
        st_u = status.select(F.col("id").alias("u"), F.col("st").alias("ust"))
        votes = (
            active.join(side(st_u), "u")
            .groupBy("v")
            .agg(
                F.max((F.col("ust") == LEADER).cast("int")).alias("has_leader"),
                F.max((F.col("ust") == UNDECIDED).cast("int")).alias("has_undecided"),
            )
        )
        status = cut_lineage(
            status.join(side(votes), status["id"] == votes["v"], "left")
            .select(
                "id",
                F.when(F.col("st") != UNDECIDED, F.col("st"))
                .when(F.col("has_leader") == 1, F.lit(ABSORBED))
                .when(F.col("has_undecided") == 1, F.lit(UNDECIDED))
                .otherwise(F.lit(LEADER))
                .alias("st"),
            )
        )
        if status.where(F.col("st") == UNDECIDED).limit(1).count() == 0:
            break
        # keep only edges that can still matter: into undecided nodes, from
        # nodes that are not absorbed
        active = cut_lineage(
            active.join(side(status.where(F.col("st") != ABSORBED).select(F.col("id").alias("u"))), "u")
            .join(side(status.where(F.col("st") == UNDECIDED).select(F.col("id").alias("v"))), "v")
            .select("u", "v")
        )
        left = active.count()
        if left <= local_edges:
            rest = local_leaders(active, F.lit(0))
        elif rounds >= most_rounds:
            rest = leaders_by_components(active, left, local_edges)
        else:
            continue
        # of the undecided nodes those without a leader among their neighbours lead
        found = cut_lineage(rest.select(F.col("v").alias("id")))
        status = cut_lineage(
            status.join(side(found.withColumn("_absorbed", F.lit(True))), "id", "left").select(
                "id", F.when(F.col("st") != UNDECIDED, F.col("st")).when(F.col("_absorbed"), F.lit(ABSORBED)).otherwise(F.lit(LEADER)).alias("st")
            )
        )
        break
    log.info("leaders_by_rounds: %d rounds", rounds)
    leaders = status.where(F.col("st") == LEADER).select(F.col("id").alias("u"))
    absorbed = status.where(F.col("st") == ABSORBED).select(F.col("id").alias("v"))
    return edges.join(side(leaders), "u").join(side(absorbed), "v").groupBy("v").agg(F.min("u").alias("leader"))


def leaders_by_components(edges: DataFrame, n_edges: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, leader) of the absorbed nodes: buckets of whole components are scanned in one task each, larger components go through rounds."""
    comp = star_components(edges, "u", "v", local_edges)
    of_edge = cut_lineage(skew_safe_join(edges, comp.select(F.col("node").alias("u"), "comp"), ["u"]))
    giant = of_edge.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_edges)
    giant = F.broadcast(giant.select("comp"))  # n_edges / local_edges rows at most
    small = of_edge.join(giant, "comp", "left_anti")
    # so many buckets that one takes a quarter of a task's edges on average, or one larger component
    assign = local_leaders(small, F.pmod(F.xxhash64("comp"), F.lit(4 * (n_edges // local_edges + 1))))
    large = cut_lineage(of_edge.join(giant, "comp", "left_semi").select("u", "v"))
    if not large.isEmpty():
        assign = assign.unionByName(leaders_by_rounds(large, local_edges, 1 << 30))
    return assign


def greedy_leaders(nodes: DataFrame, edges: DataFrame, rank_cols: list[str], id_col: str = "id", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Lexicographically-first maximal independent set (greedy leader pass).

    Scanning nodes in rank order, a node becomes a leader unless an earlier
    leader is adjacent; otherwise it joins the *first* (lowest-rank) adjacent
    leader. Graphs of up to ``local_edges`` edges are scanned in one task. Larger ones lose their decided nodes
    in rounds until so few edges are left, or go on in one task for each bucket of whole components.

    ``nodes``: one row per node with ``id_col`` and ``rank_cols`` (unique
    order together with the id). ``edges``: (a, b) undirected, a != b.
    Returns (id, is_leader, leader) for every node.
    """
    checkpoint_dir(nodes.sparkSession)
    e = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")))
    nr = nodes.select(F.col(id_col).alias("id"), *rank_cols)
    # only nodes that have a neighbour take part; their place in the scan is their name from here on
    touched = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    order = [F.asc(c) for c in [*rank_cols, "id"]]
    ranked = cut_lineage(order_index(nr.join(touched, "id", "left_semi"), order, "k").select("id", "k"))
    side = _side(ranked.count())
    directed = cut_lineage(
        e.join(side(ranked.select(F.col("id").alias("a"), F.col("k").alias("ka"))), "a")
        .join(side(ranked.select(F.col("id").alias("b"), F.col("k").alias("kb"))), "b")
        .select(F.least("ka", "kb").alias("u"), F.greatest("ka", "kb").alias("v"))
        .distinct()
    )
    n_edges = directed.count()
    if n_edges <= local_edges:
        assign = local_leaders(directed, F.lit(0))
    else:
        assign = leaders_by_rounds(directed, local_edges)
    assign = cut_lineage(assign)
    named = assign.join(side(ranked.select(F.col("id").alias("_id"), F.col("k").alias("v"))), "v").join(
        side(ranked.select(F.col("id").alias("_leader"), F.col("k").alias("leader"))), "leader"
    )
    named = named.select("_id", "_leader")
    return nr.join(named, nr["id"] == named["_id"], "left").select(
        "id", F.col("_leader").isNull().alias("is_leader"), F.coalesce("_leader", "id").alias("leader")
    )


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) by labels that sink along edges and are then halved (numpy)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        was = label.copy()
        # hook the labels of both ends under the smaller one, then let every node jump to its label's label
        np.minimum.at(label, was[x], low)
        np.minimum.at(label, was[y], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label[x] == label[y]).all():
            return nodes, nodes[label]


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u. ``edges``: u, v. Combined in each task before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def star_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, comp): the smallest node of each node's component, for nodes that have edges.

    Alternating large-star and small-star steps rewrite the edges until every component is a star around its
    smallest node: large-star hangs a node's larger neighbours under its smallest one, small-star its smaller
    neighbours and itself. No label is ever joined to all members of a component; a node with very
    many edges is salted in the one join of a step. Once ``local_edges`` edges or fewer are left
    (stars shrink them quickly), one task finishes them.
    """
    checkpoint_dir(edges.sparkSession)
    # every edge once, from its larger end (u) to its smaller (v)
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).where(F.col("u") != F.col("v"))
    e = cut_lineage(e.distinct())
    rounds, last = 0, None
    while True:
        size = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if size[0] <= local_edges:
            return _finished_locally(e)
        if tuple(size) == last:  # unchanged: all edges point to the smallest node
            break
        last = tuple(size)
        rounds += 1
        # large star: for every u, its larger neighbours point to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = skew_safe_join(both.where(F.col("v") > F.col("u")), low, ["u"])
        e = cut_lineage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        low = _smallest_neighbour(e)
        small = skew_safe_join(e, low, ["u"])
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(moved.where(F.col("u") != F.col("v")).distinct())
    log.info("star_components: %d rounds", rounds)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


def _finished_locally(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of edges, in one task."""
    _ship_by_value()

    def run(group: pa.Table) -> pa.Table:
        node, comp = union_find(group["u"].to_numpy(), group["v"].to_numpy())
        return pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())})

    return edges.withColumn("_b", F.lit(0)).groupBy("_b").applyInArrow(run, "node bigint, comp bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Minimum node id of each node's component, for nodes that have edges.

    Min-label propagation with pointer jumping: each round a node takes the
    smallest label among itself and its neighbours, then the label of its
    label. Returns (node, comp).
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    und = cut_lineage(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(und.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")))
    side = _side(labels.count())

    rounds = 0
    while True:
        rounds += 1
        nbr = (
            und.join(side(labels.select(F.col("node").alias("x"), "label")), "x")
            .groupBy("y")
            .agg(F.min("label").alias("m"))
        )
        step = labels.join(side(nbr), labels["node"] == nbr["y"], "left").select(
            "node", F.least(F.col("label"), F.coalesce(F.col("m"), F.col("label"))).alias("label")
        )
        hop = step.alias("p").join(side(step.alias("q")), F.col("p.label") == F.col("q.node")).select(
            F.col("p.node").alias("node"), F.least(F.col("p.label"), F.col("q.label")).alias("label")
        )
        new = cut_lineage(hop)
        changed = (
            new.alias("n").join(side(labels.alias("o")), "node").where(F.col("n.label") != F.col("o.label")).limit(1).count()
        )
        labels = new
        if changed == 0:
            break
    log.info("connected_components: %d rounds", rounds)
    return labels.select("node", F.col("label").alias("comp"))
