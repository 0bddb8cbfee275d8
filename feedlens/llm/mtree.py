"""Exact top-k by inner product: M-trees, searched best first.

Inner product becomes a metric by one more coordinate: with M the largest squared norm, a
stored x gets sqrt(M - |x|^2) and a query q gets 0, so |q' - x'|^2 = |q|^2 + M - 2 <q, x>.

Vectors are dealt to cells by the nearest of a bounded number of sampled pivots, and each
cell to trees of at most ``TREE_ROWS`` vectors. A tree is a set of paged nodes, rows of a
table: an entry of an inner page has a routing vector, its covering radius and its
distance to the page's own routing vector; an entry of a leaf has a vector and that distance.
The search keeps pages in a heap by their lower bound. An entry whose stored distance
already puts it farther away than the k-th result (triangle inequality) is skipped
without computing a distance.

Every query first searches one tree of its nearest cell. The k-th distance found there
rules out cells; the rest of its trees are searched with that bound. Work is dealt by
(tree, block of queries), both of bounded size. Scores are exact integers; bounds
carry a slack far above rounding error.

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors are padded with zeros; a vec_id that comes several times is one
candidate with its best score, and equal rows count once; null ids take no part; an
empty table gives no rows; vectors whose scaled squared norm passes a long raise ValueError
with a vec_id, as scores might pass it, too.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, smallest_hashes, staged

TREE_ROWS = 4096
LEAF_ROWS = 128
FANOUT = 16
MAX_PIVOTS = 1024
QUERY_BLOCK = 512
SCALE = 1024
#: Scores and squared norms are longs.
LARGEST = (1 << 63) - 1
WIDE = "decimal(38,0)"

PAGE_DDL = (
    "cell int, tree int, page int, leaf boolean, ids array<bigint>, vectors array<bigint>, "
    "radius array<double>, parent_distance array<double>, child array<int>"
)
PAGE = pa.schema([
    ("cell", pa.int32()), ("tree", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())),
    ("radius", pa.list_(pa.float64())), ("parent_distance", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())),
])


def scaled_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): distinct rows whose vectors are whole and finite, as floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct()


def squares(v: F.Column, kind: str) -> F.Column:
    """Squared norm of an integer vector, as longs or (where they might overflow) as doubles."""
    return F.aggregate(v, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind) * x.cast(kind))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return flat[off[0] : off[-1]].reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    for i, (a, n) in enumerate(zip(off, size)):
        out[i, :n] = flat[a : a + n]
    return out


def lift(x: np.ndarray, largest: int) -> np.ndarray:
    """Stored vectors with their extra coordinate, as floats."""
    rest = largest - (x * x).sum(1)
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(rest, 0).astype(np.float64))[:, None]], 1)


def slack(largest: int) -> float:
    return 1e-7 * (1.0 + math.sqrt(largest))


def build_pages(ids: np.ndarray, x: np.ndarray, largest: int, root: np.ndarray, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> list[dict]:
    """Bulk load. ``root`` is the routing vector (integers) of page 0; children follow their parent."""
    lifted = lift(x, largest)
    rng = np.random.default_rng(len(ids))
    pages: list[dict] = []

    def add(rows: np.ndarray, routing: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= leaf_rows:
            dist = np.linalg.norm(lifted[rows] - routing, axis=1)
            pages[number] = dict(page=number, leaf=True, ids=ids[rows], vectors=x[rows].ravel(), radius=[], parent_distance=dist, child=[])
            return number
        picks = rng.choice(rows, min(fanout, -(-len(rows) // leaf_rows) + 1), replace=False)
        near = np.stack([np.linalg.norm(lifted[rows] - lifted[p], axis=1) for p in picks], 1)
        home = near.argmin(1)
        if (home == home[0]).all():  # equal vectors: any even cut will do
            home = np.arange(len(rows)) % len(picks)
        entry = dict(page=number, leaf=False, ids=[], vectors=[], radius=[], parent_distance=[], child=[])
        for k, p in enumerate(picks):
            mine = np.flatnonzero(home == k)
            if len(mine):
                entry["vectors"].append(x[p])
                entry["ids"].append(ids[p])
                entry["radius"].append(near[mine, k].max())
                entry["parent_distance"].append(np.linalg.norm(lifted[p] - routing))
                entry["child"].append(add(rows[mine], lifted[p]))
        entry["vectors"] = np.concatenate(entry["vectors"])
        pages[number] = entry
        return number

    add(np.arange(len(ids)), root)
    return pages


class Tree:
    """Pages of one tree, ready to search."""

    def __init__(self, pages: list[dict], dim: int, largest: int):
        self.largest, self.slack = largest, slack(largest)
        self.pages = {}
        for p in pages:
            x = np.asarray(p["vectors"], np.int64).reshape(len(p["ids"]), dim)
            norm = (x * x).sum(1)
            self.pages[p["page"]] = (p["leaf"], np.asarray(p["ids"], np.int64), x, norm, np.asarray(p["radius"], float), np.asarray(p["parent_distance"], float), p["child"])
        self.computed = 0

    def search(self, query: np.ndarray, own: int, k: int, to_root: float, bound: float) -> list[tuple[int, int]]:
        """Up to ``k`` best (score, vec_id), ids other than ``own``; ``bound``: a distance that the k-th can't exceed."""
        q2 = int(query @ query)
        base = q2 + self.largest
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(0.0, 0, to_root)]
        while heap:
            low, number, to_page = heapq.heappop(heap)
            if low > bound:
                break
            leaf, ids, x, norm, radius, parent, child = self.pages[number]
            # stored distances first: what can't come within the bound is never computed
            gap = np.abs(to_page - parent)
            near = np.flatnonzero((gap if leaf else gap - radius) <= bound)
            if not len(near):
                continue
            dots = x[near] @ query
            self.computed += len(near)
            if leaf:
                other = ids[near] != own
                score, vec = np.concatenate([best_score, dots[other]]), np.concatenate([best_id, ids[near][other]])
                order = np.lexsort((vec, -score))
                score, vec = score[order], vec[order]
                first = np.sort(np.unique(vec, return_index=True)[1])[:k]
                best_score, best_id = score[first], vec[first]
                if len(best_score) == k:
                    bound = min(bound, math.sqrt(max(base - 2 * int(best_score[-1]), 0)) + self.slack)
            else:
                # a routing vector is a stored one: its extra coordinate meets the query's 0
                dist = np.sqrt(np.maximum(float(base) - 2.0 * dots.astype(np.float64), 0))
                for e, d in zip(near.tolist(), dist.tolist()):
                    lower = max(low, d - radius[e] - self.slack)
                    if lower <= bound:
                        heapq.heappush(heap, (lower, child[e], d))
        return list(zip(best_score.tolist(), best_id.tolist()))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each row's nearest pivot, both lifted."""
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    at = d2.argmin(1)
    return at, np.linalg.norm(x - pivots[at], axis=1)


def top_k(table: DataFrame, is_query, k: int = 10, scale: int = SCALE, tree_rows: int = TREE_ROWS, query_block: int = QUERY_BLOCK, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that ``is_query`` holds for."""
    ship_by_value()
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    vecs = staged(scaled_vectors(table, scale), "vectors")
    size = vecs.select(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
        F.max(F.greatest(F.array_max("v").cast(WIDE), -F.array_min("v").cast(WIDE))).alias("most"),
    ).first()
    if not size["n"]:
        return empty
    dim = size["dim"]
    if dim * int(size["most"]) ** 2 > LARGEST:  # some norm might pass a long
        worst = vecs.agg(F.max(F.struct(squares(F.col("v"), "double").alias("norm"), "vec_id")).alias("w")).first()["w"]
        if worst["norm"] >= LARGEST:
            raise ValueError(f"the squared norm of vector {worst['vec_id']} passes a long, so scores might, too")
    largest = int(vecs.select(F.max(squares(F.col("v"), "bigint"))).first()[0])
    n_queries = vecs.where(is_query).count()
    if not n_queries:
        return empty

    # cells: a bounded sample of pivots, all rows indexed
    n_cells = min(MAX_PIVOTS, -(-size["n"] // tree_rows))
    chosen = smallest_hashes(vecs, n_cells, "vec_id", "v").toArrow()
    pivot_int = matrix(chosen["v"], dim)
    pivots = lift(pivot_int, largest)
    ref = spark.sparkContext.broadcast(pivots)

    def place(batches):
        piv = ref.value
        for b in batches:
            at, far = nearest(lift(matrix(b.column(1), dim), largest), piv)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    placed = vecs.mapInArrow(place, "vec_id bigint, v array<bigint>, cell int, far double")
    cells = staged(placed, "cells")
    stats = {r["cell"]: (r["n"], r["far"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    trees = {c: -(-n // tree_rows) for c, (n, _) in stats.items()}
    split = spark.createDataFrame([(c, t) for c, t in trees.items()], "cell int, trees int")
    dealt = cells.join(F.broadcast(split), "cell").select("cell", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("trees")).cast("int").alias("tree"), "vec_id", "v")

    def build(key, rows):
        cell, tree = key[0].as_py(), key[1].as_py()
        pages = build_pages(rows["vec_id"].to_numpy(), matrix(rows["v"], dim), largest, ref.value[cell], leaf_rows)
        return pa.Table.from_pylist([dict(cell=cell, tree=tree, **p) for p in pages], schema=PAGE)

    pages = staged(dealt.groupBy("cell", "tree").applyInArrow(build, PAGE_DDL), "pages")
    blocks = -(-n_queries // query_block)
    queries = vecs.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(11)), F.lit(blocks)).cast("int"))
    far = [(c, stats[c][1], trees[c]) for c in sorted(stats)]

    def visits(rows: DataFrame, first: bool) -> DataFrame:
        """(cell, tree, block, query_id, v, bound, to_root) of the trees that each query has to visit."""

        def run(batches):
            piv = ref.value
            number = np.array([c for c, _, _ in far])
            radius = np.array([r for _, r, _ in far])
            many = np.array([t for _, _, t in far])
            for b in batches:
                q = matrix(b.column(1), dim)
                full = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)
                bound = np.full(len(q), np.inf) if first else b.column(3).to_numpy(zero_copy_only=False)
                out = [[], [], [], []]
                for i in range(len(q)):
                    d = np.linalg.norm(piv[number] - full[i], axis=1)
                    home = int(d.argmin())
                    for j in [home] if first else np.flatnonzero(d - radius <= bound[i] + slack(largest)).tolist():
                        for t in [0] if first else range(many[j]):
                            if first or (j, t) != (home, 0):
                                for o, v in zip(out, (i, int(number[j]), t, float(d[j]))):
                                    o.append(v)
                rows = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), b.column(2).take(rows), b.column(0).take(rows), b.column(1).take(rows), pa.array(bound).take(rows), pa.array(out[3], pa.float64())],
                    names=["cell", "tree", "block", "query_id", "v", "bound", "to_root"],
                )

        return rows.mapInArrow(run, "cell int, tree int, block int, query_id bigint, v array<bigint>, bound double, to_root double")

    def search(wanted: DataFrame) -> DataFrame:
        """(query_id, v, vec_id, score): the best k of each visited tree."""
        spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else pages.withColumn("block", F.lit(0))

        def run(left, right):
            out = [[], [], []]
            if left.num_rows and right.num_rows:
                tree = Tree(left.to_pylist(), dim, largest)
                q = matrix(right["v"], dim)
                own, bound, root = (right[c].to_pylist() for c in ("query_id", "bound", "to_root"))
                for i in range(len(q)):
                    got = tree.search(q[i], own[i], k, root[i], bound[i])
                    out[0] += [i] * len(got)
                    out[1] += [v for _, v in got]
                    out[2] += [s for s, _ in got]
            rows = pa.array(out[0], pa.int64())
            return pa.table({"query_id": right["query_id"].take(rows), "v": right["v"].take(rows), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

        keys = ["cell", "tree", "block"]
        return spread.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, "query_id bigint, v array<bigint>, vec_id bigint, score bigint")

    seed = staged(search(visits(queries.select("vec_id", "v", "block"), True)), "seed")
    # the k-th score of a query's first tree bounds its k-th distance; fewer than k found: no bound
    kth = seed.groupBy("query_id", "v").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    q2 = F.aggregate(queries["v"], F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    edge = F.sqrt(F.greatest(q2.cast("double") + F.lit(float(largest)) - 2 * F.col("least").cast("double"), F.lit(0.0))) + F.lit(slack(largest))
    bounded = queries.join(kth.withColumnRenamed("v", "kv"), (queries["vec_id"] == F.col("query_id")) & (queries["v"] == F.col("kv")), "left").select(
        queries["vec_id"], queries["v"], "block", F.when(F.col("n") >= k, edge).otherwise(F.lit(float("inf"))).alias("bound")
    )
    rest = search(visits(bounded, False))
    every = seed.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
