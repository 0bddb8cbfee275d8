import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import mtree


def brute(rows, k):
    fine = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in fine), default=0)
    pad = [(i, np.array(v + [0] * (dim - len(v)), np.int64)) for i, v in fine]
    out = []
    for q in sorted({i for i, _ in pad if i % 100 == 0}):
        best = {}
        for a, x in pad:
            for b, y in pad:
                if a == q and b != q:
                    best[b] = max(best.get(b, -(1 << 62)), int(x @ y))
        out += [(q, r + 1, b, s) for r, (b, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])]
    return out


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 3 : n // 2] = x[0] + rng.normal(scale=0.01, size=(n // 2 - n // 3, dim))  # a crowded neighbourhood
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.5, 3) for i, v in rows], "vec_id bigint, embedding array<float>, score double, cell int")


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("tree_rows,block", [(4096, 512), (64, 2)])
def test_top_k_equals_brute_force(spark, tree_rows, block):
    rows = vectors(600, 12, 1)
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10, tree_rows=tree_rows, query_block=block, leaf_rows=16)
    assert found(got) == brute(rows, 10)


def test_ties_nulls_repeated_rows_and_unequal_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(30)] + [(100, [0.25, 1.0]), (100, [0.25, 1.0]), (100, [2.0, 0.0]), (200, [1.0, None]), (300, None), (400, [nan, 1.0]), (500, [inf, 0.0])]
    rows += [(600, [-1.0, 2.0, 3.0]), (601, []), (None, [1.0, 1.0]), (7, [9.0, 9.0])]
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10, tree_rows=8, leaf_rows=4)
    assert found(got) == brute(rows, 10)


def test_empty_and_single(spark):
    assert found(mtree.top_k(frame(spark, []), F.col("vec_id") % 100 == 0)) == []
    assert found(mtree.top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0)) == []
    assert found(mtree.top_k(frame(spark, [(0, [1.0]), (3, [2.0])]), F.col("vec_id") % 100 == 0)) == [(0, 1, 3, 1024 * 2048)]


def test_large_finite_components_are_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 6)]) for i in range(300)] + [(700, [1e6, -1e6, 65536.0])]
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10, tree_rows=64, leaf_rows=16)
    assert found(got) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 10)


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="vector 0"):
        mtree.top_k(frame(spark, [(0, [1e30]), (1, [1.0])]), F.col("vec_id") % 100 == 0)


def test_stored_bounds_save_distances():
    rng = random.Random(3)
    centre = [[rng.gauss(0, 900) for _ in range(8)] for _ in range(20)]
    x = np.array([[int(c + rng.gauss(0, 10)) for c in rng.choice(centre)] for _ in range(3000)], np.int64)
    largest = int((x * x).sum(1).max())
    root = mtree.lift(x[:1], largest)[0]
    tree = mtree.Tree(mtree.build_pages(np.arange(3000), x, largest, root, 32), 8, largest)
    for i in range(20):
        got = tree.search(x[i], i, 10, float(np.linalg.norm(root - np.r_[x[i], 0])), np.inf)
        score = x @ x[i]
        order = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:10]
        assert [v for _, v in got] == order
    assert tree.computed < 0.5 * 20 * 3000
