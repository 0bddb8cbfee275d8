"""A3/A5: leaders and components against sequential models, on both the local and the distributed path."""

import random

import numpy as np
import pytest

from feedlens.operators import graph


def sequential_leaders(order, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    place = {x: i for i, x in enumerate(order)}
    leaders, of = set(), {}
    for x in order:
        earlier = sorted((place[y], y) for y in near.get(x, ()) if y in leaders)
        if earlier:
            of[x] = earlier[0][1]
        else:
            leaders.add(x)
            of[x] = x
    return of


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def frame(spark, edges, parts=4):
    return spark.createDataFrame(edges, "a bigint, b bigint").repartition(parts)


def random_edges(seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return [(a * 7 - 50, b * 7 - 50) for a, b in edges] + [(10**12, 10**12 + 1), (5, 5)]


@pytest.mark.parametrize("local", [10**6, 40, 3])
def test_leaders_equal_the_sequential_scan(spark, local):
    rng = random.Random(local)
    edges = [e for e in random_edges(local, 160, 120)]
    ids = sorted({x for e in edges for x in e} | {999, 1000})
    rank = {x: rng.randrange(30) for x in ids}
    nodes = spark.createDataFrame([(x, rank[x]) for x in ids], "id bigint, r int")
    got = graph.greedy_leaders(nodes, frame(spark, edges), ["r"], local_edges=local).collect()
    want = sequential_leaders(sorted(ids, key=lambda x: (rank[x], x)), [e for e in edges if e[0] != e[1]])
    assert {r.id: r.leader for r in got} == want and len(got) == len(ids)
    assert all(r.is_leader == (r.leader == r.id) for r in got)


@pytest.mark.parametrize("rounds", [1, 8])
def test_dense_graphs_lose_their_decided_nodes_in_rounds(spark, monkeypatch, rounds):
    rng = random.Random(rounds)
    ids = list(range(300))
    edges = [(a, b) for a in ids for b in ids if a < b and (a % 7 == b % 7 or rng.random() < 0.02)]
    if rounds == 8:  # the edges left after some rounds fit one task: no component is looked for
        monkeypatch.setattr(graph, "star_components", None)
    monkeypatch.setattr(graph.leaders_by_rounds, "__defaults__", (graph.LOCAL_EDGES, rounds))
    rank = {x: rng.randrange(300) for x in ids}
    nodes = spark.createDataFrame([(x, rank[x]) for x in ids], "id bigint, r int")
    got = graph.greedy_leaders(nodes, frame(spark, edges + edges[:50]), ["r"], local_edges=1500 if rounds == 8 else 5).collect()
    assert {r.id: r.leader for r in got} == sequential_leaders(sorted(ids, key=lambda x: (rank[x], x)), edges)


def test_a_long_path_is_scanned_in_a_fixed_number_of_jobs(spark):
    n = 20_000
    rng = random.Random(1)
    name = list(range(n))
    rng.shuffle(name)
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(name)], "id bigint, r int")
    edges = [(name[i], name[i + 1]) for i in range(n - 1)]
    jobs = []
    for m in (200, n):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"path-{m}", "leaders")
        got = graph.greedy_leaders(nodes, frame(spark, edges[: m - 1]), ["r"]).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"path-{m}")))
        spark.sparkContext.setJobGroup("", "")
    # every second node leads: the sequential scan of a path
    want = {x: x if i % 2 == 0 else name[i - 1] for i, x in enumerate(name)}
    assert {r.id: r.leader for r in got} == want
    assert abs(jobs[1] - jobs[0]) <= 2


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_equal_union_find(spark, local):
    for seed, n, m in ((1, 60, 50), (2, 300, 200), (3, 40, 200)):
        edges = random_edges(seed, n, m)
        got = graph.star_components(frame(spark, edges), local_edges=local).collect()
        want = components([e for e in edges if e[0] != e[1]])
        assert {r.node: r.comp for r in got} == want and len(got) == len(want)
    assert graph.star_components(frame(spark, [(1, 1)]), local_edges=local).collect() == []


def test_star_and_path_without_a_local_finish(spark):
    n = 100_000
    star = [(n // 2, i) for i in range(n) if i != n // 2]
    got = graph.star_components(frame(spark, star), local_edges=0)
    assert got.where("comp = 0").count() == n == got.count()
    rng = random.Random(3)
    name = list(range(n))
    rng.shuffle(name)
    path = [(name[i], name[i + 1]) for i in range(n - 1)]
    got = graph.star_components(frame(spark, path), local_edges=0)
    assert got.where("comp = 0").count() == n == got.count()


def test_union_find_in_numpy():
    for seed in range(20):
        edges = [e for e in random_edges(seed, 50, 60) if e[0] != e[1]]
        a, b = np.array(edges, np.int64).T
        assert dict(zip(*(x.tolist() for x in graph.union_find(a, b)))) == components(edges)
    n = 50_000
    nodes, comp = graph.union_find(np.arange(n - 1), np.arange(1, n))
    assert (comp == 0).all()
