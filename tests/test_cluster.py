"""Topic clustering (S10, A5–A8, O3): small cases, and a randomized check of the
pair-star components against union-find."""

import random

from pyspark.sql import functions as F

from conftest import make_items
from feedlens.operators.topics import cluster, shared_keyword_pairs, topic_components, with_keywords
from feedlens.operators.report import order_index


def _prep(spark, rows):
    df = make_items(spark, [{"title": t, "description": d, "tier": 2} for t, d, _ in rows])
    df = df.withColumn("score", F.element_at(F.array(*[F.lit(float(s)) for _, _, s in rows]), (F.col("seq") + 1).cast("int")))
    df = df.withColumn("r_tier", F.col("source_tier")).withColumn("r_neg_pub", -F.unix_micros("published")).withColumn("r_pos", F.col("seq"))
    return with_keywords(df).withColumn("item", F.col("seq"))


def _clusters(spark, rows):
    clusters, members = cluster(_prep(spark, rows))
    ranked = order_index(clusters, [F.desc("top_score"), F.asc("is_other"), F.asc("lead_key")], "rank")
    return ranked.orderBy("rank").collect(), members


NODES = [("Backdoor in a Kubernetes cluster of a bank", "", 64), ("Kubernetes nodes ship with a backdoor", "", 71)]
LOOSE = ("Bakery opens a second shop by the river", "", 12)


def test_two_shared_keywords_make_a_cluster_and_the_rest_is_other(spark):
    cl, members = _clusters(spark, [*NODES, LOOSE])
    assert [(c.is_other, c.size) for c in cl] == [(False, 2), (True, 1)]
    assert [r.item for r in members.where("is_other").collect()] == [2]


def test_one_item_alone_is_other(spark):
    (only,) = _clusters(spark, [LOOSE])[0]
    assert only.is_other and only.name == "Other" and only.shared_keywords == []


def test_clusters_and_leads_follow_the_scores(spark):
    cl, members = _clusters(spark, [
        ("Botnet floods Fortinet firewall", "", 33), ("Fortinet firewall joins a botnet", "", 58),
        ("Phishing kit copies Okta pages", "", 81), ("Okta staff met by phishing calls", "", 47), LOOSE,
    ])
    scores = {r.item: r.score for r in members.collect()}
    assert [c.top_score for c in cl] == sorted((c.top_score for c in cl), reverse=True)
    assert all(scores[c.lead_item] == c.top_score for c in cl)


def test_cluster_names_are_in_title_case(spark):
    cl, _ = _clusters(spark, [("supply chain and sql injection at once", "", 30), ("sql injection after a supply chain attack", "", 20)])
    assert cl[0].name == "Sql Injection" or cl[0].name == "Supply Chain"


def _uf_components(kw):
    parent = list(range(len(kw)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(kw)):
        for j in range(i + 1, len(kw)):
            if len(kw[i] & kw[j]) >= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(kw)):
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    vocab = [f"k{i}" for i in range(9)]
    for _ in range(3):
        kw = [set(rng.sample(vocab, rng.randint(0, 4))) for _ in range(30)]
        df = spark.createDataFrame([(i, sorted(k)) for i, k in enumerate(kw)], "item BIGINT, keywords ARRAY<STRING>")
        got = {r.item: r.comp for r in topic_components(df).collect()}
        assert got == _uf_components(kw)
        pairs = {(r.a, r.b) for r in shared_keyword_pairs(df).collect()}
        assert pairs == {(i, j) for i in range(30) for j in range(i + 1, 30) if len(kw[i] & kw[j]) >= 2}


def test_classes_of_a_popular_keyword_pair_meet_in_blocks(spark):
    import random

    from pyspark.sql import functions as F

    from feedlens.operators.topics import blocks_that_meet, expand_classes, shared_keyword_classes

    rng = random.Random(4)
    sets = {i: sorted({"hot", "pair"} | {f"k{rng.randrange(12)}" for _ in range(rng.randrange(5))}) for i in range(120)}
    sets |= {i: sorted({f"k{rng.randrange(12)}" for _ in range(4)}) for i in range(120, 170)}
    items = spark.createDataFrame([(i, ks) for i, ks in sets.items()], "item bigint, keywords array<string>")
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 2}
    for block, most in ((4, 3), (1000, 500)):
        links, members = shared_keyword_classes(items, block=block)
        pairs = expand_classes(links, members, most).collect()
        assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want
        assert links.agg(F.sum("n_links")).first()[0] == len(want)
    keyed = spark.range(5000).select(F.lit("a").alias("k1"), F.lit("b").alias("k2"), F.col("id").alias("cls"))
    left, right, _ = blocks_that_meet(keyed, 100)
    for side in (left, right):
        assert side.groupBy("k1", "k2", "i", "j").count().agg(F.max("count")).first()[0] < 200
    met = left.join(right.withColumnRenamed("cls", "other"), ["k1", "k2", "i", "j"])
    assert met.where("i < j or cls < other").count() == 5000 * 4999 // 2


def test_every_pair_of_classes_is_given_once_however_its_keywords_meet(spark, monkeypatch):
    """Keywords in groups counted by matrices and in the join give the same links; a popular pair isn't joined row by row."""
    import random

    from feedlens.operators import topics

    rng = random.Random(9)
    sets = {i: sorted({"a0", "hot", "pair"}.union(f"{rng.choice('aqz')}{rng.randrange(9)}" for _ in range(rng.randrange(6)))) for i in range(90)}
    sets |= {i: sorted({f"{rng.choice('aqz')}{rng.randrange(9)}" for _ in range(4)}) + [None] * (i % 2) for i in range(90, 140)}
    items = spark.createDataFrame([(i, ks) for i, ks in sets.items()], "item bigint, keywords array<string>")
    # a null keyword is a word like others, but leads no pair to one another
    first = {i: min(j for j in sets if set(sets[j]) == set(sets[i])) for i in sets}
    share = {(a, b): set(sets[a]) & set(sets[b]) for a in first.values() for b in first.values() if a < b}
    want = sorted((a, b, len(s)) for (a, b), s in share.items() if len(s - {None}) >= 2)
    for few, words in ((8, 5), (10**6, 1024)):
        monkeypatch.setattr(topics, "FEW", few, raising=False)
        monkeypatch.setattr(topics, "WORDS", words, raising=False)
        links = topics.shared_keyword_classes(items, block=40)[0]
        assert sorted((r.cls_a, r.cls_b, r.n_shared) for r in links.where("cls_a < cls_b").collect()) == want
        if few == 8:
            plan = links._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapGroupsInArrow" in plan


def test_links_of_single_items_are_pairs_without_a_join(spark, monkeypatch):
    from feedlens.operators import topics

    sets = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "d"], 4: ["a", "b", "d"], 5: ["x", "y"], 6: ["x", "y"]}
    want = sorted((i, j, len(set(sets[i]) & set(sets[j]))) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= 2)
    joined, real = [], topics.skew_safe_join

    def counted(big, small, keys, *args):
        if "cls_a" in big.columns:
            joined.append(big.count())
        return real(big, small, keys, *args)

    monkeypatch.setattr(topics, "skew_safe_join", counted)
    items = spark.createDataFrame(list(sets.items()), "item bigint, keywords array<string>")
    got = topics.shared_keyword_pairs(items)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["a", "b", "n_shared"]
    assert max(joined) == 4  # links 1-2, 1-3 and 2-3, 3-3 and 5-5: all but that of 1 and 2
    # an item that comes twice with unlike keywords names two classes
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["c", "d"]), (2, ["a", "b", "e"]), (3, ["c", "d", "f"])], "item bigint, keywords array<string>")
    links, members = topics.shared_keyword_classes(twice)
    assert sorted(map(tuple, topics.expand_classes(links, members).collect())) == [(1, 2, 2)] * 2 + [(1, 3, 2)] * 2
