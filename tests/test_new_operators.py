"""Dictionaries as tables, classes of keyword sets, streamed winners and the item store, against plain models."""

import datetime as dt
import io
import random
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from feedlens.operators import topics
from feedlens.operators.dedup import exact_attribution, exact_dedup
from feedlens.operators.dictionary import dictionary_hits, rows_with_terms
from feedlens.sources import store
from feedlens.streaming import winners

from conftest import NOW, make_items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_dictionary_hits_are_those_of_contains(spark, slice_bytes):
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc é") for _ in range(rng.randint(1, 4))) for _ in range(60)}) + ["", None, "ABC", "aba", "日本"]
    texts = ["".join(rng.choice("abcABC éÉ日本") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "abab"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "an abc", "x")] * 2, "id bigint, text string, terms string")
    got = dictionary_hits(rows, spark.createDataFrame([(t,) for t in terms], "term string"), "text", keep=["id"], slice_bytes=slice_bytes)
    long = sorted((str(r.id), t) for r in got.collect() for t in r.terms)
    known = {t.lower() for t in terms if t}
    want = sorted((str(i), t) for i, x in [*enumerate(texts), (None, "an abc"), (None, "an abc")] if x for t in known if t in x.lower())
    assert long == want


def test_a_row_has_its_terms_together_however_many_slices_there_are(spark, monkeypatch):
    from feedlens.operators import dictionary

    monkeypatch.setattr(dictionary, "HELD_BYTES", 200, raising=False)
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 4))) for _ in range(80)})
    texts = ["".join(rng.choice("abcd ") for _ in range(30)) for _ in range(120)] + [None, "", "zzz"]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts * 2)], "id bigint, text string").repartition(3)
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i // 2, [t for t in terms if t in x]) for i, x in enumerate(texts * 2) if x and any(t in x for t in terms))
    for slice_bytes in (1 << 20, 60):
        assert sorted((r.id, r.terms) for r in dictionary_hits(rows, listed, "text", slice_bytes=slice_bytes).collect()) == want


def test_no_terms_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a text")], "id bigint, text string")
    none = spark.createDataFrame([], "term string")
    assert dictionary_hits(rows, none, "text").collect() == [] and rows_with_terms(rows, none, "text", "id").collect() == []
    some = spark.createDataFrame([("TEXT",)], "term string")
    assert [r.id for r in rows_with_terms(rows, some, "text", "id").collect()] == [1]
    assert dictionary_hits(rows.limit(0), some, "text").collect() == []


@pytest.mark.parametrize("least", [1, 2, 3])
def test_keyword_classes_expand_to_all_pairs(spark, least):
    rng = random.Random(least)
    vocab = [f"k{i}" for i in range(7)]
    kw = [rng.sample(vocab, rng.randint(0, 5)) for _ in range(50)] + [["k0", "k1", "k1"]] * 4 + [None]
    df = spark.createDataFrame(list(enumerate(kw)), "item bigint, keywords array<string>")
    links, members = topics.shared_keyword_classes(df, min_shared=least)
    want = {(i, j): len(set(kw[i] or []) & set(kw[j] or [])) for i in range(len(kw)) for j in range(i + 1, len(kw))}
    want = {p: n for p, n in want.items() if n >= least}
    got = topics.expand_classes(links, members).collect()
    assert {(r.a, r.b): r.n_shared for r in got} == want and len(got) == len(want)
    assert links.agg(F.sum("n_links")).first()[0] == len(want)
    assert {r.item: r.cls for r in members.collect()} == {i: min(j for j, other in enumerate(kw) if set(other or []) == set(k)) for i, k in enumerate(kw) if k}


def test_one_keyword_on_all_items_joins_nothing(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("item"), F.array(F.lit("everywhere"), F.concat(F.lit("own"), F.col("id"))).alias("keywords"))
    links, members = topics.shared_keyword_classes(rows)
    assert links.count() == 0 and members.count() == n
    same = spark.range(n).select(F.col("id").alias("item"), F.array(F.lit("a"), F.lit("b")).alias("keywords"))
    (only,) = topics.shared_keyword_classes(same)[0].collect()
    assert tuple(only) == (0, 0, 2, n * (n - 1) // 2)


def item_rows(rng, n):
    return [
        {"seq": i, "title": f"Story {rng.randint(0, 6)}", "url": f"https://s.example/{rng.randint(0, 1)}", "tier": rng.randint(1, 4), "source_name": f"n{i}", "age": rng.randint(1, 200)}
        for i in range(n)
    ]


def test_streamed_winners_equal_the_batch(spark):
    items = make_items(spark, item_rows(random.Random(3), 90))
    log = winners.stream_in_parts(items, tempfile.mkdtemp(prefix="win-"), parts=4)
    cols = ["fp", "seq", "title", "source_name", "source_tier", "published", "pos", "n_copies"]
    want = exact_dedup(items.withColumn("published", F.col("published").cast("timestamp"))).select(cols)
    assert sorted(map(tuple, winners.current_winners(log).select(cols).collect())) == sorted(map(tuple, want.collect()))
    names = ["fp", "seq", "ord", "source_name"]
    want = exact_attribution(items).select(names)
    assert sorted(map(tuple, winners.recorded_copies(log).select(names).collect())) == sorted(map(tuple, want.collect()))


def test_a_late_better_tier_replaces_the_winner(spark):
    rows = [{"seq": 0, "title": "Same", "url": "https://x.example/a", "tier": 3, "source_name": "first"}, {"seq": 10, "title": "Same", "url": "https://x.example/a", "tier": 1, "source_name": "best"}, {"seq": 20, "title": "Same", "url": "https://x.example/a", "tier": 2, "source_name": "late"}]
    log = winners.stream_in_parts(make_items(spark, rows), tempfile.mkdtemp(prefix="win-"), parts=3)
    (w,) = winners.current_winners(log).collect()
    assert (w.source_name, w.pos, w.n_copies) == ("best", 0, 3)
    assert sorted((r.ord, r.source_name) for r in winners.recorded_copies(log).collect()) == [(10, "first"), (20, "late")]


def test_state_expires_after_the_horizon(spark):
    base = tempfile.mkdtemp(prefix="win-")
    story = {"title": "Same", "url": "https://x.example/a", "tier": 2}
    days = [(0, 0, story), (1, 3, {"title": "Other", "url": "https://x.example/b"}), (2, 8, {"title": "Third", "url": "https://x.example/c"}), (3, 8, story)]
    for seq, day, more in days:
        part = make_items(spark, [{"seq": seq, "published": NOW + dt.timedelta(days=day), "source_name": f"n{seq}", **more}])
        part.write.mode("append").parquet(f"{base}/landing")
        winners.run_winners(spark, f"{base}/landing", part.schema, f"{base}/log", f"{base}/state", horizon_hours=24)
    log = spark.read.parquet(f"{base}/log").where("kind = 'winner' AND title = 'Same'")
    # the state of the first copy went with its timer, so the second starts a story of its own
    assert sorted(r.e_seq for r in log.collect()) == [0, 3]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_the_store_reads_only_the_folders_it_needs(spark):
    base = tempfile.mkdtemp(prefix="store-")
    cats = ["cve", "blogs", "incidents", "community"]
    items = make_items(spark, [{"seq": i, "title": f"t{i}", "age": 24 * (i % 10) + 1, "category": cats[i % 4]} for i in range(80)])
    store.write_items(items, f"{base}/items")
    recent = store.read_items(spark, f"{base}/items", NOW, 48)
    assert sorted(r.seq for r in recent.collect()) == [i for i in range(80) if 24 * (i % 10) + 1 <= 48]
    assert "PartitionFilters: [isnotnull(day" in plan_of(recent) and len(recent.inputFiles()) > 0
    spark.createDataFrame([("cve", True), ("blogs", False), ("incidents", None)], "category string, enabled boolean").write.parquet(f"{base}/registry")
    active = store.of_active_categories(store.read_items(spark, f"{base}/items"), spark.read.parquet(f"{base}/registry"))
    assert "dynamicpruning" in plan_of(active)
    assert sorted(r.seq for r in active.collect()) == [i for i in range(80) if cats[i % 4] in ("cve", "incidents")]
    gone = store.drop_days(spark, f"{base}/items", (NOW - dt.timedelta(days=5)).date())
    assert gone and min(r.published for r in store.read_items(spark, f"{base}/items").collect()).date() >= (NOW - dt.timedelta(days=5)).date()


def test_kept_pairs_equal_those_of_the_whole_window(spark):
    from feedlens.operators.similarity import similar_title_pairs
    from feedlens.streaming.ingest import WindowPairs

    rng = random.Random(8)
    base = ["printer firmware hides a botnet", "court fines a data broker", "mail gateway breaks logins"]
    pool = sorted({rng.choice(base)[: rng.randint(15, 40)] + rng.choice(["", "s", " now", "!!"]) for _ in range(120)})
    path = tempfile.mkdtemp(prefix="pairs-")
    last = set()
    for epoch in range(4):
        window = {t for t in pool if rng.random() < 0.6} if epoch != 2 else set(pool)
        titles = spark.createDataFrame([(pool.index(t), t) for t in sorted(window)], "tid bigint, nt string")
        keeper = WindowPairs(spark, path, epoch)
        got = {(r.a, r.b) for r in keeper(titles, 85).collect()}
        assert got == {(r.a, r.b) for r in similar_title_pairs(titles, 85).collect()}
        assert keeper.compared == len(window - last)
        last = window


def test_old_days_leave_the_stream_store(spark):
    from feedlens.streaming.ingest import latest_report, stream_report_refresh

    base = tempfile.mkdtemp(prefix="refresh-")
    heads = ["Ransomware gang halts a ferry line", "Data breach at a toy shop", "Phishing wave hits a payroll firm"]
    for k, age in enumerate([24 * 40, 24 * 5, 24]):
        items = make_items(spark, [{"seq": 10 * k + i, "title": f"{heads[k]} {w}", "url": f"https://x.example/{k}/{i}", "age": age, "cvss": 9.9, "category": "incidents", "tier": 1} for i, w in enumerate(["north", "south"])])
        items.write.mode("append").partitionBy("source_category").parquet(f"{base}/landing")
        schema = spark.read.parquet(f"{base}/landing").schema
        stream_report_refresh(spark, f"{base}/landing", schema, f"{base}/store", f"{base}/report", f"{base}/state", NOW, 14, min_score=0)
    days = {r.day for r in spark.read.parquet(f"{base}/store").select("day").distinct().collect()}
    assert days == {(NOW - dt.timedelta(hours=h)).date() for h in (24 * 5, 24)}
    # titles that differ by a word are one story each
    assert {r.title.rpartition(" ")[0] for r in latest_report(spark, f"{base}/report").collect()} == set(heads[1:])


def test_streamed_items_are_derived_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def name_of(x):
        made.add(1)
        return x

    rows = [{"title": f"Story {i}", "source_name": f"s{i}"} for i in range(30)]
    items = make_items(spark, rows).withColumn("source_name", F.udf(name_of)("source_name"))
    monkeypatch.setattr(winners, "run_winners", lambda spark, landing, schema, log, *_: spark.read.parquet(landing).write.mode("overwrite").parquet(log))
    assert winners.stream_in_parts(items, tempfile.mkdtemp(prefix="win-"), parts=3).count() == 30
    assert made.value == 30
