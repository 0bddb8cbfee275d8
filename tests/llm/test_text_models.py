import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import langid, quality, toxicity
from feedlens.llm.common import id_fold
from feedlens.llm.subwords import SubwordHasher

from .conftest import words


def test_id_fold(spark):
    df = spark.createDataFrame([(1,), (12345,), (-7,), (None,)], "doc_id bigint")
    got = [r[0] for r in df.select(id_fold("doc_id", 5)).collect()]
    assert got == [zlib.crc32(s.encode()) % 5 for s in ("1", "12345", "-7", "")]


def test_subwords_against_a_plain_enumeration():
    """Two texts share a bucket for each n-gram or word that they share."""
    h = SubwordHasher(30)

    def plain(text):
        out = set()
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            marked = f"<{w}>"
            out.add(("w", w))
            out |= {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
        return out

    rng = random.Random(2)
    texts = [words(rng, 30) for _ in range(10)] + ["Ab ab, AB!", "x", "é9 ß", "", "😀 𝒜b"]
    seen = {}
    for t in texts:
        assert abs(len(h.buckets(t)) - len(plain(t))) <= 1
    for a in texts:
        for b in texts:
            shared = len(set(h.buckets(a).tolist()) & set(h.buckets(b).tolist()))
            assert abs(shared - len(plain(a) & plain(b))) <= 1, (a, b)
            seen[a, b] = shared


def labelled(spark, n=1500, seed=3):
    rng = random.Random(seed)
    vocab = words(rng, 400).split()
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = "vermin" + rng.choice(["", "s", "ous", "ly", "ish", "ed"])
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(docs, ddl), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_toxicity_on_held_out_texts_and_misspellings(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels, id_fold("doc_id", 5) != 0, bits=14)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (truth[i] == 1) for i in held]) >= 0.95
    clean, unseen = "some plain words stand here " * 8, "some plain verminz stand veermins " * 8
    pair = spark.createDataFrame([(1, clean), (2, unseen)], "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(pair, model).collect()}
    assert score[2] > score[1]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_labels_outside_the_learnable_fold_are_not_used(spark):
    docs, labels, _ = labelled(spark, 200)
    flipped = labels.withColumn("toxic", F.when(id_fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x, id_fold("doc_id", 5) != 0, bits=12) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    docs, labels, _ = labelled(spark, 100)
    model = toxicity.fit_toxicity(docs, labels, bits=12)
    rows = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (100, 101, 102)}
    assert len(empty) == 1
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    odd_labels = spark.createDataFrame([(None, 1, 1), (300, None, 1), (300, 1, 0), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    for d, x in ((odd_docs, odd_labels), (no_docs, odd_labels.limit(0)), (odd_docs, odd_labels.limit(0))):
        m = toxicity.fit_toxicity(d, x, bits=12)
        assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd_docs, m).collect())


# ---- language ----


def brute_counts(text):
    c = [x if x.isalpha() else " " for x in (" " + text.lower() + " ")]
    out = {}
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            g = "".join(c[i : i + n])
            if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                out[g] = out.get(g, 0) + 1
    return out


def test_gram_counts_against_a_plain_count():
    table = langid.letter_table()
    assert len(langid.gram_codes(langid.letters("ў日a", table))) == len(set(langid.gram_codes(langid.letters("ў日a", table)).tolist())) == 3 + 4 + 3
    for text in ("The cat, the hat. THE END", "aa  bb", "a", "é ü!", "12 x 3y"):
        code, n = langid.runs(langid.gram_codes(langid.letters(text, table)))
        assert sorted(n.tolist()) == sorted(brute_counts(text).values())


def sample_languages():
    return {
        "en": "the quick brown fox jumps over the lazy dog and then the dog sleeps while the fox thinks about what there is to eat",
        "de": "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund während der fuchs überlegt was es gibt",
        "fr": "le rapide renard brun saute par dessus le chien paresseux et puis le chien dort pendant que le renard pense à manger",
    }


def test_language_by_out_of_place_distance(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = []
    for lang, text in sample_languages().items():
        w = text.split()
        for _ in range(60):
            rows.append((len(rows), " ".join(rng.choice(w) for _ in range(rng.randint(5, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learn = id_fold("doc_id", 4) != 2
    profiles = langid.fit_profiles(docs, learn)
    assert sorted(profiles) == ["de", "en", "fr"]
    hidden = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("xx")))
    again = langid.fit_profiles(hidden, learn)
    assert all((profiles[k] == again[k]).all() for k in profiles) and sorted(again) == sorted(profiles)
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(docs, profiles).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i] == k for i, k in held]) >= 0.95
    odd = {r.doc_id: r for r in langid.predict_language(odd_docs, profiles).collect()}
    for i in (100, 101, 102):
        assert (odd[i].lang_pred, odd[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.predict_language(no_docs, profiles).count() == 0
    assert langid.fit_profiles(no_docs, learn) == {}
    assert {r.lang_pred for r in langid.predict_language(docs, {}).collect()} == {"und"}


def test_distance_equals_a_plain_computation(spark):
    texts = list(sample_languages().values())
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(sample_languages().items())], "doc_id bigint, text string, lang string")
    profiles = langid.fit_profiles(docs, F.lit(True), 50)
    table = langid.letter_table()
    got = {r.doc_id: r for r in langid.predict_language(docs, profiles, 50).collect()}
    for i, t in enumerate(texts):
        code, n = langid.runs(langid.gram_codes(langid.letters(t, table)))
        top = sorted(range(len(code)), key=lambda j: (-n[j], code[j]))[:50]
        dist = {}
        for k, p in profiles.items():
            place = {c: r for r, c in enumerate(p.tolist())}
            dist[k] = sum(min(50, abs(place[int(code[j])] - r)) if int(code[j]) in place else 50 for r, j in enumerate(top))
        best = min(sorted(dist), key=dist.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - dist[best] / (50 * len(top)))


# ---- quality ----


def pu_rows(seed=6, n=900):
    rng = random.Random(seed)
    vocab = words(rng, 500).split()
    rows = []
    for i in range(n):
        good = rng.random() < 0.75
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 150))]
        text = ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) if good else rng.choice([" ".join([w[0]] * 80), "!! ".join(w).upper(), " | ".join(w)])
        rows.append((i, text, int(good)))
    return rows


def test_positive_unlabelled_learning(spark, odd_docs, no_docs):
    rows = pu_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows if i % 3 == 0], "doc_id bigint, quality int, toxic int")
    learn = id_fold("doc_id", 4) != 2
    model, prior = quality.fit_quality(docs, labels, learn)
    assert 0.6 <= prior <= 0.9
    # labels that say "bad" are not needed: the same model without them
    only_good, prior2 = quality.fit_quality(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)), learn)
    assert prior == prior2
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model, prior).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (g == 1) for i, g in held]) >= 0.95
    kept = quality.keep_good(odd_docs, model, prior)
    assert kept.schema == odd_docs.schema
    odd = quality.score_quality(odd_docs, model, prior).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (100, 101)}) == 1
    assert quality.score_quality(no_docs, model, prior).count() == 0
    nothing, half = quality.fit_quality(no_docs, labels.limit(0), learn)
    assert nothing is None and quality.keep_good(odd_docs, nothing, half).count() == odd_docs.count()


def test_prior_estimate_on_known_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        pos = rng.normal(2, 1, 4000)
        unl = np.where(rng.random(8000) < share, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert abs(quality.estimate_prior(pos, unl) - share) < 0.06


def test_statistics_cover_all_unlabelled_documents(spark, monkeypatch):
    rows = pu_rows(n=400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(rows[1][0], rows[1][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows if i % 3 == 0], "doc_id bigint, quality int, toxic int")
    seen = []
    whole = quality.prior_of_counts
    monkeypatch.setattr(quality, "prior_of_counts", lambda pos, counts: seen.append(counts.sum()) or whole(pos, counts))
    model, prior = quality.fit_quality(docs, labels, positive_cap=60, unlabelled_cap=40)
    x = np.stack([quality.features(t) for i, t, _ in rows if i % 3])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6)
    assert seen == [len(x) - 20] * 2 and 0 < prior < 1


def test_counts_give_the_prior_of_the_scores():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(2, 1, 500), rng.normal(0, 2, 700)
    ts = quality.thresholds(pos)
    counts = quality.reached(ts, unl)
    assert [counts[i + 1 :].sum() for i in range(len(ts))] == [(unl >= t).sum() for t in ts]
    assert quality.prior_of_counts(pos, counts) == quality.estimate_prior(pos, unl)


def test_labels_on_every_document(spark):
    rows = pu_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id bigint, quality int, toxic int")
    model, prior = quality.fit_quality(docs, labels, id_fold("doc_id", 4) != 2)
    assert model is not None and 0.6 <= prior <= 0.9
    kept = {r.doc_id for r in quality.keep_good(docs, model, prior).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == (g == 1) for i, g in held]) >= 0.95


def test_query_and_stage_agree_where_nothing_is_learned(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t, _ in pu_rows(n=30)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from feedlens.llm import catalog

    rows = catalog.op10_quality_pu(spark, str(tmp_path)).collect()
    assert len(rows) == 30 and {(r.score, r.predicted) for r in rows} == {(0.7, 1)}
