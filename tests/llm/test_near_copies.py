import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import decontam, simhash

from .conftest import words


def brute_fp(text):
    import xxhash

    got = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in got.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, tau=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= tau:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("crowded", [4096, 3])
def test_groups_equal_brute_force(spark, crowded):
    rng = random.Random(1)
    rows = []
    for g in range(25):
        base = words(rng, 120).split()
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(120)] = "changed"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(simhash.near_duplicates(df, crowded=crowded)) == brute_groups(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert found(simhash.near_duplicates(odd_docs)) == brute_groups(odd_rows)
    assert found(simhash.near_duplicates(no_docs)) == []


def test_one_document_of_each_group_stays(odd_docs, odd_rows):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = {c for d, _, c in brute_groups([r for r in odd_rows if r[0] is not None])}
    assert ids == sorted(want)
    # the empty text without an id has a namesake with one; the other has no copy
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["a row without an id"]


def test_rows_without_an_id_are_decided_like_others(spark):
    rng = random.Random(15)
    a, b, c = (words(rng, 80) for _ in range(3))
    near = b.split()
    near[40] = "changed"
    rows = [(1, a), (None, a), (None, a), (None, b), (None, b), (None, " ".join(near)), (None, c)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, grp int")
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
    groups = {d: g for d, _, g in brute_groups([(k, t) for k, (_, t) in enumerate(rows)])}
    want = {min(k for k in groups if groups[k] == g) for g in set(groups.values())}
    assert len(got) == len(want) and got.count((1, a)) == 1 and (None, c) in got and (None, a) not in got


def test_thresholds_are_lossless_and_unequal():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    fps[:1000] = (fps[:1000] & ~np.uint64(0x1FFFFF)) | np.uint64(0x155)  # a crowded part value
    for m in (2, 3, 4, 5):
        groups = simhash.group_bits(fps, m)
        assert sorted(np.concatenate(groups)) == list(range(64))
        parts = [simhash.Part(g, fps, 10**6) for g in groups]
        t, _ = simhash.allocate(parts, fps, 4)
        assert (t.sum(1) == 4 - m + 1).all() and t.min() >= -1
        if m == 3:
            assert len(np.unique(t, axis=0)) > 1
        for x, tx in zip(fps[:200], t[:200]):
            y = x
            for b in rng.choice(64, 4, replace=False):
                y ^= np.uint64(1) << np.uint64(b)
            assert any(int((x ^ y) & p.mask).bit_count() <= k for p, k in zip(parts, tx))


def test_allocation_is_the_cheapest():
    fps = np.random.default_rng(4).integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    parts = [simhash.Part(g, fps, 10**5) for g in simhash.group_bits(fps, 3)]
    t, cost = simhash.allocate(parts, fps[:20], 4)
    each = [p.costs(fps[:20]) for p in parts]
    for i in range(20):
        best = min(sum(c[i, u] for c, u in zip(each, us)) for us in itertools.product(range(4), repeat=3) if sum(us) == 5)
        assert cost[i] == pytest.approx(best)
        assert sum(c[i, u + 1] for c, u in zip(each, t[i])) == pytest.approx(best)


# ---- decontamination ----


def brute_pairs(docs, items):
    """(doc, item) pairs with an aligned window that agrees in 80 %, every alignment tried."""
    out = set()
    for d, text in docs:
        w = decontam.words_of(text)
        for i, passage in items:
            p = decontam.words_of(passage)
            n = min(13, len(p))
            if len(p) < 5:
                continue
            for shift in range(-len(p), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == p[k] for k in range(len(p))]
                inside = [0 <= shift + k < len(w) for k in range(len(p))]
                if any(all(inside[k : k + n]) and sum(same[k : k + n]) >= 0.8 * n - 1e-9 for k in range(len(p) - n + 1)):
                    out.add((d, i))
                    break
    return out


def test_masks_are_lossless_for_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(
            all(o + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(13 - len(m) + 1)
        )


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_overlaps_equal_brute_force(spark, block_words):
    rng = random.Random(8)
    items = [(k, words(rng, n)) for k, n in enumerate([30, 40, 13, 14, 20, 9, 6, 5, 4, 25])] + [(50, ""), (51, None)]
    items += [(60, items[0][1])]  # an equal passage under a larger id
    docs = []
    for d in range(60):
        text = words(rng, rng.randint(0, 40)).split()
        if d % 3:
            p = (items[rng.randrange(10)][1] or "").split()
            cut = p[rng.randint(0, len(p) // 3) :]
            for _ in range(rng.choice([0, 1, 2, 5])):
                cut[rng.randrange(len(cut))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() + "," for x in cut]
        docs.append((d, " ".join(text)))
    docs += [(None, items[1][1]), (900, None), (901, "")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, matched int")
    rows = decontam.contaminated(df, bench, block_words).collect()
    want = brute_pairs(docs, items)
    assert {d for d, i in want if i == 60} == {d for d, i in want if i == 0} != set()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    kept = decontam.drop_contaminated(df, bench, block_words)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})


def test_items_of_any_type_keep_their_ids(spark):
    p = words(random.Random(2), 20)
    bench = spark.createDataFrame([("x", p), ("y", p), ("z", p.upper()), (None, None)], "item_id string, text string")
    df = spark.createDataFrame([("d", "before " + p), ("e", "none")], "doc_id string, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()) == [("d", "x"), ("d", "y"), ("d", "z")]


def test_nothing_to_compare(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "only four words here")], "item_id bigint, text string")
    assert decontam.contaminated(odd_docs, bench).count() == 0
    assert decontam.drop_contaminated(odd_docs, bench).count() == odd_docs.count()
    full = spark.createDataFrame([(1, words(random.Random(1), 20))], "item_id bigint, text string")
    assert decontam.contaminated(no_docs, full).count() == 0
    long_doc = odd_docs.where("doc_id = 103").select("text").first()[0].split()
    part = spark.createDataFrame([(1, " ".join(long_doc[20_000:20_030]))], "item_id bigint, text string")
    got = decontam.contaminated(odd_docs, part).collect()
    assert [(r.doc_id, r.doc_start, r.length) for r in got] == [(103, 20_000, 30)]


def verbatim(docs, items):
    """(doc, item) pairs whose document holds all words of the item in a row."""
    out = set()
    for d, text in docs:
        w = decontam.words_of(text)
        for i, passage in items:
            p = decontam.words_of(passage)
            if p and any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block_words", [400_000, 8])
def test_short_passages_match_as_a_whole(spark, block_words):
    rng = random.Random(9)
    items = [(n, words(rng, n)) for n in (1, 2, 3, 4)] + [(5, "北京是首都"), (6, "三加三"), (7, "กรุงเทพ"), (8, "GPT 模型"), (9, "..."), (10, None)]
    docs = []
    for n, (i, p) in enumerate(items):
        around = words(rng, 6), words(rng, 5)
        docs.append((2 * n, f"{around[0]} {(p or '').upper()}, {around[1]} {p}"))
        docs.append((2 * n + 1, f"{around[0]} {' '.join((p or '').split()[:-1])} other"))
    docs += [(100, "我知道北京是首都吧"), (101, "北京是国都"), (102, "三加"), (103, "ไปกรุงเทพแล้ว"), (104, "用gpt模型写"), (None, items[3][1]), (105, None), (106, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = decontam.contaminated(df, bench, block_words).collect()
    want = verbatim(docs, items)
    assert {(100, 5), (103, 7), (104, 8), (None, 4)} <= want and not {(101, 5), (102, 6)} & want
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.item_start == 0 and r.length == r.matched for r in rows)
    kept = decontam.drop_contaminated(df, bench, block_words)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})


def test_passages_without_blanks(spark):
    rng = random.Random(10)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    items = [(1, han(15) + "，" + han(14) + "？"), (2, han(40)), (3, "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(30)))]
    wrong = list(items[1][1])
    wrong[5] = wrong[17] = wrong[30] = "x"
    docs = [(k, han(50) + p + han(30)) for k, p in items] + [(4, han(9) + "".join(wrong)), (5, han(80)), (6, items[1][1][:10] + han(30))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start) for r in decontam.contaminated(df, bench).collect())
    assert [x[:2] for x in got] == sorted(brute_pairs(docs, items)) == [(1, 1), (2, 2), (3, 3), (4, 2)]
    assert [x[2] for x in got[:3]] == [50, 50, 50]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect()) == [5, 6]
    assert len(list(decontam.test_blocks(bench, 45))) > 1


def test_unlike_texts_under_one_id_are_decided_each(spark):
    rng = random.Random(14)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, c), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id bigint, text string, key string, fp bigint")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (5, "")])
    clash = docs.withColumn("_text_key", F.lit("keep")).withColumn("_text_key_", F.lit(1))
    kept = simhash.drop_near_duplicates(clash)
    assert kept.schema == clash.schema and {r._text_key for r in kept.collect()} == {"keep"}
    one = spark.createDataFrame([(1, a), (1, a), (2, a)], "doc_id bigint, text string")
    assert [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(one).collect()] == [(1, a)]
