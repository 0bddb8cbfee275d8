import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from feedlens.llm import packing, tokens

from .conftest import words

ODD = [
    "a\x0bb c", "İstanbul  ẞ ﬁ é ́x", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "a b c", "I'll don't 12 3a", "\r\nx\ty", "中文 字符",
    "😀a b😀", "", "   ", "a ̈b", "ﬀ Å", "ab'  's x's' it''s", "ÿa× ÷b a_b_ __", "ΑΣ ΑΣΑ", "word<|endoftext|>", "ßS!! É.. ª º aªb", "a.b.c. x,,y; it's. 's. 'S!",
]


def test_pieces_give_the_librarys_ids(vocabulary):
    enc, lib = tokens.PieceEncoder(vocabulary), Tokenizer.from_file(vocabulary)
    assert enc.latin
    rng = random.Random(1)
    alphabet = "abcXYZ .,'!?-\n\té ßÀ1290<|>endoftext😀日́ "
    for t in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_other_vocabularies_fall_back_to_whole_texts():
    from feedlens.llm.catalog import vocabulary_path

    path = vocabulary_path("byte_bpe_50k.json")
    enc, lib = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert not enc.split
    for t in ODD:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1024), (500, 40), (60, 4)])
def test_counts_with_and_without_chunks(spark, odd_docs, odd_rows, vocabulary, chunk, overlap):
    lib = Tokenizer.from_file(vocabulary)
    got = tokens.token_counts(odd_docs, vocabulary, chunk, overlap).collect()
    want = [(str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_hard_texts_widen_the_overlap(spark, vocabulary):
    rng = random.Random(9)
    lib = Tokenizer.from_file(vocabulary)
    texts = ["x" * 5000, "ab" * 2000 + " " + "c" * 3000, words(rng, 900), "12 " * 1500, " ".join(ODD) * 30, "a" * 90 + " " + "b" * 400, " " * 700 + "a", "日本語" * 900, "<|endoftext|>" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, vocabulary, 200, 10).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_no_documents(no_docs, vocabulary):
    assert tokens.token_counts(no_docs, vocabulary).count() == 0
    assert packing.pack_documents(no_docs, vocabulary).count() == 0


def check_packing(rows, texts, lib, window, end=2):
    """Every id in exactly one piece, sequences gapless and short enough; texts: doc_id -> text."""
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [end] for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for d, all_ids in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(all_ids)
    used = []
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        used.append(at)
    return used


@pytest.mark.parametrize("window,open_windows,parts", [(4096, 16, 1), (64, 4, 7), (64, 1, 40), (16, 3, 3)])
def test_packing_is_exact(spark, vocabulary, window, open_windows, parts):
    rng = random.Random(window)
    texts = {i: words(rng, rng.choice([0, 1, 5, 40, 200])) for i in range(150)} | {900: None, 901: "", 902: words(rng, 3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(parts)
    rows = packing.pack_documents(df, vocabulary, 2, window, open_windows, min_cut=4, fan=4).collect()
    used = check_packing(rows, texts, Tokenizer.from_file(vocabulary), window)
    # little padding: at most the cuts that were too short to make, and the leftovers
    assert sum(window - n for n in used) <= 3 * len(used) + window * (parts + 1)


def test_packing_odd_rows(odd_docs, odd_rows, vocabulary):
    rows = packing.pack_documents(odd_docs, vocabulary).collect()
    lib = Tokenizer.from_file(vocabulary)
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert sum(r.length for r in rows) == total
    texts = {i: t for i, t in odd_rows if i is not None and i != 300}
    check = [r for r in rows if r.doc_id in texts]
    assert {r.doc_id for r in check} == set(texts)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packing_never_alters_ids(spark, vocabulary, kind):
    rng = random.Random(6)
    ids = [2**53 + 1, 2**53 + 3, 2**53 + 5, 2**62 + 7, None]
    texts = {i if i is None or kind == "bigint" else f"d{i}": words(rng, 9) for i in ids}
    df = spark.createDataFrame(list(texts.items()), f"doc_id {kind}, text string").repartition(5)
    rows = packing.pack_documents(df, vocabulary)
    assert rows.schema["doc_id"].dataType.simpleString() == kind
    check_packing(rows.collect(), texts, Tokenizer.from_file(vocabulary), 4096)
    assert {r.doc_id for r in rows.collect()} == set(texts)


def test_open_windows_are_bounded():
    rng = random.Random(2)
    w = packing.Windows(100, 5, 8)
    closed = []
    for i in range(2000):
        closed += w.place(i, 0, bytes(4 * rng.randint(1, 250)))
        assert len(w.open) <= 5
    assert all(100 - x[0] < 8 for x in closed)
    closed += w.merge()
    assert len(w.open) <= 1
