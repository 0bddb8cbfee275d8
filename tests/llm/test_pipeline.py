import os
import random
import shutil
import subprocess
import sys
import tempfile

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from feedlens.llm import catalog, decontam
from feedlens.llm.common import id_fold

from .conftest import words
from .test_near_copies import brute_fp
from .test_tokens_packing import check_packing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def corpus(spark):
    """A small corpus with planted toxic, poor, copied and leaking documents."""
    rng = random.Random(12)
    vocab = words(rng, 500).split()
    prose = lambda n: ". ".join(" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(n))
    passages = [(k, prose(3)) for k in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(1500):
        k = rng.choice(["clean"] * 6 + ["toxic"] * 2 + ["poor"])
        text = prose(rng.randint(6, 20))
        if k == "toxic":
            w = text.split()
            for _ in range(len(w) // 12):
                w[rng.randrange(len(w))] = rng.choice(["vermin", "verminous", "filth", "filthy"])
            text = " ".join(w)
        if k == "poor":
            text = " ".join(rng.choice(vocab).upper() + "!!" for _ in range(60))
        docs.append((i, text))
        labels.append((i, int(k != "poor"), int(k == "toxic")))
        kind[i] = k
    clean = [i for i in kind if kind[i] == "clean"]
    for n, i in enumerate(clean[:20]):
        docs.append((5000 + n, docs[i][1]))
        kind[5000 + n] = "copy"
    for n, i in enumerate(clean[20:30]):
        docs.append((6000 + n, docs[i][1] + ". " + passages[n % 5][1] + ". " + prose(4)))
        kind[6000 + n] = "leak"
    folder = tempfile.mkdtemp(prefix="run-")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(docs), kind, passages


def test_every_stage_acts_on_all_that_is_left(spark, corpus):
    folder, texts, kind, passages = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    left, after = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, folder)
        assert out.columns == docs.columns
        path = tempfile.mkdtemp(prefix="run-") + "/" + name
        out.write.parquet(path)
        left = spark.read.parquet(path)
        after.append({r.doc_id for r in left.select("doc_id").collect()})
    clean = {i for i, k in kind.items() if k == "clean"}
    toxic = {i for i, k in kind.items() if k == "toxic"}
    poor = {i for i, k in kind.items() if k == "poor"}
    assert len(toxic - after[0]) >= 0.9 * len(toxic) and len(clean & after[0]) >= 0.97 * len(clean)
    assert len(poor - after[1]) >= 0.9 * len(poor) and len(clean & after[1]) >= 0.95 * len(clean & after[0])
    # near duplicates and leaks against brute force on what each stage was given
    fps = {i: brute_fp(texts[i]) for i in after[1]}
    want = set()
    for i in sorted(after[1]):
        if not any((fps[i] ^ fps[j]).bit_count() <= 4 for j in want):
            want.add(i)
    assert after[2] == want and not any(kind[i] == "copy" for i in after[2])
    low = {i: " ".join(decontam.words_of(texts[i])) for i in after[2]}
    leaks = {i for i, t in low.items() if any(" ".join(decontam.words_of(p)) in t for _, p in passages)}
    assert after[3] == after[2] - leaks and leaks
    rows = corpus_pipeline.STAGES[-1][1](spark, left, folder).collect()
    check_packing(rows, {i: texts[i] for i in after[3]}, Tokenizer.from_file(catalog.vocabulary_path()), 4096)


def test_run_equals_the_stages(spark, corpus):
    folder, texts, _, _ = corpus
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert got and got <= set(texts)


def test_stages_take_odd_rows_and_empty_tables(spark, corpus, odd_docs, no_docs):
    folder = corpus[0]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == odd_docs.columns
            docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *catalog.QUERIES} <= names and len(catalog.QUERIES) == 13
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_the_rest_imports_without_this_part():
    copy = tempfile.mkdtemp(prefix="run-") + "/repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and 'news_digest' in n; print(len(n))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_fold_of_the_contract(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(50).select("id", id_fold("id", 4)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}
