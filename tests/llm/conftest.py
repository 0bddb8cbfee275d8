import random

import pytest

DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, size bigint, key string, row int"
#: Columns beside those of documents, named like internals or results of the operators.
CLASH = (0.5, 7, 9, "k", 3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, a very long one, ties and repeated rows, extra columns."""
    rng = random.Random(5)
    long_text = words(rng, 40_000)
    base = [(i, words(rng, rng.randint(1, 60))) for i in range(40)]
    base += [(100, None), (101, ""), (102, "  \n\t "), (103, long_text), (None, "a row without an id"), (None, None)]
    base += [(200, "the same text twice over here"), (201, "the same text twice over here"), (202, "ÄÖÜ ß é 日本語 😀 ok")]
    base += [(300, "a repeated row"), (300, "a repeated row")]
    return base


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    langs = ("en", "de", None)
    return spark.createDataFrame([(i, t, langs[k % 3], "s", len(t or ""), *CLASH) for k, (i, t) in enumerate(odd_rows)], DOC_DDL)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_DDL)


@pytest.fixture(scope="session")
def vocabulary():
    from feedlens.llm.catalog import vocabulary_path

    return vocabulary_path()
