"""Scalar text functions."""

from pyspark.sql import functions as F

from feedlens.functions import text as T


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "x STRING").select(col(F.col("x")).alias("y")).collect()[0].y


def test_py_title(spark):
    assert _one(spark, T.py_title, "zero-day log4j") == "Zero-Day Log4J"


def test_cve_truncation(spark):
    assert _one(spark, T.extract_cves, "see cve-2024-123456789 and CVE-2024-1234") == ["CVE-2024-1234", "CVE-2024-1234567"]


def test_normalize_title_unicode(spark):
    assert _one(spark, T.normalize_title, "État: Log4j² ½ x!") == "état log4j² ½ x"


def test_safe_url(spark):
    assert _one(spark, T.safe_url, "HTTPS://u@h:1") == "HTTPS://u@h:1"
    assert _one(spark, T.safe_url, "ftp://x") is None
    assert _one(spark, T.safe_url, "http://") is None


def test_strip_and_collapse(spark):
    assert _one(spark, T.strip_html, "\n\t<p>Hello <b>world</b></p> ") == "Hello  world"
    assert _one(spark, lambda c: T.collapse_truncate(c, 5), "a \n\t b   c") == "a b c"


def test_keywords(spark):
    kws = _one(spark, T.extract_keywords, "Lazarus uses ransomware against Microsoft Exchange; This From CVE-2023-0001")
    assert "CVE-2023-0001" in kws and "ransomware" in kws and "lazarus" in kws and "exchange" in kws
    assert "this" not in kws and "from" not in kws


def test_fingerprint_strips_query(spark):
    df = spark.createDataFrame([("Big News!", "https://x.com/a/?utm=1"), ("big  news", "HTTPS://X.COM/a")], "t STRING, u STRING")
    a, b = [r.fp for r in df.select(T.fingerprint("t", "u").alias("fp")).collect()]
    assert a == b and len(a) == 16


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_py_title_of_a_long_word_splits_it_beside_the_lambda(spark):
    words = ["e" * 30_000, "über-Ω x9y éA", "", "😀ab'cd", "  a"]
    df = spark.createDataFrame([(w,) for w in words], "x STRING").select("x", T.py_title("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == {w: w.title() for w in words}
    assert "split(" not in _plan(df.select("y")).partition("lambdafunction(")[2]


def test_terms_are_looked_for_in_a_text_that_is_computed_once(spark):
    rows = [(1, "x.Ransomware hits"), (2, "x.nothing"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id INT, raw STRING").select("id", F.regexp_extract("raw", r"^x\.(.*)", 1).alias("title"))
    hits = df.where(T.contains_any(F.lower("title"), ["breach", "RANSOM", "botnet", "phish"]))
    assert [r.id for r in hits.collect()] == [1]
    assert _plan(hits).count("regexp_extract") <= 3  # the filter, what it says of nulls, and the column
    assert df.select("id", T.contains_any(F.lower("title"), ["a"]).alias("h")).where("h is null").collect()[0].id == 3
    found = df.select("id", F.explode(T.known_term_hits(F.lower("title"), ["hit", "ransom", "wiper", "phish"])).alias("k"))
    assert sorted((r.id, r.k) for r in found.collect()) == [(1, "hit"), (1, "ransom")]
    assert _plan(found).count("regexp_extract") <= 4
