"""Hot-key join splitting returns exactly the plain join."""

from pyspark.sql import functions as F

from feedlens.operators.report import skew_safe_join


def test_skew_safe_join_matches_plain_join(spark):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(0, 97, 2)], "k STRING, w INT")
    got = sorted(tuple(r) for r in skew_safe_join(big, small, ["k"], hot_fraction=0.05).select("k", "v", "w").collect())
    want = sorted(tuple(r) for r in big.join(small, "k").select("k", "v", "w").collect())
    assert got == want and len(got) > 1000


def test_a_hot_key_gets_more_salts_the_hotter_it_is(spark):
    big = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([("hot", 1)], "k STRING, w INT")
    joined = skew_safe_join(big, small, ["k"], hot_fraction=0.01)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and joined.count() == 4000
