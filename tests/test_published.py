"""
fact-check operator: the claim rounded to its digits must equal the computed
share. The underlying data are absent, so the counts are the published ones."""

from pyspark.sql import functions as F

from inkwell.operators import verify


def test_published_shares_pass_fact_check(spark):
    # (claim, parts, whole, claimed percent, digits)
    published = [
        ("federal workers", 69544.0, 432678.0, 16.0, 0),
        ("foreign-born", 364713.0, 1082273.0, 33.7, 1),
        ("commuters by transit", 55422.0, 571120.0, 9.7, 1),
    ]
    counts = spark.createDataFrame([(c, p, w) for c, p, w, _, _ in published], "claim string, parts double, whole double")
    metrics = counts.select(F.col("claim").alias("metric"), (F.col("parts") / F.col("whole") * 100).alias("computed"))
    claims = spark.createDataFrame([(c, c, v, d) for c, _, _, v, d in published],
                                   "claim string, metric string, value double, digits int")
    out = verify.fact_check(claims, metrics, ["metric"])
    assert out.where(~F.col("pass")).count() == 0


def test_wrong_claim_fails(spark):
    metrics = spark.createDataFrame([("m", 24.85)], "metric string, computed double")
    claims = spark.createDataFrame([("c", "m", 24.9, 1), ("d", "missing", 1.0, 1)],
                                   "claim string, metric string, value double, digits int")
    got = {r.claim: r["pass"] for r in verify.fact_check(claims, metrics, ["metric"]).collect()}
    assert got == {"c": False, "d": False}        # half-even gives 24.8; a missing metric never passes
