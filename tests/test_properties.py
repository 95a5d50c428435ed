"""Property checks: bands add up, decode/encode round trip, batches = whole."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import reshape
from inkwell.plans import QUERIES
from inkwell.sources.fixtures import f2_wide
from inkwell.sources.tables import Tables

from tests.conftest import SF_SMALL


def test_band_totals_add_up_to_universe(spark):
    bands = QUERIES["band_totals"](spark, SF_SMALL)
    per_geo_year = bands.groupBy("geo", "year").agg(F.sum("estimate_scaled").alias("s"))
    assert per_geo_year.where(F.abs(F.col("s") - 1.0) > 1e-6).count() == 0


def test_decode_then_encode_is_identity(spark):
    wide = f2_wide(Tables(spark, SF_SMALL))
    long_df = reshape.decode_variables(wide)
    back = long_df.select("geo_id", F.inline(F.array(
        F.struct(F.concat(F.regexp_extract("var", r"^(.*)_([0-9]+)$", 1), F.lit("_e"),
                          F.regexp_extract("var", r"^(.*)_([0-9]+)$", 2)).alias("col"), F.col("e").alias("v")),
        F.struct(F.concat(F.regexp_extract("var", r"^(.*)_([0-9]+)$", 1), F.lit("_m"),
                          F.regexp_extract("var", r"^(.*)_([0-9]+)$", 2)).alias("col"), F.col("m").alias("v")))))
    cols = [c for c in wide.columns if c != "geo_id"]
    rebuilt = back.groupBy("geo_id").pivot("col", cols).agg(F.first("v"))
    assert sorted(map(tuple, rebuilt.select(wide.columns).collect())) == sorted(map(tuple, wide.collect()))


def test_union_of_batches_equals_whole(spark):
    whole = QUERIES["union_batches"](spark, SF_SMALL)
    per_lang = QUERIES["classify_batches"](spark, SF_SMALL)
    assert whole.count() == per_lang.agg(F.sum("n_rows")).first()[0]


def test_subtotals_consistent(spark):
    assert QUERIES["subtotal_consistency"](spark, SF_SMALL).where(~F.col("consistent")).count() == 0


def test_distributed_rank_equals_window_rank(spark):
    from pyspark.sql import Window
    from inkwell.operators.ranking import distributed_rank
    rows = [(g, float(v) if v is not None else None) for g in ("a", "b") for v in
            [5, 5, 5, 3, None, 7, 7, 1, 2, 9] + [4] * 30 + list(range(20, 60))]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double")
    for asc in (False, True):
        order = F.col("v").asc_nulls_last() if asc else F.col("v").desc_nulls_last()
        want = df.select("id", F.rank().over(Window.partitionBy("g").orderBy(order)).cast("bigint").alias("r"),
                         F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
        got = distributed_rank(df, "v", ["g"], ascending=asc).select("id", F.col("rank").alias("r"),
                                                                                F.col("n_total").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        g1 = distributed_rank(df.where("g = 'a'"), "v", ascending=asc).select("id", "rank")
        w1 = df.where("g = 'a'").select("id", F.rank().over(Window.orderBy(order)).cast("bigint").alias("rank"))
        assert sorted(map(tuple, g1.collect())) == sorted(map(tuple, w1.collect()))


def _gap_median_frame(spark):
    rows = [(g, i, float(v) if v is not None else None) for g in ("a", "b") for i, v in enumerate(
        [5, 5, 5, 3, None, 7, 7, 1, 2, 9, None] + [4] * 30 + list(range(20, 60)) + ([8] if g == "b" else []))]
    return spark.createDataFrame(rows, "g string, unit long, v double")


def test_distributed_gap_to_next_equals_lead(spark):
    from pyspark.sql import Window
    from inkwell.operators.ranking import distributed_gap_to_next
    df = _gap_median_frame(spark)
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), F.col("unit"))
    want = df.select("g", "unit", (F.col("v") - F.lead("v").over(w)).alias("gap"))
    got = distributed_gap_to_next(df, ["g"], "v", "unit").select("g", "unit", F.col("gap_to_next").alias("gap"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    twins = spark.createDataFrame([("a", 1, 3.0), ("a", 1, 3.0), ("a", 2, 1.5)], "g string, unit long, v double")
    got = distributed_gap_to_next(twins, ["g"], "v", "unit").select("gap_to_next")
    assert sorted(map(str, (r[0] for r in got.collect()))) == ["0.0", "1.5", "None"]


def test_distributed_median_equals_median(spark):
    from inkwell.operators.ranking import distributed_median
    df = _gap_median_frame(spark)
    want = df.groupBy("g").agg(F.median("v").alias("m"))
    got = distributed_median(df, ["g"], "v", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranks_of_any_type_hot_groups_and_close_values(spark):
    """One group holds a third of the rows, another has all its values close
    together; strings, dates and decimals rank like numbers."""
    from pyspark.sql import Window
    from inkwell.operators.ranking import distributed_rank
    i = F.col("id")
    df = spark.range(900).select(
        i, F.when(i % 3 == 0, "hot").when(i % 3 == 1, "close").otherwise((i % 50).cast("string")).alias("g"),
        F.when(i % 3 == 1, i * 1e-9).otherwise((i * 7919) % 401).alias("n")).select(
            "*", F.format_string("k%s", (i * 31 % 97).cast("string")).alias("s"),
            F.date_add(F.lit("2020-01-01").cast("date"), (i % 200).cast("int")).alias("d"),
            F.when(i % 11 > 0, (F.col("n") * 1.5).cast("decimal(20,9)")).alias("c"))
    for v in ("n", "s", "d", "c"):
        want = df.select("id", F.rank().over(Window.partitionBy("g").orderBy(F.col(v).desc_nulls_last())).alias("r"))
        got = distributed_rank(df, v, ["g"]).select("id", F.col("rank").alias("r"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), v
    from inkwell.operators.ranking import _ranged
    ranged = _ranged(df.select("g", "n").distinct(), ["g"], "n", True)
    per = {r.g: r.k for r in ranged.groupBy("g").agg(F.count_distinct("_p").alias("k")).collect()}
    assert per["hot"] > 1 and per["close"] > 1


def test_scramble_uses_the_whole_key_and_sample_is_a_top_n(spark):
    from inkwell.functions.numeric import mix32, mix64
    from inkwell.operators.ranking import sample_n
    keys = spark.range(0, 200000)
    assert keys.select(mix32(F.col("id"), 42).alias("h")).distinct().count() == 200000
    high = spark.range(0, 1000).select((F.col("id") * (1 << 32) + 5).alias("id"))
    assert high.select(mix64(F.col("id"), 42)[0].alias("h")).distinct().count() > 990
    plan = sample_n(keys, "id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_fact_check_takes_any_digits(spark):
    from inkwell.operators.verify import fact_check
    claims = spark.createDataFrame([("a", 1, 12300.0, -2), ("b", 2, 0.1234568, 7), ("c", 3, 5.0, None), ("d", 9, 1.0, 0)],
                                   "claim string, k int, value double, digits int")
    metrics = spark.createDataFrame([(1, 12345.0), (2, 0.12345678), (3, 5.0)], "k int, computed double")
    got = {r.claim: r for r in fact_check(claims, metrics, ["k"]).collect()}
    assert got["a"]["pass"] and got["b"]["pass"] and not got["c"]["pass"] and not got["d"]["pass"]
    with pytest.raises(Exception, match="out of range"):
        fact_check(claims.withColumn("digits", F.lit(19)), metrics, ["k"]).collect()


def test_small_means_are_kept(spark):
    from inkwell.operators.shares import stats_by_category
    df = spark.createDataFrame([("a", 1e-11), ("a", 3e-11), ("b", 1e30), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: (r["count"], r.avg_rating, r.med_rating) for r in stats_by_category(df, ["g"], "v").collect()}
    assert got == {"a": (2, pytest.approx(2e-11), pytest.approx(2e-11)), "b": (2, 1e30, 1e30), "c": (1, None, None)}


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace
    from inkwell.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_distributed_ranks_equal_single_ranks(spark):
    """Several ranks sharing one checkpoint equal the ranks taken one by one."""
    from pyspark.sql import Window
    from inkwell.operators.ranking import distributed_ranks
    rows = [(i, g, float(v) if v is not None else None, float((7 * i) % 11))
            for i, (g, v) in enumerate((g, v) for g in ("a", "b") for v in [5, 5, 3, None, 7, 1, 2, 9] * 3)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    got = distributed_ranks(df, [("v", ["g"], False, "r_v"), ("w", [], True, "r_w")]).select("id", "r_v", "r_w")
    want = df.select("id",
                     F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())).cast("bigint").alias("r_v"),
                     F.rank().over(Window.orderBy(F.col("w").asc_nulls_last())).cast("bigint").alias("r_w"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_has_adaptive_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
