"""Plan properties: no Python outside enrichment, pushed predicates and
pruned reads, shuffle-free decode, bounded per-group top-k."""

import re

import pytest

from inkwell.plans import QUERIES

from tests.conftest import SF_SMALL

PY_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas")
STAGED = {"scan_pipe_delimited", "scan_dictionary", "sink_csv", "scan_headerless_csv", "scan_precincts",
          "incremental_enrich", "client_retry_queue"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STAGED))
def test_no_python_in_any_job(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert not any(n in plan for n in PY_NODES)


def test_topk_uses_window_group_limit(spark):
    df = QUERIES["topk_per_group"](spark, SF_SMALL)
    assert "WindowGroupLimit" in _plan(df)


def test_decode_is_shuffle_free_after_the_fixture(spark):
    from inkwell.operators import reshape
    wide = spark.createDataFrame([("g", 1.0, 0.1)], "geo_id string, b1_e001 double, b1_m001 double")
    plan = _plan(reshape.decode_variables(wide))
    assert "Exchange" not in plan and "Generate" in plan


def test_title_scan_is_pruned(spark):
    plan = _plan(QUERIES["title_year_split"](spark, SF_SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("value") >= 70).select("user_id")
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,70.0)]" in _plan(ev)


def test_decode_pushes_key_and_prunes_columns_on_staged_table(spark):
    """A staged wide table: the geography predicate reaches the parquet scan
    and only the requested variables' columns are read, before the unpivot."""
    from pyspark.sql import functions as F
    from inkwell.operators import reshape
    from inkwell.session import scratch_path
    from inkwell.sources.fixtures import f2_wide
    from inkwell.sources.tables import Tables
    path = scratch_path(spark, "wide")
    f2_wide(Tables(spark, SF_SMALL)).write.parquet(path)
    wide = spark.read.parquet(path).where(F.col("geo_id") == "0500000us7")
    df = reshape.decode_variables(wide, variables=["b90001_001", "b90001_002"])
    plan = _plan(df)
    assert "EqualTo(geo_id,0500000us7)" in plan
    assert ("ReadSchema: struct<geo_id:string,b90001_e001:double,b90001_m001:double,"
            "b90001_e002:double,b90001_m002:double>") in plan
    assert {r.var for r in df.collect()} == {"b90001_001", "b90001_002"}


YEARLY = {"scan_vintages_long": False, "filter_compound": True, "filter_in_list": False, "choropleth_bins": False,
          "unpivot_named": False, "growth_ratio": False, "order_flip": False}


@pytest.mark.parametrize("key", sorted(YEARLY))
def test_year_filters_are_partition_filters(spark, key):
    """Trend jobs read the stored extract, only the folders of the asked years, and no raw table."""
    df = QUERIES[key](spark, SF_SMALL)
    scans = [line for line in _plan(df).splitlines() if "FileScan parquet" in line]
    assert scans and all("/yearly-extract-" in f and "/year=" in f for f in df.inputFiles())
    assert all(re.search(r"PartitionFilters: \[[^]]*year", s) for s in scans)
    if YEARLY[key]:
        assert all("(geo,7)" in s for s in scans)


def test_yearly_extract_is_built_from_filtered_scans(spark):
    """Built for some years and nations alone, the cube reads only those."""
    from inkwell.sources.fixtures import f1_long
    from inkwell.sources.tables import Tables
    plan = _plan(f1_long(Tables(spark, SF_SMALL), years=[1999], geos=[7]))
    assert "GreaterThanOrEqual(o_orderdate" in plan and ("EqualTo(c_nationkey,7)" in plan or "In(c_nationkey" in plan)


def test_vintages_read_each_year_once(spark):
    """Three vintages, each its own years: no folder of the extract is read twice."""
    df = QUERIES["vintage_harmonize"](spark, SF_SMALL)
    scans = [line for line in _plan(df).splitlines() if "FileScan parquet" in line]
    bounds = sorted(tuple(map(int, re.findall(r"year#\d+ [<>]= (\d+)", s.split("PartitionFilters")[1].split("PushedFilters")[0])))
                    for s in scans)
    assert bounds == [(1995, 1997), (1998, 1999), (2000, 2001)]


def test_precinct_jobs_read_the_votes_once_without_a_join_of_views(spark):
    for key in ("precinct_winner", "no_vote_flag", "legend_classes", "winner_flip"):
        assert _plan(QUERIES[key](spark, SF_SMALL)).count("lineitem.parquet") <= 1


def test_literal_tables_are_sized_at_plan_time(spark):
    """Small fixed tables (band maps, enum sets, rings) are built so that
    Spark's plan-time size check broadcasts them; nested types survive."""
    from inkwell.sources.io import literal_table
    big = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_returnflag")
    tags = literal_table(spark, [("A", "x"), ("R", "y")], "l_returnflag string, tag string")
    assert "BroadcastHashJoin" in _plan(big.join(tags, "l_returnflag", "left"))
    ring = [{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}]
    got = literal_table(spark, [(7, ring)], "area_id long, ring array<struct<x:double,y:double>>").collect()
    assert got[0].area_id == 7 and [(p.x, p.y) for p in got[0].ring] == [(0.0, 1.0), (2.0, 3.0)]
