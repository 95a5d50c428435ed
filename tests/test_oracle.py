"""Every registered job against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from inkwell.sources.tables import TABLES

from tests.conftest import SF_SMALL

from inkwell.plans import ORACLE, QUERIES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 25
    assert df.columns == ["geo_id", "var", "stub", "e", "universe", "share", "rank", "n_total"]


def test_sample_n_is_exact_and_repeatable(spark):
    a = [r.title_id for r in E.queries()["sample_n"](spark, SF_SMALL).collect()]
    b = [r.title_id for r in E.queries()["sample_n"](spark, SF_SMALL).collect()]
    assert len(a) == 10 and sorted(a) == sorted(b)
