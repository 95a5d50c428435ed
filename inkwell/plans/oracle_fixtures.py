"""The F1-F8 fixtures restated as DuckDB SQL CTEs for the oracle.

Written from the fixture definitions (FIXTURES.md §2), not from the Spark
code: the oracle uses the direct formulation (e.g. ``count(DISTINCT ...)``)
where the Spark side uses a cheaper equivalent plan.
"""

from __future__ import annotations

from inkwell.sources.fixtures import (
    COMMON_NAMES, F1_BASE, F2_BASE, F2_TRAP, F3_FIXES, F8_CELL, F8_COLS, F8_ROWS, SEGMENTS, VINTAGES,
)


def r6(expr: str, alias: str) -> str:
    """Reported doubles are rounded to 6 digits on both sides."""
    return f"round({expr}, 6) + 0.0 AS {alias}"


def _seg_case(col: str) -> str:
    whens = " ".join(f"WHEN '{s}' THEN '{i + 2:03d}'" for i, s in enumerate(SEGMENTS))
    return f"CASE {col} {whens} END"


def f1_long() -> str:
    seg = _seg_case("c_mktsegment")
    return f"""
f1_join AS (
  SELECT n_nationkey AS geo, n_regionkey AS parent, CAST(year(o_orderdate) AS INTEGER) AS year,
         c_mktsegment, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f1_long AS (
  SELECT geo, parent, year, '{F1_BASE}_' || {seg} AS variable,
         CAST(count(*) AS DOUBLE) AS estimate, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS moe
  FROM f1_join GROUP BY geo, parent, year, c_mktsegment
  UNION ALL
  SELECT geo, parent, year, '{F1_BASE}_001', CAST(count(*) AS DOUBLE), CAST(count(DISTINCT o_custkey) AS DOUBLE)
  FROM f1_join GROUP BY geo, parent, year)"""


def f1_var(common: str) -> str:
    return f"{F1_BASE}_{COMMON_NAMES.index(common) + 1:03d}"


def f1_wide(vintage: str) -> str:
    """CTE ``f1_<vintage>`` (needs f1_long)."""
    _, y0, y1, codes = next(v for v in VINTAGES if v[0] == vintage)
    cols = []
    for common, code in zip(COMMON_NAMES, codes):
        v = f1_var(common)
        cols.append(f"max(CASE WHEN variable = '{v}' THEN estimate END) AS \"{code}E\"")
        cols.append(f"max(CASE WHEN variable = '{v}' THEN moe END) AS \"{code}M\"")
    return f"""
f1_{vintage} AS (
  SELECT geo, parent, year, {', '.join(cols)}
  FROM f1_long WHERE year BETWEEN {y0} AND {y1} GROUP BY geo, parent, year)"""


def f1_catalogue() -> str:
    label = "CASE name WHEN '" + F1_BASE + "_001' THEN 'Total' " + " ".join(
        f"WHEN '{F1_BASE}_{i + 2:03d}' THEN '{s.capitalize()}'" for i, s in enumerate(SEGMENTS)) + " END"
    return f"""
f1_cat_names AS (SELECT DISTINCT variable AS name, year FROM f1_long),
f1_catalogue AS (
  SELECT name, CASE WHEN year < 1998 THEN 'Estimate!!' ELSE 'Estimate!!Total:!!' END || {label} AS label, year
  FROM f1_cat_names)"""


def f1_harmonized() -> str:
    """CTE ``f1_harm``: common names from the three vintages (needs f1_v1..v3)."""
    parts = []
    for name, _, _, codes in VINTAGES:
        cols = ", ".join(f"\"{c}E\" AS {n}, \"{c}M\" AS {n}_margin" for n, c in zip(COMMON_NAMES, codes))
        parts.append(f"SELECT geo, parent, year, {cols} FROM f1_{name}")
    return "\nf1_harm AS (" + " UNION ALL ".join(parts) + ")"


def f1_all() -> str:
    return ",".join([f1_long(), f1_wide("v1"), f1_wide("v2"), f1_wide("v3"), f1_harmonized()])


F2_MEASURES = (
    [(f"{F2_BASE}_e001", "c_custkey IS NOT NULL"), (f"{F2_BASE}_m001", "c_acctbal < 0")]
    + [x for i, s in enumerate(SEGMENTS) for x in (
        (f"{F2_BASE}_e{i + 2:03d}", f"c_mktsegment = '{s}'"),
        (f"{F2_BASE}_m{i + 2:03d}", f"c_mktsegment = '{s}' AND c_acctbal < 0"))]
    + [(f"{F2_TRAP}_e001", "c_acctbal >= 5000"), (f"{F2_TRAP}_m001", "c_acctbal >= 9000"),
       (f"{F2_TRAP}_e002", "c_acctbal < 5000"), (f"{F2_TRAP}_m002", "c_acctbal < 1000")])
F2_COLS = [n for n, _ in F2_MEASURES]


def f2_wide() -> str:
    nat_cols = ", ".join(f"CAST(count_if({p}) AS DOUBLE) AS {n}" for n, p in F2_MEASURES)
    reg_cols = ", ".join(f"CAST(coalesce(sum({n}), 0) AS DOUBLE) AS {n}" for n in F2_COLS)
    plain = ", ".join(F2_COLS)
    return f"""
f2_nat AS (
  SELECT n_nationkey, n_regionkey, {nat_cols}
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
f2 AS (
  SELECT '0500000us' || CAST(n_nationkey AS VARCHAR) AS geo_id, {plain} FROM f2_nat
  UNION ALL
  SELECT '0400000us' || CAST(r_regionkey AS VARCHAR) AS geo_id, {reg_cols}
  FROM region LEFT JOIN f2_nat ON n_regionkey = r_regionkey GROUP BY r_regionkey)"""


def f2_dictionary() -> str:
    seg = _seg_case("c_mktsegment")
    return f"""
f2_dict AS (
  SELECT DISTINCT '{F2_BASE}_' || {seg} AS unique_id,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS stub, true AS is_leaf
  FROM customer
  UNION ALL SELECT '{F2_BASE}_001', 'Total customers', false
  UNION ALL SELECT '{F2_TRAP}_001', 'Balance of 5000 or more', true
  UNION ALL SELECT '{F2_TRAP}_002', 'Balance under 5000', true)"""


def f2_long() -> str:
    """CTE ``f2_long`` (geo_id, var, ordinal, e, m) by plain UNION ALL; needs f2."""
    pairs, seen = [], []
    for n in F2_COLS:
        base, rest = n.rsplit("_", 1)
        key = f"{base}_{rest[1:]}"
        if key not in seen:
            seen.append(key)
    for i, key in enumerate(seen):
        base, num = key.rsplit("_", 1)
        pairs.append(f"SELECT geo_id, '{key}' AS var, {i + 1} AS ordinal, {base}_e{num} AS e, {base}_m{num} AS m FROM f2")
    return "\nf2_long AS (" + " UNION ALL ".join(pairs) + ")"


def f3() -> str:
    fixes = ", ".join(f"('{k}', '{v}')" for k, v in sorted(F3_FIXES.items()))
    return rf"""
f3_raw AS (
  SELECT p_partkey AS title_id,
         CASE WHEN p_partkey % 37 = 0 THEN p_name
              ELSE p_name || ' (' || CAST(1950 + p_partkey % 74 AS VARCHAR) || ')' END AS title,
         CASE WHEN p_partkey % 50 = 0 THEN regexp_replace(p_brand, '^Brand', 'Brnad') || chr(9)
              ELSE p_brand END AS state,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice / 100 END AS rating,
         CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS multiple_locations,
         p_type AS description
  FROM part),
f3_fix(bad, good) AS (VALUES {fixes}),
f3_trim AS (
  SELECT *, regexp_replace(state, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS state_t,
         TRY_CAST(nullif(regexp_extract(title, '\((\d{{4}})\)', 1), '') AS INTEGER) AS year_t
  FROM f3_raw),
f3 AS (
  SELECT title_id, regexp_replace(title, '\s*\(\d{{4}}\)\s*$', '') AS title,
         coalesce(f3_fix.good, state_t) AS state, rating, multiple_locations, description AS genre,
         year_t AS year, CAST(floor(year_t / 10) * 10 AS INTEGER) AS year_bin
  FROM f3_trim LEFT JOIN f3_fix ON f3_trim.state_t = f3_fix.bad)"""


def f4() -> str:
    return """
f4 AS (
  SELECT n_regionkey AS district, n_nationkey AS school, o_orderpriority AS grade,
         o_orderstatus AS subject, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(count(*) AS BIGINT) AS tested, CAST(count_if(o_totalprice > 250000) AS BIGINT) AS passed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""


def f5() -> str:
    return """
f5_votes AS (
  SELECT p_partkey, coalesce(count_if(l_returnflag = 'A'), 0) AS a, coalesce(count_if(l_returnflag = 'R'), 0) AS r
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey),
f5_runoff AS (
  SELECT p_partkey AS precinct_geo,
         CASE WHEN a + r > 0 THEN CAST(round_even(CAST(a AS DOUBLE) * 100.0 / (a + r), 1) AS VARCHAR) ELSE 'NaN' END AS gonzalez,
         CASE WHEN a + r > 0 THEN CAST(round_even(CAST(r AS DOUBLE) * 100.0 / (a + r), 1) AS VARCHAR) ELSE 'NaN' END AS higgins,
         CAST(a + r AS VARCHAR) AS precinct_total
  FROM f5_votes),
f5_first_votes AS (
  SELECT p_partkey, coalesce(count_if(l_returnflag = 'A'), 0) AS a, coalesce(count_if(l_returnflag = 'R'), 0) AS r
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linestatus = 'F' GROUP BY p_partkey),
f5_first AS (
  SELECT p_partkey AS precinct_geo,
         CASE WHEN a > r THEN 'Gonzalez' WHEN r > a THEN 'Higgins' ELSE '?' END AS winner
  FROM f5_first_votes),
f5_demo AS (
  SELECT p_partkey AS precinct_geo,
         CASE WHEN p_partkey % 23 = 0 THEN '?' ELSE lower(p_type) END AS race,
         CASE WHEN p_partkey % 23 = 0 THEN '?' ELSE CAST(p_size AS VARCHAR) END AS immigrant_prop
  FROM part),
f5 AS (
  SELECT r.precinct_geo, r.gonzalez, r.higgins, r.precinct_total, f.winner, d.race, d.immigrant_prop
  FROM f5_runoff r LEFT JOIN f5_first f ON r.precinct_geo = f.precinct_geo
  LEFT JOIN f5_demo d ON r.precinct_geo = d.precinct_geo),
f5_norm AS (
  SELECT precinct_geo,
         coalesce(CASE WHEN isnan(TRY_CAST(gonzalez AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(gonzalez AS DOUBLE) END, 0.0) AS gonzalez,
         coalesce(CASE WHEN isnan(TRY_CAST(higgins AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(higgins AS DOUBLE) END, 0.0) AS higgins,
         coalesce(CASE WHEN isnan(TRY_CAST(precinct_total AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(precinct_total AS DOUBLE) END, 0.0) AS total_votes,
         winner AS first_round_winner,
         CASE WHEN race = '?' THEN '' ELSE upper(substr(race, 1, 1)) || substr(race, 2) END AS race,
         CASE WHEN immigrant_prop = '?' THEN '' ELSE immigrant_prop || '%' END AS immigrant_label,
         CASE WHEN immigrant_prop = '?' THEN NULL ELSE TRY_CAST(immigrant_prop AS DOUBLE) END AS immigrant_pct
  FROM f5)"""


def f6() -> str:
    return """
f6 AS (SELECT user_id AS site, value AS reading, ts, event_type AS zone FROM events)"""


def f8() -> str:
    return f"""
f8_points AS (
  SELECT event_id AS point_id, dayofmonth(ts) + CAST(hour(ts) AS DOUBLE) / 24.0 AS x, value AS y FROM events),
f8_rect AS (
  SELECT i AS area_id, floor(i / {F8_ROWS}) * {F8_CELL} AS x0, (i % {F8_ROWS}) * {F8_CELL} AS y0,
         floor(i / {F8_ROWS}) * {F8_CELL} + {F8_CELL} AS x1, (i % {F8_ROWS}) * {F8_CELL} + {F8_CELL} AS y1
  FROM range({F8_COLS * F8_ROWS}) t(i))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
