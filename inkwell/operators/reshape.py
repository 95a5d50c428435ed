"""Reshaping: unpivot, code split, estimate/margin pivot, decode, year pivots,
trend tables, vintage harmonisation, unions (SURVEY §2.3, §2.4, §2.8)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.numeric import safe_div
from inkwell.functions.text import clean_name

# Wide survey column names: <base>_<e|m><number>. Anchored, so a base that
# itself ends in "e" or "m" (e.g. b90001e) is kept whole.
CODE_RE = r"^(.*)_([em])([0-9]+)$"
_CODE = re.compile(CODE_RE)


def value_columns(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def unpivot_wide(df: DataFrame, key: str = "geo_id", columns: Sequence[str] | None = None,
                 var: str = "var", value: str = "value") -> DataFrame:
    """All columns but ``key`` -> rows ``(key, var, ordinal, value)``.

    ``ordinal`` is the column's position, so row order stays explicit. Pass
    ``columns`` to unpivot a subset: they are selected *before* the unpivot,
    which keeps the parquet read pruned (a filter on ``var`` above the unpivot
    would not prune).
    """
    cols = list(columns) if columns is not None else value_columns(df, key)
    rows = F.array(*[F.struct(F.lit(c).alias(var), F.lit(i + 1).alias("ordinal"),
                              F.col(c).cast("double").alias(value)) for i, c in enumerate(cols)])
    return df.select(key, F.inline(rows))


def unpivot_named(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  name: str = "series", value: str = "count") -> DataFrame:
    """Named columns -> ``(keys..., name, value)`` via ``DataFrame.unpivot``."""
    return df.unpivot(list(keys), list(columns), name, value)


def split_code(df: DataFrame, col: str = "var") -> DataFrame:
    """Code -> base, type (e/m), num. Uses an anchored regex, not ``split``."""
    c = F.col(col)
    return df.withColumns({"base": F.regexp_extract(c, CODE_RE, 1),
                           "type": F.regexp_extract(c, CODE_RE, 2),
                           "num": F.regexp_extract(c, CODE_RE, 3)})


def pivot_estimate_margin(long_df: DataFrame, keys: Sequence[str] = ("geo_id", "base", "num"),
                          value: str = "value") -> DataFrame:
    """type rows -> columns ``e`` and ``m`` (values listed: no discovery job).

    Conditional aggregation over the keys; ``ordinal`` keeps the first position.
    Two rows for one cell are an error.
    """
    def cell(t):
        hit = F.col("type") == t
        return F.when(F.count_if(hit) > 1, F.raise_error(F.lit(f"several rows for one cell of type {t}")).cast(
            long_df.schema[value].dataType)).otherwise(F.max(F.when(hit, F.col(value)))).alias(t)

    return long_df.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"), cell("e"), cell("m"))


def code_pairs(columns: Iterable[str]) -> list[tuple[str, str | None, str | None]]:
    """Pair estimate and margin columns by schema: [(var, e_col, m_col)] in
    order of first appearance. Works on names only (metadata, not data)."""
    order: list[str] = []
    pairs: dict[str, dict[str, str]] = {}
    for c in columns:
        m = _CODE.match(c)
        if not m:
            continue
        base, typ, num = m.groups()
        var = f"{base}_{num}"
        if var not in pairs:
            pairs[var] = {}
            order.append(var)
        pairs[var][typ] = c
    return [(v, pairs[v].get("e"), pairs[v].get("m")) for v in order]


def decode_variables(wide: DataFrame, dictionary: DataFrame | None = None,
                     key: str = "geo_id", variables: Sequence[str] | None = None) -> DataFrame:
    """Wide survey table -> ``(key, var, ordinal, e, m, stub)`` for all geographies.

    The unpivot, code split and e/m pivot are fused: estimate and margin
    columns of a variable sit in the same input row, so pairing them by name
    and emitting one row per variable needs no shuffle at all (the plan is a
    scan + Generate). ``variables`` restricts the output and, since only
    those columns are selected, the parquet read.

    The dictionary holds one row per survey variable; the left join is left
    to Spark's size check (see ``left_join_dictionary``).
    """
    pairs = code_pairs(value_columns(wide, key))
    if variables is not None:
        wanted = set(variables)
        pairs = [p for p in pairs if p[0] in wanted]

    def val(c):
        return F.col(c).cast("double") if c else F.lit(None).cast("double")

    rows = F.array(*[F.struct(F.lit(v).alias("var"), F.lit(i + 1).alias("ordinal"),
                              val(e).alias("e"), val(m).alias("m"))
                     for i, (v, e, m) in enumerate(pairs)])
    long_df = wide.select(key, F.inline(rows))
    if dictionary is None:
        return long_df.withColumn("stub", F.lit(None).cast("string"))
    return left_join_dictionary(long_df, dictionary)


def left_join_dictionary(long_df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Label by variable code (dictionary: unique_id, stub).

    No broadcast hint: Spark broadcasts the dictionary when its estimated
    size is under ``autoBroadcastJoinThreshold``, and AQE re-checks the
    actual size at runtime; a dictionary beyond it gets a shuffle join."""
    dim = dictionary.select(F.col("unique_id").alias("var"), "stub")
    return long_df.join(dim, "var", "left").select(*long_df.columns, "stub")


def pivot_years(long_df: DataFrame, keys: Sequence[str], years: Sequence[int],
                value: str = "estimate", prefix: str = "x") -> DataFrame:
    """long ``(keys, year, value)`` -> one column per year (``x1995`` ...).

    Years are listed up front, so Spark does not run a job to discover them;
    the pivot is a single hash aggregation on ``keys``. Two rows for one cell,
    or a year that is not listed, are an error."""
    year, v = F.col("year"), F.col(value)
    dtype = long_df.schema[value].dataType
    odd = F.max(F.when(~F.coalesce(year.isin(list(years)), F.lit(False)), F.coalesce(year.cast("string"), F.lit("null"))))

    def cell(y):
        hit = year == y
        return (F.when(odd.isNotNull(), F.raise_error(F.concat(F.lit("year not listed: "), odd)).cast(dtype))
                .when(F.count_if(hit) > 1, F.raise_error(F.lit(f"several rows for one cell of year {y}")).cast(dtype))
                .otherwise(F.max(F.when(hit, v))).alias(f"{prefix}{y}"))

    return long_df.groupBy(*keys).agg(*[cell(y) for y in years])


def index_to_first(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                   columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Each column divided by its value in the partition's first row
    (``first_value`` over an ordered window); base 0 or null -> null."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                   Window.unboundedFollowing)
    return df.withColumns({c + suffix: safe_div(F.col(c), F.first(c).over(w)) for c in columns})


def trend_table(long_df: DataFrame, catalogue: DataFrame, catalogue_year: int, years: Sequence[int],
                newest: DataFrame, newest_year: int, key: str = "geo") -> DataFrame:
    """Label join -> drop margin -> pivot years -> join newest year -> index to first row.

    ``newest`` carries ``(key, variable, estimate)`` from another source; it is
    renamed to ``x<newest_year>``. The catalogue is sliced to one year so a
    label reworded between years cannot split a row.
    """
    labelled = left_join_catalogue(long_df.select(key, "variable", "year", "estimate"),
                                   catalogue, catalogue_year)
    wide = pivot_years(labelled, [key, "variable", "label"], years)
    new_col = f"x{newest_year}"
    joined = left_join_new_vintage(wide, newest, [key, "variable"], "estimate", new_col)
    cols = [f"x{y}" for y in years] + [new_col]
    return index_to_first(joined, [key], ["variable"], cols)


def left_join_catalogue(long_df: DataFrame, catalogue: DataFrame, year: int,
                        on: str = "variable") -> DataFrame:
    """Label by variable from one catalogue year (catalogue: name, label, year)."""
    cat = catalogue.where(F.col("year") == year).select(F.col("name").alias(on), "label")
    return long_df.join(cat, on, "left")


def label_intervals(catalogue: DataFrame) -> DataFrame:
    """(name, label, from_year, to_year): the years for which a variable's label holds. A label holds
    from the catalogue year that brings it to the one before the next wording (null: it still holds), so
    a skipped catalogue year splits nothing. Of two labels in one year the smaller counts."""
    one = catalogue.groupBy("name", "year").agg(F.min("label").alias("label"))
    by_year = Window.partitionBy("name").orderBy("year")        # a variable's catalogue years
    new = ~F.col("label").eqNullSafe(F.lag("label").over(by_year)) | (F.row_number().over(by_year) == 1)
    first = one.withColumn("_new", new).where("_new").select("name", "label", F.col("year").alias("from_year"))
    return first.withColumn("to_year", F.lead("from_year").over(Window.partitionBy("name").orderBy("from_year")) - 1)


def join_label_intervals(long_df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each row with the ``label`` of its own year and ``label_now``, the newest wording: a pivot by
    variable and ``label_now`` keeps one row however often a label was reworded."""
    year = F.col("year")
    spans = intervals.select(F.col("name").alias("_name"), "label", "from_year", "to_year")
    now = intervals.where("to_year is null").select(F.col("name").alias("_now"), F.col("label").alias("label_now"))
    joined = long_df.join(spans, (F.col("variable") == F.col("_name")) & (year >= F.col("from_year"))
                          & (F.col("to_year").isNull() | (year <= F.col("to_year"))), "left")
    return joined.join(now, F.col("variable") == F.col("_now"), "left").select(*long_df.columns, "label", "label_now")


def left_join_new_vintage(df: DataFrame, newest: DataFrame, keys: Sequence[str],
                          value: str, new_name: str) -> DataFrame:
    """Add the newest year's value as column ``new_name``."""
    return df.join(newest.select(*keys, F.col(value).alias(new_name)), list(keys), "left")


def semi_join_variables(df: DataFrame, wanted: DataFrame, on: str = "variable") -> DataFrame:
    """Keep rows whose code is in ``wanted`` (a DataFrame, not a driver-side list)."""
    return df.join(wanted.select(on).distinct(), on, "left_semi")


def vintage_harmonize(frames: Mapping[str, DataFrame], codes: Mapping[str, Sequence[str]],
                      names: Sequence[str], keep: Sequence[str] = ("geo", "parent", "year"),
                      margin_suffix: str = "_margin") -> DataFrame:
    """Rename each vintage's codes (``<code>E``/``<code>M``) to common names and stack.

    The mapping is keyed by (vintage, code): the same code may mean different
    groups in different vintages.
    """
    out = None
    for vintage, df in frames.items():
        ren = {}
        for name, code in zip(names, codes[vintage]):
            ren[code + "E"] = name
            ren[code + "M"] = name + margin_suffix
        cols = list(keep) + [c for n in names for c in (n, n + margin_suffix)]
        part = df.withColumnsRenamed(ren).select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def union_vintages(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by name; columns missing from a frame become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack frames with a literal source-name column."""
    out = None
    for name, f in frames.items():
        part = f.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def add_partition_literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def flatten_struct(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """Struct column -> one column per field, named ``<prefix>_<field>``."""
    prefix = col if prefix is None else prefix
    fields = df.schema[col].dataType.fieldNames()
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.col(f"{col}.{f}").alias(f"{prefix}_{f}") for f in fields])


def ribbon_series(df: DataFrame, keys: Sequence[str], series: Sequence[str],
                  margin_suffix: str = "_margin") -> DataFrame:
    """``(keys, series, estimate, lower, upper)`` behind an error-band chart."""
    rows = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("estimate"),
                              (F.col(s) - F.col(s + margin_suffix)).alias("lower"),
                              (F.col(s) + F.col(s + margin_suffix)).alias("upper")) for s in series])
    return df.select(*keys, F.inline(rows))
