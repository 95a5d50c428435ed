"""Delimited sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import clean_name


def normalize_names_values(df: DataFrame) -> DataFrame:
    """snake_case lower-case names (digit-leading -> ``x`` prefix) and
    lower-cased string values; other types pass through."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.lower(c)
        cols.append(c.alias(clean_name(f.name)))
    return df.select(*cols)


def header_of(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names from the header line only (one small read, no inference)."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(sep) if first else []


def wide_survey_schema(names: list[str]) -> T.StructType:
    """Wide survey tables: first column is the geography key, the rest are numbers."""
    fields = [T.StructField(names[0], T.StringType())]
    fields += [T.StructField(n, T.DoubleType()) for n in names[1:]]
    return T.StructType(fields)


def scan_pipe_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Pipe-delimited table with header -> normalized names and string case.

    The schema is explicit (derived from the header when not given): no
    inference pass over the data. Every file's header is checked against it;
    a file whose columns differ in name or order is an error, never read by
    position.
    """
    if schema is None:
        schema = wide_survey_schema(header_of(spark, path, "|"))
    df = (spark.read.option("header", True).option("sep", "|")
          .option("enforceSchema", False).schema(schema).csv(path))
    return normalize_names_values(df)


def scan_headerless_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV without header; columns take the names of ``schema`` by position."""
    return spark.read.option("header", False).schema(schema).csv(path)


REJECT = "_line"


def scan_delimited_checked(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                           header: bool = False) -> DataFrame:
    """A delimited file with its bad rows kept: the columns of ``schema``, ``_line`` (the raw text of a
    bad row, null for a good one) and ``flaw``: 'short', 'long' or 'unparsable value'. Every line that
    isn't blank gives a row, so good and bad rows add up to the lines. A line is a row (no line breaks
    inside quotes); with ``header`` lines equal to the first one are headers."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    if header:
        first = header_of(spark, path, "\n")
        lines = lines.where(F.col("value") != first[0]) if first else lines
    with_line = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_line.fields), {
        "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT})
    df = lines.select(row.alias("r")).select("r.*")
    # Separators outside quotes.
    bare = F.regexp_replace(F.col(REJECT), '"([^"]|"")*"', "")
    fields = 1 + F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
    flaw = F.when(F.col(REJECT).isNull(), None).when(fields < len(schema), "short").when(
        fields > len(schema), "long").otherwise("unparsable value")
    return df.withColumn("flaw", flaw)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with the file's columns, bad rows as (line, flaw)) of a checked scan."""
    good = df.where(F.col(REJECT).isNull()).drop(REJECT, "flaw")
    return good, df.where(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("line"), "flaw")


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Write with a header; no row-name column. Returns the path."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def literal_table(spark: SparkSession, rows, schema: str | T.StructType) -> DataFrame:
    """A small fixed table (a few hundred rows at most) as literals.

    ``createDataFrame`` on a Python list gives an RDD whose size Spark cannot
    estimate, so a join with it is planned as a shuffle join. Built as one
    generated row set over ``range(1)``, the table's size is known when the
    plan is made and Spark's own broadcast size check applies."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], st)

    def lit(v, dt):
        if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
            return F.array(*[lit(e, dt.elementType) for e in v]).cast(dt)
        if isinstance(dt, T.StructType):
            vals = [v.get(f.name) for f in dt.fields] if isinstance(v, dict) else list(v)
            return F.struct(*[lit(x, f.dataType).alias(f.name) for x, f in zip(vals, dt.fields)])
        return F.lit(v).cast(dt)

    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
