"""Sharding by minimax contiguous partition.

Rows that must stay together form atomic groups; the groups are ordered by a key hash and
pre-summed into ``cells`` ordered cells (a group never spans two cells, so a cell is itself
atomic). A binary search finds the smallest shard capacity for which a greedy left-to-right fill
of the ordered cells needs at most ``n_shards`` shards, and the cells are cut there. The search
runs over the bounded array of cell sizes in one row, so its cost does not grow with the data; at
any size a shard exceeds the mean by at most about one cell (1/32768 of the data) unless a single
group is larger than that.

Equal texts share a cell, hence a shard. Null texts are one group, apart from empty ones. An empty
table gives an empty result. Repeated rows (even with equal ids) are all kept, each with a slot of
its own. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import stage, table

CELLS = 32768
#: A hot cell's rows are numbered in this many independent parts.
SUBCELLS = 128


def _greedy(sizes: Column, cap: Column) -> Column:
    """Shards a greedy fill with capacity ``cap`` needs."""
    start = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("fill"))
    return F.aggregate(sizes, start, lambda a, s: F.when(
        a["fill"] + s <= cap, F.struct(a["n"].alias("n"), (a["fill"] + s).alias("fill"))
    ).otherwise(F.struct((a["n"] + 1).alias("n"), s.alias("fill"))), lambda a: a["n"])


def smallest_capacity(sizes: Column, n_shards: int) -> Column:
    """Binary search over an array of ordered sizes: the smallest feasible capacity. A capacity
    below the largest size or the mean is never feasible; their sum always is."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s)
    low = F.greatest(F.array_max(sizes), F.ceil(total / n_shards).cast("long"))
    span = F.struct(low.alias("lo"), (low + F.array_max(sizes)).alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("long")
        return F.when(a["lo"] >= a["hi"], a).otherwise(
            F.when(_greedy(sizes, mid) <= n_shards, F.struct(a["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))))

    # 2^63 bounds any span, and a step over a closed interval costs nothing.
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), span, step, lambda a: a["hi"])


def cut(cells: DataFrame, n_shards: int) -> DataFrame:
    """``cells`` (cell, bytes) with the shard of each. One row holds the bounded array of sizes;
    the smallest capacity is searched there. Within that capacity a shard is closed near its even
    share of what is left, as soon as a greedy fill from the right shows that the rest still fits
    into the shards left, so that one oversized group doesn't leave trailing shards empty."""
    c = cells.groupBy().agg(F.sort_array(F.collect_list(F.struct("cell", "bytes"))).alias("c"))
    c = c.where(F.size("c") > 0).withColumn(
        "cap", smallest_capacity(F.transform("c", lambda x: x["bytes"]), n_shards))
    cap, zero = F.col("cap"), F.lit(0).cast("long")
    # Left edges of the shards of a greedy fill from the right.
    back = F.aggregate(
        F.reverse("c"),
        F.struct(zero.alias("fill"), F.lit(-1).alias("at"), F.array().cast("array<int>").alias("edges")),
        lambda a, x: F.when(a["fill"] + x["bytes"] <= cap, F.struct(
            (a["fill"] + x["bytes"]).alias("fill"), x["cell"].alias("at"), a["edges"].alias("edges")))
        .otherwise(F.struct(x["bytes"].alias("fill"), x["cell"].alias("at"),
                            F.concat(a["edges"], F.array(a["at"])).alias("edges"))),
        lambda a: a["edges"])
    c = c.withColumn("edges", back).withColumn(
        "total", F.aggregate("c", zero, lambda a, x: a + x["bytes"]))

    def fill(a, x):
        after = F.lit(n_shards - 1) - a["shard"]
        fits = F.size(F.filter("edges", lambda e: e > x["cell"])) + 1 <= after
        even = a["fill"] + x["bytes"] / 2 > a["left"] / (after + 1)
        close = (a["fill"] > 0) & ((a["fill"] + x["bytes"] > cap) | ((after > 0) & even & fits))
        return F.when(close, F.struct(
            (a["shard"] + 1).alias("shard"), x["bytes"].alias("fill"), (a["left"] - a["fill"]).alias("left"),
            F.concat(a["starts"], F.array(x["cell"])).alias("starts"))).otherwise(F.struct(
                a["shard"].alias("shard"), (a["fill"] + x["bytes"]).alias("fill"), a["left"].alias("left"),
                a["starts"].alias("starts")))

    starts = F.aggregate(
        "c", F.struct(F.lit(0).alias("shard"), zero.alias("fill"), F.col("total").alias("left"),
                      F.array().cast("array<int>").alias("starts")), fill, lambda a: a["starts"])
    return c.select("c", starts.alias("starts")).select(F.explode("c").alias("x"), "starts").select(
        F.col("x.cell").alias("cell"),
        F.size(F.filter("starts", lambda s: s <= F.col("x.cell"))).alias("shard"))


def shard_rows(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (id, size, cell, ...) with ``shard`` and a gapless ``slot`` in it. Slots follow
    (cell, part of the cell, id); a part's first slot comes from the counts of all parts before
    it, so a cell that holds a third of the rows is numbered by 128 tasks."""
    rows = rows.withColumn("part", F.pmod(F.coalesce("id", F.lit(0)), F.lit(SUBCELLS)).cast("int"))
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    shards = cut(parts.groupBy("cell").agg(F.sum("bytes").alias("bytes")), n_shards)
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.join(shards, "cell").select(
        "cell", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("cell", "part").orderBy("id", "size", "crc")
    return (rows.withColumn("k", F.row_number().over(own)).join(at, ["cell", "part"])
            .withColumn("slot", F.col("first") + F.col("k") - 1).drop("k", "first", "part"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, size, crc, cell, ...) of each row; the cell is an ordered range of the text's MD5."""
    key = F.coalesce(F.md5(F.col(text_col)), F.md5(F.lit("no text")))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
        F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("int") / 2).cast("int").alias("cell"), *more)


def place(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, and the shard and slot of each row."""
    rows = keyed(docs, id_col, text_col, F.struct(*docs.columns).alias("doc"))
    return shard_rows(rows, n_shards).select(
        "doc.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """Every document's shard and slot by the law of near-equal bytes."""
    rows = stage(keyed(table(spark, sf_dir, "documents")), "shards")
    return shard_rows(rows, n_shards).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
