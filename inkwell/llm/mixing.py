"""Mixing sources to target weights by a hypergeometric splitting tree.

Each source's target follows its weight, capped at ``max_repeat`` times its own words with the
excess reshared. A target of q + r times the source (0 <= r < 1) takes every document q times and
a random part of the source once more. The extra draw works on blocks: a source's documents fall
by hash into ``BLOCKS`` blocks, the blocks are permuted by a seeded hash, and the leading blocks up
to r times the source's words are drawn, the last one in part (document by document, the last of
these by its leading words), so the words taken miss the target by less than one.

The draws (one per block and epoch) are dealt to the output shards by a binary splitting tree: a
node with n draws passes a uniformly random half of them, without replacement, to its left child.
So the sources' counts in a child follow the multivariate hypergeometric law, every node's
quota is exact, and the shards hold disjoint permuted blocks. Documents get a seeded random place
inside their shard's block for the local shuffle. Everything is seeded by MD5: reruns agree on any
number of executors.

Null sources are a source of their own, last in order. Null or wordless texts have size 0: they
are taken with their block and add no words. Sources without words have target 0. Repeated rows
count as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import n_words, stage, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
BLOCKS = 1024
DEPTH = 4
SEED = 17


def _hash(*cols):
    return F.md5(F.concat_ws("/", F.lit(str(SEED)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))


def targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, words) with each source's ``target``.

    With the sources ordered by cap / weight, the capped ones are a leading run: the level
    (words per unit of weight) left for the others after k caps is (total - caps) / weights, and
    the run ends at the first k whose level is below the next source's cap. One row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("words") * float(max_repeat))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("goal", F.sum("words").over(everything) * float(share))
         .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("free", F.first(fits, ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "words", F.coalesce(
        F.least(F.col("free") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def splitting_tree(draws: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``draws`` (source, block, epoch) with ``shard`` in [0, 2^depth): level by level each node
    sends the half of its draws with the smallest random keys to the left."""
    d = draws.withColumn("shard", F.lit(0))
    for level in range(depth):
        node = Window.partitionBy("shard")
        key = _hash(F.lit(level), F.col("source"), F.col("source").isNull(), F.col("block"), F.col("epoch"))
        rank = F.row_number().over(node.orderBy(key, F.col("source"), "block", "epoch"))
        half = F.floor((F.count("*").over(node) + 1) / 2)
        d = d.withColumn("shard", F.col("shard") * 2 + F.when(rank <= half, 0).otherwise(1))
    return d


def mix(rows: DataFrame, share: float = SHARE, weights=WEIGHTS, max_repeat: float = MAX_REPEAT,
        depth: int = DEPTH) -> DataFrame:
    """``rows`` (id, source, size) with source_size, target, taken, and ``draws``: an array of
    (epoch, shard, words, place), one per copy the mix takes, whole or in part.

    A source's windows run over its blocks (at most 1024 rows), a document's over its block, so a
    source with a third of all rows spreads over 1024 groups."""
    key = _hash(F.col("id"), F.col("size"))
    rows = rows.withColumn("key", key).withColumn(
        "block", F.pmod(F.conv(F.substring("key", 1, 7), 16, 10).cast("int"), F.lit(BLOCKS)))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("words")), share, weights, max_repeat)
    b = blocks.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.source", "b.block", F.col("b.words").alias("words"), F.col("g.words").alias("source_size"), "g.target")
    b = b.withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    b = b.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    permuted = Window.partitionBy("source").orderBy(
        _hash(F.lit("block"), F.col("source"), F.col("block")), "block")
    b = b.withColumn("before", F.coalesce(
        F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = stage(b, "blocks")
    epochs = F.col("whole") + F.when(F.col("before") < F.col("extra"), 1).otherwise(0)
    draws = b.where(epochs > 0).select(
        "source", "block", F.explode(F.sequence(F.lit(1).cast("long"), epochs)).alias("epoch"))
    dealt = splitting_tree(draws, depth).groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("dealt"))
    b = (b.alias("b").join(dealt.alias("d"), F.col("b.source").eqNullSafe(F.col("d.source"))
                           & (F.col("b.block") == F.col("d.block")), "left")
         .select("b.*", "d.dealt"))
    out = rows.alias("r").join(b.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))
                               & (F.col("r.block") == F.col("b.block")))
    out = out.select("r.*", "b.source_size", "b.target", "b.whole", "b.extra", "b.before", "b.dealt")
    inside = Window.partitionBy("source", "block").orderBy("key", "id", "size")
    at = F.col("before") + F.coalesce(F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The document at the end of the drawn part gives only its leading words.
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.round("extra").cast("long") - at))
    out = out.withColumn("part", F.when(F.col("size") > 0, part).otherwise(
        F.when(at < F.col("extra"), 0)).cast("long"))
    copies = F.col("whole") + F.when((F.col("part") > 0) | ((F.col("size") == 0) & F.col("part").isNotNull()), 1
                                     ).otherwise(0)
    place = F.transform(F.filter("dealt", lambda d: d["epoch"] <= copies), lambda d: F.struct(
        d["epoch"].alias("epoch"), d["shard"].alias("shard"),
        F.when(d["epoch"] <= F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words"),
        F.md5(F.concat_ws("/", F.col("key"), d["epoch"])).alias("place")))
    out = out.withColumn("draws", F.coalesce(place, F.array().cast(
        "array<struct<epoch:bigint,shard:int,words:bigint,place:string>>")))
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.coalesce("part", F.lit(0))).drop(
        "whole", "extra", "before", "dealt", "part", "key", "block")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is drawn, with all its columns. The
    part of a document at the end of a quota counts as a copy from half of its words on."""
    key = F.xxhash64(id_col, text_col, source_col)
    sizes = docs.select(key.alias("key"), source_col, text_col)
    rows = stage(sized(sizes, "key", text_col, source_col), "sized")
    whole = F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))
    # Rows with equal keys are equal in what matters here: their copies go to one of them.
    copies = mix(rows, **options).groupBy("id").agg(F.sum(F.size(whole)).alias("copies"), F.count("*").alias("n"))
    copies = stage(copies.where("copies > 0"), "copies")
    packed = docs.select(key.alias("id"), F.struct(*docs.columns).alias("doc"))
    if copies.where("n > 1").limit(1).count():
        packed = packed.dropDuplicates(["id"])
    # By a sort-merge join at every size, as the near-duplicates are.
    out = packed.join(copies.hint("merge"), "id").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select("doc.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target, the words the mix takes of it, and the
    output shards of its copies."""
    out = mix(stage(sized(table(spark, sf_dir, "documents")), "sized"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
                      F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))
