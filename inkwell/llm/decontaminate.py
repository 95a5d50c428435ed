"""Benchmark decontamination by spaced-seed hashing, in SQL functions only.

Words are lower-cased runs of non-space. A text is contaminated by an item if some ``WINDOW``
consecutive words of the item stand in the text with at most ``MISSES`` of them substituted (an
item of fewer words must stand there whole and unchanged). Two fixed masks of six positions hash the
words at every place of items and texts, ignoring the positions between; whatever two words of
thirteen are substituted, one of the masks lies clear of them, so every such passage has a hit
(tests/llm checks all 78 pairs). An item shorter than the first mask, 1 to 6 words, is hashed whole,
and texts at every place for the lengths that such items have. Each hit is verified on the words
along its diagonal.

The hashes and words of the benchmark are broadcast if they are at most ``MAX_SEEDS`` and
``MAX_WORDS``; then texts are neither shuffled nor joined. A larger benchmark is joined by hash with
a shuffle of (key, place, hash), and hits are verified after joining texts and items back. Texts are
told apart by two hashes of id and text, items by their place in the staged table, so both ways give
the same rows.

Null and empty texts have no words: they are clean, and as items match nothing. A null id is a value
like any other on both sides (in ``item_ids`` it has no text). Equal rows give equal results; rows
that share an id are reported together. Empty tables give an empty result. Columns other than id and
text are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE_CLASS, stage, table

WINDOW, MISSES = 13, 2
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
MAX_SEEDS = 1_000_000
MAX_WORDS = 1_000_000
#: Words of the first mask: shorter items are hashed whole.
SHORT = MASKS[0][-1] + 1


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), SPACE_CLASS)


def _seed(words: str, at: str, name: int, places: tuple[int, ...]) -> Column:
    """Hash of the words at ``places`` from place ``at`` on, null where they stick out."""
    taken = ", ".join(f"get({words}, {at} + {p})" for p in places)
    return F.expr(f"CASE WHEN {at} + {places[-1]} < size({words}) THEN xxhash64({name}, {taken}) END")


def _seeds(df: DataFrame, words: str, lengths: list[int], *cols: str, whole: bool = False) -> DataFrame:
    """One row per place and mask: cols, at, seed. ``lengths``: those of the short items. ``whole``:
    short rows only as wholes (items), else all runs of their lengths (texts)."""
    at = df.select(*cols, words, F.posexplode(words).alias("at", "w"))
    seeds = [_seed(words, "at", m, places) for m, places in enumerate(MASKS)]
    for n in lengths:
        run = _seed(words, "at", -n, tuple(range(n)))
        seeds.append(F.when((F.size(words) == n) & (F.col("at") == 0), run) if whole else run)
    hashed = at.select(*cols, words, "at", F.array(*seeds).alias("s"))
    return hashed.select(*cols, words, "at", F.explode("s").alias("seed")).where("seed is not null")


def _overlap(text_words: Column, item_words: Column, shift: Column) -> tuple[Column, Column]:
    """(equal words along the diagonal, whether a window of them passes). ``text_words`` starts at
    the item's word ``shift``."""
    equal = F.zip_with(text_words, F.slice(item_words, shift + 1, F.size(text_words)),
                       lambda a, b: (a == b).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    whole = (F.size(item_words) < WINDOW) & (total(equal) == F.size(item_words))
    window = F.exists(F.sequence(F.lit(1), F.greatest(F.size(equal) - WINDOW + 1, F.lit(1))),
                      lambda s: total(F.slice(equal, s, WINDOW)) >= WINDOW - MISSES)
    enough = (F.size(item_words) >= WINDOW) & (F.size(text_words) >= WINDOW) & window
    return total(equal), whole | enough


KEY = ("k1", "k2")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """Two hashes of id and text: rows that share them are equal here."""
    return {"k1": F.xxhash64(id_col, text_col), "k2": F.xxhash64(F.lit(1), text_col, id_col)}


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
          shuffle: bool | None) -> DataFrame:
    """(k1, k2, id, item, equal) of every verified hit."""
    keyed = _keyed(docs, id_col, text_col)
    texts = docs.select(*[c.alias(k) for k, c in keyed.items()], F.col(id_col).cast("long").alias("id"),
                        _words(F.col(text_col)).alias("words"))
    bench = items.select(F.col(item_col).cast("long").alias("item"), _words(F.col(item_text_col)).alias("iw"))
    bench = stage(bench.where("iw is not null and iw[0] <> ''").withColumn("row", F.monotonically_increasing_id()), "items")
    short = bench.where(F.size("iw") < SHORT).select(F.size("iw").alias("n")).distinct().collect()     # six at most
    lengths = sorted(r["n"] for r in short)
    seeds = stage(_seeds(bench, "iw", lengths, "row", whole=True).select(
        "row", F.col("at").alias("j"), "seed", F.size("iw").alias("n")), "seeds")
    if shuffle is None:
        size = bench.agg(F.sum(F.size("iw")).alias("w")).first()["w"] or 0
        shuffle = size > MAX_WORDS or seeds.count() > MAX_SEEDS
    start = F.greatest(F.col("at") - F.col("j"), F.lit(0))
    if shuffle:
        found = _seeds(texts, "words", lengths, *KEY).select(*KEY, "at", "seed")
        hits = found.join(seeds, "seed").select(*KEY, "row", (F.col("at") - F.col("j")).alias("diagonal")).distinct()
        hits = hits.join(texts, list(KEY)).join(bench, "row")
        hits = hits.withColumn("shift", F.greatest(-F.col("diagonal"), F.lit(0)))
        hits = hits.withColumn("tw", F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1,
                                             F.size("iw") - F.col("shift")))
    else:
        found = _seeds(texts, "words", lengths, *KEY, "id")
        hits = found.join(F.broadcast(seeds), "seed").select(
            *KEY, "id", "row", (start - F.col("at") + F.col("j")).alias("shift"),
            F.slice("words", start + 1, F.col("n") - (start - F.col("at") + F.col("j"))).alias("tw"))
        hits = hits.join(F.broadcast(bench), "row")
    equal, passes = _overlap(F.col("tw"), F.col("iw"), F.col("shift"))
    return hits.where(passes).select(*KEY, "id", "item", equal.alias("equal"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", shuffle: bool | None = None) -> DataFrame:
    """(id, item, equal_words) of every contaminated text and item. ``shuffle`` picks the way;
    by default the benchmark's size does."""
    hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, shuffle)
    return hits.groupBy("id", "item").agg(F.max("equal").cast("long").alias("equal_words"))


def contaminated(docs: DataFrame, items: DataFrame, **cols) -> DataFrame:
    """One row per contaminated text: (id, n_items, item_ids, equal_words)."""
    return overlaps(docs, items, **cols).groupBy("id").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("item_ids"),
        F.max("equal_words").alias("equal_words"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", shuffle: bool | None = None) -> DataFrame:
    """``docs`` without the contaminated rows."""
    hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, shuffle).select(*KEY).distinct()
    packed = docs.select(*[c.alias(k) for k, c in _keyed(docs, id_col, text_col).items()], F.struct(*docs.columns).alias("doc"))
    return packed.join(hits, list(KEY), "left_anti").select("doc.*")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed(
        "id", "doc_id")


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS dk, doc_id,
             string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                '[\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS ik, item_id,
        string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           '[\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT dk, doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
iw AS (SELECT ik, item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM i WHERE w[1] <> ''),
same AS (SELECT dk, doc_id, ik, item_id, p - q AS diagonal, q, iw.n AS n,
                least(iw.n, dw.n - (p - q)) - greatest(0, q - p) AS room
         FROM dw JOIN iw ON dw.word = iw.word),
near AS (SELECT *, count(*) OVER (PARTITION BY dk, ik, diagonal ORDER BY q
                                  RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c,
                count(*) OVER (PARTITION BY dk, ik, diagonal) AS equal_words FROM same),
hit AS (SELECT doc_id, item_id, max(equal_words) AS equal_words FROM near
        WHERE (n >= {WINDOW} AND room >= {WINDOW} AND c >= {WINDOW - MISSES}) OR (n < {WINDOW} AND equal_words = n)
        GROUP BY ALL)
SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids,
       max(equal_words) AS equal_words FROM hit GROUP BY doc_id
"""
