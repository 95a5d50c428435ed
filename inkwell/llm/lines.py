"""Line dedup by a log-template tree, in SQL functions only.

A line of at least ``MIN_TOKENS`` tokens goes down a tree of fixed depth: by its token count, then
by its first ``DEPTH`` tokens, where a token with a digit counts as ``<*>``. Within a leaf, a later
token is kept in the template if at least ``MIN_DOCS`` documents and one in ``SHARE`` of the leaf's
have it at that place (summed over the leaf's distinct lines), else it is generalised to ``<*>``.
Lines with equal templates are instances of one if at least half of the tokens beyond the head, and
one at least, are kept words (``<*>`` is none). Failing that, a line stands for itself with its
digits generalised, if half of its own tokens beyond the head are words; else for its exact words,
so rows of figures recur only where all figures do. A template found in ``MIN_DOCS`` documents or
more recurs: all its lines are dropped but the first (smallest id, then line).

Only (id, line, hashes) of each line is shuffled, and pre-aggregated to distinct lines; tokens are
fetched for one instance of each distinct line, and only in leaves with several of them. Templates
are staged, so that joins with lines are plain shuffle joins whose hot keys Spark splits. A text is
split into lines once in each step, so its cost is linear in its lines. Null texts stay null with no
lines; empty ones have one empty line; short and blank lines stay. Repeated rows with equal ids lose
the same lines. An empty table gives an empty result. Columns other than id and text are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE_CLASS, stage, table

DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 3
SHARE = 20
ANY = "<*>"
TRIM = " \t\x0b\x0c\r"


def _masked(line: Column, digits: Column) -> Column:
    """The line with every token that has a digit as ``<*>``."""
    return F.when(digits, F.regexp_replace(line, "[^\\x20\\x09-\\x0D0-9]*[0-9][^\\x20\\x09-\\x0D]*", ANY)).otherwise(line)


def _parsed(df: DataFrame, line: Column, *cols) -> DataFrame:
    """cols, tokens, leaf, the hashes of the tokens and of the exact words, and whether enough tokens
    are words, of the lines with enough tokens."""
    df = df.select(*cols, F.btrim(line, F.lit(TRIM)).alias("line"))
    df = df.select(*cols, "line", F.col("line").rlike("[0-9]").alias("digits"))
    df = df.select(*cols, "line", "digits", F.split(_masked(F.col("line"), F.col("digits")), SPACE_CLASS).alias("tokens"))
    df = df.where(F.size("tokens") >= MIN_TOKENS)
    head = [F.get("tokens", F.lit(i)) for i in range(DEPTH)]
    # Only a line with digits differs from its exact words, or has tokens that are no words.
    words = F.when(F.col("digits"), F.size(F.array_remove(F.slice("tokens", DEPTH + 1, F.size("tokens")), ANY))).otherwise(
        F.size("tokens") - DEPTH)
    exact = F.when(F.col("digits"), F.xxhash64(F.split("line", SPACE_CLASS))).otherwise(F.xxhash64("tokens"))
    return df.select(*cols, "tokens", F.xxhash64(F.size("tokens"), *head).alias("leaf"), F.xxhash64("tokens").alias("lh"),
                     exact.alias("rh"), _enough(words, F.size("tokens")).alias("wordy"))


def _enough(words: Column, size: Column) -> Column:
    return (words >= 1) & (2 * words >= size - DEPTH)


def _templates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(leaf, lh, template) of the distinct lines that are instances of a general template."""
    wanted = classes.where("kinds > 1").select("leaf", "lh", "n", "docs", "one.id", "one.no").groupBy("id").agg(
        F.collect_list(F.struct("no", "leaf", "lh", "n", "docs")).alias("wanted"))
    # Texts are met by sort-merge joins at every size, so the plan's cost is the same share of any
    # input. The text is split once (a lambda's argument is computed once) and its lines picked.
    picked = F.transform(F.array(F.split("text", "\n")), lambda l: F.transform("wanted", lambda w: F.struct(
        F.get(l, w["no"]).alias("raw"), w["leaf"].alias("leaf0"), w["lh"].alias("lh0"), w["n"].alias("n"), w["docs"].alias("docs"))))
    got = docs.join(wanted.hint("merge"), "id").select(F.explode(F.flatten(picked)).alias("p")).select("p.*")
    got = _parsed(got, F.col("raw"), "leaf0", "lh0", "n", "docs").where("leaf = leaf0 and lh = lh0")
    tokens = stage(got.select("leaf", "lh", "n", "docs", F.size("tokens").alias("size"),
                              F.posexplode("tokens").alias("at", "token")).distinct(), "tokens")
    usual = tokens.where((F.col("at") >= DEPTH) & (F.col("token") != ANY)).groupBy("leaf", "at", "token").agg(
        F.sum("n").alias("have"), F.max("docs").alias("docs")).where(
            (F.col("have") >= MIN_DOCS) & (SHARE * F.col("have") >= F.col("docs"))).select(
                "leaf", "at", "token", F.lit(1).alias("fixed"))
    general = tokens.join(usual, ["leaf", "at", "token"], "left").select(
        "leaf", "lh", "size", "at", F.coalesce("fixed", F.lit(0)).alias("fixed"),
        F.when((F.col("at") < DEPTH) | F.col("fixed").isNotNull(), F.col("token")).alias("token"))
    return general.groupBy("leaf", "lh").agg(
        F.xxhash64(F.sort_array(F.collect_list(F.struct("at", "token")))).alias("t"),
        F.sum("fixed").alias("fixed"), F.first("size").alias("size")).where(_enough(F.col("fixed"), F.col("size"))).select(
            "leaf", "lh", F.xxhash64("leaf", "t").alias("template"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row, the text without recurring lines."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = docs.where("id is not null").select("id", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    lines = stage(_parsed(each, F.col("raw"), "id", "no").drop("tokens"), "lines")
    classes = lines.groupBy("leaf", "lh", "id").agg(F.min("no").alias("no"), F.first("wordy").alias("wordy")).groupBy(
        "leaf", "lh").agg(F.count("*").alias("n"), F.min(F.struct("id", "no")).alias("one"), F.first("wordy").alias("wordy"))
    leaves = classes.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds")).where(
        F.col("docs") >= MIN_DOCS)
    classes = stage(classes.join(leaves, "leaf"), "line_classes")
    named = stage(classes.select("leaf", "lh", "wordy").join(_templates(docs, classes), ["leaf", "lh"], "left").select(
        "leaf", "lh", F.coalesce("template", F.when(F.col("wordy"), F.xxhash64("leaf", "lh", F.lit("own")))).alias("template")), "named")
    placed = stage(lines.join(named, ["leaf", "lh"]).select(
        "id", "no", F.coalesce("template", F.xxhash64("leaf", "rh", F.lit("exact"))).alias("template")), "placed")
    recurring = placed.groupBy("template", "id").agg(F.min("no").alias("no")).groupBy("template").agg(
        F.count("*").alias("docs"), F.min(F.struct("id", "no")).alias("first")).where(F.col("docs") >= MIN_DOCS)
    recurring = stage(recurring, "recurring")
    dropped = placed.join(recurring.select("template", "first"), "template").where(
        (F.col("id") != F.col("first.id")) | (F.col("no") != F.col("first.no")))
    dropped = dropped.groupBy("id").agg(F.collect_set("no").alias("gone"))
    out = docs.join(dropped.hint("merge"), "id", "left").select(
        "id", F.split("text", "\n").alias("l"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # What stays are the runs between neighbouring dropped lines: one slice each.
    out = out.withColumn("cut", F.concat(F.array(F.lit(-1)), F.sort_array("gone"), F.array(F.size("l"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice(
        "l", F.get("cut", k) + 2, F.get("cut", k + 1) - F.get("cut", k) - 1)))
    return out.select("id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_lines"),
                      F.size("gone").cast("long").alias("n_dropped"),
                      F.when(F.col("l").isNotNull(), F.array_join(kept, "\n")).alias("text"))


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return drop_recurring(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP1_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
m AS (SELECT doc_id, no, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS exact FROM l),
p AS (SELECT doc_id, no, string_split_regex(exact, '[\x20\x09-\x0D]+') AS e,
             string_split_regex(regexp_replace(exact, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '{ANY}', 'g'),
                                '[\x20\x09-\x0D]+') AS w FROM m),
q AS (SELECT doc_id, no, array_to_string(w, ' ') AS lh, array_to_string(e, ' ') AS rh, w,
             len(list_filter(w[{DEPTH + 1}:], lambda x: x <> '{ANY}')) AS words, [len(w)::VARCHAR, w[1], w[2], w[3]] AS leaf
      FROM p WHERE len(w) >= {MIN_TOKENS}),
c AS (SELECT leaf, lh, any_value(w) AS w, count(DISTINCT doc_id) AS n FROM q GROUP BY leaf, lh),
v AS (SELECT leaf, sum(n) AS docs, count(*) AS kinds FROM c GROUP BY leaf HAVING sum(n) >= {MIN_DOCS}),
t AS (SELECT c.leaf, c.lh, c.n, v.docs, len(w) AS size, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
      FROM c JOIN v ON c.leaf = v.leaf WHERE kinds > 1),
u AS (SELECT leaf, pos, token FROM t WHERE pos >= {DEPTH} AND token <> '{ANY}'
      GROUP BY ALL HAVING sum(n) >= {MIN_DOCS} AND {SHARE} * sum(n) >= max(docs)),
g AS (SELECT t.leaf, t.lh, size, t.pos, u.token IS NOT NULL AS fixed, CASE WHEN t.pos < {DEPTH} OR u.token IS NOT NULL THEN t.token END AS token
      FROM t LEFT JOIN u ON t.leaf = u.leaf AND t.pos = u.pos AND t.token = u.token),
r AS (SELECT leaf, lh, list(token ORDER BY pos) AS template FROM g GROUP BY leaf, lh, size
      HAVING count(*) FILTER (fixed) >= 1 AND 2 * count(*) FILTER (fixed) >= size - {DEPTH}),
k AS (SELECT doc_id, no, q.leaf, coalesce(r.template, CASE WHEN words >= 1 AND 2 * words >= len(q.w) - {DEPTH}
             THEN ['own', q.lh] ELSE ['exact', q.rh] END) AS template
      FROM q JOIN v ON q.leaf = v.leaf LEFT JOIN r ON q.leaf = r.leaf AND q.lh = r.lh),
f AS (SELECT leaf, template, min({{'d': doc_id, 'n': no}}) AS first FROM k GROUP BY leaf, template
      HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
x AS (SELECT DISTINCT doc_id, no FROM k JOIN f ON k.leaf = f.leaf AND k.template = f.template
      WHERE {{'d': doc_id, 'n': no}} <> first)
SELECT d.doc_id, count(l.no) AS n_lines, count(x.no) AS n_dropped,
       CASE WHEN any_value(d.text) IS NOT NULL THEN
            coalesce(string_agg(l.raw, chr(10) ORDER BY l.no) FILTER (x.no IS NULL), '') END AS text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN x ON l.doc_id = x.doc_id AND l.no = x.no
GROUP BY d.doc_id
"""
