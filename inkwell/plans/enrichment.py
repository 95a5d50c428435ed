"""Enrichment jobs on F7 (documents + labels): classification with trained models
behind the pluggable-classifier output, validation, model comparison, scorecard,
batches, flattening, and resumable streaming enrichment (SURVEY §2.3, §2.8,
§2.11, §2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import enrich, request_queue, reshape, textmodel
from inkwell.operators.enrich import DOCUMENT, GOLD
from inkwell.operators.textmodel import CLASSES, MODELS
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.session import scratch_path, spread, stored_once
from inkwell.sources.fixtures import f7_labels, f7_rows
from inkwell.sources.tables import Tables
from inkwell.streaming.incremental import current_results, incremental_enrich as run_incremental

r6 = O.r6


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def _rows(spark, sf_dir) -> DataFrame:
    return spread(f7_rows(Tables(spark, sf_dir)), _path(sf_dir, "documents"))


def trained(spark, sf_dir) -> DataFrame:
    """The models of these tables, trained on the rows outside the held-out fold; once per application."""
    def build() -> DataFrame:
        rows = _rows(spark, sf_dir).where(~textmodel.held_out(F.col("doc_id")) & F.col("text").isNotNull())
        gold = textmodel.gold(F.col("lang"), F.col("quality"), F.col("toxic"))
        rows = rows.join(f7_labels(Tables(spark, sf_dir)), "doc_id", "left").select(
            "text", *[g.alias(t) for t, g in gold.items()])
        return textmodel.train(rows, max(m.terms for m in MODELS.values())).coalesce(1)     # a few thousand rows

    return stored_once(spark, "text-model", [_path(sf_dir, t) for t in ("documents", "labels")], build)


def _classified(spark, sf_dir, models=("A", "B"), passthrough=()) -> DataFrame:
    return enrich.classify_by_model(_rows(spark, sf_dir), list(models), trained(spark, sf_dir), passthrough=passthrough)


# ----------------------------------------------------------------- oracle SQL
def _lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cls_cte() -> str:
    """The models trained and applied in SQL, then one row per document and model."""
    def best(target: str, i: int) -> str:
        return f"max(labels[{i}]) FILTER (target = '{target}')"

    picks = [best("language", i) for i in (1, 2, 3)] + [best("quality", 1), best("toxicity", 1)]
    cols = ", ".join(f"CASE WHEN ok THEN {x} END AS {a}" for x, a in zip(picks, DOCUMENT.attributes))      # of three rows
    price = "CASE model " + " ".join(f"WHEN '{m}' THEN CAST({x.price} AS DOUBLE)" for m, x in MODELS.items()) + " END"
    return textmodel.scored_sql(MODELS) + f""",
cls AS (
  SELECT doc_id, lang, model, ok, CAST(ok AS INTEGER) AS attempts, CASE WHEN ok THEN {price} ELSE 0.0 END AS cost,
    CASE WHEN NOT ok THEN '{enrich.ERR_EMPTY_INPUT}' END AS error, held_out, g_language, g_quality, g_toxicity, {cols}
  FROM (SELECT *, NOT (text IS NULL OR trim(text) = '') AS ok FROM scored JOIN doc USING (doc_id))
  GROUP BY doc_id, lang, model, ok, held_out, g_language, g_quality, g_toxicity)
"""


CLS = _cls_cte()


def _summary_sql(prefix: str = "") -> str:
    return "concat_ws('|', " + ", ".join(f"{prefix}{a}" for a in DOCUMENT.attributes) + ")"


# ----------------------------------------------------------------- jobs
@query("classify_rows", sql=CLS + f"""
SELECT doc_id, model, ok, CAST(attempts AS INTEGER) AS attempts, {r6('cost', 'cost')}, error, primary_language,
       quality, toxicity
FROM cls""")
def classify_rows(spark, sf_dir):
    """Every document through both models: ok flag, attempts, per-row cost, error text, the classes."""
    df = _classified(spark, sf_dir)
    return finish(df.select("doc_id", "model", F.col("result").isNotNull().alias("ok"), "attempts", "cost", "error",
                            *[F.col(f"result.{a}").alias(a) for a in GOLD]))


@query("flatten_struct", sql=CLS + "SELECT doc_id, error, " + ", ".join(f"{a} AS a_{a}" for a in DOCUMENT.attributes)
       + " FROM cls WHERE model = 'A'")
def flatten_struct(spark, sf_dir):
    """Model A's structured result flattened to prefixed columns."""
    df = _classified(spark, sf_dir, ["A"]).select("doc_id", "error", "result")
    return reshape.flatten_struct(df, "result", "a")


def _invalid_sql() -> str:
    return " + ".join(f"CASE WHEN list_contains({_lst(v)}, {a}) THEN 0 ELSE 1 END" for a, v in DOCUMENT.enums.items())


@query("validate_enums", sql=CLS + f"""
SELECT doc_id, model, CAST({_invalid_sql()} AS INTEGER) AS n_invalid_values,
       secondary_language = primary_language AS secondary_repeats_primary,
       (tertiary_language = primary_language OR tertiary_language = secondary_language) AS tertiary_repeats,
       ({_invalid_sql()}) = 0 AND NOT (secondary_language = primary_language)
         AND NOT (tertiary_language = primary_language OR tertiary_language = secondary_language) AS valid
FROM cls WHERE ok""")
def validate_enums(spark, sf_dir):
    """Per successful classification: values outside the enum and ranked-attribute dependency breaks."""
    return enrich.validate_enums(_classified(spark, sf_dir))


@query("compare_models", sql=CLS + f"""
, a AS (SELECT * FROM cls WHERE model = 'A'), b AS (SELECT * FROM cls WHERE model = 'B')
SELECT a.doc_id, CASE WHEN a.ok THEN {_summary_sql('a.')} END AS a_result, {r6('a.cost', 'a_cost')},
       CASE WHEN b.ok THEN {_summary_sql('b.')} END AS b_result, {r6('b.cost', 'b_cost')},
       CAST({' + '.join(f'CAST(coalesce(a.{x} = b.{x}, false) AS INTEGER)' for x in DOCUMENT.attributes)} AS INTEGER) AS n_agree
FROM a JOIN b ON a.doc_id = b.doc_id""")
def compare_models(spark, sf_dir):
    """The same rows through two models side by side, with per-row cost."""
    return finish(enrich.compare_models(_rows(spark, sf_dir), trained(spark, sf_dir)))


def _scorecard_sql() -> str:
    known = {a: f"(held_out AND g_{t} IS NOT NULL)" for a, t in GOLD.items()}
    right = {a: f"(held_out AND coalesce({a} = g_{t}, false))" for a, t in GOLD.items()}
    each = ", ".join(f"count(*) FILTER ({right[a]}) / nullif(count(*) FILTER ({known[a]}), 0) AS {a}_accuracy" for a in GOLD)
    add = lambda x: " + ".join(f"CAST({v} AS INTEGER)" for v in x.values())
    return f"""
, pm AS (
  SELECT model, count(*) FILTER (k > 0) AS n_rows, CAST(sum(k) AS BIGINT) AS n_gold, CAST(sum(c) AS BIGINT) AS n_correct,
    count(*) FILTER (k > 0 AND c = k) AS n_perfect, {each}, sum(cost) AS total_cost
  FROM (SELECT *, {add(known)} AS k, {add(right)} AS c FROM cls) GROUP BY model)
SELECT model, n_rows, n_gold, n_correct, n_perfect, {', '.join(r6(f'{a}_accuracy', f'{a}_accuracy') for a in GOLD)},
  {r6('total_cost', 'total_cost')}, {r6('CAST(n_correct AS DOUBLE) / nullif(n_gold, 0)', 'accuracy')},
  row_number() OVER (ORDER BY CAST(n_correct AS DOUBLE) / nullif(n_gold, 0) DESC, model) = 1 AS is_winner FROM pm"""


@query("model_scorecard", sql=CLS + _scorecard_sql())
def model_scorecard(spark, sf_dir):
    """Correct attributes against the gold of held-out documents per model: rows, correct, perfect rows,
    accuracy of each attribute and of all, cost, winner."""
    # Labels meet the classifier output (no texts), never the documents.
    cls = _classified(spark, sf_dir, passthrough=["lang"]).join(f7_labels(Tables(spark, sf_dir)), "doc_id", "left")
    gold = textmodel.gold(F.col("lang"), F.col("quality"), F.col("toxic"))
    return finish(enrich.model_scorecard(cls.withColumns(
        {**gold, "held_out": textmodel.held_out(F.col("doc_id"))})))


@query("enum_schema", sql=CLS + """
, allowed(attribute, value, position) AS (VALUES """ + ", ".join(
    f"('{a}', '{v}', {i + 1})" for a, vals in DOCUMENT.enums.items() for i, v in enumerate(vals)) + f"""),
used AS ({' UNION ALL '.join(f"SELECT '{a}' AS attribute, {a} AS value FROM cls WHERE model = 'A' AND ok" for a in DOCUMENT.attributes)}),
n AS (SELECT attribute, value, count(*) AS n FROM used GROUP BY ALL)
SELECT a.attribute, a.value, CAST(a.position AS INTEGER) AS position, CAST(coalesce(n.n, 0) AS BIGINT) AS n_rows
FROM allowed a LEFT JOIN n ON n.attribute = a.attribute AND n.value = a.value""")
def enum_schema(spark, sf_dir):
    """The closed label set as data, with how often model A used each value."""
    used = enrich.results_long(_classified(spark, sf_dir, ["A"])).groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return (enrich.allowed_values(spark, DOCUMENT).join(used, ["attribute", "value"], "left")
            .select("attribute", "value", "position", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows")))


BATCH_SQL = CLS + f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(ok) AS BIGINT) AS n_ok,
       CAST(count_if(NOT ok) AS BIGINT) AS n_failed, {r6('sum(cost)', 'total_cost')}
FROM cls WHERE model = 'A' GROUP BY lang"""


@query("classify_batches", sql=BATCH_SQL)
def classify_batches(spark, sf_dir):
    """All batches in one job. Rows are classified in their scan splits
    (sized by ``spark.sql.files.maxPartitionBytes``), which do not follow the
    batch key, so a batch holding a third of the rows still uses every task
    and the texts are never shuffled; only the per-batch partial sums are."""
    cls = _classified(spark, sf_dir, ["A"], ["lang"])
    return finish(cls.groupBy("lang").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(F.col("result").isNotNull()).cast("bigint").alias("n_ok"),
        F.count_if(F.col("result").isNull()).cast("bigint").alias("n_failed"),
        F.sum("cost").alias("total_cost")))


@query("union_batches", sql=CLS + "SELECT doc_id, lang, model, CAST(attempts AS INTEGER) AS attempts, ok FROM cls WHERE model = 'A'")
def union_batches(spark, sf_dir):
    """The stacked per-batch results: one DataFrame for every batch at once."""
    cls = _classified(spark, sf_dir, ["A"], ["lang"])
    return cls.select("doc_id", "lang", "model", "attempts", F.col("result").isNotNull().alias("ok"))


@query("incremental_enrich", sql=CLS + """
SELECT doc_id, model, CAST(attempts AS INTEGER) AS attempts, ok, error FROM cls""")
def incremental_enrich(spark, sf_dir):
    """Resumable stream over the documents' files through both models; the target's current rows."""
    target, ckpt = (scratch_path(spark, n) for n in ("enrich-target", "enrich-checkpoint"))
    run_incremental(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", f7_rows(Tables(spark, sf_dir)).schema, target,
                    ckpt, list(MODELS), model_job(trained(spark, sf_dir)))
    return current_results(spark, target).select("doc_id", "model", "attempts", "ok", "error")


def model_job(model: DataFrame):
    """(key, model, ...) rows with texts through the trained model each names."""
    def job(df: DataFrame) -> DataFrame:
        out = enrich.classify_by_model(df, list(MODELS), model, passthrough=["wanted"])
        return out.where(F.col("model") == F.col("wanted")).select(
            "doc_id", "model", "attempts", F.col("result").isNotNull().alias("ok"), "error")

    return job


# Limits of the client: characters that an attempt's deadline allows, a word that its policy refuses.
DEADLINE_CHARS, REFUSED = 3000, "scum"
_FAILED = enrich.ERR_FAILED.format(model="' || model || '", attempts=enrich.MAX_ATTEMPTS, last="' || last || '")


@query("client_retry_queue", sql=CLS + f""",
sent AS (
  SELECT cls.*, length(text) AS chars, list_contains(words, '{REFUSED}') AS refused,
    greatest(1, CAST(ceil(length(text) / {DEADLINE_CHARS}.0) AS INTEGER)) AS needed
  FROM cls JOIN cut USING (doc_id)),
done AS (
  SELECT *, ok AND NOT refused AND needed <= {enrich.MAX_ATTEMPTS} AS got,
    CASE WHEN needed > {enrich.MAX_ATTEMPTS} THEN 'deadline exceeded' ELSE 'refused by content policy' END AS last
  FROM sent)
SELECT doc_id, model, got AS ok,
  CASE WHEN NOT ok THEN 0 WHEN got THEN needed ELSE {enrich.MAX_ATTEMPTS} END AS attempts,
  CASE WHEN NOT ok THEN error WHEN NOT got THEN '{_FAILED}' END AS error,
  {r6(f'cost * CASE WHEN got THEN needed ELSE {enrich.MAX_ATTEMPTS} END', 'cost')},
  {', '.join(f'CASE WHEN got THEN {a} END AS {a}' for a in GOLD)}
FROM done""")
def client_retry_queue(spark, sf_dir):
    """Every document through the batched client of both models: long texts need several attempts or
    miss every deadline, refused texts fail after the last; one outcome a request."""
    model = trained(spark, sf_dir)
    clients = {m: request_queue.LocalModelClient(m, request_queue.model_weights(model, x.terms), x.price,
                                                 DEADLINE_CHARS, [REFUSED]) for m, x in MODELS.items()}
    done = request_queue.run_queue(_rows(spark, sf_dir), list(MODELS), clients, scratch_path(spark, "queue"),
                                   backoff_base=0)
    return finish(done.select("doc_id", "model", F.col("result").isNotNull().alias("ok"), "attempts", "error", "cost",
                              *[F.col(f"result.{a}").alias(a) for a in GOLD]))
