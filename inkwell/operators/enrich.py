"""Enrichment of text rows with a closed set of labels through a pluggable
classifier (SURVEY §2.11).

Two kinds of classifier give the same output. The trained models read the
whole text in column expressions (``classify_by_model``, ``textmodel``): no
Python, no shuffle of texts. A client class for a remote model runs inside
``mapInPandas`` (``classify_rows``): each task opens its client once and passes
it batches of rows; a failure becomes data (an error text in place of the
record), never a task failure. Everything around it (validation, comparison,
scoring) is plain DataFrame work and holds for any closed label set.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import textmodel
from inkwell.operators.textmodel import CLASSES, LANGUAGES, MODELS
from inkwell.sources.io import literal_table

# ----------------------------------------------------------------- fixed values
# The closed label set: 11 attributes; the three sub-genre attributes share one
# 33-value list. Values and order as published with the classification job.
SUB_GENRES = [
    "phobia", "madness", "home invasion", "slasher", "backwoods horror", "torture",
    "body horror", "splatter", "cannibal", "extreme", "zombies", "virus", "vampire",
    "werewolf", "classic and mythological", "neo-monsters", "nature", "giant creatures",
    "small creatures", "sci-fi and aliens", "ghost and spirits", "haunted house",
    "possession", "devils, demons, and hell", "witches", "supernatural power",
    "horror comedy", "parody horror", "Lovecraftian/Cosmic horror", "gothic horror",
    "found footage", "folk horror", "post-apocalyptic",
]
CHARACTER_TYPES = ["human", "human with extra powers", "possessed human", "non-human entity", "unknown"]
PROTAGONIST_GENDERS = ["male", "female", "unknown"]
ANTAGONIST_GENDERS = ["male", "female", "androgynous", "unknown"]
AGES = ["under 18", "18-30", "30-50", "50+", "unknown"]
SETTING_TIMES = ["past", "present", "future"]
SETTING_LOCATIONS = ["house", "forest", "big city", "small town", "rural", "outer space", "unknown"]

ENUMS: dict[str, list[str]] = {
    "primary_sub_genre": SUB_GENRES,
    "secondary_sub_genre": SUB_GENRES,
    "tertiary_sub_genre": SUB_GENRES,
    "protagonist_type": CHARACTER_TYPES,
    "antagonist_type": CHARACTER_TYPES,
    "protagonist_gender": PROTAGONIST_GENDERS,
    "antagonist_gender": ANTAGONIST_GENDERS,
    "protagonist_age": AGES,
    "antagonist_age": AGES,
    "setting_time": SETTING_TIMES,
    "setting_location": SETTING_LOCATIONS,
}
ATTRIBUTES = list(ENUMS)

# Attempts per row, and the texts that stand in place of a
# record when a call is refused or fails ({models}, {model}, {attempts},
# {last} are filled in).
MAX_ATTEMPTS = 3
ERR_UNKNOWN_MODEL = "ERROR: model must be one of: {models}"
ERR_EMPTY_INPUT = "ERROR: text must be provided and cannot be empty"
ERR_FAILED = "ERROR: Failed to get valid response from {model} API after {attempts} attempts. Last error: {last}"
ERR_EMPTY_RESULT = "Empty result received from API"



class LabelSet(NamedTuple):
    """A closed label set: allowed values by attribute, and the attributes that must differ in turn
    (the second from the first, the third from both)."""

    enums: dict[str, list[str]]
    ranked: tuple[str, str, str]

    @property
    def attributes(self) -> list[str]:
        return list(self.enums)

    @property
    def result_type(self) -> T.StructType:
        return T.StructType([T.StructField(a, T.StringType()) for a in self.enums])


PUBLISHED = LabelSet(ENUMS, ("primary_sub_genre", "secondary_sub_genre", "tertiary_sub_genre"))
#: What the tables hold gold for.
DOCUMENT = LabelSet({"primary_language": LANGUAGES, "secondary_language": LANGUAGES, "tertiary_language": LANGUAGES,
                     "quality": CLASSES["quality"], "toxicity": CLASSES["toxicity"]},
                    ("primary_language", "secondary_language", "tertiary_language"))
#: The class target behind each attribute that has gold.
GOLD = {"primary_language": "language", "quality": "quality", "toxicity": "toxicity"}


def output_schema(key: str, key_type: T.DataType, extra: Sequence[T.StructField] = (),
                  labels: LabelSet = PUBLISHED) -> T.StructType:
    return T.StructType([
        T.StructField(key, key_type), *extra, T.StructField("model", T.StringType()),
        T.StructField("result", labels.result_type), T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()), T.StructField("cost", T.DoubleType())])


def allowed_values(spark, labels: LabelSet = PUBLISHED) -> DataFrame:
    """The enum set as data: (attribute, value, position). ~100 rows, fixed."""
    rows = [(a, v, i + 1) for a, vals in labels.enums.items() for i, v in enumerate(vals)]
    return literal_table(spark, rows, "attribute string, value string, position int")


# ----------------------------------------------------------------- classifiers
class Classifier:
    """A model client. ``classify_batch`` gets rows (the whole texts included)
    and the attempt number and returns, for each, a dict of the 11 attributes
    or an exception; by default it calls ``classify`` row by row. Subclasses
    hold no driver-side state; ``open`` runs once per task."""

    name = "base"
    cost_per_call = 0.0

    def open(self) -> None:  # per-task client set-up (connections, sessions)
        pass

    def classify(self, row: Mapping, attempt: int) -> dict:
        raise NotImplementedError

    def classify_batch(self, rows: Sequence[Mapping], attempt: int) -> list:
        out = []
        for row in rows:
            try:
                out.append(self.classify(row, attempt))
            except Exception as e:  # noqa: BLE001 - any model failure becomes data
                out.append(e)
        return out


# ----------------------------------------------------------------- trained models
def with_model_results(df: DataFrame, models: Sequence[str], trained: DataFrame, keep: Sequence[str],
                       text: str = "text") -> DataFrame:
    """``keep`` columns with one struct ``_result_<model>`` per model (null for an empty text)."""
    empty = F.col(text).isNull() | (F.btrim(F.col(text)) == "")
    rows = df.select(*keep, text).withColumn("_empty", empty)
    ranked = textmodel.score(rows, trained, {m: MODELS[m] for m in models}, [*keep, "_empty"], text)

    def record(m: str) -> Column:
        r = F.col(f"_ranked_{m}")
        best = [F.get(r["language"], F.lit(i)) for i in range(3)] + [F.get(r[t], F.lit(0)) for t in ("quality", "toxicity")]
        return F.when(~F.col("_empty"), F.struct(*[x.alias(a) for x, a in zip(best, DOCUMENT.attributes)]))

    return ranked.select(*keep, *[record(m).alias(f"_result_{m}") for m in models])


def classify_by_model(df: DataFrame, models: Sequence[str], trained: DataFrame, key: str = "doc_id",
                      text: str = "text", passthrough: Sequence[str] = ()) -> DataFrame:
    """The trained models' output in the schema of ``classify_rows`` with the ``DOCUMENT`` labels:
    every text is read once for all models, in its scan split."""
    known = [m for m in models if m in MODELS]
    wide = with_model_results(df, known, trained, list(dict.fromkeys([key, *passthrough])), text)
    none = F.lit(None).cast(DOCUMENT.result_type)

    def output(m: str) -> Column:
        if m not in MODELS:
            return F.struct(F.lit(m).alias("model"), none.alias("result"),
                            F.lit(ERR_UNKNOWN_MODEL.format(models=", ".join(MODELS))).alias("error"),
                            F.lit(0).alias("attempts"), F.lit(0.0).alias("cost"))
        r = F.col(f"_result_{m}")
        return F.struct(F.lit(m).alias("model"), r.cast(DOCUMENT.result_type).alias("result"),
                        F.when(r.isNull(), F.lit(ERR_EMPTY_INPUT)).alias("error"),
                        F.when(r.isNull(), 0).otherwise(1).alias("attempts"),
                        F.when(r.isNull(), 0.0).otherwise(MODELS[m].price).alias("cost"))

    return wide.select(key, *passthrough, F.inline(F.array(*[output(m) for m in models])))


# ----------------------------------------------------------------- the job
def _attempt_rows(client: Classifier | None, model: str, known: Sequence[str], rows: Sequence[Mapping], text: str,
                  max_attempts: int, backoff: Callable[[int], float], sleep: Callable[[float], None]) -> list[tuple]:
    """(result, error, attempts, cost) of each row; never raises. All rows still
    failing go into the next attempt together, after one pause."""
    if client is None:
        return [(None, ERR_UNKNOWN_MODEL.format(models=", ".join(known)), 0, 0.0)] * len(rows)
    out: list = [(None, ERR_EMPTY_INPUT, 0, 0.0)] * len(rows)
    todo = [i for i, r in enumerate(rows)
            if r.get(text) is not None and not (isinstance(r[text], str) and r[text].strip() == "")]
    for attempt in range(1, max_attempts + 1):
        if not todo:
            break
        if attempt > 1:
            sleep(backoff(attempt - 1))
        try:
            got = list(client.classify_batch([rows[i] for i in todo], attempt))
        except Exception as e:  # noqa: BLE001 - a failed batch fails its rows
            got = [e] * len(todo)
        cost, failed = attempt * client.cost_per_call, []
        for i, g in zip(todo, got):
            if g and not isinstance(g, Exception):
                out[i] = (g, None, attempt, cost)
                continue
            last = str(g) if isinstance(g, Exception) else ERR_EMPTY_RESULT    # an empty result is a failure
            out[i] = (None, ERR_FAILED.format(model=model, attempts=attempt, last=last), attempt, cost)
            failed.append(i)
        todo = failed
    return out


def classify_rows(df: DataFrame, models: Sequence[str], classifiers: Mapping[str, Classifier],
                  key: str = "doc_id", text: str = "text", fields: Sequence[str] = ("doc_id", "text", "lang", "n_chars"),
                  max_attempts: int = MAX_ATTEMPTS, backoff_base: float = 2.0,
                  passthrough: Sequence[str] = (), labels: LabelSet = PUBLISHED) -> DataFrame:
    """One structured result per (row, model): key, model, result, error, attempts, cost.

    Unknown model or empty input -> error row with 0 attempts. Up to
    ``max_attempts`` tries with ``backoff_base ** n`` seconds between them.
    Cost is per row (attempts x price per call). Only ``fields`` travel to
    Python; the text is passed whole. ``passthrough`` columns are carried to
    the output, so callers never join the result back to its input.
    """
    known = sorted(classifiers)
    clients = dict(classifiers)
    cols = list(dict.fromkeys([key, text, *fields, *passthrough]))
    schema = output_schema(key, df.schema[key].dataType, [df.schema[c] for c in passthrough], labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = {}
        for m in models:
            c = clients.get(m)
            if c is not None:
                c.open()
            opened[m] = c
        backoff = (lambda n: backoff_base ** n) if backoff_base else (lambda n: 0.0)
        sleep = time.sleep if backoff_base else (lambda s: None)
        for pdf in batches:
            out = {key: [], **{c: [] for c in passthrough},
                   "model": [], "result": [], "error": [], "attempts": [], "cost": []}
            rows = pdf.to_dict("records")
            for m in models:
                got = _attempt_rows(opened[m], m, known, rows, text, max_attempts, backoff, sleep)
                for row, (res, err, att, cost) in zip(rows, got):
                    out[key].append(row[key])
                    for c in passthrough:
                        out[c].append(row[c])
                    out["model"].append(m)
                    out["result"].append(res)
                    out["error"].append(err)
                    out["attempts"].append(att)
                    out["cost"].append(cost)
            yield pd.DataFrame(out)

    return df.select(*cols).mapInPandas(run, schema)


def results_long(classified: DataFrame, key: str = "doc_id", labels: LabelSet = DOCUMENT) -> DataFrame:
    """(key, model, attribute, value) for successful rows."""
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col("result")[a].alias("value")) for a in labels.attributes])
    return classified.where(F.col("result").isNotNull()).select(key, "model", F.inline(rows))


def validate_enums(classified: DataFrame, key: str = "doc_id", labels: LabelSet = DOCUMENT) -> DataFrame:
    """Per successful (row, model): values outside the enum, and the dependency rules of the ranked
    attributes (the second repeats the first; the third repeats either).

    The enum set is a fixed literal, so membership is an ``array_contains``
    in one projection: no join, no shuffle, the classifier output is read once."""
    r = F.col("result")
    bad = sum((~F.coalesce(F.array_contains(F.array(*[F.lit(v) for v in vals]), r[a]), F.lit(False))).cast("int")
              for a, vals in labels.enums.items())
    p, s, t = (r[a] for a in labels.ranked)
    out = classified.where(r.isNotNull()).select(
        key, "model", bad.cast("int").alias("n_invalid_values"),
        (s == p).alias("secondary_repeats_primary"), ((t == p) | (t == s)).alias("tertiary_repeats"))
    return out.withColumn("valid", (F.col("n_invalid_values") == 0) & ~F.col("secondary_repeats_primary")
                          & ~F.col("tertiary_repeats"))


def summary(result: Column, labels: LabelSet = DOCUMENT) -> Column:
    """The attributes as one ``|``-joined text (null for a failed row)."""
    return F.when(result.isNotNull(), F.concat_ws("|", *[result[a] for a in labels.attributes]))


def compare_models(df: DataFrame, trained: DataFrame, models: Sequence[str] = ("A", "B"), key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Two trained models side by side: one column per model (result summary and
    per-row cost) plus the number of attributes on which they agree. Both read
    a text in the same pass."""
    wide = with_model_results(df, models, trained, [key], text)
    a, b = (F.col(f"_result_{m}") for m in models)
    cols = []
    for m, r in zip(models, (a, b)):
        cols += [summary(r).alias(f"{m.lower()}_result"),
                 F.when(r.isNull(), 0.0).otherwise(MODELS[m].price).alias(f"{m.lower()}_cost")]
    agree = sum((F.coalesce(a[x] == b[x], F.lit(False))).cast("int") for x in DOCUMENT.attributes)
    return wide.select(key, *cols, agree.cast("int").alias("n_agree"))


def model_scorecard(classified: DataFrame) -> DataFrame:
    """Correct gold attributes per model on the held-out rows, accuracy (of each attribute, too), the
    winner and total cost. ``classified`` carries ``held_out`` and a column of gold for each class
    target (joined to the classifier's small output, never to the texts). A failed classification
    scores 0; the cost covers every classified row. One aggregation by model."""
    r, held = F.col("result"), F.col("held_out")
    known = {a: (held & F.col(t).isNotNull()) for a, t in GOLD.items()}
    right = {a: known[a] & F.coalesce(r[a] == F.col(t), F.lit(False)) for a, t in GOLD.items()}
    n_known = sum(k.cast("int") for k in known.values())
    n_right = sum(x.cast("int") for x in right.values())
    per_model = classified.select("model", "cost", n_known.alias("k"), n_right.alias("c"),
                                  *[known[a].alias(f"k_{a}") for a in GOLD], *[right[a].alias(f"c_{a}") for a in GOLD])
    per_model = per_model.groupBy("model").agg(
        F.count_if(F.col("k") > 0).cast("bigint").alias("n_rows"), F.sum("k").cast("bigint").alias("n_gold"),
        F.sum("c").cast("bigint").alias("n_correct"),
        F.count_if((F.col("k") > 0) & (F.col("c") == F.col("k"))).cast("bigint").alias("n_perfect"),
        *[F.try_divide(F.count_if(f"c_{a}"), F.count_if(f"k_{a}")).alias(f"{a}_accuracy") for a in GOLD],
        F.sum(F.col("cost").cast("decimal(18,6)")).cast("double").alias("total_cost"))
    per_model = per_model.withColumn("accuracy", F.try_divide("n_correct", "n_gold"))
    w = Window.orderBy(F.col("accuracy").desc(), F.col("model"))   # one row per model
    return per_model.withColumn("is_winner", F.row_number().over(w) == 1)
