"""A trained text classifier for a closed label set, in column expressions.

Training counts, for every word and shape feature, the labelled texts of each class that hold it (one
aggregation, partial per task); a feature's weight for a class is the log odds of holding it, in
thousandths. Each class keeps the ``terms`` features with the largest likelihood ratio (G), if that
is beyond chance for a vocabulary of any usual size. So a model is a table of a bounded
number of rows at any input size. Classification splits a text once, matches its distinct features
with the model (a join whose model side Spark broadcasts by its size) and sums weights per text; no
text is shuffled, a text's longest row in the shuffle is its sums. All models score in one pass.

Texts whose key falls in the held-out fold never train, and the scorecard counts only those."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes that the tables hold gold for.
LANGUAGES = ["en", "de", "fr", "es"]
CLASSES: dict[str, list[str]] = {"language": LANGUAGES, "quality": ["high", "low"], "toxicity": ["clean", "toxic"]}
PAIRS = [(t, c) for t, cs in CLASSES.items() for c in cs]
#: Everything but letters parts words; A-Z are lowered, other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "[\\x01-\\x60\\x7B-\\x7F]+"
SYMBOLS = "#*$%&|<>"
#: One key in so many is held out.
FOLDS = 5
#: Least G of a feature, in thousandths (20: one in 130,000 by chance).
LEAST_G = 20_000


class Model(NamedTuple):
    """Strongest features kept for each class, and the price of a call."""

    terms: int
    price: float


MODELS: dict[str, Model] = {"A": Model(512, 0.002), "B": Model(4, 0.0005)}


def held_out(key: Column) -> Column:
    """Whether a key is in the held-out fold; a null key never trains."""
    return F.coalesce(F.pmod(F.pmod(key, F.lit(2147483647)) * 48271, F.lit(2147483647)) % FOLDS == 0, F.lit(True))


def words(text: Column) -> Column:
    # Both lower A-Z only; on plain ASCII ``lower`` works on bytes, ``translate`` letter by letter.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(lowered, APART)


def features(text: Column, words: Column, *extra: str) -> Column:
    """The distinct words of a text and its shape: binary digits of the share of symbols and of the
    number of words to a line, as tokens that no word equals; and ``extra`` tokens."""
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))    # a byte each
    lines = 1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))

    def size(x: Column) -> Column:
        return F.length(F.bin(F.floor(x).cast("long"))).cast("string")

    shape = F.array(F.concat(F.lit("#"), size(symbols * 1000 / F.greatest(F.length(text), F.lit(1)))),
                    F.concat(F.lit("|"), size(F.size(words) / lines)))
    return F.array_distinct(F.concat(shape, words, F.array(*map(F.lit, extra)).cast("array<string>")))


def features_of(text: str) -> set[str]:
    """``features`` of one text in Python, for clients that run inside a task."""
    words = re.split(APART, text.translate(str.maketrans(UPPER, LOWER)))
    symbols, lines = sum(map(text.count, SYMBOLS)), 1 + text.count("\n")
    return {*words, f"#{max(1, (symbols * 1000 // max(len(text), 1)).bit_length())}",
            f"|{max(1, (len(words) // lines).bit_length())}"}


def _tokens(rows: DataFrame, text: str, keep: Sequence[str], *extra: str) -> DataFrame:
    """``keep`` columns and each distinct ``token`` of the text, and ``extra`` tokens."""
    cut = rows.withColumn("_words", words(F.col(text)))         # split once, used twice
    return cut.select(*keep, F.explode(features(F.col(text), F.col("_words"), *extra)).alias("token"))


def gold(lang: Column, quality: Column, toxic: Column) -> dict[str, Column]:
    """The classes that a row's own columns state; null where they don't."""
    return {"language": F.when(lang.isin(LANGUAGES), lang),
            "quality": F.when(quality == 1, "high").when(quality == 0, "low"),
            "toxicity": F.when(toxic == 0, "clean").when(toxic == 1, "toxic")}


def _column(target: str, label: str) -> str:
    return f"{target}_{CLASSES[target].index(label)}"


def train(rows: DataFrame, terms: int, text: str = "text") -> DataFrame:
    """(target, label, token, weight, place) of the strongest features, with the class's prior as
    token '' at place 0. ``rows``: the training texts with a gold column for each target."""
    # Classes travel with every token, so as small numbers (another value: -1).
    def number(t: str) -> Column:
        known = [F.when(F.col(t) == c, i) for i, c in enumerate(CLASSES[t])]
        return F.coalesce(*known, F.when(F.col(t).isNotNull(), -1)).alias(t)

    rows = rows.select(text, *map(number, CLASSES))
    hit = {(t, c): F.count_if(F.col(t) == i).alias(_column(t, c)) for t, cs in CLASSES.items() for i, c in enumerate(cs)}
    known = {t: F.count(t).alias(t) for t in CLASSES}
    tokens = _tokens(rows, text, list(CLASSES))

    def long(counts: DataFrame) -> DataFrame:
        return counts.select("token", F.inline(F.array(*[F.struct(
            F.lit(t).alias("target"), F.lit(c).alias("label"), F.col(_column(t, c)).alias("p"),
            (F.col(t) - F.col(_column(t, c))).alias("n")) for t, c in PAIRS])))

    counts = tokens.where("token <> ''").groupBy("token").agg(*hit.values(), *known.values())
    # The totals need no words. As one more token they would make the texts be cut twice: Spark moves
    # the filter on it below the aggregation.
    total = long(rows.groupBy(F.lit("").alias("token")).agg(*hit.values(), *known.values())).select(
        "target", "label", F.col("p").alias("all_p"), F.col("n").alias("all_n"))
    j = long(counts).join(F.broadcast(total), ["target", "label"])      # total: one row a class

    def thousandths(x: Column) -> Column:
        return F.round(x * 1000).cast("long")

    p, n, all_p, all_n = (F.col(c).cast("double") for c in ("p", "n", "all_p", "all_n"))
    cells = [(p, all_p, p + n), (n, all_n, p + n), (all_p - p, all_p, all_p + all_n - p - n),
             (all_n - n, all_n, all_p + all_n - p - n)]
    g = 2 * sum(F.when(x > 0, x * F.log(x * (all_p + all_n) / (side * part))).otherwise(0.0) for x, side, part in cells)
    weight = F.log((p + 1) * (all_n + 2) / ((n + 1) * (all_p + 2)))
    # Rounding is dear, so the bulk goes before it.
    weighed = j.where(g * 1000 > LEAST_G - 2).withColumn("weight", thousandths(weight)).withColumn(
        "g", thousandths(g)).where(F.col("g") >= LEAST_G)
    order = Window.partitionBy("target", "label").orderBy(F.col("g").desc(), "token")
    # The limit stands on the rank itself, so that each task keeps only so many rows a class before the sort.
    kept = weighed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= terms)
    prior = total.select("target", "label", F.lit("").alias("token"),
                         thousandths(F.log((all_p + 1) / (all_n + 1))).alias("weight"), F.lit(0).alias("place"))
    return kept.select("target", "label", "token", "weight", "place").union(prior)


def score(rows: DataFrame, model: DataFrame, models: Mapping[str, Model], keep: Sequence[str],
          text: str = "text") -> DataFrame:
    """``keep`` columns with one struct per model: the classes of each target from the best down."""
    def sums(m: Model) -> list[Column]:
        return [F.sum(F.when((F.col("target") == t) & (F.col("label") == c) & (F.col("place") <= m.terms), F.col("weight"))
                      .otherwise(0)) for t, c in PAIRS]

    names = {m: [f"{m}_{_column(t, c)}" for t, c in PAIRS] for m in models}
    wide = model.groupBy("token").agg(*[s.alias(n) for m, x in models.items() for s, n in zip(sums(x), names[m])])
    # The empty token holds the priors, so every text has a match.
    rows = rows.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("_row", F.monotonically_increasing_id())
    tokens = _tokens(rows, text, ["_row", *keep], "")
    total = tokens.join(wide, "token").groupBy("_row", *keep).agg(*[F.sum(n).alias(n) for x in names.values() for n in x])

    def ranked(m: str, target: str) -> Column:
        labels = CLASSES[target]
        n = len(labels)
        # The earlier label of a tie first.
        scored = F.array(*[F.col(f"{m}_{_column(target, c)}") * n + (n - 1 - i) for i, c in enumerate(labels)])
        return F.transform(F.sort_array(scored, asc=False),
                           lambda s: F.element_at(F.array(*map(F.lit, labels)), n - F.pmod(s, F.lit(n)).cast("int")))

    return total.select(*keep, *[F.struct(*[ranked(m, t).alias(t) for t in CLASSES]).alias(f"_ranked_{m}") for m in models])


# ------------------------------------------------------------------------------------------ SQL
def _thousandths_sql(x: str) -> str:
    return f"CAST(round(({x}) * 1000) AS BIGINT)"


def _g_sql() -> str:
    cells = [("p", "all_p", "(p + n)"), ("n", "all_n", "(p + n)"), ("(all_p - p)", "all_p", "(all_p + all_n - p - n)"),
             ("(all_n - n)", "all_n", "(all_p + all_n - p - n)")]
    return "2 * (" + " + ".join(f"CASE WHEN {x} > 0 THEN {x} * ln({x} * (all_p + all_n) / ({side} * {part})) ELSE 0.0 END"
                                for x, side, part in cells) + ")"


def held_out_sql(key: str) -> str:
    return f"coalesce(({key} % 2147483647 * 48271) % 2147483647 % {FOLDS} = 0, true)"


def scored_sql(models: Mapping[str, Model]) -> str:
    """CTEs ``doc`` (documents with gold and ``held_out``) and ``scored`` (doc_id, model, target,
    labels from the best down) over the tables documents and labels."""
    feats = f"""list_distinct(list_concat(
      ['#' || length(bin(CAST(floor((length(body) - length(translate(body, '{SYMBOLS}', ''))) * 1000
        / greatest(length(body), 1)) AS BIGINT))),
       '|' || length(bin(CAST(floor(len(words) / (1 + length(body) - length(replace(body, chr(10), '')))) AS BIGINT)))],
      words))"""
    count = ", ".join(f"count(*) FILTER (g_{t} = '{c}') AS {_column(t, c)}" for t, c in PAIRS)
    known = ", ".join(f"count(g_{t}) AS {t}" for t in CLASSES)
    long = " UNION ALL ".join(f"SELECT token, '{t}' AS target, '{c}' AS label, {_column(t, c)} AS p, "
                              f"{t} - {_column(t, c)} AS n FROM counts" for t, c in PAIRS)
    place = "CASE label " + " ".join(f"WHEN '{c}' THEN {i}" for t, c in PAIRS for i in [CLASSES[t].index(c)]) + " END"
    terms = ", ".join(f"('{m}', {x.terms})" for m, x in models.items())
    return f"""
WITH doc AS (
  SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic, {held_out_sql('d.doc_id')} AS held_out,
    CASE WHEN d.lang IN ({', '.join(f"'{x}'" for x in LANGUAGES)}) THEN d.lang END AS g_language,
    CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS g_quality,
    CASE l.toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS g_toxicity
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cut AS (SELECT doc.*, coalesce(text, '') AS body,
  string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{APART}') AS words FROM doc),
tok AS (SELECT doc_id, held_out, text, g_language, g_quality, g_toxicity, unnest({feats}) AS token FROM cut),
counts AS (
  SELECT token, {count}, {known} FROM (
    SELECT token, g_language, g_quality, g_toxicity FROM tok WHERE NOT held_out AND text IS NOT NULL AND token <> ''
    UNION ALL
    SELECT '*', g_language, g_quality, g_toxicity FROM doc WHERE NOT held_out AND text IS NOT NULL)
  GROUP BY token),
long AS ({long}),
weighed AS (
  SELECT target, label, token, {_thousandths_sql(_g_sql())} AS g, {_thousandths_sql("""CASE WHEN token = '*'
    THEN ln((all_p + 1) / (all_n + 1)) ELSE ln((p + 1) * (all_n + 2) / ((n + 1) * (all_p + 2))) END""")} AS weight
  FROM (SELECT x.target, x.label, x.token, CAST(x.p AS DOUBLE) AS p, CAST(x.n AS DOUBLE) AS n,
          CAST(a.p AS DOUBLE) AS all_p, CAST(a.n AS DOUBLE) AS all_n
        FROM long x JOIN long a ON a.token = '*' AND a.target = x.target AND a.label = x.label)),
model AS (
  SELECT target, label, CASE WHEN token = '*' THEN '' ELSE token END AS token, weight,
    row_number() OVER (PARTITION BY target, label ORDER BY token = '*' DESC, g DESC, token) - 1 AS place
  FROM weighed WHERE token = '*' OR g >= {LEAST_G}),
machines(model, terms) AS (VALUES {terms}),
held AS (SELECT doc_id, token FROM tok WHERE token <> '' UNION ALL SELECT doc_id, '' FROM doc),
sums AS (
  SELECT h.doc_id, u.model, m.target, m.label, sum(m.weight) AS score
  FROM held h JOIN model m ON m.token = h.token JOIN machines u ON m.place <= u.terms GROUP BY ALL),
pairs(target, label) AS (VALUES {', '.join(f"('{t}', '{c}')" for t, c in PAIRS)}),
scored AS (
  SELECT d.doc_id, u.model, p.target AS target,
    list(p.label ORDER BY coalesce(s.score, 0) DESC, {place.replace('label', 'p.label', 1)}) AS labels
  FROM doc d CROSS JOIN machines u CROSS JOIN pairs p
  LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.model = u.model AND s.target = p.target AND s.label = p.label
  GROUP BY ALL)
"""
