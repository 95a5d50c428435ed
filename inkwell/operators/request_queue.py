"""Requests to a record-returning model client, with a durable retry queue.

A request is one (row, model) pair. Rounds stand for attempts: every round sends the requests still
open in batches through the client (``mapInPandas``; a client opens once per task) and writes their
outcomes under ``<queue>/attempt=<n>`` in the shared folder. A finished round is never sent again: a
restart takes up the queue at the first round without a commit, and a lost executor repeats its own
tasks only. Only keys and outcomes are queued; the texts are read again for the requests that still
need them. Between rounds the whole queue waits once, 2^n seconds.

Unknown models and empty texts are refused without an attempt. A refusal, a failure or an empty
result by the client is data: the request goes into the next round, and after the last one its error
text stands in place of a record. Rows are told apart by key; rows that share a key are one request
(the smallest row), a null key is a key like any other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import textmodel
from inkwell.operators.enrich import (
    DOCUMENT, ERR_EMPTY_INPUT, ERR_EMPTY_RESULT, ERR_FAILED, ERR_UNKNOWN_MODEL, MAX_ATTEMPTS, Classifier, LabelSet,
)

#: Rows of one call to a client.
REQUEST_ROWS = 64


def _outcome_schema(labels: LabelSet) -> T.StructType:
    return T.StructType([T.StructField("model", T.StringType()), T.StructField("result", labels.result_type),
                         T.StructField("error", T.StringType())])


def _send(clients: Mapping[str, Classifier], key: str, fields: Sequence[str], attempt: int, request_rows: int):
    """(key, model, result, error) of every request; never raises for what a client does."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: set[str] = set()
        for pdf in batches:
            out: dict[str, list] = {key: [], "model": [], "result": [], "error": []}
            for model, part in pdf.groupby("model", sort=True):
                client = clients[model]
                if model not in opened:
                    client.open()
                    opened.add(model)
                rows = part[list(fields)].to_dict("records")
                for lo in range(0, len(rows), request_rows):
                    some = rows[lo:lo + request_rows]
                    try:
                        got = list(client.classify_batch(some, attempt))
                    except Exception as e:  # noqa: BLE001 - a failed call fails its rows
                        got = [e] * len(some)
                    for row, g in zip(some, got, strict=True):
                        failed = not g or isinstance(g, Exception)
                        out[key].append(row[key])
                        out["model"].append(model)
                        out["result"].append(None if failed else g)
                        out["error"].append((str(g) if isinstance(g, Exception) else ERR_EMPTY_RESULT) if failed else None)
            yield pd.DataFrame(out)

    return task


def _committed(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def run_queue(rows: DataFrame, models: Sequence[str], clients: Mapping[str, Classifier], queue_dir: str,
              key: str = "doc_id", text: str = "text", fields: Sequence[str] = (), max_attempts: int = MAX_ATTEMPTS,
              backoff_base: float = 2.0, sleep: Callable[[float], None] = time.sleep,
              request_rows: int = REQUEST_ROWS, labels: LabelSet = DOCUMENT) -> DataFrame:
    """(key, model, result, error, attempts, cost) of every request, from the queue's folder."""
    spark = rows.sparkSession
    columns = list(dict.fromkeys([key, text, *fields]))
    known = [m for m in models if m in clients]
    empty = F.col(text).isNull() | (F.btrim(F.col(text)) == "")
    one = rows.select(*columns).groupBy(key).agg(F.min(F.struct(*[c for c in columns if c != key])).alias("r")).select(key, "r.*")
    outcome = T.StructType([rows.schema[key], *_outcome_schema(labels)])
    rounds: list[DataFrame] = []
    for attempt in range(1, max_attempts + 1):
        folder = f"{queue_dir}/attempt={attempt}"
        if not _committed(spark, folder):
            if attempt == 1:
                open_requests = one.where(~empty).withColumn("model", F.explode(F.array(*map(F.lit, known)).cast("array<string>")))
            else:
                failed = rounds[-1].where(F.col("result").isNull()).select(F.col(key).alias("_k"), "model")
                open_requests = one.join(failed, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
                sleep(backoff_base ** (attempt - 1) if backoff_base else 0.0)
            open_requests.mapInPandas(_send(clients, key, columns, attempt, request_rows), outcome).write.mode(
                "overwrite").parquet(folder)
        rounds.append(spark.read.schema(outcome).parquet(folder))
    price = F.create_map(*[x for m in known for x in (F.lit(m), F.lit(clients[m].cost_per_call))]) if known else None
    out = []
    for attempt, done in enumerate(rounds, 1):
        final = done if attempt == max_attempts else done.where(F.col("result").isNotNull())
        error = F.when(F.col("result").isNull(), F.concat(
            F.lit(ERR_FAILED.split("{model}")[0]), F.col("model"),
            F.lit(ERR_FAILED.split("{model}")[1].format(attempts=attempt, last="")), F.col("error")))
        out.append(final.select(key, "model", "result", error.alias("error"), F.lit(attempt).alias("attempts"),
                                (F.lit(attempt) * (price[F.col("model")] if known else F.lit(0.0))).alias("cost")))
    none = F.lit(None).cast(labels.result_type)
    unknown = F.lit(ERR_UNKNOWN_MODEL.format(models=", ".join(sorted(clients))))
    refused = one.withColumn("model", F.explode(F.array(*map(F.lit, models)).cast("array<string>"))).where(
        empty | ~F.col("model").isin(known))
    out.append(refused.select(key, "model", none.alias("result"), F.when(F.col("model").isin(known), F.lit(ERR_EMPTY_INPUT))
                              .otherwise(unknown).alias("error"), F.lit(0).alias("attempts"), F.lit(0.0).alias("cost")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


class LocalModelClient(Classifier):
    """A trained model run inside the task under the limits of a service: a deadline, which allows a
    text so many characters more with every attempt, and a policy that refuses texts with some words.

    ``weights``: (target, label, token) to a weight, the rows of a trained model (a bounded table)."""

    def __init__(self, name: str, weights: Mapping[tuple[str, str, str], int], price: float,
                 deadline_chars: int | None = None, refused_words: Sequence[str] = ()) -> None:
        self.name, self.cost_per_call = name, price
        self._weights: dict[str, list[tuple[str, str, int]]] = {}
        for (target, label, token), w in weights.items():
            self._weights.setdefault(token, []).append((target, label, w))
        self._deadline, self._refused = deadline_chars, frozenset(refused_words)

    def classify(self, row: Mapping, attempt: int) -> dict:
        text = row["text"]
        if self._deadline and len(text) > attempt * self._deadline:
            raise TimeoutError("deadline exceeded")
        tokens = textmodel.features_of(text)
        if not self._refused.isdisjoint(tokens):
            raise PermissionError("refused by content policy")
        score = dict.fromkeys(textmodel.PAIRS, 0)
        for token in tokens | {""}:        # the empty token holds the priors
            for target, label, w in self._weights.get(token, ()):
                score[target, label] += w
        best = {t: sorted(cs, key=lambda c: (-score[t, c], cs.index(c))) for t, cs in textmodel.CLASSES.items()}  # noqa: B023
        first = [*best["language"][:3], best["quality"][0], best["toxicity"][0]]
        return dict(zip(DOCUMENT.attributes, first, strict=True))


def model_weights(trained: DataFrame, terms: int) -> dict[tuple[str, str, str], int]:
    """A trained model's rows on the driver: at most ``terms + 1`` for each class."""
    rows = trained.where(F.col("place") <= terms).select("target", "label", "token", "weight").toArrow().to_pylist()
    return {(r["target"], r["label"], r["token"]): r["weight"] for r in rows}
