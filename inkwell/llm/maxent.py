"""Language-model scores: hashed maximum-entropy model with class-factored softmax.

Words fall into ``CLASSES`` - 1 classes by their ending; the end of a text is a class of its own.
P(token) = P(class | context) * P(second-level class | class, context) * P(word | both classes).
The first two factors are softmaxes over hashed features of the context: the previous word, the two
before it, their pair (n-grams), and the second and third words back alone (skips). A class's words
fall by hash into ``CLASSES`` second-level classes; there the features are hashed with the class,
and the softmax starts from the counts of the second-level classes, so what it learns is how the
context changes them. The last factor is the add-one estimate within the second-level class, from
counts over all training texts: only words that share both classes are told apart by counts alone.

The softmaxes learn by distributed gradient updates in ``ROUNDS`` rounds, each over its own share of
all training texts: every task starts from the broadcast weights (2 MB at any input size), makes
Adagrad steps on minibatches of its texts, and the tasks' weights are averaged by tokens in a
tree, so each training token is used once. Texts are scored in sparse numpy batches.

Counts are grouped by 64-bit token hash with a partial sum per task. The ``FREQUENT`` most frequent
tokens, a bounded table, go to every scoring task; counts of all other tokens are joined by hash
with a shuffle, and as frequent ones are gone, no join key is hot.

Null and empty texts consist of the end token. Without training texts all counts are 0 and the
classes equally likely. A null id counts as the empty text in the training split. Repeated rows are
scored, and counted, each. An empty table gives an empty result. Columns other than id and text are
not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import count_threshold, stage, table

CLASSES = 32
FEATURES = 8192
ROUNDS = 2
FREQUENT = 1 << 18
BATCH = 8192
RATE = 0.1
#: Tasks' weights are merged by so many at once.
FAN_IN = 16
END = CLASSES - 1


def tokens(raw: np.ndarray, off: np.ndarray):
    """(hash, class, row, first) of all tokens, each row's words and its end; first: index of each
    row's first token, one more entry than rows."""
    low = K.LOWER[raw]
    start, stop, words = K.word_spans(low, off)
    rows = len(off) - 1
    first = words + np.arange(rows + 1)
    row = np.repeat(np.arange(rows), np.diff(first))
    h = np.full(first[-1], K.U(1), K.U)
    cls = np.full(first[-1], END, np.int64)
    at = np.arange(len(start)) + np.repeat(np.arange(rows), np.diff(words))
    h[at] = K.span_hash(K.prefix(low), start, stop)
    tail = low[stop - 1].astype(K.U)
    for i in (2, 3):
        tail = tail * K.U(256) + np.where(stop - i >= start, low[np.maximum(stop - i, 0)], 0).astype(K.U)
    cls[at] = (K.mix(tail) % K.U(CLASSES - 1)).astype(np.int64)
    return h, cls, row, first


def second(h: np.ndarray) -> np.ndarray:
    """The second-level class of words, by their hash."""
    return (K.mix(h.astype(K.U) + K.U(CLASSES)) % K.U(CLASSES)).astype(np.int64)


def features(h: np.ndarray, first: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
    """(tokens x 5) feature numbers of each token's context within its text, together with its
    class if ``cls`` is given."""
    n = len(h)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        prev = np.zeros(n, K.U)
        prev[k:] = h[:n - k] if k < n else h[:0]
        prev[place < k] = K.U(7)
        back.append(prev)
    cols = [np.zeros(n, K.U), back[0], back[1] * K.U(3), back[2] * K.U(5), back[0] * K.U(K.BASE) + back[1] * K.U(11)]
    if cls is not None:
        node = K.mix(cls.astype(K.U) + K.U(101))
        cols = [c + node for c in cols]
    out = np.empty((n, len(cols)), np.int32)
    for i, c in enumerate(cols):
        out[:, i] = (K.mix(c + K.U(i + 1)) % K.U(FEATURES - 1)).astype(np.int32) + 1 if i else 0
    return out


def log_probs(weights: np.ndarray, feats: np.ndarray, cls: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of P(class | features), in batches; ``prior``: what each token's scores
    start from."""
    out = np.empty(len(cls))
    for lo in range(0, len(cls), BATCH):
        f, c = feats[lo:lo + BATCH], cls[lo:lo + BATCH]
        z = weights[f[:, 0]]
        for i in range(1, f.shape[1]):
            z = z + weights[f[:, i]]
        if prior is not None:
            z = z + prior[lo:lo + BATCH]
        z -= z.max(1, keepdims=True)
        out[lo:lo + BATCH] = z[np.arange(len(c)), c] - np.log(np.exp(z).sum(1))
    return out


def steps(weights: np.ndarray, grown: np.ndarray, feats: np.ndarray, cls: np.ndarray,
          prior: np.ndarray | None = None) -> None:
    """Adagrad steps in place; ``grown``: the sums of squared gradients so far."""
    columns = np.arange(CLASSES)
    for lo in range(0, len(cls), BATCH):
        f, c = feats[lo:lo + BATCH], cls[lo:lo + BATCH]
        z = weights[f[:, 0]]
        for i in range(1, f.shape[1]):
            z = z + weights[f[:, i]]
        if prior is not None:
            z = z + prior[lo:lo + BATCH]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(c)), c] -= 1
        g = np.zeros(FEATURES * CLASSES)
        for i in range(f.shape[1]):
            g += np.bincount((f[:, i, None] * CLASSES + columns).ravel(), p.ravel(), len(g))
        g = (g / len(c)).reshape(FEATURES, CLASSES).astype(np.float32)
        grown += g * g
        weights -= RATE * g / (np.sqrt(grown) + 1e-6)


def _pieces(batch: pa.RecordBatch, column: int):
    raw, off = K.column_bytes(batch.column(column))
    yield from K.pieces(raw, off, 1 << 20)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        have = np.empty((0, 3), np.int64)
        for _, _, raw, off in _pieces(batch, 0):
            h, cls, _, _ = tokens(raw, off)
            key, at, c = np.unique(h.astype(np.int64), return_index=True, return_counts=True)
            have = np.concatenate([have, np.stack([key, cls[at], c], 1)])
            if len(have) > 1 << 20:
                yield _counts(have)
                have = have[:0]
        if len(have):
            yield _counts(have)


def _counts(have: np.ndarray) -> pa.RecordBatch:
    have = have[np.argsort(have[:, 0], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], have[1:, 0] != have[:-1, 0]]))
    return pa.RecordBatch.from_arrays(
        [pa.array(have[first, 0]), pa.array(have[first, 1].astype(np.int32)),
         pa.array(second(have[first, 0]).astype(np.int32)), pa.array(np.add.reduceat(have[:, 2], first))],
        names=["h", "cls", "sub", "c"])


def _levels(raw: np.ndarray, off: np.ndarray, prior: np.ndarray):
    """(hash, class, row, first) of ``tokens``, and what each softmax takes: (features, class, prior,
    tokens it is for)."""
    h, cls, row, first = tokens(raw, off)
    word = np.flatnonzero(cls != END)
    return h, cls, row, first, (
        (features(h, first), cls, None, slice(None)),
        (features(h, first, cls)[word], second(h[word]), prior[cls[word]], word))


def _learner(start: np.ndarray, prior: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, grown, seen = start.copy(), np.zeros_like(start), 0
        for batch in batches:
            for _, _, raw, off in _pieces(batch, 0):
                h, _, _, _, levels = _levels(raw, off, prior)
                for i, (f, c, start_at, _) in enumerate(levels):
                    steps(weights[i], grown[i], f, c, start_at)
                seen += len(h)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([(weights * seen).astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())],
                names=["w", "n"])
    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(2 * FEATURES * CLASSES), 0
    for batch in batches:
        for w, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            total += np.frombuffer(w.as_buffer(), np.float32)
            seen += n
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["w", "n"])


def train(texts: DataFrame, part: Column, prior: np.ndarray) -> np.ndarray:
    """Weights of both softmaxes learnt from ``texts`` (text); round r takes the rows with ``part``
    r. ``prior``: for each class the scores its second-level classes start from."""
    weights = np.zeros((2, FEATURES, CLASSES), np.float32)
    for r in range(ROUNDS):
        got = stage(texts.where(part == r).select("text").mapInArrow(_learner(weights, prior), "w binary, n long"), "weights")
        rows = got.count()
        while rows > 4:
            rows = -(-rows // FAN_IN)
            got = stage(got.repartition(rows).mapInArrow(_merge, "w binary, n long"), "weights")
        parts = got.collect()                       # at most four rows of 2 MB
        if parts:
            total = sum(np.frombuffer(p["w"], np.float32).astype(np.float64) for p in parts)
            weights = (total / sum(p["n"] for p in parts)).astype(np.float32).reshape(2, FEATURES, CLASSES)
    return weights


def _scorer(weights: np.ndarray, frequent: np.ndarray, logs: np.ndarray, prior: np.ndarray):
    """frequent: sorted hashes with the log10 of their count + 1; prior: for each class the natural
    logarithms of its second-level classes' denominators."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in _pieces(batch, 1):
                h, cls, row, first, levels = _levels(raw, off, prior)
                rows = hi - lo
                model = np.zeros(len(h))
                for i, (f, c, start_at, which) in enumerate(levels):
                    model[which] += log_probs(weights[i], f, c, start_at)
                    if start_at is not None:
                        model[which] -= start_at[np.arange(len(c)), c]
                model /= math.log(10)
                key = h.astype(np.int64)
                word = cls != END
                at = np.minimum(np.searchsorted(frequent, key), max(0, len(frequent) - 1))
                known = word & (frequent[at] == key) if len(frequent) else np.zeros(len(h), bool)
                common = np.bincount(row[known], logs[at[known]], rows).astype(float)
                rest = np.flatnonzero(word & ~known)
                order = rest[np.lexsort((key[rest], row[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(order)))
                offsets = pa.array(np.searchsorted(row[order[lead]], np.arange(rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(np.diff(first)),
                     pa.array(np.bincount(row[known], minlength=rows)), pa.array(common),
                     pa.array(np.bincount(row, model, rows).astype(float)),
                     pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                         [pa.array(key[order[lead]]), pa.array(times)], names=["h", "times"]))],
                    names=["id", "held_out", "n_tokens", "n_frequent", "common", "model", "rare"])
    return task


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows that
    are not ``held_out`` train the model."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = stage(training.select("text").mapInArrow(_count, "h long, cls int, sub int, c long").groupBy("h", "cls", "sub").agg(
        F.sum("c").alias("c")), "counts")
    classes = counts.groupBy("cls", "sub").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, kinds = sum(r["c"] for r in classes), sum(r["v"] for r in classes)
    ends = sum(r["c"] for r in classes if r["cls"] == END)
    prior = np.zeros((CLASSES, CLASSES), np.float32)
    for r in classes:
        if r["cls"] != END:
            prior[r["cls"], r["sub"]] = math.log(r["c"] + r["v"] + 1)
    known = counts.where(F.col("cls") != END)
    top = known.where(F.col("c") >= count_threshold(known, "c", FREQUENT)).select("h", "c").toArrow()
    order = np.argsort(top["h"].to_numpy())
    frequent, logs = top["h"].to_numpy()[order], np.log10(top["c"].to_numpy()[order] + 1.0)
    part = F.pmod(F.xxhash64(F.coalesce("id", F.lit(0)), F.lit("round")), F.lit(ROUNDS))
    weights = train(training, part, prior)
    parts = rows.select("id", "text", "held_out").mapInArrow(
        _scorer(weights, frequent, logs, prior),
        "id long, held_out boolean, n_tokens long, n_frequent long, common double, model double, rare array<struct<h:long,times:long>>")
    parts = stage(parts.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = parts.select("rid", F.explode("rare").alias("x")).select("rid", "x.h", "x.times").join(
        counts.where(F.col("cls") != END).select("h", "c"), "h").groupBy("rid").agg(
            F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("seldom"))
    out = parts.drop("rare").join(rare, "rid", "left").fillna(0, ["n_rare", "seldom"])
    seen = F.col("common") + F.col("seldom")
    return out.select(
        "id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.col("n_rare") + (1 if ends else 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (seen + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(total + kinds + 1))).alias("base_score"),
        (seen + F.col("model")).alias("score"))


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")
