"""Quality rules on repetition, by a suffix array over the words of each text.

The suffixes of all texts of a bounded piece are sorted together by prefix doubling (ranks carry
the text, so only suffixes of one text ever tie); neighbours in the suffix array give the longest
common prefixes, whose intervals of at least ``MIN_REPEAT`` words are the maximal repeated
substrings. The union of their spans over the words is the covered fraction. A text is kept if
the plain rules hold (50 words, at most half of them in repeated 3-word windows), at most
``MAX_COVERED`` percent of its words are covered, and its longest repeat has at most ``MAX_LONGEST``
words. Both limits lie below the plain rule's: 3-word windows may fill half of a text. Of the texts
labelled good, none exceeds either (covered at most 18.2%, longest repeat 13 words, at sf0.1).

Row by row, without a shuffle. Null and empty texts have no words and fail; repeated rows get the
same verdict each; texts of any length are taken whole. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import table

MIN_WORDS = 50
MIN_REPEAT = 10
MAX_COVERED = 20
MAX_LONGEST = 100

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
SCHEMA = "id long, " + ", ".join(f"{m} long" for m in MEASURES)


def suffix_ranks(keys: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words until all suffixes differ. ``keys`` must differ
    between texts; ``end``: for each word the index after its text's last word. A rank is the
    place of the first suffix with that prefix, so the last ranks are the inverse suffix array."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size > 1, size)]
    levels, k = [rank], 1
    while len(tied):
        at = tied + k
        nxt = np.where(at < end[tied], rank[np.minimum(at, n - 1)], -1)
        key = rank[tied] * (n + 1) + nxt + 1
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(tied)))
        old = rank[tied]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        lead = np.flatnonzero(group)
        inside = np.repeat(first, size) - np.repeat(lead, np.diff(np.append(lead, len(tied))))
        rank = rank.copy()
        rank[tied] = old + inside
        levels.append(rank)
        tied = tied[np.repeat(size > 1, size)]
        k *= 2
    return levels


def repeats(keys: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes whose longest common prefix has ``least`` words or more:
    (first start, second start, length)."""
    n = len(keys)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none, none
    levels = suffix_ranks(keys, end)
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    a, b = sa[:-1], sa[1:]
    must = min(len(levels) - 1, int(np.log2(least)))
    same = levels[must][a] == levels[must][b]
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, x, y = levels[level], a + length, b + length
        ok = (x < end[a]) & (y < end[b])
        ok &= r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]
        length += ok * (1 << level)
    long = length >= least
    return a[long], b[long], length[long]


def measure(raw: np.ndarray, off: np.ndarray, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All measures of the texts raw[off[i]:off[i + 1]]."""
    rows = len(off) - 1
    start, stop, first = K.word_spans(raw, off)
    counts = np.diff(first)
    n = len(start)
    doc = np.repeat(np.arange(rows), counts)
    out = {"n_words": counts,
           "word_chars": K.per_row(((raw & 0xC0) != 0x80) & ~K.SPACE[raw], off),
           "n_symbols": K.per_row(SYMBOLS[raw], off)}
    dup = np.zeros(rows, np.int64)
    data = raw.tobytes()
    for i in np.flatnonzero(K.per_row(raw == 10, off) > 0):
        lines = [x for x in data[off[i]:off[i + 1]].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    word = K.span_hash(K.prefix(raw), start, stop)
    keys = K.mix(word + K.mix(doc.astype(K.U) + K.U(1)))
    end = np.repeat(first[1:], counts)
    mark = np.zeros(n + 1, np.int64)
    if n >= 3:
        w = np.flatnonzero(np.arange(n - 2) + 2 < end[:-2])
        gram = K.mix(keys[w] * K.U(K.BASE) + K.mix(keys[w + 1] * K.U(K.BASE2) + keys[w + 2]))
        o = np.argsort(gram)
        g = gram[o]
        same = g[1:] == g[:-1]
        again = np.zeros(len(w), bool)
        again[o[1:][same]] = again[o[:-1][same]] = True
        hit = w[again]
        mark[hit] += 1
        np.subtract.at(mark, hit + 3, 1)
    out["n_repeat_words"] = K.per_row(np.cumsum(mark)[:n] > 0, first)
    a, b, length = repeats(keys, end, least)
    mark = np.zeros(n + 1, np.int64)
    for x in (a, b):
        np.add.at(mark, x, 1)
        np.subtract.at(mark, x + length, 1)
    out["covered_words"] = K.per_row(np.cumsum(mark)[:n] > 0, first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc[a], length)
    out["longest_repeat"] = longest
    return out


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.column_bytes(batch.column(1))
        for lo, hi, part, at in K.pieces(raw, off):
            got = measure(part, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *(pa.array(got[m], pa.int64()) for m in MEASURES)],
                names=["id", *MEASURES])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every text with ``base_failed`` and ``kept``."""
    m = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_task, SCHEMA)
    return with_verdict(m)


def with_verdict(m: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= MAX_LONGEST)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def good(m: dict[str, np.ndarray]) -> np.ndarray:
    """The verdict of ``with_verdict`` on measures in a task."""
    n = m["n_words"]
    plain = (n >= MIN_WORDS) & (100 * m["n_repeat_words"] <= 50 * n)
    return plain & (100 * m["covered_words"] <= MAX_COVERED * n) & (m["longest_repeat"] <= MAX_LONGEST)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.column_bytes(batch.column(at))
            keep = [good(measure(part, offsets)) for _, _, part, offsets in K.pieces(raw, off)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(task, docs.schema)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
