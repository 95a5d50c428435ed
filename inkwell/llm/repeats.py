"""Exact substring dedup over sampled suffixes, range-partitioned and sorted.

A byte is removed if a string of ``WIDTH`` bytes over it also starts earlier (in a text with a
smaller id, or earlier in the same one). Suffixes are sampled by content: of each window of
``WIDTH`` bytes the 32-byte gram with the smallest hash is its anchor, so equal windows have
equal anchors at equal places, and about one suffix in 35 is kept. The windows of an anchor form a
segment.

1. Anchors are range-partitioned by sampled splitters on (leading bytes and hash of the gram, hash
   of the segment, id, place) and sorted. A segment whose twin stands before it in that order is
   repeated as a whole. Of the first segments, those that share the gram with another segment, and
   those beside a bucket's boundary, are unsure.
2. The bytes of unsure segments are range-partitioned by the same leading tokens, a gram with more
   than ``HOT`` segments in several parts. Each bucket sorts the windows of bounded blocks by
   multikey quicksort on 8-byte characters (by the leading word; only ties go on to the next);
   equal neighbours beyond the first are repeated.
3. Windows of a gram in several parts are compared across their boundaries: by two 64-bit hashes,
   the smallest (id, place) of each window over all parts.
4. The removed spans meet their texts again.

A string that a third of all texts share is split over buckets by (id, place) in step 1 and by id
in step 2; nothing is grouped but the spans of one text. Finished steps are staged in the shared folder and their shuffle files
released. Null and empty texts have no bytes. Rows with a null id take no part and stay whole. Ids
identify texts: rows that repeat one must repeat its text, and get the same result. An empty table
gives an empty result. Columns other than id and text are not read."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import drop_staged, stage, table

WIDTH, GRAM = 100, 32
#: Windows sorted at once in a task, up to the end of a gram's segments.
BLOCK = 400_000
#: A gram with more unsure segments is split by id into parts of about so many.
HOT = 20_000
FOUND = "kind int, lead long, id long, place long, stop long, k1 long, k2 long"
SORTED = FOUND + ", spans array<struct<lo:long,hi:long>>"
REPEATED, UNSURE, BORDER = 0, 1, 2


def anchors(raw: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(row, start, extra, lead, segment hash) of each anchor's segment: its windows start at
    start .. start + extra of the row."""
    none = np.empty(0, np.int64)
    n = len(raw)
    if n < width:
        return none, none, none, none, none
    span = width - gram + 1
    pre = K.prefix(raw)
    at = np.arange(n - gram + 1)
    h = K.span_hash(pre, at, at + gram)
    # The smallest hash of each window, the leftmost of ties: places stand in the low bits.
    bits = max(26, int(n).bit_length())
    low = K.U((1 << bits) - 1)
    m = (h & ~low) | at.astype(K.U)
    reach = 1
    while reach * 2 <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if span > reach:
        m = np.minimum(m[:len(m) - (span - reach)], m[span - reach:])
    ok = np.ones(n - width + 1, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        ok[max(a, b - width + 1):b] = False
    s = np.flatnonzero(ok)
    if not len(s):
        return none, none, none, none, none
    a = (m[s] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo, hi, a = s[cut], s[np.append(cut[1:], len(s)) - 1], a[cut]
    row = np.searchsorted(off, lo, "right") - 1
    first = raw[a].astype(np.int64) << 16 | raw[a + 1].astype(np.int64) << 8 | raw[a + 2]
    lead = first << 39 | (h[a] >> K.U(25)).astype(np.int64)
    return row, lo - off[row], hi - lo, lead, K.span_hash(pre, lo, hi + width).astype(np.int64)


def _anchor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        raw, off = K.column_bytes(batch.column(1))
        for lo, _, part, at in K.pieces(raw, off):
            row, start, extra, lead, segment = anchors(part, at)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead), pa.array(segment), pa.array(ids[lo + row]), pa.array(start << 8 | extra)],
                    names=["lead", "segment", "id", "place"])


def _rows(kind: int, lead, ids, place, stop=None, k1=None, k2=None) -> pa.RecordBatch:
    zero = np.zeros(len(ids), np.int64)
    cols = [np.full(len(ids), kind, np.int32), lead, ids, place, *(zero if x is None else x for x in (stop, k1, k2))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols],
                                      names=[x.split()[0] for x in FOUND.split(", ")])


def _sorted_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over one sorted bucket; ``head`` is the first row of the current class, held back
    until the next class tells whether its gram is shared."""
    head, head_shared = None, True          # the bucket's first class lies at a boundary
    for batch in batches:
        if not len(batch):
            continue
        lead, seg, ids, place = (batch.column(i).to_numpy() for i in range(4))
        if head is not None:
            lead, seg, ids, place = (np.concatenate([[h], x]) for h, x in zip(head, (lead, seg, ids, place), strict=True))
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (seg[1:] != seg[:-1])
        first = np.flatnonzero(new)
        own = first[np.cumsum(new) - 1]
        again = (ids != ids[own]) | (place != place[own])
        if again.any():
            p = place[again]
            yield _rows(REPEATED, lead[again], ids[again], p >> 8, (p >> 8) + (p & 255) + WIDTH)
        same = lead[first[1:]] == lead[first[:-1]]
        shared = np.zeros(len(first), bool)
        shared[1:] = same
        shared[:-1] |= same
        shared[0] |= head_shared
        last = first[-1]
        out = first[:-1][shared[:-1]]
        if len(out):
            yield _rows(UNSURE, lead[out], ids[out], place[out])
        head, head_shared = (lead[last], seg[last], ids[last], place[last]), bool(shared[-1])
    if head is not None:                    # so does its last class
        yield _rows(UNSURE, *(np.array([x]) for x in (head[0], head[2], head[3])))


def _segment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.column_bytes(batch.column(1))
        data, held = raw.tobytes(), 0
        rows: list[tuple] = []

        def flush():
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                names=["lead", "part", "split", "id", "place", "item"])

        for i, (doc, want) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
            for lead, part, split, p in zip(*(want.values.field(k).to_pylist() for k in range(4)), strict=True):
                start = off[i] + (p >> 8)
                rows.append((lead, part, split, doc, p >> 8, data[start:min(off[i + 1], start + (p & 255) + WIDTH)]))
                held += len(rows[-1][5]) + 40
            if held > 4 << 20:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()


def multikey_order(raw: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the windows raw[start:start + width] as strings of 8-byte big-endian characters:
    (order, whether a window differs from the one before it). Ties keep their order. Only windows
    that tie so far look at the next character."""
    word = np.zeros(len(raw), K.U)
    for i in range(8):
        word[:len(raw) - 7] |= raw[i:len(raw) - 7 + i].astype(K.U) << K.U(56 - 8 * i)
    order = np.argsort(word[start], kind="stable")
    key = word[start[order]]
    new = np.ones(len(start), bool)
    new[1:] = key[1:] != key[:-1]
    for step in [*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]:
        tie = ~new
        tie[:-1] |= ~new[1:]
        at = np.flatnonzero(tie)
        if not len(at):
            break
        group = np.cumsum(new[at])
        key = word[start[order[at]] + step]
        o = np.lexsort((key, group))
        order[at] = order[at][o]
        key, group = key[o], group[o]
        new[at[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return order, new


def _sort_block(lead, ids, place, items, split: bool) -> Iterator[pa.RecordBatch]:
    """``items`` of one block, sorted by (lead, id, place); ``split``: they are one part of a gram."""
    raw = np.frombuffer(b"".join(items), np.uint8)
    size = np.array([len(x) for x in items], np.int64)
    base = np.cumsum(size) - size
    n = size - WIDTH + 1
    seg = np.repeat(np.arange(len(items)), n)
    inside = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    start = base[seg] + inside
    order, new = multikey_order(raw, start)
    first = np.flatnonzero(new)
    own = order[first[np.cumsum(new) - 1]]              # the first window of each one's class
    w_id, w_at = ids[seg], place[seg] + inside
    again = np.zeros(len(seg), bool)
    again[order] = (w_id[order] != w_id[own]) | (w_at[order] != w_at[own])
    hit = np.flatnonzero(again)
    if len(hit):                    # one row per text of the block
        cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])])
        lo, hi = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
        o = np.argsort(w_id[lo], kind="stable")
        lo, hi = lo[o], hi[o]
        first = np.flatnonzero(np.concatenate([[True], w_id[lo[1:]] != w_id[lo[:-1]]]))
        spans = pa.StructArray.from_arrays([pa.array(w_at[lo]), pa.array(w_at[hi] + WIDTH)], names=["lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(lo)).astype(np.int32)), spans)
        zero = np.zeros(len(first), np.int64)
        yield _with_spans(_rows(REPEATED, zero, w_id[lo[first]], zero), lists)
    if split:
        edge = order[np.flatnonzero(new)]
        s = start[edge]
        k = [K.span_hash(K.prefix(raw, b), s, s + WIDTH, b).astype(np.int64) for b in (K.BASE, K.BASE2)]
        rows = _rows(BORDER, lead[seg[edge]], w_id[edge], w_at[edge], w_at[edge] + WIDTH, *k)
        yield _with_spans(rows, pa.nulls(len(edge), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))


def _with_spans(rows: pa.RecordBatch, spans: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, spans], names=[*rows.schema.names, "spans"])


def _sorted_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over a bucket sorted by (lead, part, id, place); a part of a split gram is a block of
    its own, other blocks end between grams."""
    held: list[tuple] = []
    windows = 0

    def flush():
        cols = list(zip(*held, strict=True))
        return _sort_block(*(np.array(c, np.int64) for c in (cols[0], cols[3], cols[4])), cols[5], cols[2][0])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if len(row[5]) < WIDTH:
                continue
            if held and row[:2] != held[-1][:2] and (windows >= BLOCK or row[2] or held[-1][2]):
                yield from flush()
                held, windows = [], 0
            held.append(row)
            windows += len(row[5]) - WIDTH + 1
    if held:
        yield from flush()


def _remover(texts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.column_bytes(batch.column(1))
            gone, spans, sha, kept = [], [], [], []
            for i, want in enumerate(batch.column(2)):
                text = raw[off[i]:off[i + 1]].tobytes()
                parts, end, removed, runs = [], 0, 0, 0
                if want.is_valid and len(want.values):
                    lo, hi = want.values.field(0).to_numpy(), want.values.field(1).to_numpy()
                    o = np.argsort(lo)
                    lo, hi = lo[o], np.minimum(np.maximum.accumulate(hi[o]), len(text))
                    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    for a, b in zip(lo[cut].tolist(), hi[np.append(cut[1:], len(lo)) - 1].tolist(), strict=True):
                        if a < b:
                            parts.append(text[end:a])
                            end, removed, runs = b, removed + b - a, runs + 1
                parts.append(text[end:])
                left = b"".join(parts)
                gone.append(removed)
                spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [batch.column(0), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(kept if texts else [None] * len(kept), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                cols, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return task


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(id, spans): arrays of spans (lo, hi) to remove from ``rows`` (id, text), not yet united."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("id is not null")
    found = stage(rows.mapInArrow(_anchor_task, "lead long, segment long, id long, place long")
                  .repartitionByRange(n, "lead", "segment", "id", "place")
                  .sortWithinPartitions("lead", "segment", "id", "place")
                  .mapInArrow(_sorted_anchors, FOUND), "anchors")
    _release(spark)
    unsure = found.where(F.col("kind") == UNSURE).select("lead", "id", "place")
    hot = unsure.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    parts = F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1))
    unsure = unsure.join(hot, "lead", "left").select("id", F.struct(
        "lead", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), (parts > 1).alias("split"), "place").alias("w"))
    unsure = unsure.groupBy("id").agg(F.collect_list("w").alias("want"))
    segments = stage(rows.join(unsure, "id").select("id", "text", "want").mapInArrow(
        _segment_task, "lead long, part int, split boolean, id long, place long, item binary"), "segments")
    _release(spark)
    fine = stage(segments.repartitionByRange(n, "lead", "part").sortWithinPartitions("lead", "part", "id", "place")
                 .mapInArrow(_sorted_segments, SORTED), "windows")
    drop_staged(spark, segments)
    border = fine.where(F.col("kind") == BORDER)
    first = border.groupBy("k1", "k2").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    across = border.join(first.where("n > 1"), ["k1", "k2"]).where(
        "id <> first.id or place <> first.place").select("id", "place", "stop")
    whole = found.where(F.col("kind") == REPEATED).select("id", "place", "stop").union(across)
    whole = whole.select("id", F.array(F.struct(F.col("place").alias("lo"), F.col("stop").alias("hi"))).alias("spans"))
    return whole.union(fine.where(F.col("kind") == REPEATED).select("id", "spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept``, the remaining
    bytes, is null unless ``texts``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = stage(spans, "spans")
    _release(docs.sparkSession)
    return rows.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(
        _remover(texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept").withColumnRenamed("id", "doc_id")
