"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cover the same bytes, so a byte offset where a token of each ends is a shared cut.
From an interval of tokens A and B, the end of the middle token of A is located among the ends of B
by bisect; if B has none there, the ends next to it are tried, outward. At the cut found the
interval falls into two halves, which are handled alike; an interval without a cut inside is a leaf,
a group. All intervals of a level are probed together, over the concatenated texts of a bounded
piece (ends of texts are cuts, too).

The links of a group are all its pairs of a token of A and one of B. A text's links are kept as
distinct id pairs with their multiplicity, so a group of many equal tokens stays small. Pairs are
counted over all texts from per-batch sums. The ``HEAD`` most frequent counts at most (taken by a
threshold from a histogram of the counts) go to the tasks; the rest, each held by few texts, are
joined by pair. No text is shuffled.

Null and empty texts, and those whose tokens of A or B do not spell a blank and the text, have no
tokens: zeros, and an empty hash. A repeated row counts as a document of its own. Rows with a null
id keep it. Long texts are encoded in blocks cut where both tokenizers cut. An empty table gives an
empty result. Columns other than id and text are not read."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe
from inkwell.llm.common import count_threshold, stage, table

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Pair counts sent to tasks, at most.
HEAD = 1 << 18
#: Bytes of text that a task aligns together, about.
PIECE = 1 << 20
#: An id pair is one number: A's id above so many bits of B's.
SHIFT = 18
BLANK = "▁"

ROW = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def leaf_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as token counts of A and of B. ``a_end`` and ``b_end`` are the rising byte
    offsets of token ends, the last ones equal."""
    if not len(a_end):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Tokens [i, j) of A and [k, m) of B; the ends j - 1 and m - 1 are a cut already.
    i, j = np.array([0]), np.array([len(a_end)])
    k, m = np.array([0]), np.array([len(b_end)])
    out_j, out_m = [], []
    while len(i):
        leaf = (j - i == 1) | (m - k == 1)      # one token on a side: no end inside
        out_j.append(j[leaf])
        out_m.append(m[leaf])
        i, j, k, m = (x[~leaf] for x in (i, j, k, m))
        if not len(i):
            break
        middle = (i + j) // 2 - 1
        cut = np.full(len(i), -1)
        at = np.full(len(i), -1)
        todo, d = np.arange(len(i)), 0
        while len(todo):
            for probe in ((middle[todo] - d, middle[todo] + d) if d else (middle[todo],)):
                inside = (probe >= i[todo]) & (probe < j[todo] - 1)
                want = a_end[np.where(inside, probe, 0)]
                place = np.searchsorted(b_end, want)
                hit = inside & (b_end[place] == want)
                cut[todo[hit]], at[todo[hit]] = probe[hit], place[hit]
            d += 1
            todo = todo[(cut[todo] < 0) & ((middle[todo] - d >= i[todo]) | (middle[todo] + d < j[todo] - 1))]
        found = cut >= 0
        out_j.append(j[~found])
        out_m.append(m[~found])
        i, j, k, m, cut, at = (x[found] for x in (i, j, k, m, cut, at))
        # Halves side by side, so probes rise and bisect near each other.
        i, j = np.stack([i, cut + 1], 1).ravel(), np.stack([cut + 1, j], 1).ravel()
        k, m = np.stack([k, at + 1], 1).ravel(), np.stack([at + 1, m], 1).ravel()
    return np.sort(np.concatenate(out_j)), np.sort(np.concatenate(out_m))


#: Marks a piece whose tokens don't spell it.
MISSPELT = -1


def packed(ids, known: dict[int, bytes], text: bytes) -> bytes:
    """Ids as 32-bit numbers, or the mark. Tokens that spell more than their piece would be an error:
    as they never do, a text is spelt right only if all its pieces are."""
    spelt = b"".join([known.get(i, b"") for i in ids])
    if len(spelt) > len(text):
        raise ValueError("a tokenizer that adds bytes is not supported")
    return np.array(ids if spelt == text else [MISSPELT], np.int32).tobytes()


class PieceModel:
    """The sentencepiece model inside a task, run by blank-led words: no entry has a blank after
    another character, so no merge crosses the start of a run of blanks."""

    WORD = re.compile(r" *[^ ]+| +")

    def __init__(self, model: bytes) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self._model
        names = [m.id_to_piece(i) for i in range(m.piece_size())]
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("entries with a blank inside are not supported")
        self.bytes = {i: bytes([int(n[3:-1], 16)]) if m.is_byte(i) else n.replace(BLANK, " ").encode()
                      for i, n in enumerate(names) if not m.is_control(i) and not m.is_unknown(i)}
        self._sizes = np.zeros(m.piece_size(), np.int64)
        self._sizes[list(self.bytes)] = [len(x) for x in self.bytes.values()]
        self._known: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        return packed(self._model.encode("x" + word)[len(self._model.encode("x")):], self.bytes, word.encode())

    def _many(self, words: list[str]) -> Iterator[bytes]:
        """Packed ids of blank-led words: encoded as one text, as each stands for itself, and cut at
        their ends; one by one if the text isn't spelt right."""
        whole = "".join(words)
        ids = np.array(self._model.encode(whole[1:]), np.int32)     # the model adds the first blank
        ends = np.cumsum(self._sizes[ids])
        stops = np.cumsum([len(w.encode()) for w in words])
        if b"".join([self.bytes.get(i, b"") for i in ids.tolist()]) != whole.encode():
            return map(self._one, words)
        cuts = [0, *(np.searchsorted(ends, stops) + 1).tolist()]
        return (ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True))

    def encode(self, spaced: str) -> bytes:
        """The packed ids of a text, given with the blank that the model adds."""
        words, known = self.WORD.findall(spaced), self._known
        out = list(map(known.get, words))
        if None not in out:
            return b"".join(out)
        new = list({w for w, x in zip(words, out, strict=True) if x is None})
        led = [w for w in new if w[0] == " " and w[-1] != " "]
        known.update(zip(led, self._many(led) if led else (), strict=True))
        known.update((w, self._one(w)) for w in new if w not in known)
        out = b"".join(map(known.__getitem__, words))
        for w in new:       # a bounded memory
            if len(w) > bpe.SHORT or len(known) > bpe.REMEMBERED:
                del known[w]
        return out


class Aligner:
    """Both tokenizers inside a task."""

    def __init__(self, proof: bpe.Proof, model: bytes) -> None:
        pieces = bpe.Pieces(proof, plain_special=True)
        a_bytes = bpe.token_bytes(json.loads(proof.spec))
        # A whole string is its token's bytes, so it is spelt right.
        whole = np.array(list(proof.whole.values()), np.int32).tobytes()
        self._ids = bpe.Remembered({p: whole[4 * n:4 * n + 4] for n, p in enumerate(proof.whole)},
                                   lambda p: packed(pieces.merge(p), a_bytes, p.encode())).__getitem__
        self._split = pieces.split
        self._b = PieceModel(model)
        if max(*a_bytes, *self._b.bytes) >> SHIFT:
            raise ValueError(f"ids of {SHIFT} bits at most")
        self._sizes = [np.zeros(max(t) + 1, np.int64) for t in (a_bytes, self._b.bytes)]
        for size, known in zip(self._sizes, (a_bytes, self._b.bytes), strict=True):
            size[list(known)] = [len(x) for x in known.values()]
        # A's numbers end with a comma or, last of a group, a bar; B's with a comma or a semicolon.
        self._names = [[np.array([f"{i}{end}" for i in range(len(size))], object) for end in ends]
                       for size, ends in zip(self._sizes, (",|", ",;"), strict=True)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B; none if either doesn't spell a blank and the text."""
        a, b = [], []
        for block in bpe.blocks(" " + text):
            a.append(b"".join(map(self._ids, self._split(block))))
            b.append(self._b.encode(block))
        a, b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (a, b))
        right = a.min(initial=0) >= 0 and b.min(initial=0) >= 0
        return (a, b) if right else (a[:0], b[:0])

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
        ids = [self.encode(t) if t else (np.empty(0, np.int64),) * 2 for t in texts]
        a, b = (np.concatenate([x[s] for x in ids]) for s in (0, 1))
        a_last, b_last = leaf_ends(np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b]))
        a_at, b_at = (np.cumsum([0] + [len(x[s]) for x in ids]) for s in (0, 1))
        first = np.searchsorted(a_last, a_at, "right")      # groups before each text
        a_size, b_size = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        texts_pairs = self._pairs(a, b, a_last, b_last, a_size, b_size, text_of, len(texts))
        # The groups' numbers in order: A's of a group, then B's.
        names = np.empty(len(a) + len(b), object)
        for ids_s, last, size, name, before in ((a, a_last, a_size, self._names[0], b_last - b_size),
                                                (b, b_last, b_size, self._names[1], a_last)):
            part = name[0][ids_s]
            if len(last):
                part[last - 1] = name[1][ids_s[last - 1]]
            names[np.arange(len(ids_s)) + np.repeat(before, size)] = part
        out = []
        for t in range(len(texts)):
            lo, hi = first[t], first[t + 1]
            na, nb = int(a_at[t + 1] - a_at[t]), int(b_at[t + 1] - b_at[t])
            text = "".join(names[a_at[t] + b_at[t]:a_at[t + 1] + b_at[t + 1]].tolist())[:-1]
            digest = hashlib.sha256(text.encode()).hexdigest() if na else ""
            links = int((a_size[lo:hi] * b_size[lo:hi]).sum())
            out.append((na, nb, int(hi - lo), links, digest, *texts_pairs[t]))
        return out

    @staticmethod
    def _pairs(a, b, a_last, b_last, a_size, b_size, text_of, n_texts) -> list[tuple[bytes, bytes]]:
        """For each text its distinct linked id pairs, sorted, and how often each is linked."""
        def counted(ids, size):
            """Distinct ids of each group: (group, id, times)."""
            key = (np.repeat(np.arange(len(size)), size) << SHIFT) | ids
            key, times = np.unique(key, return_counts=True)
            return key >> SHIFT, key & ((1 << SHIFT) - 1), times

        single = (a_size == 1) & (b_size == 1)
        one = np.flatnonzero(single)
        text, pair = [text_of[one]], [(a[a_last[one] - 1] << SHIFT) | b[b_last[one] - 1]]
        times = [np.empty(0, np.int64)]
        in_a, in_b = np.repeat(~single, a_size), np.repeat(~single, b_size)
        many = np.flatnonzero(~single)
        ga, ia, ta = counted(a[in_a], a_size[many])
        gb, ib, tb = counted(b[in_b], b_size[many])
        at = np.searchsorted(gb, np.arange(len(many) + 1))
        width = np.diff(at)
        step = 1 << 20      # rows of distinct pairs made at a time
        rows = np.concatenate([[0], np.cumsum(width[ga])])
        lo = 0
        while lo < len(ga):
            hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + step, "right")) - 1)
            g, w = ga[lo:hi], width[ga[lo:hi]]
            left = np.repeat(np.arange(lo, hi), w)
            right = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(at[g], w)
            text.append(text_of[many[ga[left]]])
            pair.append((ia[left] << SHIFT) | ib[right])
            times.append(ta[left] * tb[right])
            lo = hi
        # Sorted as one number, text above pair; the many single links by themselves first.
        bits = int(max((x.max(initial=0) for x in pair), default=0)).bit_length()
        if bits + n_texts.bit_length() > 62:
            raise ValueError("too many texts in a piece")
        first, rest = (text[0] << bits) | pair[0], [(t << bits) | p for t, p in zip(text[1:], pair[1:], strict=True)]
        first.sort()
        start = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.empty(0, np.int64)
        key = np.concatenate([first[start], *rest])
        times = np.concatenate([np.diff(np.append(start, len(first))), *times[1:]])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        total = np.add.reduceat(times, start) if len(start) else times
        key = key[start]
        bound = np.searchsorted(key, np.arange(n_texts + 1) << bits)
        pair = key & ((1 << bits) - 1)
        return [(pair[x:y].tobytes(), total[x:y].tobytes()) for x, y in zip(bound[:-1], bound[1:], strict=True)]


def _encoded(proof: bpe.Proof, model: bytes):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(proof, model)
        names = [f.split(" ")[0] for f in ROW.split(", ")]
        for batch in batches:
            sizes = np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + PIECE, "right")) - 1)
                got = zip(*aligner.align(batch.column(2).slice(lo, hi - lo).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     *(pa.array(x, kind) for x, kind in zip(got, [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2,
                                                            strict=True))], names=names)
                lo = hi

    return task


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a batch with the number of its texts that hold them."""
    for batch in batches:
        pairs = np.concatenate([np.empty(0, np.int64)] + [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)])
        pair, texts = np.unique(pairs, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(texts)], names=["pair", "texts"])


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, texts, best): how many texts hold a pair, and whether no pair of its A id is in more."""
    held = encoded.select("pairs").mapInArrow(_held, "pair long, texts long").groupBy("pair").agg(
        F.sum("texts").alias("texts"))
    held = stage(held, "held")
    id_a = F.shiftright("pair", SHIFT)
    top = held.groupBy(id_a.alias("a")).agg(F.max("texts").alias("most"))
    return stage(held.withColumn("a", id_a).join(top, "a").select(
        "pair", "texts", (F.col("texts") == F.col("most")).alias("best")), "counted")


def _scored(pair: np.ndarray, texts: np.ndarray, best: np.ndarray):
    """Per row the sums over the pairs in the head, and its other pairs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, total, rest, rest_times = [], [], [], []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                p, times = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
                hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                n_best.append(int((times[hit] * best[at[hit]]).sum()))
                total.append(int((times[hit] * texts[at[hit]]).sum()))
                rest.append(p[~hit])
                rest_times.append(times[~hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(rest, pa.list_(pa.int64())), pa.array(rest_times, pa.list_(pa.int64()))],
                names=["row", "n_best", "count_sum", "rest", "rest_times"])

    return task


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                 head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    proof = bpe.prove(path_a)
    with open(path_b, "rb") as f:
        model = f.read()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col))
    encoded = stage(rows.mapInArrow(_encoded(proof, model), ROW), "encoded")
    counts = pair_counts(encoded)
    least = count_threshold(counts, "texts", head)
    known = counts.where(F.col("texts") >= least).orderBy("pair").toArrow()       # at most ``head`` rows
    top = [known.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "texts", "best")]
    scored = stage(encoded.select("row", "pairs", "times").mapInArrow(
        _scored(top[0], top[1], top[2].astype(np.int64)),
        "row long, n_best long, count_sum long, rest array<long>, rest_times array<long>"), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select(
        "row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    rest = rest.join(counts.where(F.col("texts") < least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("rest_best"),
        F.sum(F.col("times") * F.col("texts")).alias("rest_sum"))
    sums = scored.select("row", "n_best", "count_sum").join(rest, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"))
    return encoded.drop("pairs", "times").join(sums, "row").select(
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every document."""
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A),
                        public_tokenizers.path(TOKENIZER_B)).withColumnRenamed("id", "doc_id")
