"""Near-duplicates by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct 5-word shingles (lower-cased A-Z; a shorter text is one
shingle). SuperMinHash gives ``BANDS * ROWS`` slots: round j of an element ranks it in [j, j + 1)
at the j-th place of its own random permutation, so slots are covered evenly (lower variance than
independent hashes), and a document stops after the first round with every slot filled. Two sets
with Jaccard similarity 0.85 share none of 25 bands of 5 with probability 4e-7 at most.

Equal sets are one node. Within a bucket, members are compared with hubs, never all with all:
each round a bucket names hubs (first the one sharing most buckets, then ``GROWTH`` times more each time, of the smallest
sets), and only members that are not yet in a hub's component and pass the exact filters become
candidate pairs, which full sets confirm. The filters bound the sizes of linked sets: after the
first round also by the number of items a set shares with any other open set (items that only one
set has can't be in an intersection) and by parity bitmaps (they differ in no more bits than the
sets in items). Tested hubs and rows without a possible partner leave
the bucket; a bucket is done once its members lie in one component. So every pair of a bucket that
could change a component is tested, while a bucket of copies costs about one comparison a member,
also where many of them lie just below the threshold to each other.

Null, empty and wordless texts have the empty set and are linked with nothing. Rows with a null id
are kept with a null component. Equal rows fall in one component. An empty table gives an empty
result. Columns other than id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import drop_staged, is_empty, shared_dir, stage, table
from inkwell.llm.components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Links: ``PART * intersection >= LEAST * union``.
LEAST, PART = 85, 100
#: 64-bit words of a set's bitmap.
WORDS = 8
BITS = [f"b{i}" for i in range(WORDS)]
#: A round names so many times more hubs a bucket than the last.
GROWTH = 32


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = K.LOWER[raw]
    start, stop, first = K.word_spans(low, off)
    word = K.span_hash(K.prefix(low), start, stop)
    n = len(word)
    gram = K.mix(word + K.U(width))
    for i in range(1, width):
        nxt = np.zeros(n, K.U)
        nxt[:max(0, n - i)] = word[i:]
        gram = K.mix(gram * K.U(K.BASE) + nxt)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(gram[a:b - width + 1]))
        elif b > a:
            h = K.mix(word[a:a + 1] + K.U(b - a))
            for i in range(a + 1, b):
                h = K.mix(h * K.U(K.BASE) + word[i:i + 1])
            out.append(h)
        else:
            out.append(np.empty(0, K.U))
    return out


def superminhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots) of the sets laid end to end in ``elements``."""
    rows = len(sizes)
    never = np.iinfo(np.int64).max
    sig = np.full((rows, slots), never, np.int64)
    low32 = K.U(0xFFFFFFFF)

    def draw(x, j):
        r = K.mix(x + K.U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        return (r >> K.U(32)).astype(np.int64) + (j << 32), (
            ((r & low32) * K.U(slots - j)) >> K.U(32)).astype(np.int64) + j

    doc = np.repeat(np.arange(rows), sizes)
    value, place = draw(elements, 0)
    np.minimum.at(sig.ravel(), doc * slots + place, value)
    open_rows = (sig == never).any(1) & (sizes > 0)
    act = np.flatnonzero(open_rows[doc])
    while len(act):          # bounded blocks of whole rows
        take = act[:100_000]
        if len(take) < len(act):
            take = take[doc[take] < doc[act[len(take)]]] if doc[take[0]] != doc[act[len(take)]] else act[
                doc[act] == doc[take[0]]]
        act = act[len(take):]
        x, d = elements[take], doc[take]
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(take), 1))
        k = place[take]
        perm[np.arange(len(take)), k] = 0
        for j in range(1, slots):
            value_j, k = draw(x, j)
            i = np.arange(len(x))
            np.minimum.at(sig.ravel(), d * slots + perm[i, k], value_j)
            perm[i, k] = perm[:, j]
            live = (sig[np.unique(d)] == never).any(1)
            if not live.any():
                break
            keep = np.isin(d, np.unique(d)[live])
            if not keep.all():
                x, d, perm = x[keep], d[keep], perm[keep]
    return sig


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.column_bytes(batch.column(1))
        for lo, hi, part, at in K.pieces(raw, off, 1 << 20):
            sets = shingle_sets(part, at)
            sizes = np.array([len(s) for s in sets], np.int64)
            sig = superminhash(np.concatenate(sets), sizes).astype(K.U).reshape(hi - lo, BANDS, ROWS)
            band = np.broadcast_to(K.mix(np.arange(1, BANDS + 1, dtype=K.U)), (hi - lo, BANDS))
            for r in range(ROWS):
                band = K.mix(band * K.U(K.BASE) + sig[:, :, r])
            digest = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
            flat = pa.array(band.astype(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * BANDS + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes),
                 pa.array(np.array([x >> 64 for x in digest], K.U).astype(np.int64)),
                 pa.array(np.array([x & (1 << 64) - 1 for x in digest], K.U).astype(np.int64)), bands],
                names=["id", "n", "h1", "h2", "bands"])


def parity_bits(items: np.ndarray) -> np.ndarray:
    """Bitmap of 64 * WORDS bits: whether an odd number of items hash to a bit. The bits in which
    two sets differ are at most their symmetric difference, which bounds the intersection."""
    odd = np.bincount((items % K.U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.column_bytes(batch.column(1))
        for lo, hi, part, at in K.pieces(raw, off):
            sets = shingle_sets(part, at)
            bits = np.stack([parity_bits(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary()),
                 *(pa.array(bits[:, i]) for i in range(WORDS))], names=["id", "items", *BITS])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if PART * common >= LEAST * (len(both) - common):
                keep.append(i)
        if keep:
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(keep)) for i in (0, 1)], names=["u", "v"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, items = batch.column(0).to_numpy(), batch.column(1)
        for lo in range(0, len(ids), 500):
            part = [np.frombuffer(x.as_buffer(), np.int64) for x in items[lo:lo + 500]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[lo:lo + 500], [len(x) for x in part])), pa.array(np.concatenate(part))],
                names=["id", "item"])


def _shared_items(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, r): how many items of a set also occur in another set of ``rest``."""
    ids = rest.select("id", "n").distinct()
    items = sets.join(ids, "id", "left_semi").select("id", "items").mapInArrow(_elements, "id long, item long").distinct()
    alone = items.groupBy("item").agg(F.count("*").alias("sets"), F.min("id").alias("id")).where("sets = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    return ids.join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("r"))


def _most(r: str, n: str):
    """Size of the largest set that a set of ``n`` items, ``r`` of them shared, can be linked with:
    the intersection is at most r, so (PART + LEAST) * r >= LEAST * (n + other)."""
    return F.floor((PART + LEAST) * F.col(r) / LEAST) - F.col(n)


def _rounds(buckets: DataFrame, sets: DataFrame):
    """Component of every node that isn't the smallest of its own: (node, root), or None.
    ``buckets``: (bucket, id, n, mass). ``most`` bounds the size of a partner, the bitmaps the
    intersection of a pair (they come in after the first round)."""
    cols = ["bucket", "id", "n", "most", "rank", "comp", *BITS]
    apart = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in BITS)
    both = F.col("n") + F.col("hub_n")
    may_link = (PART + LEAST) * (both - apart) >= 2 * LEAST * both
    rest = stage(buckets.select("bucket", "id", "n", F.floor(PART * F.col("n") / LEAST).alias("most"),
                                (-F.col("mass")).alias("rank"), F.col("id").alias("comp"),
                                *[F.lit(0).cast("long").alias(b) for b in BITS]), "rest")
    links, root, hubs_a_bucket = None, None, 1
    while not is_empty(rest):
        salt = F.pmod(F.xxhash64("id", F.lit(hubs_a_bucket)), F.lit(hubs_a_bucket))
        hubs = rest.groupBy("bucket", salt.alias("salt")).agg(
            F.min(F.struct("rank", "id", "n", "most", "comp", *BITS)).alias("h")).select(
                "bucket", *[F.col(f"h.{c}").alias(f"hub_{c}") for c in ("id", "n", "most", "comp", *BITS)])
        pairs = rest.join(hubs, "bucket").where("comp <> hub_comp and n <= hub_most and hub_n <= most").where(may_link)
        pairs = pairs.select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct()
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        new = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
            _verify, "u long, v long"), "links")
        if not is_empty(new):
            links = new if links is None else links.union(new)
            root = components(links)
        # Go on with the buckets whose members, without the hubs tested, lie in several components.
        left_over = rest.join(hubs.select("bucket", F.col("hub_id").alias("id")), ["bucket", "id"], "left_anti")
        if root is not None:
            left_over = left_over.drop("comp").join(
                root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
                    "comp", F.coalesce("root", "id")).select(*cols)
        old, rest = rest, stage(_open(left_over), "rest")
        drop_staged(old.sparkSession, old)
        if hubs_a_bucket == 1 and not is_empty(rest):
            # What is still open is bounded by the items that two open sets share at all. The
            # smallest sets are hubs first: they are the last that one with few shared items fits.
            shared = _shared_items(rest, sets)
            rest = rest.drop("most", *BITS).join(shared, "id").join(sets.select("id", *BITS), "id").withColumn(
                "most", _most("r", "n")).withColumn("rank", F.col("n")).select(*cols)
            rest = stage(_open(rest), "rest")
        hubs_a_bucket *= GROWTH
    return root


def _open(rest: DataFrame) -> DataFrame:
    """Rows that may still be linked: some set of the bucket is small enough for them, and the rows
    of the bucket for which this holds lie in several components."""
    least = rest.groupBy("bucket").agg(F.min("n").alias("least"))
    rest = rest.join(least, "bucket").where("least <= most").drop("least")
    several = rest.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return rest.join(several.select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stage(rows.mapInArrow(_sign, "id long, n long, h1 long, h2 long, bands array<long>"), "signed")
    nodes = stage(signed.where("n > 0 and id is not null").groupBy("h1", "h2").agg(
        F.min(F.struct("id", "n", "bands")).alias("s")).select(
            "h1", "h2", F.col("s.id").alias("rep"), F.col("s.n").alias("n"), F.col("s.bands").alias("bands")), "nodes")
    buckets = nodes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "n")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stage(buckets.join(shared, "bucket"), "buckets")
    mass = buckets.groupBy("id").agg(F.sum("size").alias("mass"))
    # By a sort-merge join at every size, so the plan's cost is the same share of any input.
    sets = stage(rows.join(mass.select("id").hint("merge"), "id", "left_semi").mapInArrow(
        _sets, "id long, items binary, " + ", ".join(f"{b} long" for b in BITS)), "sets")
    root = _rounds(buckets.drop("size").join(mass, "id").select("bucket", "id", "n", "mass"), sets)
    classes = nodes.select("h1", "h2", F.col("rep").alias("comp"))
    if root is not None:
        classes = nodes.select("h1", "h2", "rep").join(
            root.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
                "h1", "h2", F.coalesce("root", "rep").alias("comp"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2").join(
        classes, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. Rows without an id stay, as
    nothing names them."""
    rows = stage(near_duplicates(docs, id_col, text_col).select("id", "kept"), "kept")
    gone = rows.where(~F.col("kept")).select(F.col("id").alias(id_col)).distinct()
    out = docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
    repeated = rows.where("kept and id is not null").groupBy("id").count().where("count > 1")
    return out if is_empty(repeated) else out.dropDuplicates([id_col]).where(F.col(id_col).isNotNull()).union(
        out.where(F.col(id_col).isNull()))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
