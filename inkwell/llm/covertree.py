"""Hard negatives by a cover tree over norm-augmented candidates.

Each component x becomes floor(256 * x); scores are integer inner products. Candidates get one more
component that lifts all of them to the norm M of the longest, so a larger inner product with an
anchor (lifted by 0) means a smaller angle, and a node whose points lie within an angle r of its
centre bounds the scores of all of them: |q| M cos(angle to the centre -+ r).

The top of the tree is one net: about one centre a block of candidates, picked by hash; every
candidate is assigned to its nearest centre, whose covering radius is the exact maximum. A centre's
candidates, cut by hash into parts of bounded size, form blocks. Inside a block a task builds the
lower levels top down: the children of a node are the net that a farthest-first traversal picks, so
they are separated by more than the radius that they cover. Anchors go in streams to the blocks whose
bounds meet their window, and descend level by level; nodes outside the window, or all of whose
labels are on the wrong side, are skipped. Leaves are taken best bound first and verified exactly,
until no bound reaches the last score kept (ties go on, as a smaller id may win).

Two such searches run: for the positives of each anchor, then for the negatives in the window that
each positive's score opens. Candidates with equal vector and label tie in every search, so only the
first ``COPIES`` ids of such a group can ever be returned; the others are not searched, and anchors
with equal vector and label ask once. No result depends on blocks, radii or picked centres.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. A vector
shorter than others counts as filled up with zeros. Rows that share an id count once, with the
smallest label and then the smallest vector. Components must stay under 2^20 in magnitude once
multiplied (an error otherwise), which keeps scores exact. An empty table gives an empty result. Columns other
than id, vector and label are not read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import shared_dir, stage, table

POSITIVES = NEGATIVES = 5
#: Ids of one vector and label that can be returned: five others beside an anchor itself.
COPIES = 1 + max(POSITIVES, NEGATIVES)
#: Percent of the positive's score from which a negative is hard.
LEAST = 80
#: Children of a node, points of a leaf.
FAN, LEAF = 16, 64
#: Candidates of a block: 4096, or 8 times the root of their number; 2^23 components at most.
BLOCK, ROOTS, ROOM = 4096, 8, 1 << 23
#: Centres of the top level, and their components, at most.
CENTRES, CENTRE_ROOM = 4096, 1 << 20
LARGEST = 1 << 20
#: Anchors that a task searches together.
ASKS = 256
#: Added to float bounds of integer scores.
SLACK = 1.0


class Level(NamedTuple):
    """The nodes of one depth, ordered by the span of points [start, end) that they cover."""

    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    low: np.ndarray         # smallest and largest label
    high: np.ndarray
    leaf: np.ndarray


def _angle(dots: np.ndarray, norms: np.ndarray | float) -> np.ndarray:
    """Angles for inner products; 0 where a vector is 0."""
    return np.where(norms > 0, np.arccos(np.clip(dots / np.maximum(norms, 1e-30), -1, 1)), 0.0)


class CoverTree:
    """Levels over the rows of ``points`` (float64 holding integers), which are reordered."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        square = (points ** 2).sum(1)
        self.norm = float(np.sqrt(square.max()))
        lift = np.sqrt(np.maximum(square.max() - square, 0))
        lifted = np.column_stack([points, lift])
        order = np.arange(len(points))
        self.levels: list[Level] = []
        todo = [(0, len(points), 0)]        # start, end, parent
        while todo:
            nodes, after = [], []
            for start, end, parent in todo:
                # The pivot that the parent's traversal picked stands first.
                rows = order[start:end]
                away = self._away(lifted, rows, rows[0])
                leaf = end - start <= LEAF or not away.max() > 1e-6
                nodes.append((rows[0], away.max(), start, end, parent, leaf))
                if not leaf:
                    order[start:end], sizes = self._net(lifted, rows, away)
                    at = start
                    for size in sizes:
                        after.append((at, at + size, len(nodes) - 1))
                        at += size
            centre, radius, start, end, parent, leaf = (np.array(x) for x in zip(*nodes, strict=True))
            self.levels.append(Level(centre, radius + 1e-7, start, end, parent, start, end, leaf))
            todo = after
        self.points, self.labels, self.ids = points[order], labels[order], ids[order]
        for i, level in enumerate(self.levels):
            low, high = (np.array([f(self.labels[s:e]) for s, e in zip(level.start, level.end, strict=True)])
                         for f in (np.min, np.max))
            self.levels[i] = level._replace(centre=points[level.centre], low=low, high=high)

    def _away(self, lifted: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
        return _angle(lifted[rows] @ lifted[centre], self.norm ** 2)

    def _net(self, lifted: np.ndarray, rows: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The rows by child, each child's centre first, and the children's sizes."""
        child = np.zeros(len(rows), np.int64)
        first, away = [0], away.copy()
        while len(first) < FAN and away.max() > 1e-6:
            pick = int(away.argmax())
            near = self._away(lifted, rows, rows[pick])
            near[pick] = -1.0       # its own, whatever the rounding
            child[near < away] = len(first)
            away = np.minimum(near, away)
            first.append(pick)
        is_first = np.zeros(len(rows), bool)
        is_first[first] = True
        order = np.lexsort((~is_first, child))
        return rows[order], np.bincount(child, minlength=len(first)).tolist()

    def search(self, asks: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
               same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ask, window, score, id) of the first k points of the same label (or of others) for each ask
        and each of its windows, a column of ``low`` and ``high`` (an empty window has low > high)."""
        floor, top = np.where(low <= high, low, np.inf).min(1), np.where(low <= high, high, -np.inf).max(1)
        scale = np.sqrt((asks ** 2).sum(1))[:, None] * self.norm
        alive = np.ones((len(asks), 1), bool)
        found = []
        for level in self.levels:
            angle = _angle(asks @ level.centre.T, scale)
            upper = scale * np.cos(np.maximum(angle - level.radius, 0)) + SLACK
            lower = scale * np.cos(np.minimum(angle + level.radius, np.pi)) - SLACK
            alive = alive[:, level.parent] & (upper >= floor[:, None]) & (lower <= top[:, None])
            if same:
                alive &= (level.low <= labels[:, None]) & (level.high >= labels[:, None])
            else:
                alive &= (level.low != labels[:, None]) | (level.high != labels[:, None])
            who, leaf = np.nonzero(alive & level.leaf)
            found.append((who, level.start[leaf], level.end[leaf], upper[who, leaf]))
        who, start, end, bound = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((-bound, who))
        who, start, end, bound = who[order], start[order], end[order], bound[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = _Best(low, high, k)
        step = 1        # the best leaf of every ask, then the next 2, 4, 8, ...
        while (place >= step - 1).any():
            some = np.flatnonzero((place >= step - 1) & (place < 2 * step - 1))
            some = some[best.may_enter(who[some], bound[some])]
            step *= 2
            some = some[np.argsort(start[some], kind="stable")]
            cuts = np.flatnonzero(np.diff(start[some])) + 1
            for group in np.split(some, cuts) if len(some) else ():
                lo, hi, ask = start[group[0]], end[group[0]], who[group]
                score = self.points[lo:hi] @ asks[ask].T
                fits = (self.labels[lo:hi, None] == labels[ask]) == same
                best.offer(ask, score, fits, self.ids[lo:hi])
            best.settle()
        return best.rows()


class _Best:
    """The first k of each ask and window so far, and the score that another must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self._high, self._k, self._windows = high, k, low.shape[1]
        self._least = np.where(low <= high, low, np.inf)
        self._new: list[tuple] = []
        self._kept = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]     # slot, score, id

    def may_enter(self, ask: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (np.minimum(bound[:, None], self._high[ask]) >= self._least[ask]).any(1)

    def offer(self, ask: np.ndarray, score: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self._windows):
            row, col = np.nonzero(fits & (score >= self._least[ask, w]) & (score <= self._high[ask, w]))
            self._new.append((ask[col] * self._windows + w, score[row, col], ids[row]))

    def settle(self) -> None:
        slot, score, ident = map(np.concatenate, zip(self._kept, *self._new, strict=True))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < self._k
        self._kept, self._new = [slot[first], score[first], ident[first]], []
        last = place == self._k - 1
        self._least.ravel()[slot[last]] = score[last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slot, score, ident = self._kept
        return slot // self._windows, slot % self._windows, score, ident


# ------------------------------------------------------------------------------------------ Spark
def integer_rows(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part: v holds integers as doubles."""
    x = F.col(vec_col)
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(good).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"))


def _packed(width: int):
    """(id, label, v binary): vectors as 32-bit integers, filled up to ``width``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            size = np.diff(v.offsets.to_numpy())
            values = v.flatten().to_numpy(zero_copy_only=False)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError(f"components must be below {LARGEST / 256:g} in magnitude")
            full = np.zeros((len(batch), width), np.int32)
            full[np.arange(width) < size[:, None]] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in full], pa.binary())],
                                             names=["id", "label", "v"])

    return task


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in col]
    return np.stack(rows).astype(np.float64) if rows else np.empty((0, 0))


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``lows`` and ``highs`` as matrices, filled up with empty windows."""
    out = []
    for name, fill in (("lows", np.inf), ("highs", -np.inf)):
        col = part.column(name)
        size = np.diff(col.offsets.to_numpy())
        full = np.full((len(part), max(1, size.max(initial=0))), fill)
        full[np.arange(full.shape[1]) < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
        out.append(full)
    return out[0], out[1]


class Net(NamedTuple):
    """The top level: centres, their covering radii and the number of parts of each."""

    centre: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    norm: float


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm ** 2 - (x ** 2).sum(1), 0))])


def _assigned(centre: np.ndarray, norm: float):
    """(id, label, v, node, away): each candidate at its nearest centre."""
    top = _lifted(centre, norm)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                dots = _lifted(_matrix(part.column(2)), norm) @ top.T
                node = dots.argmax(1)
                away = _angle(dots[np.arange(len(node)), node], norm ** 2)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, pa.int64()), pa.array(away)],
                                                 names=["id", "label", "v", "node", "away"])

    return task


def top_level(items: DataFrame, width: int) -> tuple[DataFrame, Net]:
    """The candidates with their node and part, and the net."""
    n, square = items.select(F.count("*"), F.max("square")).first()
    size = max(1, min(max(BLOCK, int(ROOTS * n ** 0.5)), ROOM // max(1, width)))
    wanted = max(1, min(CENTRES, CENTRE_ROOM // max(1, width), -(-n // size)))
    # By hash, so the same centres in every run: the candidates under a share of the hash range.
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    share = int((1 << 40) * min(1.0, 2.0 * wanted / n)) + 1
    picked = items.where(place < share).select("v", place.alias("place")).distinct().orderBy("place").limit(wanted).toArrow()
    if not picked.num_rows:
        picked = items.select("v").limit(1).toArrow()
    centre, norm = _matrix(picked.column("v")), float(square) ** 0.5
    placed = stage(items.select("id", "label", "v").mapInArrow(
        _assigned(centre, norm), "id long, label long, v binary, node long, away double"), "placed")
    sizes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # one row a centre
    radius, parts = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for row in sizes:
        radius[row["node"]], parts[row["node"]] = row["r"] + 1e-6, -(-row["n"] // size)
    return placed, Net(centre, radius, parts, norm)


def _blocks(net: Net):
    """(block, id, label, v): a centre's candidates by a hash of the id over its parts."""
    first = np.cumsum(net.parts) - net.parts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(3).to_numpy()
            place = K.mix(batch.column(0).to_numpy().astype(K.U)) % net.parts[node].astype(K.U)
            yield pa.RecordBatch.from_arrays([pa.array(first[node] + place.astype(np.int64)), *batch.columns[:3]],
                                             names=["block", "id", "label", "v"])

    return task


def _routed(net: Net):
    """An ask for each block that its windows may meet: (block, id, label, v, lows, highs)."""
    block = np.cumsum(net.parts) - net.parts
    some = max(1, min(ASKS, (1 << 16) // int(net.parts.sum())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), some):
                part = batch.slice(lo, some)
                q = _matrix(part.column("v"))
                low, high = _windows(part)
                low, high = np.where(low <= high, low, np.inf).min(1), np.where(low <= high, high, -np.inf).max(1)
                scale = np.sqrt((q ** 2).sum(1))[:, None] * net.norm
                angle = _angle(q @ net.centre.T, scale)
                meets = scale * np.cos(np.maximum(angle - net.radius, 0)) + SLACK >= low[:, None]
                meets &= scale * np.cos(np.minimum(angle + net.radius, np.pi)) - SLACK <= high[:, None]
                who, node = np.nonzero(meets & (net.parts > 0))
                blocks = block[node]
                who, blocks = (np.repeat(x, net.parts[node]) for x in (who, blocks))
                inside = np.arange(len(who)) - np.repeat(np.cumsum(net.parts[node]) - net.parts[node], net.parts[node])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks + inside), *part.take(pa.array(who)).columns], names=["block", *part.schema.names])

    return task


def _searched(k: int, same: bool):
    """Candidates, then asks, of sorted blocks to the best of each ask in each block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, items = None, None, []
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(block)], strict=True):
                if block[lo] != at:
                    tree, at, items = None, block[lo], []
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    items.append(part)
                    continue
                if tree is None and items:
                    all_items = pa.Table.from_batches(items)
                    tree = CoverTree(_matrix(all_items.column("v")), all_items.column("label").to_numpy(),
                                     all_items.column("id").to_numpy())
                    items = []
                for i in range(0, len(part) if tree else 0, ASKS):
                    some = part.slice(i, ASKS)
                    low, high = _windows(some)
                    ask, window, score, ident = tree.search(
                        _matrix(some.column("v")), some.column("label").to_numpy(), low, high, k, same)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").take(pa.array(ask)), pa.array(high[ask, window].astype(np.int64)),
                         pa.array(score.astype(np.int64)), pa.array(ident)], names=["ask", "high", "score", "id"])

    return task


def _best(placed: DataFrame, net: Net, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, high, score, id): the first k candidates of every ask and window. ``asks``: id, label, v, and
    the windows as lists ``lows`` and ``highs``."""
    none = F.array().cast("array<long>")
    items = placed.mapInArrow(_blocks(net), "block long, id long, label long, v binary").select(
        "block", F.lit(0).alias("kind"), "id", "label", "v", none.alias("lows"), none.alias("highs"))
    routed = asks.select("id", "label", "v", "lows", "highs").mapInArrow(
        _routed(net), "block long, id long, label long, v binary, lows array<long>, highs array<long>")
    both = items.union(routed.select("block", F.lit(1).alias("kind"), "id", "label", "v", "lows", "highs"))
    found = both.repartition(max(1, int(net.parts.sum())), "block").sortWithinPartitions("block", "kind").mapInArrow(
        _searched(k, same), "ask long, high long, score long, id long")
    order = Window.partitionBy("ask", "high").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   anchors=lambda vec_id: vec_id % 100 == 0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchors`` says
    of an id column which rows are anchors."""
    shared_dir(rows.sparkSession)
    whole = integer_rows(rows, id_col, vec_col, label_col)
    width = whole.agg(F.max(F.size("v"))).first()[0] or 1
    packed = whole.mapInArrow(_packed(width), "id long, label long, v binary").groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("first"))
    packed = stage(packed.select("id", "first.*"), "packed")
    kind = ["v", "label"]
    copies = Window.partitionBy(*kind).orderBy("id")
    items = packed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= COPIES)
    items = stage(items.select("id", "label", "v").mapInArrow(_squares, "id long, label long, v binary, square double"), "items")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not items.limit(1).count():
        return rows.sparkSession.createDataFrame([], schema)
    placed, net = top_level(items, width)
    chosen = packed.where(anchors(F.col("id")))
    # Anchors with equal vector and label ask once, by their smallest id.
    asks = stage(chosen.groupBy(*kind).agg(F.min("id").alias("id")), "asks")
    far = 1 << 62
    searched = asks.select("id", "label", "v", F.array(F.lit(-far)).alias("lows"), F.array(F.lit(far)).alias("highs"))
    positives = stage(_best(placed, net, searched, POSITIVES + 1, True).select("ask", "rank", "score", "id"), "positives")
    # A window for each positive's score: 80 * score <= 100 * negative <= 100 * score.
    windows = positives.where("score >= 0").groupBy(F.col("ask").alias("id")).agg(
        F.collect_set("score").alias("highs")).withColumn(          # six at most
            "lows", F.transform("highs", lambda h: -F.floor(-h * LEAST / 100)))
    windows = windows.join(asks, "id")
    listed = F.sort_array(F.collect_list(F.struct("rank", "score", "id")))      # five at most
    negatives = _best(placed, net, windows, NEGATIVES, False).groupBy("ask", F.col("high").alias("score")).agg(
        listed.alias("negatives"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "score", "id", "negatives")))     # six at most
    answers = positives.join(negatives, ["ask", "score"], "left").groupBy("ask").agg(listed.alias("positives"))
    answers = stage(answers.join(asks.select(F.col("id").alias("ask"), *kind), "ask").drop("ask"), "answers")
    others = F.slice(F.filter("positives", lambda p: p["id"] != F.col("anchor_id")), 1, POSITIVES)
    return chosen.select(F.col("id").alias("anchor_id"), *kind).join(answers, kind).select(
        "anchor_id", F.explode(others).alias("p")).select("anchor_id", "p", F.explode("p.negatives").alias("x")).select(
            "anchor_id", F.col("p.id").alias("positive_id"), F.col("x.rank").alias("rank"),
            F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
            F.col("x.score").alias("negative_score"))


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        square = (_matrix(batch.column(2)) ** 2).sum(1) if len(batch) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(square, pa.float64())], names=["id", "label", "v", "square"])


def relabelled(rows: DataFrame) -> DataFrame:
    """``embeddings`` with every seventh label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the anchors of ``embeddings``."""
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


#: Repeated ids count once, as above; vectors are padded to the longest.
OP11_SQL = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
rows_ AS (SELECT id, min(label) AS label, arg_min(v, label) AS v FROM whole GROUP BY id),
scored AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
