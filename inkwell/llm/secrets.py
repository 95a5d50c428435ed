"""Secret scan: fixed patterns, plus a character convolutional network over every candidate.

One pass over the texts finds the base findings (patterns ``assign``, ``access``, ``hex``) and
every other candidate: a run of at least ``RUN`` token characters with a digit in it. Candidates
travel with their surroundings; the texts don't. The network (embedding, one convolution, maximum
over the candidate and over its context, logistic output; all numpy) learns from all of them that
have a label. Positives are the values of the base findings (but
those that read as harmless, which stay findings and train nothing) and
random pieces of them, and made-up keys of mixed letters and digits; negatives are what is known to be harmless: candidates that read as numbers,
dates, mail addresses, paths or words with short numbers (``HARMLESS``), a plain word of every text, and such forms
made up from plain words. All other candidates are unlabelled and train nothing. A quarter
is held out, there the scores are calibrated (Platt). For the threshold each base
pattern in turn is left out of training, and the threshold is as high as a recall of ``RECALL`` on all
values of the left-out patterns allows (on the held-out quarter, where there is one pattern only). Every
candidate that is no base finding and passes it adds a span of kind ``model``.

Training is spread over groups of about ``GROUP`` labelled rows, dealt by hash: in each of ``ROUNDS``
rounds every group goes on from the same network over its own rows, and the groups' networks are
averaged (one group: one round of ``EPOCHS`` epochs). Calibration and threshold come from counts of all scores,
in steps of 1/``STEPS``. Only averages and counts reach the driver. Null and empty texts
have no findings. Without both labels (an empty or tiny table) no spans are added.
Repeated rows get the same result each. Texts of any length are scanned whole."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.common import stage, table

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")
#: Kinds of rows that only training knows by name: a plain word, and a candidate known to be harmless.
PLAIN, KNOWN = 4, 5
MIXED = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
_PART = rb"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,3}|[0-9]{1,8}"
HARMLESS = re.compile(rb"[-+]?[0-9][0-9./=_-]*(?:T[0-9]{2}|Z)?|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|"
                      rb"[/._=@+-]*(?:" + _PART + rb")(?:[/._=@+-]+(?:" + _PART + rb"))*[/._=@+-]*")

WORD = re.compile(rb"[A-Za-z]{5,}")

RUN = 12
#: Most rows of an aggregate that the driver reads (it has a dozen: one a network, one a label).
SAMPLE = 2000
RECALL = 0.99
GROUP, ROUNDS, EPOCHS = 8192, 4, 12
#: Steps of a score (a logit within ±``LIMIT``) that are counted, and of an averaged parameter.
STEPS, LIMIT, SCALE = 16, 30, 1 << 32
BEFORE, HALF, AFTER = 24, 24, 8
WIDTH, DIM, FILTERS = 5, 8, 24

RUN_CLASS = np.zeros(256, bool)
RUN_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.@-")] = True
HEX_CLASS = np.zeros(256, bool)
HEX_CLASS[list(b"0123456789abcdef")] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True

FOUND = "array<struct<start:long,stop:long,kind:int,near:binary>>"
SCHEMA = f"id long, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"


def runs(flag: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` set bytes that don't cross a row's border."""
    begin, stop = flag.copy(), flag.copy()
    begin[1:] &= ~flag[:-1]
    stop[:-1] &= ~flag[1:]
    inner = off[(off > 0) & (off < len(flag))]
    begin[inner] = flag[inner]
    stop[inner - 1] = flag[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = end - start >= least
    return start[long], end[long]


def base_findings(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted, of one text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_start(text: bytes, start: int) -> int:
    """Where the value of an ``assign`` finding begins."""
    return ASSIGN.match(text, start).start(2)


def surroundings(text: bytes, start: int, end: int) -> bytes:
    """Fixed-width view of a candidate: what precedes it, its head, its tail, what follows."""
    body = text[start:end]
    return (text[max(0, start - BEFORE):start].rjust(BEFORE, b"\0") + body[:HALF].ljust(HALF, b"\0")
            + body[max(HALF, len(body) - HALF):].ljust(HALF, b"\0") + text[end:end + AFTER].ljust(AFTER, b"\0"))


def _reads_harmless(near: bytes) -> bool:
    return bool(HARMLESS.fullmatch(near[BEFORE:-AFTER].replace(b"\0", b"")))


def trains(near: bytes, kind: int) -> bytes | None:
    """The surroundings, or nothing for a base value that reads as harmless ("token=abcdefgh1"): its form can't tell it."""
    return None if kind < 3 and _reads_harmless(near) else near


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()),
                               ("near", pa.binary())]))
    for batch in batches:
        raw_all, off_all = K.column_bytes(batch.column(1))
        for lo, hi, raw, off in K.pieces(raw_all, off_all):
            data, low = raw.tobytes(), K.LOWER[raw].tobytes()
            hits = []
            for word, where in [*((w, low) for w in KEYWORDS), (b"AKIA", data)]:
                at = where.find(word)
                while at >= 0:
                    hits.append(at)
                    at = where.find(word, at + 1)
            hits += list(runs(HEX_CLASS[raw], off, 32)[0])
            start, end = runs(RUN_CLASS[raw], off, RUN)
            digits = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(DIGIT[raw], out=digits[1:])
            some = digits[end] > digits[start]
            start, end = start[some], end[some]
            row_of = lambda x: np.searchsorted(off, x, "right") - 1
            base_rows = set(np.unique(row_of(np.array(hits, np.int64))).tolist()) if hits else set()
            run_rows = row_of(start)
            cut = np.searchsorted(run_rows, np.arange(hi - lo + 1))
            ids = batch.column(0).slice(lo, hi - lo)
            n = np.zeros((hi - lo, 3), np.int64)
            sha, found = [nothing] * (hi - lo), [[] for _ in range(hi - lo)]
            for i in range(hi - lo):
                text = data[off[i]:off[i + 1]]
                base = base_findings(text) if i in base_rows else []
                todo = [(s, e, k) for s, k, e in base]
                for s, e in zip((start[cut[i]:cut[i + 1]] - off[i]).tolist(),
                                (end[cut[i]:cut[i + 1]] - off[i]).tolist(), strict=True):
                    if not any(s < b and a < e for a, _, b in base):
                        todo.append((s, e, KNOWN if HARMLESS.fullmatch(text, s, e) else 3))
                if m := WORD.search(text, len(text) // 2):      # a negative for training only
                    todo.append((m.start(), m.end(), PLAIN))
                if not todo:
                    continue
                points = np.zeros(len(text) + 1, np.int64)
                np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=points[1:])
                for _, k, _ in base:
                    n[i, k] += 1
                if base:
                    sha[i] = hashlib.sha256(spans_text(
                        (int(points[s]), k, int(points[e])) for s, k, e in base).encode()).hexdigest()
                found[i] = [{"start": int(points[s]), "stop": int(points[e]), "kind": k,
                             "near": trains(surroundings(text, value_start(text, s) if k == 0 else s, e), k)}
                            for s, e, k in todo]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(n[:, j]) for j in range(3)), pa.array(sha, pa.string()), pa.array(found, kind)],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


class CharCNN:
    """Character convolutional network for fixed-width byte strings, in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (97, DIM)), "conv": r.normal(0, 0.2, (WIDTH * DIM, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": r.normal(0, 0.2, 2 * FILTERS), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def codes(near: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(near), np.uint8).reshape(len(near), -1)
        return np.where((x >= 32) & (x < 127), x - np.uint8(31), np.where(x == 0, np.uint8(0), np.uint8(96)))

    def _forward(self, x, places=False):
        p = self.p
        # An embedding times a row of the convolution, once for each code and place in the window.
        tables = np.matmul(p["emb"], p["conv"].reshape(WIDTH, DIM, FILTERS)).astype(np.float32)
        best, at = np.empty((len(x), 2 * FILTERS), np.float32), np.empty((len(x), 2 * FILTERS), np.intp)
        tail = x[:, BEFORE + HALF:BEFORE + 2 * HALF].any(1)
        # The windows within an empty tail are all alike: the first of them stands for all.
        for rows, gap in ((np.flatnonzero(tail), 0), (np.flatnonzero(~tail), HALF - WIDTH)):
            if len(rows):
                best[rows], at[rows] = self._pooled(tables, x[rows].T.astype(np.intp, order="C"), gap, places)
        pooled = np.maximum(best + np.tile(p["bias"], 2), 0)
        return at, pooled, pooled @ p["out"] + p["b"]

    @staticmethod
    def _pooled(tables, x, gap, places):
        """Maxima over the candidate and over its context of every filter, and the first window that has each
        (``x``: a column a row; ``gap``: windows left out after the first that is all tail)."""
        first, size = BEFORE + HALF + 1, len(x) - WIDTH + 1
        a = np.empty((size - gap, x.shape[1], FILTERS), np.float32)
        whole = tables.view(f"V{4 * FILTERS}")[:, :, 0]      # a row as one item, which numpy picks faster
        for w in range(WIDTH):
            for to, lo, hi in ((0, 0, first), (first, first + gap, size)):
                part = a[to:to + hi - lo]
                got = whole[w][x[lo + w:hi + w]].view(np.float32).reshape(part.shape)
                if w:
                    part += got
                else:
                    part[:] = got
        lo, hi = BEFORE - 2, BEFORE + 2 * HALF - 2 - gap
        body, context = a[lo:hi].max(0), np.maximum(a[:lo].max(0), a[hi:].max(0))
        if not places:
            return np.concatenate([body, context], 1), 0
        rank = np.arange(len(a), 0, -1, dtype=np.uint8)[:, None, None]
        seen = lambda lo, hi, best: ((a[lo:hi] == best) * rank[lo:hi]).max(0)
        at = len(a) - np.concatenate([seen(lo, hi, body), np.maximum(seen(0, lo, context), seen(hi, len(a), context))],
                                     1).astype(np.intp)
        return np.concatenate([body, context], 1), np.where(at < first, at, at + gap)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[lo:lo + 512])[2] for lo in range(0, max(1, len(x)), 512)])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, size: int = 128,
            seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        flat = self.flat()
        self._lay(flat)
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        t = 0
        # Cells of the sums below, but for the code: place in the window, then filter.
        cells = (np.arange(WIDTH) * 97 * FILTERS)[:, None, None] + np.tile(np.arange(FILTERS), 2)
        conv = self.p["conv"].reshape(WIDTH, DIM, FILTERS)
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(y)), max(1, len(y) // size)):
                own = x[part]
                at, pooled, z = self._forward(own, True)
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
                dp = np.outer(dz, self.p["out"]) * (pooled > 0)
                # What each code at each place of the window under each filter gets back.
                at += np.arange(len(part))[:, None] * own.shape[1]
                codes = own.ravel()[at + np.arange(WIDTH)[:, None, None]].astype(np.intp)
                back = np.bincount((codes * FILTERS + cells).ravel(), np.broadcast_to(dp, codes.shape).ravel(),
                                   WIDTH * 97 * FILTERS).reshape(WIDTH, 97, FILTERS)
                g = {"emb": np.matmul(back, conv.transpose(0, 2, 1)).sum(0),
                     "conv": np.matmul(self.p["emb"].T, back).reshape(WIDTH * DIM, FILTERS),
                     "bias": dp.sum(0).reshape(2, FILTERS).sum(0), "out": pooled.T @ dz, "b": dz.sum(keepdims=True)}
                g = np.concatenate([g[k].ravel() for k in self.p])
                t += 1
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g ** 2
                flat -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold with that recall."""
        z = self.logit(x)
        self._platt(z, y, np.ones(len(z)))
        good = np.sort(self.probability(x)[y == 1])
        self.threshold = float(good[int(np.floor((1 - recall) * len(good)))])

    def _platt(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Scale and shift from scores that come ``n`` times each."""
        design, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        goal = np.where(y == 1, (n[y == 1].sum() + 1) / (n[y == 1].sum() + 2), 1 / (n[y == 0].sum() + 2))
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hess = (design * (n * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(hess, design.T @ (n * (q - goal)) + 1e-3 * (w - [1.0, 0.0]))
        if w[0] > 0:
            self.scale, self.shift = float(w[0]), float(w[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logit(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def _lay(self, flat: np.ndarray) -> None:
        """The parameters as views of one array."""
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape)
            at += v.size

    @classmethod
    def of(cls, flat: np.ndarray) -> CharCNN:
        model = cls()
        model._lay(flat.astype(float))
        return model


def pieces_of(near: bytes, r: np.random.Generator) -> bytes:
    """The same surroundings with a random piece of the value, of ``RUN`` bytes or more."""
    head = near[BEFORE:BEFORE + HALF].rstrip(b"\0")
    if len(head) <= RUN:
        return near
    size = int(r.integers(RUN, len(head) + 1))
    at = int(r.integers(0, len(head) - size + 1))
    return surroundings(near[:BEFORE] + head[at:at + size] + near[-AFTER:], BEFORE, BEFORE + size)


def made_up(near: bytes, r: np.random.Generator) -> bytes:
    """The same surroundings with random letters and digits of both cases as the value."""
    key = bytes(r.choice(MIXED, int(r.integers(RUN, HALF + 1))))
    return surroundings(near[:BEFORE] + key + near[-AFTER:], BEFORE, BEFORE + len(key))


def harmless_forms(near: bytes, r: np.random.Generator) -> list[bytes]:
    """A number, a date, a mail address, a path and a joined name in place of a plain word."""
    word = near[BEFORE:BEFORE + HALF].rstrip(b"\0").lower() or b"word"
    digits = lambda n: b"%0*d" % (n, int(r.integers(0, 10**n)))
    forms = [digits(int(r.integers(12, 18))), b"20%s-%s-%sT%s" % tuple(digits(2) for _ in range(4)),
             word + digits(int(r.integers(1, 4))) + b"@" + word[::-1][:6] + b".example.com",
             b"www." + word + b".org/" + word + b"/" + digits(2), word.title() + b"_" + word + b"-" + digits(3)]
    return [surroundings(near[:BEFORE] + f + near[-AFTER:], BEFORE, BEFORE + len(f)) for f in forms]


def _moved(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each positive also stands in the surroundings of a negative, so the value itself must tell."""
    r = np.random.default_rng(11)
    first = len(y)
    for side in (True, False):
        own = held[:first] == side
        moved, rest = x[:first][own & (y[:first] == 1)].copy(), x[:first][own & (y[:first] == 0)]
        if not len(rest):
            continue
        other = rest[r.integers(0, len(rest), len(moved))]
        moved[:, :BEFORE], moved[:, -AFTER:] = other[:, :BEFORE], other[:, -AFTER:]
        x, y = np.concatenate([x, moved]), np.concatenate([y, np.ones(len(moved), y.dtype)])
        held = np.concatenate([held, np.full(len(moved), side)])
    return x, y, held


def _fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> CharCNN:
    """A network trained and calibrated on the rows."""
    x, y, held = _moved(x, y, held)
    model = CharCNN()
    model.fit(x[~held], y[~held])
    model.calibrate(x[held], y[held])
    return model


def examples(near: list[bytes], label: list[int], key: list[int], kinds: list) -> tuple[np.ndarray, ...]:
    """Codes, labels, kinds and whether held out (every fourth key): the rows, then the pieces and
    made-up keys of positives and the harmless forms of plain words."""
    near, label, key, kinds = list(near), list(label), list(key), list(kinds)
    r = np.random.default_rng(13)
    for i in range(len(near)):
        more = [pieces_of(near[i], r), made_up(near[i], r)] if kinds[i] in (0, 1, 2) else (
            harmless_forms(near[i], r) if kinds[i] == PLAIN else [])
        near += more
        label += [label[i]] * len(more)
        key += [key[i]] * len(more)
        kinds += [kinds[i]] * len(more)
    x = CharCNN.codes(near) if near else np.empty((0, 0), np.uint8)
    return (x, np.array(label), np.array([-1 if k is None else k for k in kinds]),
            np.array([k % 4 == 0 for k in key], bool))


def train(sample, kinds=None) -> CharCNN | None:
    """``sample``: rows (near, label, key) of one group. ``kinds``: the kind of
    each row; positives get pieces and made-up keys, plain words harmless forms, and with two base
    patterns or more the threshold is that of the patterns left out."""
    if kinds is not None:
        use = [trains(bytes(r["near"]), k) is not None for r, k in zip(sample, kinds, strict=True)]
        sample, kinds = ([x for x, u in zip(xs, use, strict=True) if u] for xs in (sample, kinds))
    x, y, kind, held = examples([bytes(r["near"]) for r in sample], [r["label"] for r in sample],
                                [r["key"] for r in sample], kinds if kinds is not None else [None] * len(sample))
    both = lambda use: all(((y == k) & h & use).any() for k in (0, 1) for h in (held, ~held))
    if not len(y) or not both(np.ones(len(y), bool)):
        return None
    model = _fitted(x, y, held)
    left_out, whole = [], np.arange(len(y)) < len(sample)
    for k in np.unique(kind[(y == 1) & (kind >= 0)]):
        rest = ~((y == 1) & (kind == k))
        if both(rest):
            left_out.append(_fitted(x[rest], y[rest], held[rest]).probability(x[~rest & whole]))
    if left_out:
        good = np.sort(np.concatenate(left_out))
        model.threshold = float(good[int(np.floor((1 - RECALL) * len(good)))])
    return model


def _group(rows: pa.Table) -> tuple[np.ndarray, ...]:
    rows = rows.sort_by([("key", "ascending"), ("kind", "ascending"), ("near", "ascending")])
    kinds = rows["kind"].to_pylist()
    return *examples(rows["near"].to_pylist(), [int(k < 3) for k in kinds], rows["key"].to_pylist(), kinds), len(kinds)


def _rest(out: int, x, y, kind, held):
    """The rows without positives of the pattern ``out`` (-1: all rows)."""
    rest = ~((y == 1) & (kind == out))
    return _moved(x[rest], y[rest], held[rest])


def _learn(starts: dict[int, np.ndarray], epochs: int, seed: int):
    """One round of a group: each network (by the pattern it does without) goes on over the group's rows."""
    def task(rows: pa.Table) -> pa.Table:
        *group, _ = _group(rows)
        done = []
        for out, start in starts.items():
            x, y, held = _rest(out, *group)
            if len(np.unique(y[~held])) == 2:
                model = CharCNN.of(start)
                model.fit(x[~held], y[~held], epochs, seed=seed)
                done.append((out, np.round(model.flat() * SCALE).astype(np.int64)))
        return pa.table({"out": pa.array([o for o, _ in done], pa.int32()),
                         "p": pa.array([p for _, p in done], pa.list_(pa.int64()))})
    return task


def _judge(models: dict[int, np.ndarray]):
    """Counts of a group's scores: held-out rows by label, and the values of the pattern left out (2)."""
    def task(rows: pa.Table) -> pa.Table:
        *group, n = _group(rows)
        x, y, kind, _ = group
        got = []
        for out, flat in models.items():
            model = CharCNN.of(flat)
            some, label, held = _rest(out, *group)
            left = x[:n][(y[:n] == 1) & (kind[:n] == out)]
            for what, part in ((0, some[held & (label == 0)]), (1, some[held & (label == 1)]), (2, left)):
                if len(part):
                    z = np.floor(np.clip(model.logit(part), -LIMIT, LIMIT) * STEPS).astype(np.int64)
                    got += [(out, what, b, c) for b, c in zip(*np.unique(z, return_counts=True), strict=True)]
        return pa.table({c: pa.array([g[i] for g in got], t) for i, (c, t) in enumerate(
            [("out", pa.int32()), ("what", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])})
    return task


def _few(df: DataFrame) -> list:
    return df.limit(SAMPLE).collect()


def train_on(rows: DataFrame) -> CharCNN | None:
    """The network of all labelled rows (near, kind, key), wherever they lie."""
    held = F.col("key") % 4 == 0
    sizes = _few(rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(held).alias("held")))
    n = {r["kind"]: (r["held"], r["n"] - r["held"]) for r in sizes}
    total = sum(r["n"] for r in sizes)
    both = lambda out: all(any(n[k][side] for k in n if k != out and (k < 3) == positive)
                           for positive in (True, False) for side in (0, 1))
    if not both(-1):
        return None
    groups = -(-total // GROUP)
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups))).select("grp", "near", "kind", "key")
    one = dealt.groupBy("grp")
    nets = {out: CharCNN().flat() for out in (-1, *sorted(k for k in n if k < 3)) if both(out)}
    for turn in range(1 if groups == 1 else ROUNDS):
        done = one.applyInArrow(_learn(nets, EPOCHS if groups == 1 else 1, 7 + turn), "out int, p array<long>")
        # Whole numbers, so that their sum does not depend on the order.
        mean = done.select("out", F.posexplode("p")).groupBy("out", "pos").agg(
            F.sum(F.col("col").cast("decimal(38,0)")).cast("double").alias("s"), F.count("*").alias("n"))
        mean = mean.groupBy("out").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("v")))).alias("p"))
        nets |= {r["out"]: np.array([x["v"] for x in r["p"]]) / SCALE for r in _few(mean)}
    counts = one.applyInArrow(_judge(nets), "out int, what int, bin long, n long").groupBy("out", "what", "bin").agg(
        F.sum("n").alias("n")).groupBy("out", "what").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    seen = {(r["out"], r["what"]): np.array(sorted((x["bin"], x["n"]) for x in r["bins"])) for r in _few(counts)}
    models = {}
    for out, flat in nets.items():
        models[out] = CharCNN.of(flat)
        parts = [seen[out, y] for y in (0, 1)]
        models[out]._platt(np.concatenate([p[:, 0] + 0.5 for p in parts]) / STEPS,
                           np.repeat([0, 1], [len(p) for p in parts]), np.concatenate([p[:, 1] for p in parts]))
    good = [(out, seen[out, 2]) for out in nets if (out, 2) in seen] or [(-1, seen[-1, 1])]
    p = np.concatenate([models[out].calibrated(bins[:, 0] / STEPS) for out, bins in good])      # lower ends: no recall lost
    many = np.concatenate([bins[:, 1] for _, bins in good])
    order = np.argsort(p)
    models[-1].threshold = float(p[order][np.searchsorted(np.cumsum(many[order]), np.floor((1 - RECALL) * many.sum()), "right")])
    return models[-1]


def _score(model: CharCNN | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(5)
            lists = found.offsets.to_numpy() if len(batch) else np.zeros(1, np.int64)
            items = found.values
            start, stop, kind = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            keep = kind < 3
            other = np.flatnonzero((kind == 3) | (kind == KNOWN))
            if model is not None:
                near = items.field(3)
                for lo in range(0, len(other), 2048):
                    part = other[lo:lo + 2048]
                    p = model.probability(CharCNN.codes(near.take(pa.array(part)).to_pylist()))
                    keep[part[p >= model.threshold]] = True
            spans, more = [], []
            for i in range(len(batch)):
                at = np.arange(lists[i], lists[i + 1])
                at = at[keep[at]]
                spans.append(spans_text((int(start[j]), min(3, int(kind[j])), int(stop[j])) for j in at))
                more.append(int((kind[at] >= 3).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])
    return task


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings of every text: counts, digest of the base spans, all spans."""
    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                 .mapInArrow(_scan, SCHEMA), "candidates")
    one = rows.select("id", F.explode("found").alias("f")).select(
        F.col("f.near").alias("near"), F.col("f.kind").alias("kind"),
        F.xxhash64("id", "f.start").bitwiseAND((1 << 63) - 1).alias("key"))
    model = train_on(one.where((F.col("kind") != 3) & F.col("near").isNotNull()))
    return rows.mapInArrow(_score(model), "id long, n_assign long, n_access long, n_hex long, "
                                          "base_sha256 string, spans string, n_model long")


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base findings and the network's."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
