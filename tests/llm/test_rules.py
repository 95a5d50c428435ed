"""Quality rules (op9), secrets (op4), decontamination (op10), scores (op8)."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import decontaminate, kernel, maxent, quality, secrets
from tests.llm import brute
from tests.llm.conftest import frame, prose


def texts_with_repeats():
    r, out = random.Random(4), []
    for i in range(40):
        w = prose(i, r.randrange(1, 120), r.choice([2, 8, 400])).split(" ")
        for _ in range(r.randrange(3)):
            at, size = r.randrange(len(w)), r.randrange(5, 40)
            w += w[at:at + size] * r.randrange(1, 3)
        out.append(r.choice([" ", "\n", " \t"]).join(w) + r.choice(["", "#%|", "\n a\n a\n a "]))
    return out


def test_measures_match_brute_force(edges):
    texts = [t for d, t in edges.items() if d not in (9, 12)] + texts_with_repeats() + ["a b c " * 90]
    raw, off = kernel.column_bytes(pa.array(texts))
    m = quality.measure(raw, off)
    assert [tuple(int(m[k][i]) for k in quality.MEASURES) for i in range(len(texts))] == [
        brute.quality(t) for t in texts]


def test_quality_of_edges_and_pipeline_filter(spark, edges, empty):
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0
    docs = dict(edges) | dict(enumerate(texts_with_repeats(), 20)) | {90: prose(3, 80) + " " + prose(3, 80)}
    df = frame(spark, docs).withColumnRenamed("n_chars", "kept")
    rows = {r.id: r for r in quality.quality(df).collect()}
    small = [d for d in docs if d not in (9, 12)]
    assert {d: rows[d].kept for d in small} == {d: brute.quality_kept(docs[d]) for d in small}
    assert rows[9].kept and not rows[12].kept and not rows[90].kept
    left = quality.keep_good(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d in docs if rows[d].kept}


def test_the_suffix_array_rejects_what_the_plain_rules_pass(spark):
    fresh = lambda seed, n: prose(seed, n, 10**9)
    docs = {1: fresh(1, 900) + " " + fresh(2, 101) + " " + fresh(3, 900) + " " + fresh(2, 101),      # one long passage twice
            2: fresh(1, 900) + " " + fresh(2, 100) + " " + fresh(3, 900) + " " + fresh(2, 100),
            3: fresh(4, 79) + " " + " ".join([fresh(5, 10)] * 2) + " x",                             # 20 words of 100 covered
            4: fresh(4, 78) + " " + " ".join([fresh(5, 10)] * 2) + " x",                             # 20 of 99
            5: fresh(6, 4000) + " " + fresh(7, 2400) + " " + fresh(8, 1200) + " " + fresh(7, 2400)}
    rows = {r.id: r for r in quality.quality(frame(spark, docs)).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {d: r.kept for d, r in rows.items()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert {r.doc_id for r in quality.keep_good(frame(spark, docs)).collect()} == {2, 3}


def secret_texts(n=400):
    r, out = random.Random(8), {}
    for i in range(n):
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([20, 32, 40])))
        extra = [f'Token = "{hexes}"', f"AKIA{hexes.upper()}", f"ñ {hexes}", "password: short", f"api_key:{hexes}",
                 f"mail{i}@mail.example.com", f"{r.randrange(10**16):016d}", "secret=token=abcdefgh1", "x", "x"][i % 10]
        out[i] = prose(i, 10) + " " + extra + " é " + prose(i, 8)
    return out


def test_base_findings_match_brute_force(spark, edges, empty):
    assert secrets.scan(empty).count() == 0
    docs = {1000 + d: t for d, t in edges.items()} | secret_texts()
    rows = {r.id: r for r in secrets.scan(frame(spark, docs).withColumnRenamed("lang", "spans")).collect()}
    assert {d: r.base_sha256 for d, r in rows.items()} == {d: brute.secrets_sha(t) for d, t in docs.items()}
    for d, t in docs.items():
        kinds = Counter(k for _, k, _ in brute.secrets(t))
        assert (rows[d].n_assign, rows[d].n_access, rows[d].n_hex) == (kinds[0], kinds[1], kinds[2])
        base = {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute.secrets(t)}
        assert base <= set(rows[d].spans.split(",") if rows[d].spans else ())
    assert rows[1000].spans == "" and rows[1000].base_sha256 == hashlib.sha256(b"").hexdigest()
    # Shorter hexadecimal keys are no base finding; the network finds most of them and no mail address.
    short = [d for d, t in docs.items() if d % 10 == 2 and d < 1000 and not brute.secrets(t)]
    assert len(short) > 5 and np.mean([rows[d].n_model > 0 for d in short]) > 0.3
    assert np.mean([rows[d].n_model > 0 for d in docs if d < 1000 and d % 10 == 5]) < 0.2


def test_frequent_formats_that_no_pattern_knows_are_found(spark):
    r, mixed = random.Random(5), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(r.choice(mixed) for _ in range(n))
    docs = secret_texts()
    for i in range(300):
        value = [f"ghp_{key(36)}", f"sk_live_{key(24)}", f"eyJhbGciOiJIUzI1NiJ9.{key(40)}.{key(43)}",
                 f"{r.randrange(10**14):014d}", f"www.example.com/page{i}/view", f"order_item_{i}_7"][i % 6]
        docs[1000 + i] = f"{prose(i, 10)} {value} {prose(i, 8)}"
    rows = {x.id: x for x in secrets.scan(frame(spark, docs)).collect()}
    found = [np.mean([rows[d].n_model > 0 for d in docs if d >= 1000 and (d - 1000) % 6 == k]) for k in range(6)]
    assert min(found[:3]) > 0.5 and max(found[3:]) < 0.1, found


def test_network_separates_held_out_findings():
    r = random.Random(2)
    sample = []
    for i in range(600):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40)) if i % 2 else f"user{i}@mail{r.randrange(99)}.org"
        text = f"{prose(i, 6)} {value} {prose(i, 3)}".encode()
        at = text.index(value.encode())
        sample.append({"near": secrets.surroundings(text, at, at + len(value)), "label": i % 2, "key": r.randrange(10**9)})
    model = secrets.train(sample[:400])
    x = secrets.CharCNN.codes([s["near"] for s in sample[400:]])
    y = np.array([s["label"] for s in sample[400:]])
    assert ((model.probability(x) >= model.threshold) == y).mean() > 0.95
    assert secrets.train([]) is None and secrets.train(sample[1:400:2]) is None


class PlainCNN(secrets.CharCNN):
    """The network by plain indexing: every window of every row, every sum by itself."""

    def _forward(self, x, places=False):
        p, length = self.p, x.shape[1] - secrets.WIDTH + 1
        lo, hi, x = secrets.BEFORE - 2, secrets.BEFORE + 2 * secrets.HALF - 2, x.astype(np.intp)
        tables = np.matmul(p["emb"], p["conv"].reshape(secrets.WIDTH, secrets.DIM, secrets.FILTERS)).astype(np.float32)
        a = tables[0][x[:, :length]]
        for w in range(1, secrets.WIDTH):
            a += tables[w][x[:, w:w + length]]
        parts = [a[:, lo:hi], np.concatenate([a[:, :lo], a[:, hi:]], 1)]
        at = [part.argmax(1) for part in parts] if places else []
        at = [at[0] + lo, np.where(at[1] < lo, at[1], at[1] + hi - lo)] if places else []
        pooled = np.maximum(np.concatenate([part.max(1) for part in parts], 1) + np.tile(p["bias"], 2), 0)
        return at, pooled, pooled @ p["out"] + p["b"]

    def fit(self, x, y, epochs, rate=0.01, size=128, seed=7):
        r, width, filters = np.random.default_rng(seed), secrets.WIDTH, secrets.FILTERS
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
        t = 0
        for part in (p for _ in range(epochs) for p in np.array_split(r.permutation(len(y)), len(y) // size)):
            own = x[part].astype(np.intp)
            at, pooled, z = self._forward(own, True)
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            dp = np.outer(dz, self.p["out"]) * (pooled > 0)
            cell = [(w * 97 + own[np.arange(len(part))[:, None], np.concatenate(at, 1) + w]) * filters
                    + np.tile(np.arange(filters), 2) for w in range(width)]
            back = sum(np.bincount(c.ravel(), dp.ravel(), width * 97 * filters) for c in cell).reshape(width, 97, filters)
            conv = self.p["conv"].reshape(width, secrets.DIM, filters)
            g = {"out": pooled.T @ dz, "b": dz.sum(keepdims=True), "bias": dp.sum(0).reshape(2, filters).sum(0),
                 "conv": np.matmul(self.p["emb"].T, back).reshape(width * secrets.DIM, filters),
                 "emb": np.matmul(back, conv.transpose(0, 2, 1)).sum(0)}
            t += 1
            for k in self.p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)


def test_the_network_equals_plain_indexing_at_less_cost():
    r = random.Random(12)
    values = [lambda: "plainword", lambda: f"{r.randrange(10**15):015d}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
              lambda: "x" * 26, lambda: "\0" * 30, lambda: "z" * 24, lambda: "", lambda: "ñ" * 20]
    near = [b"\0" * 80, b"z" * 80]
    for i in range(2400):
        value, before, after = values[i % 8]().encode(), prose(i, i % 7).encode(), prose(i, i % 3).encode()
        near.append(secrets.surroundings(before + value + after, len(before), len(before + value)))
    x, y = secrets.CharCNN.codes(near), np.arange(len(near)) % 8 == 4
    assert 100 < x[:, secrets.BEFORE + secrets.HALF:-secrets.AFTER].any(1).sum() < 2000
    took, nets, scores = {}, [], []
    for kind in (PlainCNN, secrets.CharCNN) * 3:
        model, begun = kind(), time.process_time()
        model.fit(x, y, 2)
        scores.append(model.logit(x))
        took[kind] = min(took.get(kind, 1e9), time.process_time() - begun)
        nets.append(model.flat())
    assert all(np.array_equal(nets[0], n) for n in nets) and all(np.array_equal(scores[0], z) for z in scores)
    assert took[secrets.CharCNN] < 0.8 * took[PlainCNN], took


def test_spans_do_not_depend_on_the_order_or_layout_of_rows(spark):
    docs = list(secret_texts(700).items())
    one = {r.id: r.spans for r in secrets.scan(frame(spark, docs).coalesce(1)).collect()}
    two = {r.id: r.spans for r in secrets.scan(frame(spark, docs[::-1]).repartition(5)).collect()}
    assert one == two and any(one.values())


def test_every_two_substitutions_leave_a_seed():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MISSES):
        assert any(not {at + p for p in mask} & set(gone) for mask in decontaminate.MASKS
                   for at in range(decontaminate.WINDOW - mask[-1]))
    assert all(len(m) == 6 and m[0] == 0 for m in decontaminate.MASKS)


@pytest.mark.parametrize("shuffle", [False, True])
def test_contamination_matches_brute_force(spark, edges, empty, shuffle):
    items = {i: prose(500 + i, n) for i, n in enumerate((5, 8, 12, 13, 20, 40))} | {7: None, 8: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    r, docs = random.Random(6), dict(edges)
    docs[9] = prose(1, 500)
    for i in range(60):
        w = items[i % 6].split(" ")
        lo, hi = (0, len(w)) if i < 30 else sorted((r.randrange(len(w)), len(w)))
        w = w[lo:hi]
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed"
        docs[20 + i] = prose(i, 9) + " " + " ".join(w).upper().replace("W", "w") + "\n" + prose(i + 1, 9)
    rows = decontaminate.overlaps(frame(spark, docs), bench, shuffle=shuffle).collect()
    want = {(d, i) for d, t in docs.items() for i in brute.contaminated(t, items)}
    assert {(r.id, r.item) for r in rows} == want and len(rows) == len(want) > 20
    assert decontaminate.overlaps(empty, bench, shuffle=shuffle).count() == 0
    assert decontaminate.overlaps(frame(spark, docs), bench.limit(0), shuffle=shuffle).count() == 0


def test_both_ways_agree_on_nulls_short_items_and_repeated_ids(spark):
    short = {n: " ".join(f"q{n}{i}" for i in range(n)) for n in range(1, 8)}
    long = prose(77, 20)
    bench = spark.createDataFrame([*short.items(), (None, long), (None, "only this"), (9, "only this"), (9, "other words here"),
                                   (10, ""), (11, None), (12, " \n")], "item_id long, text string")
    texts = [(n, "a " + t.upper() + "\tb") for n, t in short.items()] + [
        (20, short[5] + " x " + short[2]), (21, "q50 q51 q52 q53"), (22, "q21 q20"), (None, "z " + long), (None, long + " z"),
        (None, "clean"), (23, "only this other words here"), (23, "only q10"), (24, "only  this"), (25, ""), (26, None)]
    df = frame(spark, texts + texts[:3])
    want = {(n, n, n) for n in short} | {(20, 5, 5), (20, 2, 2), (None, None, 20), (23, None, 2), (23, 9, 3), (23, 1, 1),
                                         (24, None, 2), (24, 9, 2)}
    for shuffle in (False, True):
        rows = [tuple(r) for r in decontaminate.overlaps(df, bench, shuffle=shuffle).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        left = decontaminate.keep_clean(df, bench, shuffle=shuffle)
        assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id) == [
            (21, "q50 q51 q52 q53"), (22, "q21 q20"), (25, ""), (26, None)]
        assert [r.text for r in left.where("doc_id is null").collect()] == ["clean"]


def test_only_contaminated_rows_go(spark):
    item = prose(1, 20)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = frame(spark, [(None, item), (None, "clean"), (1, "x " + item), (1, "clean"), (2, None), (2, None)])
    left = decontaminate.keep_clean(df.withColumnRenamed("lang", "key"), bench)
    assert left.columns == ["doc_id", "text", "key", "source", "n_chars"]
    assert sorted(map(str, [(r.doc_id, r.text) for r in left.collect()])) == sorted(
        map(str, [(None, "clean"), (1, "clean"), (2, None), (2, None)]))


def scores(spark, docs, **more):
    from pyspark.sql import functions as F
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return {r.id: r for r in maxent.score_texts(frame(spark, docs), held, **more).collect()}


def test_base_scores_match_brute_force_and_the_model_learns(spark, edges, empty, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(maxent, "FREQUENT", 50)       # most tokens take the join
    monkeypatch.setattr(maxent, "FAN_IN", 2)
    r, docs = random.Random(3), {1000 + d: t for d, t in edges.items()}
    for i in range(300):                              # each word tells the next one's class
        w = ["start"]
        for _ in range(60):
            w.append(f"{w[-1][-1]}{r.randrange(40)}" + "abcdef"["abcdef".find(w[-1][-1]) + 1 & 3])
        docs[i] = " ".join(w)
    rows = scores(spark, docs)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    seen = {d: brute.words(brute.lower(t)) + [None] for d, t in docs.items()}
    c = Counter(t for d in docs if not held[d] for t in seen[d])
    total = sum(c.values())
    for d, w in seen.items():
        row = rows[d]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (
            held[d], len(w), sum(c[t] > 0 for t in w), total)
        want = sum(math.log10((c[t] + 1) / (total + len(c) + 1)) for t in w)
        assert row.base_score == pytest.approx(want, rel=1e-9, abs=1e-9)
    out = [d for d in docs if held[d] and d < 1000]
    assert sum(rows[d].score for d in out) > sum(rows[d].base_score for d in out)
    assert maxent.score_texts(empty, F.lit(False)).count() == 0
    none = maxent.score_texts(frame(spark, {1: "a b", 2: None}), F.lit(True)).collect()
    assert {(x.id, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in none} == {(1, 3, 0, 0, 0), (2, 1, 0, 0, 0)}


def test_words_of_one_class_with_equal_counts_are_told_apart_by_context(spark, monkeypatch):
    monkeypatch.setattr(maxent, "BATCH", 64)
    one, other = "k0zzz", "k1zzz"                     # one class: the last three bytes agree
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = {d: (f"left {one}", f"right {other}")[i % 2] for i, d in enumerate(ids[:2000])}
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = scores(spark, docs | {held[0]: f"left {one}", held[1]: f"left {other}"})
    assert rows[held[0]].base_score == rows[held[1]].base_score
    assert rows[held[0]].score > rows[held[1]].score + 0.5


def test_class_probabilities_sum_to_one():
    w = np.random.default_rng(1).normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    f = np.tile(np.array([[0, 5, 9, 3, 100]], np.int32), (maxent.CLASSES, 1))
    assert np.exp(maxent.log_probs(w, f, np.arange(maxent.CLASSES))).sum() == pytest.approx(1, rel=1e-5)


def test_every_labelled_value_trains_the_network(spark):
    """More harmless values than any sample held, one form with the smallest hashes, another with the largest."""
    from pyspark.sql import functions as F

    ids = [x.id for x in spark.range(1 << 15).orderBy(F.xxhash64("id", F.lit(4).cast("long")).bitwiseAND((1 << 63) - 1)).collect()]
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    odd = lambda: "/".join(f"{letters(1).upper()}{letters(1)}{r.randrange(1000)}" for _ in range(5))
    docs = {d: f"at  {r.randrange(10**15):015d} ok" for d in ids[:6000]} | {d: f"at  {odd()} ok" for d in ids[-6000:]}
    docs |= {10**6 + d: t for d, t in secret_texts().items()}
    rows = {x.id: x for x in secrets.scan(frame(spark, docs)).collect()}
    assert np.mean([rows[d].n_model > 0 for d in ids[-6000:]]) < 0.02
