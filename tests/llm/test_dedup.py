"""Near-duplicates (op2), exact repeats (op7) and line templates (op1) against brute force."""

import random

import numpy as np
import pytest

from inkwell.llm import components, kernel, lines, minhash, repeats
from tests.llm import brute
from tests.llm.conftest import edited, frame, prose


def got(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_words_and_hashes_follow_the_pattern(edges):
    import pyarrow as pa
    raw, off = kernel.column_bytes(pa.array(list(edges.values())))
    start, stop, first = kernel.word_spans(raw, off)
    h = kernel.span_hash(kernel.prefix(raw), start, stop)
    seen = {}
    for i, text in enumerate(edges.values()):
        w = [raw[a:b].tobytes().decode() for a, b in zip(start[first[i]:first[i + 1]], stop[first[i]:first[i + 1]])]
        assert w == brute.words(text)
        for word, x in zip(w, h[first[i]:first[i + 1]].tolist()):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_superminhash_estimates_and_is_exact_per_round():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:180], r.integers(0, 2**63, 20).astype(np.uint64)])
    small = a[:3]
    sig = minhash.superminhash(np.concatenate([a, b, small]), np.array([200, 200, 3]))
    assert abs((sig[0] == sig[1]).mean() - 180 / 220) < 0.12
    # Every round is a permutation: three elements fill the slots evenly.
    owner = [minhash.superminhash(x[None], np.array([1]))[0] for x in small]
    counts = [(sig[2] == o).sum() for o in owner]
    assert sum(counts) == minhash.SLOTS and min(counts) >= 25
    assert sorted((owner[0] >> 32).tolist()) == list(range(minhash.SLOTS))


@pytest.fixture(scope="module")
def families(edges):
    docs, base = dict(edges), [prose(100 + i, n) for i, n in enumerate((150, 150, 400, 12))]
    for i in range(160):             # many copies just about the threshold to each other
        docs[100 + i] = edited(base[i % 4], i, (1, 2, 3, 4, 6)[i % 5])
    docs[400], docs[401] = base[0], base[0].upper().replace("W", "w")
    return docs


def test_components_match_brute_force(spark, families):
    want = brute.near_components(families)
    rows = got(minhash.near_duplicates(frame(spark, families)))
    assert {d: (r.n_shingles, r.component_id) for d, r in rows.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in rows.items())


def test_components_without_links_repeated_rows_and_null_ids(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    rows = minhash.near_duplicates(frame(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "a"), (3, None)])).collect()
    assert sorted((r.id or -1, r.component_id or -1, r.kept) for r in rows) == [
        (-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    kept = minhash.keep_first(frame(spark, [(1, "a b"), (1, "a b"), (2, "A b"), (None, "a b"), (4, "")]))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b"), (1, "a b"), (4, "")]


def test_star_rounds_give_the_components(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 7)
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    u, v = components.union_find(*(np.array(x) for x in zip(*edges)))
    rows = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(x.node, x.root) for x in rows} == set(zip(u.tolist(), v.tolist())) and len(rows) == len(u)


@pytest.mark.parametrize(("block", "hot"), [(400_000, 20_000), (150, 4)])
def test_repeats_match_brute_force(spark, edges, monkeypatch, block, hot):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = dict(edges)
    docs[9] = prose(1, 800)
    passage = prose(7, 40)
    for i in range(30):
        docs[20 + i] = prose(200 + i, 20) + passage + prose(300 + i, 20)
    for i in range(10):
        docs[60 + i] = edited(docs[20], i, 2)
    docs[80], docs[81] = "ab" * 400, "é" * 49 + "ab" * 60
    rows = got(repeats.remove_repeats(frame(spark, docs)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in rows.items()} == brute.repeats_removed(docs)


def test_repeats_keep_rows_without_id_and_repeated_rows(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    t = prose(9, 60)
    rows = repeats.remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, t)])).collect()
    assert sorted((r.id or -1, r.n_removed) for r in rows) == [(-1, 0), (1, 0), (1, 0), (2, len(t))]


def test_multikey_sort_orders_like_bytes():
    r = np.random.default_rng(0)
    raw = r.integers(97, 99, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 400)
    order, new = repeats.multikey_order(raw, start, 13)
    keys = [raw[s:s + 13].tobytes() for s in start[order]]
    assert keys == sorted(keys) and new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def alpha(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(n))


def test_templates_generalise_variable_fields(spark, edges, empty):
    assert lines.drop_recurring(empty).count() == 0
    docs = dict(edges)
    for i in range(6):
        docs[20 + i] = f"{alpha(i, 7)}\nuser login from host {'abcdef'[i]} at port 8{i}\n{alpha(50 + i, 6)}"
    docs[30] = "user login from host zz at port 9\nuser login from host zz at port 9\n"
    rows = got(lines.drop_recurring(frame(spark, docs).withColumnRenamed("n_chars", "line")))
    assert rows[20].n_dropped == 0                    # the first instance stays
    for i in range(1, 6):
        assert rows[20 + i].n_dropped == 1 and "login" not in rows[20 + i].text
    assert (rows[30].n_lines, rows[30].n_dropped, rows[30].text) == (3, 2, "")
    assert rows[0].text is None and rows[0].n_lines == 0 and rows[1].text == "" and rows[1].n_lines == 1
    assert rows[9].text == docs[9]


def test_prose_with_a_common_head_and_rows_of_figures_stay(spark):
    prose_lines = ["This is the dog barking", "This is the cat sleeping", "This is the sun rising"]
    figures = ["12 30 44 5.1", "13 31 45 5.2", "14 32 46 5.3", "15 33 47 5.4"]
    docs = {i: t for i, t in enumerate(prose_lines)} | {10 + i: t for i, t in enumerate(figures)}
    docs |= {20 + i: "1 2 3 4" for i in range(3)} | {30 + i: "Total of page 7 is here" for i in range(3)}
    docs |= {40 + i: f"Printed on page {i} of the report" for i in range(3)}
    rows = got(lines.drop_recurring(frame(spark, docs)))
    assert all(rows[i].n_dropped == 0 for i in (0, 1, 2, 10, 11, 12, 13, 20, 30, 40))
    assert all(rows[i].n_dropped == 1 for i in (21, 22, 31, 32, 41, 42))


def test_frequent_values_of_variable_fields_are_generalised(spark):
    """Two fields with frequent values: support is a share of the leaf's documents."""
    people, towns = [f"name{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"], [f"town{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = {i: f"order sent to {people[i % 36]} living near {towns[i % 26]} with best regards" for i in range(400)}
    rows = got(lines.drop_recurring(frame(spark, docs)))
    assert sum(r.n_dropped for r in rows.values()) == 399 and rows[0].n_dropped == 0


def test_a_text_of_many_lines_takes_linear_time(spark):
    import time
    r = random.Random(1)
    text = "\n".join(f"event {r.choice('abc')} of run {r.randrange(10**6)} {alpha(i, 2)} done" for i in range(100_000))
    docs = {i: text[i:50_000 + i] for i in range(1, 4)} | {0: text}
    t = time.time()
    row = lines.drop_recurring(frame(spark, docs)).where("id = 0").first()
    assert row.n_lines == 100_000 and time.time() - t < 60
