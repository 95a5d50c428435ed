"""Token counts, alignment and hard negatives against the libraries and brute force."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import alignment, bpe, covertree, tokencount
from tests.llm.conftest import frame, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "s", "'", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "1", "²", "é", "՘",
         "\U00011de0", "<|endoftext|>", "<|", "<s>", "<0x0A>", "▁", "!", "中", "😀", "the", " the", "ing", "====", "\x00"]


@pytest.fixture(scope="module")
def proof():
    return bpe.prove(A)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(A)


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(n)]


# ------------------------------------------------------------------------------------------- op12
def test_whole_strings_encode_alone(proof, library):
    some = random.Random(2).sample(sorted(proof.whole), 500)
    assert len(proof.whole) > 49_000 and "<|endoftext|>" not in proof.whole
    assert all(library.encode(s, add_special_tokens=False).ids == [proof.whole[s]] for s in some)


def test_counts_match_the_library(proof, library):
    texts = odd_texts(3000) + [prose(3, 5000), "x" * 30_000, " " * 5000, "", "aé" * 4000]
    count = tokencount.counter(proof)
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_blocks_of_a_long_text_give_the_same_tokens(proof, library, monkeypatch):
    text = " ".join(odd_texts(3000, 5)) + "  end "
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert "".join(bpe.blocks(text, 50)) == text and len(list(bpe.blocks(text, 50))) > 100
    assert sum(map(tokencount.counter(proof), bpe.blocks(text, 50))) == want
    assert list(bpe.blocks("no-cut" * 100, 50)) == ["no-cut" * 100] and list(bpe.blocks("", 50)) == [""]


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.prove(public_tokenizers.path("word_bpe_49k.json"))


def test_count_rows(spark, edges, empty, library):
    rows = frame(spark, [*edges.items(), (8, "one"), (None, "null id")]).withColumn("id", F.lit(5)).withColumn(
        "n_tokens", F.lit("x"))
    got = tokencount.count_tokens(rows, A)
    assert got.columns == ["id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
            for d, t in [*edges.items(), (8, "one"), (None, "null id")]]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((*r, r[2] > 512) for r in want), key=key)
    assert tokencount.count_tokens(empty, A).count() == 0


# ------------------------------------------------------------------------------------------- op13
@pytest.fixture(scope="module")
def brute_align(proof):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes = bpe.token_bytes(json.loads(proof.spec))

    def b_bytes(i):
        name = sp.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()

    def align(text):
        """(n_a, n_b, n_groups, n_links, hash, {(a, b): times})"""
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        left, right = [a_bytes.get(i, b"") for i in a], [b_bytes(i) for i in b]
        if not text or not b"".join(left) == b"".join(right) == (" " + text).encode():
            return 0, 0, 0, 0, "", {}
        a_end, b_end = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        groups, links, i, k = [], {}, 0, 0
        for cut in sorted({*a_end} & {*b_end}):
            j, m = a_end.index(cut) + 1, b_end.index(cut) + 1
            groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
            for x in a[i:j]:
                for y in b[k:m]:
                    links[x, y] = links.get((x, y), 0) + 1
            i, k = j, m
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return len(a), len(b), len(groups), sum(links.values()), digest, links

    return align


def expected_rows(brute_align, texts):
    got = [brute_align(t) for t in texts]
    held, top = {}, {}
    for *_, links in got:
        for p in links:
            held[p] = held.get(p, 0) + 1
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    return [(*g[:4], sum(n for p, n in g[5].items() if held[p] == top[p[0]]),
             sum(n * held[p] for p, n in g[5].items()), g[4]) for g in got]


def test_leaf_ends_are_all_shared_cuts():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a, b = (np.unique(np.append(r.integers(1, n + 1, int(r.integers(0, 40))), n)) for _ in range(2))
        cuts = np.intersect1d(a, b)
        j, m = alignment.leaf_ends(a, b)
        assert a[j - 1].tolist() == cuts.tolist() == b[m - 1].tolist()
    assert [len(x) for x in alignment.leaf_ends(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_alignment_rows(spark, brute_align, edges, empty, head):
    texts = [*[t for t in edges.values() if not t or len(t) < 20_000], *odd_texts(120, 9), "one", "one", "==" * 300, prose(7, 200)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pair string")
    got = alignment.align_tokens(rows, A, B, head=head)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in got.orderBy("id").collect()] == expected_rows(brute_align, texts)
    if not head:
        assert alignment.align_tokens(empty, A, B, head=head).count() == 0


def test_blocks_align_like_the_whole_text(proof, brute_align, monkeypatch):
    aligner = alignment.Aligner(proof, open(B, "rb").read())
    text = " ".join(odd_texts(400, 12)).replace("▁", "") + " " + prose(5, 400)
    cut = bpe.blocks
    monkeypatch.setattr(bpe, "blocks", lambda t: cut(t, 40))
    assert aligner.align([text])[0][:5] == brute_align(text)[:5]


# ------------------------------------------------------------------------------------------- op11
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    """Rows of (id, vector, label); ids unique."""
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows
            if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = set()
    for a, va, ya in (r for r in good if r[0] % 100 == 0):
        scored = sorted((-dot(va, v), i, y) for i, v, y in good if i != a)
        for ps, p, _ in [s for s in scored if s[2] == ya][:5]:
            hard = [s for s in scored if s[2] != ya and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out |= {(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(hard)}
    return out


def vectors(seed, n, d, kind):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * 0.3
    if kind == "clusters":
        x = r.normal(size=(8, d))[r.integers(0, 8, n)] + x * 0.2
    if kind == "ties":
        x = r.integers(-1, 2, (n, d)) / 4
    return [(i, [float(v) for v in x[i].astype(np.float32)], int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_hard_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "BLOCK", 120)
    monkeypatch.setattr(covertree, "ROOTS", 1)
    rows = vectors(3, 700, 5, kind)
    got = covertree.hard_negatives(spark.createDataFrame(rows, VECTORS))
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows)


def test_hard_negative_edges(spark):
    same = [(i, [0.5, 0.5], i % 2) for i in range(300)]        # one vector, a third and more of all rows
    rest = [(300, [0.5, 0.4, 0.1], 0), (301, None, 0), (302, [1.0, 1.0], None), (None, [1.0], 0),
            (303, [float("nan"), 1.0], 1), (304, [float("inf")], 1), (305, [None, 1.0], 1), (306, [], 1),
            (400, [0.0, 0.0], 1), (500, [-1.0, -1.0], 0), (501, [-0.9, -1.0], 1)]
    rows = same + rest
    df = spark.createDataFrame(rows, VECTORS).withColumn("block", F.lit("x")).withColumn("id", F.lit(1))
    out = covertree.hard_negatives(df.union(df))         # every row twice
    assert {tuple(r) for r in out.collect()} == brute_negatives(rows)
    assert covertree.hard_negatives(df.limit(0)).count() == 0
    assert covertree.hard_negatives(df.where("vec_id = 301")).columns == out.columns


def test_tree_levels_cover_their_points():
    r = np.random.default_rng(8)
    x = np.floor(256 * r.normal(size=(900, 6)))
    tree = covertree.CoverTree(x, r.integers(0, 4, 900), np.arange(900))
    lifted = covertree._lifted(tree.points, tree.norm)
    assert sorted(tree.ids.tolist()) == list(range(900)) and len(tree.levels) > 2
    for level in tree.levels:
        for c, radius, lo, hi in zip(level.centre, level.radius, level.start, level.end, strict=True):
            top = covertree._lifted(c[None], tree.norm)[0]
            assert covertree._angle(lifted[lo:hi] @ top, tree.norm ** 2).max() <= radius
    leaves = sorted((int(s), int(e)) for v in tree.levels for s, e, f in zip(v.start, v.end, v.leaf, strict=True) if f)
    assert leaves[0][0] == 0 and leaves[-1][1] == 900 and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))


def test_large_components_are_an_error(spark):
    from pyspark.errors import PythonException
    with pytest.raises(PythonException):
        covertree.hard_negatives(spark.createDataFrame([(0, [1e7], 0), (1, [1.0], 1)], VECTORS)).collect()
