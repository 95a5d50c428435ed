"""Archives (op3), mixing (op5), sharding (op6)."""

import io
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from inkwell.llm import mixing, shards, warc
from tests.llm import brute
from tests.llm.conftest import EDGES, frame, prose


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    rows = [(d, f"http://x/{d}", t) for d, t in EDGES.items()]
    rows += [(20, None, "big " * 50000), (21, "http://y\r\nz", "a\r\n\r\nb"), (22, "u", "same"), (23, "u", "same"),
             (None, "u", "same"), (None, "u", "alone"), (24, "u", None)]
    manifest = warc.write_archives(pages(spark, rows).withColumn("first", F.lit(1)))
    back = warc.read_archives(manifest).collect()
    assert len(back) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    first = {}
    for d, _, t in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for r in back:
        t = next((t for d, _, t in rows if d == r.page_id), None) if r.page_id is not None else None
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), warc.digest32((t or "").encode()))
            lead = first[t or ""]
            assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
            assert r.payload is None if lead != r.page_id else bytes(r.payload) == (t or "").encode()
    assert sorted((r.record_type, r.refers_to) for r in back if r.page_id is None) == [("response", None), ("revisit", 22)]
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_small_payloads_can_be_left_alone(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")]
    back = warc.read_archives(warc.write_archives(pages(spark, rows), least=5)).collect()
    assert sorted((r.page_id, r.record_type) for r in back) == [
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def archive(records, dictionary=b"some words " * 50):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for r in records:
        w.add(r)
    return out.getvalue()


def test_reader_checks_frames_headers_and_lengths():
    good = warc.record(1, "u", b"payload", None, False, "d")
    data = archive([good, warc.record(2, "u", b"payload", 1, True, "d")])
    read = list(warc.read_archive(io.BytesIO(data), chunk=7))
    assert [(r[0], r[2], r[3], r[5]) for r in read] == [(1, "response", 7, None), (2, "revisit", 7, 1)]
    packed = zstandard.ZstdCompressor().compress(b"some words " * 50)
    start = 8 + struct.unpack("<I", data[4:8])[0]
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[start:]
    assert len(list(warc.read_archive(io.BytesIO(again)))) == 2
    assert len(list(warc.read_archive(io.BytesIO(archive([good], b""))))) == 1
    for bad in (b"", b"\0" * 20, data[:-5], data[:30], archive([good + good]), archive([good[:-1]]),
                archive([good.replace(b"Length: 7", b"Length: 8")]), archive([good.replace(b"payload", b"pAyload")]),
                archive([good.replace(b"WARC/1.1", b"WARK/1.1")]), archive([good.replace(b"WARC-Date", b"WARC-Dote")])):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))


def test_mix_reaches_its_targets(spark, empty):
    assert mixing.mix(mixing.sized(empty)).count() == 0
    r = random.Random(1)
    docs = [(i, prose(i, r.randrange(0, 60))) for i in range(400)] + [(i, t) for i, t in EDGES.items()]
    names = ["a", "b", "c", "d", None, "hot", "none"]
    source = {d: "hot" if i % 3 == 0 else names[i % 6] for i, (d, _) in enumerate(docs)}
    df = frame(spark, docs, lambda d: None).drop("source").withColumn("size", F.lit("clash"))
    rows = spark.createDataFrame([(i, d, t, source[d]) for i, (d, t) in enumerate(docs)], "k long, id0 long, text string, source string")
    rows = rows.union(spark.createDataFrame([(900, 900, None, "none")], rows.schema)).withColumn("size", F.lit("clash"))
    out = mixing.mix(mixing.sized(rows, "k")).collect()
    assert len(out) == len(docs) + 1 and df.count() == len(docs)
    sizes, taken = {}, {}
    for x in out:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken <= 2 * x.size and x.taken == sum(d.words for d in x.draws)
    want = brute.mix_targets(sizes)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(mixing.sized(rows.repartition(7), "k")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_tree_gives_exact_quotas_and_hypergeometric_counts(spark):
    draws = spark.createDataFrame([(s, b, 1) for s, n in (("a", 500), ("b", 300), (None, 7)) for b in range(n)],
                                  "source string, block int, epoch long")
    out = mixing.splitting_tree(draws, 3).groupBy("shard").agg(
        F.count("*").alias("n"), F.sum((F.col("source") == "a").cast("int")).alias("a")).collect()
    assert len(out) == 8 and {r.n for r in out} <= {100, 101, 102} and sum(r.n for r in out) == 807
    assert all(abs(r.a - 62.5) < 20 for r in out)


def test_draw_repeats_rows_as_drawn(spark, empty):
    assert mixing.draw(empty).count() == 0
    docs = [(i, prose(i, 20)) for i in range(60)] + [(70, "twin words"), (70, "twin words"), (None, "x y"), (None, None)]
    df = frame(spark, docs).withColumnRenamed("lang", "copies")
    out = mixing.draw(df)
    assert out.columns == df.columns and out.count() == mixing.draw(df.repartition(5)).count() > 60


def test_capacity_is_minimax_and_cut_keeps_it(spark):
    r = random.Random(2)
    for n, sizes in ((3, [5, 1, 9, 2, 2, 7]), (4, [r.randrange(1, 50) for _ in range(30)]),
                     (5, [1] * 10 + [100] + [1] * 10), (8, [3, 4])):
        cells = spark.createDataFrame(list(enumerate(sizes)), "cell int, bytes long")
        best = brute.minimax(sizes, n)
        got = spark.range(1).select(shards.smallest_capacity(F.array(*[F.lit(int(x)) for x in sizes]), n)).first()[0]
        assert got == best
        shard = {x.cell: x.shard for x in shards.cut(cells, n).collect()}
        order = [shard[i] for i in range(len(sizes))]
        assert order == sorted(order) and max(order) < n
        sums = np.bincount(order, sizes)
        assert sums.max() <= best and set(order) == set(range(max(order) + 1))
        if len(sizes) > 2 * n:
            assert len(set(order)) == n           # no trailing shard stays empty


def test_rows_with_equal_texts_share_a_shard(spark, empty):
    assert shards.shard_rows(shards.keyed(empty), 5).count() == 0
    docs = list(EDGES.items()) + [(20 + i, "hot text") for i in range(300)] + [(400 + i, prose(i, 9)) for i in range(300)]
    docs += [(None, None), (None, "hot text"), (3, "one"), (3, "one")]
    df = frame(spark, docs).withColumnRenamed("lang", "slot0").withColumnRenamed("n_chars", "cell")
    out = shards.place(df, 6).collect()
    assert len(out) == len(docs)
    by_text, slots = {}, {}
    for x in out:
        by_text.setdefault(x.text, set()).add(x.shard)
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
