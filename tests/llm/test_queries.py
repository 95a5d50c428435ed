"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm.common import stage, table
from inkwell.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    cur = con.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted([plain(x) for x in r] for r in cur.fetchall()) == sorted(
        [plain(r[c]) for c in cols] for r in df.collect())


def test_remaining_queries_match_brute_force(spark, docs):
    text = {d: r.text for d, r in docs.items()}
    for r in QUERIES["op4_secret_spans"](spark, SF).collect():
        assert r.base_sha256 == brute.secrets_sha(text[r.doc_id])
    want = brute.repeats_removed(text)
    for r in QUERIES["op7_suffix_repeats"](spark, SF).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    rows = QUERIES["op6_minimax_shards"](spark, SF).collect()
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert {r.shard for r in rows} == set(range(40))
    for r in QUERIES["op9_repetition_rules"](spark, SF).collect():
        if r.n_words < 400:
            assert tuple(r)[1:8] == brute.quality(text[r.doc_id])
            assert r.kept == brute.quality_kept(text[r.doc_id])
    rows = QUERIES["op8_maxent_scores"](spark, SF).collect()
    assert len(rows) == len(docs) and len({r.train_tokens for r in rows}) == 1


def test_pipeline_stages_match_brute_force(spark, docs):
    rows = table(spark, SF, "documents").where("n_chars < 8000").withColumn("key", F.lit(1))
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    text = {d: r.text for d, r in docs.items()}
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in rows.collect()}
        new = stage(function(spark, rows, SF), "test")
        after = [r.doc_id for r in new.collect()]
        if i == 0:
            assert set(after) == {d for d in before if brute.quality_kept(text[d])}
        elif i == 1:
            near = brute.near_components({d: text[d] for d in before})
            assert set(after) == {d for d in before if near[d][1] == d}
        elif i == 2:
            assert set(after) == {d for d in before if not brute.contaminated(text[d], items)}
        elif i == 3:
            size = {d: len(brute.words(text[d])) for d in before}
            by = {}
            for d in before:
                by[docs[d].source] = by.get(docs[d].source, 0) + size[d]
            target = brute.mix_targets(by)
            for s in by:
                got = sum(size[d] for d in after if docs[d].source == s)
                assert abs(got - target[s]) <= max(size[d] for d in before if docs[d].source == s) / 2 + 1
        if i < 4:
            assert new.columns == rows.columns and len(after) == len(set(after)) or i == 3
            rows = new
    assert sorted(after) == sorted(r.doc_id for r in rows.collect())
    assert new.columns == [*rows.columns, "shard", "slot"]


def test_pipeline_takes_empty_tables(spark):
    rows = table(spark, SF, "documents").limit(0)
    for _, function in corpus_pipeline.STAGES:
        rows = stage(function(spark, rows, SF), "empty")
        assert rows.count() == 0
