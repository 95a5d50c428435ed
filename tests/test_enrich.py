"""Classification: errors as data, retries, trained models, validation, resumable streaming."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import enrich, textmodel
from inkwell.operators.request_queue import LocalModelClient, model_weights, run_queue
from inkwell.session import scratch_path, stored_once
from inkwell.plans.enrichment import model_job, trained
from inkwell.streaming.incremental import current_results, incremental_enrich, retry_failed, writer_of

from tests.conftest import SF_SMALL


cloudpickle.register_pickle_by_value(sys.modules[__name__])    # workers can't import this module

GOOD = {a: enrich.ENUMS[a][0] for a in enrich.ATTRIBUTES}


def _rows(spark):
    return spark.createDataFrame([(1, "some text", "en", 100), (2, "   ", "fr", 3), (89, "late", "de", 5),
                                  (97, "never", "es", 7), (3, None, "en", 0)],
                                 "doc_id long, text string, lang string, n_chars long")


class _Injected(enrich.Classifier):
    """Fails always on some texts, until the third attempt on others."""

    name = "I"
    cost_per_call = 0.002

    def classify(self, row, attempt):
        if row["text"] == "never" or (row["text"] == "late" and attempt < 3):
            raise RuntimeError("rate limited")
        return GOOD


def test_classify_errors_retries_unknown_model(spark):
    out = enrich.classify_rows(_rows(spark), ["I", "Z"], {"I": _Injected()}, backoff_base=0)
    got = {(r.doc_id, r.model): r for r in out.collect()}
    assert got[(1, "I")].result is not None and got[(1, "I")].attempts == 1
    for d in (2, 3):
        assert got[(d, "I")].error == enrich.ERR_EMPTY_INPUT and got[(d, "I")].attempts == 0
    assert got[(89, "I")].result is not None and got[(89, "I")].attempts == 3
    assert got[(97, "I")].result is None and "after 3 attempts" in got[(97, "I")].error
    assert got[(1, "Z")].error.startswith("ERROR: model must be one of") and got[(1, "Z")].attempts == 0
    assert abs(got[(89, "I")].cost - 3 * 0.002) < 1e-12


WORDS = {"en": "the and of this with", "de": "der und ist ein mit", "fr": "le et de est avec", "es": "el y los con por"}


def _labelled(n=400, seed=3):
    """Texts in four languages; toxic ones hold an insult, low ones symbols on every word."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang].split(" ")) if r.random() < 0.4 else f"w{r.choice('abcdefghij')}{r.choice('klmnop')}"
                 for _ in range(r.randrange(20, 60))]
        toxic, low = r.random() < 0.2, r.random() < 0.2
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Idiot", "clown!"]))
        if low:
            words = [w + "###" for w in words]
        out.append((i, " ".join(words), lang, None if i % 3 == 0 else int(not low), None if i % 3 == 0 else int(toxic)))
    return out


@pytest.fixture(scope="module")
def small_model(spark):
    rows = spark.createDataFrame(_labelled(), "doc_id long, text string, lang string, quality int, toxic int")
    gold = textmodel.gold(F.col("lang"), F.col("quality"), F.col("toxic"))
    model = textmodel.train(rows.where(~textmodel.held_out(F.col("doc_id"))).select("text", *[g.alias(t) for t, g in gold.items()]), 512)
    path = scratch_path(spark, "model")
    model.write.parquet(path)
    return spark.read.parquet(path)


def test_trained_classes_on_held_out_texts(spark, small_model):
    rows = spark.createDataFrame(_labelled(), "doc_id long, text string, lang string, quality int, toxic int")
    cls = enrich.classify_by_model(rows, ["A", "B"], small_model, passthrough=["lang", "quality", "toxic"])
    gold = textmodel.gold(F.col("lang"), F.col("quality"), F.col("toxic"))
    card = {r.model: r for r in enrich.model_scorecard(cls.withColumns(
        {**gold, "held_out": textmodel.held_out(F.col("doc_id"))})).collect()}
    held = [r.doc_id for r in rows.where(textmodel.held_out(F.col("doc_id"))).collect()]
    assert card["A"].n_rows == len(held) and 60 < len(held) < 120 and card["A"].is_winner
    assert card["A"].primary_language_accuracy > 0.95 and card["A"].quality_accuracy > 0.95
    assert card["A"].toxicity_accuracy > 0.95 and card["A"].n_gold > card["A"].n_rows
    top = {r.token for r in small_model.where("target = 'toxicity' and place between 1 and 2").collect()}
    assert top == {"idiot", "clown"}


def test_model_edges(spark, small_model):
    texts = ["The idiot and the clown of this", "", None, "   ", "der und", "zzz", "der und", "x " * 20000]
    rows = spark.createDataFrame([(7 if t == "der und" else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = rows.withColumn("token", F.lit("clash")).withColumn("weight", F.lit(0))
    got = enrich.classify_by_model(rows, ["A"], small_model).collect()
    assert len(got) == len(texts)                      # repeated rows stay apart
    by = {r.doc_id: r for r in got}
    assert by[0].result.toxicity == "toxic" and by[0].result.primary_language == "en"
    assert [by[i].error for i in (1, 2, 3)] == [enrich.ERR_EMPTY_INPUT] * 3 and by[1].attempts == 0
    assert sum(r.doc_id == 7 and r.result.primary_language == "de" for r in got) == 2
    for r in got:
        if r.result:
            assert len({r.result.primary_language, r.result.secondary_language, r.result.tertiary_language}) == 3
    assert enrich.classify_by_model(rows.limit(0), ["A"], small_model).count() == 0
    unknown = enrich.classify_by_model(rows, ["A", "Z"], small_model).where("model = 'Z'").collect()
    assert len(unknown) == len(texts) and all(r.error.startswith("ERROR: model must be one of") for r in unknown)


def test_classification_shuffles_no_text(spark, small_model):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = enrich.classify_by_model(rows, ["A", "B"], small_model)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan
    assert exchanges and not any("text" in x for x in exchanges) and plan.count("documents.parquet") == 1


def test_gold_comes_from_the_rows_own_columns(spark):
    rows = spark.createDataFrame([(1, 0, "en"), (0, 1, "xx"), (None, None, None)], "quality int, toxic int, lang string")
    gold = textmodel.gold(F.col("lang"), F.col("quality"), F.col("toxic"))
    got = {r[0]: tuple(r)[1:] for r in rows.select("quality", *[g.alias(t) for t, g in gold.items()]).collect()}
    assert got == {1: ("en", "high", "clean"), 0: (None, "low", "toxic"), None: (None, None, None)}


def test_validate_flags_values_outside_enum(spark):
    def check(values, labels):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("model", T.StringType()),
                               T.StructField("result", labels.result_type)])
        row = spark.createDataFrame([(1, "A", tuple(values))], schema)
        return enrich.validate_enums(row, labels=labels).first()

    good = ["en", "de", "fr", "high", "clean"]
    assert check(good, enrich.DOCUMENT).valid
    bad = check(["en", "en", "en", "medium", None], enrich.DOCUMENT)
    assert bad.n_invalid_values == 2 and bad.secondary_repeats_primary and bad.tertiary_repeats and not bad.valid
    published = [enrich.ENUMS[a][min(i, len(enrich.ENUMS[a]) - 1)] for i, a in enumerate(enrich.ATTRIBUTES)]
    assert check(published, enrich.PUBLISHED).valid
    assert check(["no genre", *published[1:]], enrich.PUBLISHED).n_invalid_values == 1


def test_stored_table_is_written_once_and_again_when_its_source_changes(spark, tmp_path):
    src, built = f"file://{tmp_path}/src", []

    def build():
        built.append(1)
        return spark.read.parquet(src)

    spark.range(3).write.parquet(src)
    first = [stored_once(spark, "t", [src], build).count() for _ in range(2)]
    spark.range(3, 8).write.mode("append").parquet(src)
    assert first == [3, 3] and len(built) == 1
    assert stored_once(spark, "t", [src], build).count() == 8 and len(built) == 2


def _job(classifiers):
    def job(df):
        # One model a row: ``wanted``.
        out = enrich.classify_rows(df, sorted(classifiers), classifiers, backoff_base=0, passthrough=["wanted"])
        return out.where("model = wanted").select("doc_id", "model", "attempts",
                                                  F.col("result").isNotNull().alias("ok"), "error")
    return job


def test_incremental_enrich_second_run_adds_nothing(spark):
    job = model_job(trained(spark, SF_SMALL))
    src, tgt, ckpt = (scratch_path(spark, n) for n in ("src", "tgt", "ckpt"))
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "n_chars") \
        .repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    first = incremental_enrich(spark, src, schema, tgt, ckpt, ["A"], job)
    assert first == spark.read.parquet(src).count()
    assert incremental_enrich(spark, src, schema, tgt, ckpt, ["A"], job) == 0
    # a fresh checkpoint re-reads every file, and the lookup still adds nothing
    assert incremental_enrich(spark, src, schema, tgt, scratch_path(spark, "ckpt2"), ["A"], job) == 0
    # a second model runs over all rows
    assert incremental_enrich(spark, src, schema, tgt, scratch_path(spark, "ckpt3"), ["A", "B"], job) == first
    assert current_results(spark, tgt).count() == 2 * first


def test_incremental_enrich_null_keys_repeats_and_retry(spark):
    src, tgt = scratch_path(spark, "src"), scratch_path(spark, "tgt")
    rows = spark.createDataFrame([(1, "a", "en", 1), (1, "a", "en", 1), (None, "b", "en", 1), (97, "never", "en", 1)],
                                 "doc_id long, text string, lang string, n_chars long")
    rows.coalesce(1).write.parquet(src)
    for _ in range(2):      # twice, with fresh checkpoints
        added = incremental_enrich(spark, src, rows.schema, tgt, scratch_path(spark, "c"), ["I"], _job({"I": _Injected()}))
    assert added == 1       # only the failed row again
    state = {r.doc_id: r.ok for r in current_results(spark, tgt).collect()}
    assert state == {1: True, None: True, 97: False}
    healed = _job({"I": _Flaky([GOOD])})
    assert retry_failed(spark, src, tgt, ["I"], healed) == 1 and retry_failed(spark, src, tgt, ["I"], healed) == 0
    assert all(r.ok for r in current_results(spark, tgt).collect())


def _files(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.mode("append").parquet(path)


def test_stream_admits_a_pair_once_without_reading_its_target(spark):
    src, tgt, ckpt = (scratch_path(spark, n) for n in ("src", "tgt", "ckpt"))
    job = _job({"I": _Injected()})
    schema = "doc_id long, text string, lang string, n_chars long"
    schema = spark.createDataFrame([], schema).schema
    run = lambda: incremental_enrich(spark, src, schema, tgt, ckpt, ["I"], job, max_files_per_trigger=1)
    _files(spark, src, [(1, "a", "en", 1), (2, "b", "en", 1)], [(2, "b", "en", 1), (None, "c", "en", 1)])
    assert run() == 3                       # the key of both files once
    # The target unreadable for its own stream's next run: the state alone knows what was admitted.
    hidden = f"{tgt}/writer={writer_of(ckpt)}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(tgt).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = jvm.org.apache.hadoop.fs.Path
    assert fs.rename(path(hidden), path(f"{tgt}-away"))
    _files(spark, src, [(1, "a", "en", 1), (3, "d", "en", 1), (None, "c", "en", 1)])
    assert run() == 1
    assert [r.doc_id for r in spark.read.parquet(tgt).collect()] == [3]


def test_a_replayed_batch_overwrites_its_folder(spark):
    src, tgt, ckpt = (scratch_path(spark, n) for n in ("src", "tgt", "ckpt"))
    _files(spark, src, [(1, "a", "en", 1), (2, "b", "en", 1)])
    schema = spark.read.parquet(src).schema
    job, calls = _job({"I": _Injected()}), []

    def dies_after_writing(df):
        calls.append(1)
        return job(df)

    def run(enrich_job):
        return incremental_enrich(spark, src, schema, tgt, ckpt, ["I"], enrich_job)

    import inkwell.streaming.incremental as incremental
    write = incremental._write

    def crash(*args):
        write(*args)
        raise RuntimeError("lost after the write")

    incremental._write = crash
    try:
        with pytest.raises(Exception, match="lost after the write"):
            run(dies_after_writing)
    finally:
        incremental._write = write
    assert spark.read.parquet(tgt).count() == 2 and run(dies_after_writing) == 2 and len(calls) == 2
    assert sorted(r.doc_id for r in spark.read.parquet(tgt).collect()) == [1, 2]


def test_an_unfinished_first_write_is_no_target(spark, tmp_path):
    src, tgt = scratch_path(spark, "src"), f"file://{tmp_path}/target"
    _files(spark, src, [(1, "a", "en", 1)])
    (tmp_path / "target" / "writer=x" / "batch=0" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "target" / "writer=x" / "batch=0" / "_temporary" / "0" / "part-0.parquet").write_bytes(b"half")
    assert incremental_enrich(spark, src, spark.read.parquet(src).schema, tgt, scratch_path(spark, "c"), ["I"],
                              _job({"I": _Injected()})) == 1


def test_unreadable_target_is_an_error(spark, tmp_path):
    job = _job({"A": _Injected()})
    src = scratch_path(spark, "src")
    rows = _rows(spark)
    rows.write.parquet(src)
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        incremental_enrich(spark, src, rows.schema, f"file://{tmp_path}/target", scratch_path(spark, "c"), ["A"], job)


class _Service(_Injected):
    """Counts its calls; refuses a whole batch that holds 'poison'."""

    def __init__(self, log):
        self.log = log

    def classify_batch(self, rows, attempt):
        with open(self.log, "a") as f:
            f.writelines(f"{attempt} {r['doc_id']}\n" for r in rows)
        if any(r["text"] == "poison" for r in rows):
            raise RuntimeError("batch refused")
        return super().classify_batch(rows, attempt)


def _queue(spark, rows, log, folder, **more):
    return run_queue(rows, ["I", "Z"], {"I": _Service(str(log))}, folder, backoff_base=0, labels=enrich.PUBLISHED, **more)


def test_queue_rounds_errors_and_costs(spark, tmp_path):
    rows = _rows(spark).union(spark.createDataFrame([(None, "null key", "en", 1), (5, "poison", "en", 1), (1, "some text", "en", 100)],
                                                    "doc_id long, text string, lang string, n_chars long"))
    slept = []
    out = run_queue(rows, ["I", "Z"], {"I": _Service(str(tmp_path / "log"))}, scratch_path(spark, "q"), labels=enrich.PUBLISHED,
                    sleep=slept.append, request_rows=1)
    got = {(r.doc_id, r.model): r for r in out.collect()}
    assert len(got) == out.count() == 2 * 7
    assert {k[0]: r.attempts for k, r in got.items() if k[1] == "I"} == {1: 1, 2: 0, 3: 0, 89: 3, 97: 3, None: 1, 5: 3}
    assert got[(97, "I")].error == enrich.ERR_FAILED.format(model="I", attempts=3, last="rate limited")
    assert got[(5, "I")].error.endswith("Last error: batch refused") and got[(3, "I")].error == enrich.ERR_EMPTY_INPUT
    assert got[(1, "Z")].error.startswith("ERROR: model must be one of: I") and got[(1, "Z")].attempts == 0
    assert abs(got[(89, "I")].cost - 0.006) < 1e-12 and got[(89, "I")].result is not None
    assert slept == [2.0, 4.0]
    sent = (tmp_path / "log").read_text().split("\n")
    assert sum(x.startswith("1 ") for x in sent) == 5 and sum(x.startswith("3 ") for x in sent) == 3


def test_queue_goes_on_after_its_last_committed_round(spark, tmp_path):
    rows, folder, log = _rows(spark), scratch_path(spark, "q"), tmp_path / "log"

    def stop(seconds):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        _queue(spark, rows, log, folder, sleep=stop)
    first = log.read_text()
    assert sorted(first.split("\n")) == ["", "1 1", "1 89", "1 97"]
    done = {(r.doc_id, r.attempts) for r in _queue(spark, rows, log, folder).where("model = 'I'").collect()}
    assert done == {(1, 1), (89, 3), (97, 3), (2, 0), (3, 0)}
    assert log.read_text().count("1 1\n") == 1              # round 1 was not sent again
    assert _queue(spark, rows, log, folder).count() == 10 and log.read_text().count("3 97\n") == 1


def test_queue_of_no_rows_and_no_clients(spark, tmp_path):
    assert _queue(spark, _rows(spark).limit(0), tmp_path / "log", scratch_path(spark, "q")).count() == 0
    out = run_queue(_rows(spark), ["Z"], {}, scratch_path(spark, "q"), backoff_base=0)
    assert {r.attempts for r in out.collect()} == {0} and out.count() == 5


def test_client_in_python_agrees_with_the_columns(spark, small_model):
    texts = [t for _, t, *_ in _labelled(60, 9)] + ["a\nb", " x", "ünï é", "###", "0", "x" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    client = LocalModelClient("A", model_weights(small_model, 512), 0.1)
    want = {r.doc_id: r.result.asDict() for r in enrich.classify_by_model(rows, ["A"], small_model).collect()}
    assert {i: client.classify({"text": t}, 1) for i, t in enumerate(texts)} == want


class _Flaky(enrich.Classifier):
    name = "F"
    cost_per_call = 1.0

    def __init__(self, outcomes):
        self.outcomes = list(outcomes)

    def classify(self, row, attempt):
        out = self.outcomes[min(attempt, len(self.outcomes)) - 1]
        if isinstance(out, Exception):
            raise out
        return out


def test_backoff_is_two_to_the_n_between_attempts():
    slept = []
    res, err, att, cost = enrich._attempt_rows(
        _Flaky([RuntimeError("a"), RuntimeError("b"), RuntimeError("c")]), "F", ["F"], [{"text": "x"}], "text",
        3, lambda n: 2.0 ** n, slept.append)[0]
    assert res is None and att == 3 and cost == 3.0 and slept == [2.0, 4.0]
    assert err.endswith("after 3 attempts. Last error: c")


def test_empty_result_counts_as_an_attempt():
    slept = []
    res, err, att, _ = enrich._attempt_rows(_Flaky([{}, {}, {}]), "F", ["F"], [{"text": "x"}], "text",
                                            3, lambda n: 0.0, slept.append)[0]
    assert res is None and att == 3 and err.endswith("Last error: " + enrich.ERR_EMPTY_RESULT)


def test_success_after_retry_reports_attempts_and_cost():
    good = {a: enrich.ENUMS[a][0] for a in enrich.ATTRIBUTES}
    res, err, att, cost = enrich._attempt_rows(_Flaky([RuntimeError("x"), good]), "F", ["F"], [{"text": "x"}], "text",
                                               3, lambda n: 0.0, lambda s: None)[0]
    assert res == good and err is None and att == 2 and cost == 2.0


def test_training_cuts_texts_once_and_ranks_before_the_shuffle(spark, capsys):
    rows = spark.createDataFrame([("Ä B c# É\n d", "en", "high", "clean"), ("x Y é", "de", None, "toxic")] * 40,
                                 "text string, language string, quality string, toxicity string")
    model = textmodel.train(rows, 4)
    model.explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate explode") == 1 and "WindowGroupLimit" in plan
    got = {r.token for r in rows.select(F.explode(textmodel.features(F.col("text"), textmodel.words(F.col("text")), "")).alias(
        "token")).collect()}
    assert got == {"Ä", "É", "b", "c", "d", "x", "y", "é", "", *(f for t in ("Ä B c# É\n d", "x Y é") for f in textmodel.features_of(t))}
    assert {r.label for r in model.where("place = 0").collect()} == {c for cs in textmodel.CLASSES.values() for c in cs}
    assert textmodel.train(rows.limit(0), 4).count() == 0
