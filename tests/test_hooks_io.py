import json
import os
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from contrasta.operators.hooks import model_answers, model_scores, observed, rhetoric_from_model
from contrasta.operators.emotion import EMOTION_COLUMNS
from contrasta.sources import io
from contrasta.streaming.incremental import compact, incremental_scores, latest, score_stream, stored_scores, upsert_scores
from contrasta.plans.featurize import prepare_domain_frame


def _docs(spark):
    return spark.createDataFrame([(1, "I hate this"), (2, ""), (3, "boom"), (4, "good day")], "doc_id long, text string")


def test_model_scores_defaults_failed_rows(spark):
    # defined inside the test so the closure ships to the Python workers by value
    def _load_emotion():
        def score(texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("model failure")
            return [{"anger": 1.0 if "hate" in t else 0.0, "joy": 1.0 if "good" in t else 0.0} for t in texts]
        return score

    out = {r.doc_id: r for r in model_scores(_docs(spark), _load_emotion, EMOTION_COLUMNS, batch_size=2).collect()}
    assert out[1].anger == 1.0 and not out[1].defaulted
    assert out[2].anger == 0.0 and not out[2].defaulted  # blank: zeros without a model call
    assert out[3].defaulted and all(out[3][e] == 0.0 for e in EMOTION_COLUMNS)
    assert out[4].joy == 1.0


def test_rhetoric_model_answers_parsed(spark):
    def load():
        def ask(texts):
            return ['Sure: {"urgency": 0.8, "authority": 0.0, "doubt": 0.5} ok' if "hate" in t else "no json" for t in texts]
        return ask
    out = {r.doc_id: r for r in rhetoric_from_model(_docs(spark), load).collect()}
    assert (out[1].urgency, out[1].doubt, out[1].urgency_presence) == (0.8, 0.5, 1)
    assert out[4].urgency == 0.0 and out[4].authority_to_doubt_ratio == 0.0


def test_incremental_scores_only_new_or_changed(spark):
    calls = []

    def scorer(df):
        calls.append(df.count())
        return df.select("doc_id", F.length("text").cast("double").alias("score"))

    docs = _docs(spark)
    first = incremental_scores(docs, None, scorer).cache()
    assert first.count() == 4
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("changed")).otherwise(F.col("text")))
    again = incremental_scores(changed, first, scorer)
    rows = {r.doc_id: r.score for r in again.collect()}
    assert calls[-1] == 1 and rows[3] == 7.0 and len(rows) == 4


def test_score_stream_scores_each_document_once(spark):
    root = tempfile.mkdtemp(prefix="contrasta-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    _docs(spark).write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    sink = os.path.join(root, "out")

    def scorer(df):
        return df.select("doc_id", F.length("text").alias("n"))
    q = score_stream(stream, scorer, sink, os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 4


def test_failed_answers_are_flagged_and_counted(spark):
    def load():
        def ask(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failure")
            return [None if "good" in t else f'{{"doubt": 0.{len(t)}}}' for t in texts]
        return ask
    seen = Observation("answers")
    got = {r.doc_id: (r.answer, r.defaulted) for r in observed(model_answers(_docs(spark), load, batch_size=4), seen).collect()}
    assert got == {1: ('{"doubt": 0.11}', False), 2: ('{"doubt": 0.0}', False), 3: ("", True), 4: ("", True)}
    assert seen.get == {"rows": 4, "defaulted": 2}
    assert {r.doc_id: r.doubt for r in rhetoric_from_model(_docs(spark), load).collect()}[3] == 0.0


def test_score_log_is_idempotent(spark):
    """A replayed epoch replaces itself, a changed text its stale score; what is unchanged is not scored again."""
    path = os.path.join(tempfile.mkdtemp(prefix="contrasta-log-", dir="/tmp"), "scores")
    calls = []

    def scorer(df):
        calls.append(sorted(r.doc_id for r in df.collect()))
        return df.select("doc_id", F.length("text").alias("n"))

    docs = _docs(spark).unionByName(spark.createDataFrame([(None, "no id"), (1, "I hate this")], "doc_id long, text string"))
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("another text")).otherwise(F.col("text")))
    for batch, epoch in ((docs, 0), (docs, 0), (changed, 1), (changed, 1), (docs.limit(2), 2)):
        upsert_scores(batch, path, scorer, epoch)
    assert calls == [[1, 2, 3, 4], [1, 2, 3, 4], [3], [3], []]
    log = stored_scores(spark, path)
    assert log.count() == 5 and {r.doc_id: r.n for r in latest(log).collect()} == {1: 11, 2: 0, 3: 12, 4: 8}
    compact(spark, path, path + "-new", 0)
    assert {r.doc_id: r.n for r in stored_scores(spark, path + "-new").collect()} == {1: 11, 2: 0, 3: 12, 4: 8}


def test_unreadable_log_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="contrasta-log-", dir="/tmp")
    assert stored_scores(spark, os.path.join(root, "absent")) is None
    os.makedirs(os.path.join(root, "broken", "epoch=0"))
    with open(os.path.join(root, "broken", "epoch=0", "part-0.parquet"), "w") as fh:
        fh.write("this is not Parquet")
    with pytest.raises(Exception):
        upsert_scores(_docs(spark), os.path.join(root, "broken"), lambda d: d.select("doc_id", F.length("text").alias("n")), 1)


def test_json_reports_and_landing(spark):
    root = tempfile.mkdtemp(prefix="contrasta-io-", dir="/tmp")
    df = spark.createDataFrame([("climate", [1.5, None], {"a": 1}), ("ä \"q\"", [], {})], "domain string, xs array<double>, m map<string,int>")
    io.write_json(df, os.path.join(root, "report"))
    back = io.read_json_report(spark, os.path.join(root, "report")).orderBy("domain").collect()
    assert [r.domain for r in back] == ["climate", "ä \"q\""] and back[0].xs == [1.5, None] and back[0].m.a == 1
    io.land(spark, os.path.join(root, "report"), "json", os.path.join(root, "landed"))
    assert spark.read.parquet(os.path.join(root, "landed")).count() == 2


def test_domain_store_opens_the_wanted_files_only(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="contrasta-store-", dir="/tmp"), "store")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.col("id") % 3).alias("domain"))
    io.write_processed(docs, path)
    for name in os.listdir(os.path.join(path, "domain=d0")):  # whoever opens one of these fails
        with open(os.path.join(path, "domain=d0", name), "w") as fh:
            fh.write("broken")
    some = io.read_processed(spark, path, ["d1"], schema=docs.schema)
    assert some.count() == 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(domain" in plan or "domain#" in plan.split("PartitionFilters:")[1].split("]")[0]
    wanted = spark.createDataFrame([("d2", 1), ("d2", 2), ("d0", 0)], "domain string, x int").where("x > 0")
    joined = io.read_processed(spark, path, wanted, schema=docs.schema)
    assert joined.columns == ["doc_id", "domain"] and joined.where("doc_id is not null").count() == 20
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


def test_raw_csv_and_partitioned_write(spark):
    root = tempfile.mkdtemp(prefix="contrasta-io-", dir="/tmp")
    path = os.path.join(root, "raw.csv")
    with open(path, "w") as fh:
        fh.write('text,label\n"line one\nline two",na\n"x, y",n/a\nplain,1\n')
    df = io.read_raw_csv(spark, path)
    rows = df.collect()
    assert [r.text for r in rows] == ["line one\nline two", "x, y", "plain"]
    assert [r.label for r in rows] == [None, None, "1"]
    out = os.path.join(root, "processed")
    io.write_processed(df.withColumn("domain", F.lit("covid")), out)
    assert os.path.isdir(os.path.join(out, "domain=covid"))
    back = spark.read.parquet(out).where("domain = 'covid'")
    assert back.count() == 3


def test_prepare_domain_frame_requires_emotions(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    with pytest.raises(ValueError, match="anger"):
        prepare_domain_frame(df)
    full = spark.createDataFrame([(1, None, *([0.1] * 7), 0.5)],
                                 "doc_id long, text string, " + ", ".join(f"{e} double" for e in EMOTION_COLUMNS) + ", vader_compound double")
    out = prepare_domain_frame(full)
    r = out.first()
    assert r.text == "" and r.char_count == 0 and r.dominant_emotion == "anger"
    assert [c for c in out.columns if c.startswith("vader_")] == ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]
