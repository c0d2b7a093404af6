import importlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from contrasta.llm import mixing, packing, quality, secrets
from contrasta.llm._util import materialize

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, as the pipeline makes them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(materialize(f(spark, out[-1], SF), "test-stage"))
    return [x.toPandas() for x in out]


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]
    for x in stages[:-1]:
        assert list(x.columns) == list(stages[0].columns) and len(x)


def test_quality_keeps_what_the_model_keeps(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs)
    kept = set()
    for r in docs.collect():
        shape = quality.shapes(r.text or "")
        s = quality.signals(r.text or "", shape)
        idx, val = quality.features(s, shape)
        if s.words and 1 / (1 + np.exp(-(model.weights[idx] @ val + model.weights[-1]))) >= 0.3:
            kept.add(r.doc_id)
    assert set(stages[1].doc_id) == kept and 0 < len(kept) < len(stages[0])


def test_one_of_each_group_stays(stages):
    before = list(zip(stages[1].doc_id, stages[1].text, strict=True))
    want = {k for k, _, c in brute(before, n=5, percent=80) if k == c}
    assert sorted(stages[2].doc_id) == sorted(want)


def test_near_copies_of_five_words(spark, stages):
    """Similarity 0.8 or more over sets of five words; the first two copies are below 0.9 over sets of three."""
    base = [f"w{i}" for i in range(400)]
    copies = [base, [*base, *(f"x{i}" for i in range(70))], base[:340], [f"y{i}" if i % 60 == 9 else w for i, w in enumerate(base)],
              base[:300], [*base, *(f"z{i}" for i in range(110))], [f"v{i}" if i % 20 == 9 else w for i, w in enumerate(base)]]
    rows = [(i + 5, " ".join(x), "en", "s", 1) for i, x in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for before, kept in ((rows, [r.doc_id for r in cp.keep_first_of_group(spark, docs, SF).collect()]),
                         (list(zip(stages[1].doc_id, stages[1].text, strict=True)), list(stages[2].doc_id))):
        pairs = [x[:2] for x in before]
        want = {k for k, _, c in brute(pairs, n=5, percent=80) if k == c}
        assert sorted(kept) == sorted(want)
    assert {k for k, _, c in brute([x[:2] for x in rows]) if k == c} != {k for k, _, c in brute([x[:2] for x in rows], n=5, percent=80) if k == c}


def test_secrets_are_gone(stages):
    before = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    assert set(before) == set(stages[3].doc_id)
    for r in stages[3].itertuples():
        text, at, out = before[r.doc_id], 0, ""
        for a, _, b, _ in secrets.python_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        out += text[at:]
        assert r.text == out and r.n_chars == len(out)


def test_mixture_is_whole_documents(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    times = Counter(stages[4].doc_id)
    assert set(times) <= set(before) and max(times.values()) <= 3
    assert all(before[r.doc_id] == r.text for r in stages[4].itertuples())
    words = {k: len(t.split()) for k, t in before.items()}
    assert abs(sum(words[k] * n for k, n in times.items()) - sum(words.values())) < 0.05 * sum(words.values())


def test_every_token_is_packed(stages):
    times, enc = Counter(stages[4].doc_id), packing.encoder(None)
    texts = dict(zip(stages[4].doc_id, stages[4].text, strict=True))
    pieces = stages[5]
    assert set(pieces.doc_id) == set(times)
    for k, x in pieces.groupby("doc_id"):
        ids = np.append(np.frombuffer(enc(texts[k]), "<u2"), 0).astype("<u4")
        assert x.length.sum() == times[k] * len(ids) and (x.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in x.itertuples())


def test_null_and_repeated_ids(spark):
    """Copies without id go, texts that share an id stay, and the mixture takes rows without id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(None, a), (None, a), (7, b), (7, c), (7, b), (3, c + " end"), (None, b), (None, d), (9, ""), (9, ""), (None, " "), (8, None)]
    docs = spark.createDataFrame([(k, t, "en", "s" if k else "none", 1) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.keep_first_of_group(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(None, a), (7, b), (3, c + " end"), (None, d), (9, ""), (None, " "), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    got = Counter(r.doc_id for r in cp.mix_sources(spark, docs, SF).collect())
    assert got == {r.doc_id: r.n for r in copies.collect() if r.n} and got[None]
    many = spark.createDataFrame([(None if i % 2 else i // 4, "w " * (i % 5 + 1) + f"v{i}", "en", f"s{i % 3}", 1) for i in range(300)], docs.schema)
    plan = {r.source: (r.target, r.n) for r in mixing.mix(many).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("n")).collect()}
    words = Counter()
    for r in cp.mix_sources(spark, many, SF).collect():
        words[r.source] += len(r.text.split())
    assert all(words[k] == n and abs(n - target) <= 6 for k, (target, n) in plan.items())


def test_run_and_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("doc_id < 40").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/a").count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
    odd = docs.where("doc_id < 30").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))) \
        .withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    odd.union(odd).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/c").count() > 0


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
