import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasta.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "no id"), (90001, None), (90002, ""), (90003, " \n\t "), (90004, "12 34 !!"), (90005, "word " * 30000), (90006, "é😀"), (90005, "word " * 30000)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(k, t, "en", "odd", 0, 5) for k, t in ODD],
                                "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    return docs.withColumn("toxic", F.lit(3)).unionByName(odd).cache(), labels


def accuracy(rows, truth, got, want):
    both = [(r[got], truth[r.doc_id]) for r in rows if r.doc_id in truth and r.doc_id < 90000]
    assert len(both) > 50
    return sum(bool(a) == bool(b) if want is bool else a == b for a, b in both) / len(both)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, _ = tables
    full, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = full.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").unionByName(docs.where("doc_id >= 90000").select("doc_id", "text"))
    rest = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.fit(docs, labels.where(~rest), sample_rows=4000)
    assert model.categories == ("insult", "contempt", "toxic") and len(model.weights) == 3
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.where(rest).collect()}
    assert accuracy(rows, truth, "is_toxic", bool) > 0.93
    for r in rows:
        assert 0 <= r.p_insult <= 1 and 0 <= r.p_toxic <= 1
        if r.doc_id in (90001, 90002, 90003, 90004):
            assert r.p_toxic == 0 and not r.is_toxic
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.weights == [] and toxicity.score(docs.limit(5), none).where("is_toxic").count() == 0


def test_chain_feeds_out_of_fold_probabilities(monkeypatch):
    """The second model's extra column must come from models that have not seen the row."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(5000, 6, replace=False)).astype(np.int32) for _ in range(90)]  # words that say nothing
    y = rng.integers(0, 2, (90, 2)).astype(bool)
    seen = []
    fit = toxicity.fit_linear

    def spy(idx, ends, extra, labels, weight, **kw):
        seen.append((len(labels), extra.copy(), labels.copy()))
        return fit(idx, ends, extra, labels, weight, **kw)
    monkeypatch.setattr(toxicity, "fit_linear", spy)
    toxicity.fit_chain(rows, y, np.ones(90), ("a", "b"), folds=3, rounds=200, l2=0.0)
    assert [n for n, _, _ in seen] == [90, 60, 60, 60, 90] and seen[-1][1].shape == (90, 1)
    fed = seen[-1][1][:, 0]
    # in sample the words would name every row's label; out of fold they cannot
    assert abs(np.corrcoef(fed, y[:, 0])[0, 1]) < 0.5


def test_quality_matches_labels(spark, tables):
    docs, labels = tables
    model = quality.fit(docs)
    rows = quality.classify(docs, model=model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert accuracy(rows, truth, "keep", bool) > 0.94
    good = [r.keep for r in rows if truth.get(r.doc_id) == 1]
    assert sum(good) / len(good) > 0.96
    assert all(not r.keep and r.score == 0 for r in rows if r.doc_id in (90001, 90002, 90003))
    assert 0.6 < model.good_share < 0.99
    assert quality.classify(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(60000) < 0.8
    rates = [(0.95, 0.9), (0.85, 0.7), (0.9, 0.6), (0.7, 0.8), (0.6, 0.6), (0.9, 0.9), (0.8, 0.8), (0.75, 0.9), (0.9, 0.7), (0.8, 0.6)]  # right on good, on bad
    v = np.stack([np.where(rng.random(60000) < 0.2, quality.NONE, np.where(truth, rng.random(60000) < g, rng.random(60000) >= b)) for g, b in rates], 1)
    patterns, counts = np.unique(v.astype(int), axis=0, return_counts=True)
    share, p, post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    for k, (g, b) in enumerate(rates):
        assert abs(p[1, k, quality.GOOD] - g) < 0.03 and abs(p[0, k, quality.BAD] - b) < 0.05
    label = dict(zip(map(tuple, patterns.tolist()), post, strict=True))
    assert np.mean([(label[tuple(x)] > 0.5) == t for x, t in zip(v[:5000].astype(int).tolist(), truth[:5000], strict=True)]) > 0.95


def test_languages_held_out(spark, tables):
    docs, _ = tables
    rows = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 90000").collect()}
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert accuracy(held, truth, "lang_pred", str) > 0.97
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (90001, 90002, 90003, 90004))
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(20)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_held_out_labels_are_never_learnt(spark, tables):
    """Held-out labels may say anything: predictions stay."""
    docs, _ = tables
    lied = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in langid.identify(d.where("doc_id < 400")).collect()} for d in (docs, lied))
    assert a == b


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows, labels = [], np.arange(600) % 3
    for y in labels:
        idx = np.unique(np.concatenate([rng.choice(2000, 20) + 100, [y * 7, y * 7 + 1]]))
        rows.append((idx, np.full(len(idx), 1 / np.sqrt(len(idx)))))
    w = langid.fit_ftrl(rows[:400], labels[:400], 3, l1=0.5)
    dense = langid.fit_ftrl(rows[:400], labels[:400], 3, l1=0.0)
    assert (w != 0).sum() < 0.5 * (dense != 0).sum()
    logits = np.array([v @ w[i] + w[-1] for i, v in rows[400:]])
    assert (logits.argmax(1) == labels[400:]).mean() > 0.95
    noisy = rng.normal(size=(3000, 3))
    truth = np.array([rng.choice(3, p=langid.softmax(x)) for x in noisy])
    assert abs(langid.fit_temperature(noisy * 5, truth) - 5) < 0.8
    assert langid.fit_temperature(noisy[:0], truth[:0]) == 1.0


def test_ngrams_ignore_case_and_marks():
    a, b = langid.ngram_counts("Ab, cD!"), langid.ngram_counts("ab  cd?")
    assert all((x == y).all() for x, y in itertools.zip_longest(a, b))
