import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contrasta.operators import tfidf
from contrasta.operators.tokens import english_stop_words
from contrasta.plans import analyze as an

DOCS = [
    (1, "covid", "covid vaccine spread fast covid claim"),
    (2, "covid", "vaccine claim false covid"),
    (3, "covid", "Cafe5bar covid vaccine"),
    (4, "climate", "climate change claim hoax climate"),
    (5, "climate", "climate change warming"),
    (6, "climate", ""),
]


def brute_force(docs, min_df=1, max_df=1.0, max_features=None):
    stop = set(english_stop_words())
    grams = {}
    for i, _, t in docs:
        toks = [w for w in re.findall(r"[a-zA-Z]{2,}", t.lower()) if w not in stop]
        grams[i] = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    n = len(docs)
    dfc = Counter(g for gs in grams.values() for g in set(gs))
    tot = Counter(g for gs in grams.values() for g in gs)
    hi = max_df if isinstance(max_df, int) else max_df * n
    vocab = sorted([g for g in dfc if dfc[g] >= min_df and dfc[g] <= hi], key=lambda g: (-tot[g], g))
    if max_features:
        vocab = vocab[:max_features]
    idf = {g: math.log((1 + n) / (1 + dfc[g])) + 1 for g in vocab}
    out = {}
    for i, gs in grams.items():
        c = Counter(g for g in gs if g in idf)
        w = {g: (1 + math.log(k)) * idf[g] for g, k in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for g, v in w.items():
            out[(i, g)] = v / norm
    return out


def test_weights_match_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, domain string, text_lemma string")
    _, _, _, w = tfidf.fit(df, min_df=1, max_df=1.0, max_features=None)
    got = {(r.doc_id, r.term): r.score for r in w.collect()}
    exp = brute_force(DOCS)
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    assert ("3", "cafe") not in got and (3, "cafe") in got and (3, "bar") in got


def test_row_lookup_and_join_agree(spark):
    """Weights within the row (bounded vocabulary) against the join, with long, empty, null and repeated texts."""
    docs = [*DOCS, (7, "covid", None), (8, "covid", "vaccine " * 5000 + "claim"), (9, "climate", "zz yy zz yy zz"), (None, "covid", "covid hoax")]
    df = spark.createDataFrame(docs, "doc_id long, domain string, text_lemma string")
    for cap in (1, 4, 1000):
        tf, _, vocab, w = tfidf.fit(df, min_df=1, max_df=1.0, max_features=cap)
        one, other = ({(r.doc_id, r.term): (r.domain, r.tf, round(r.score, 12)) for r in x.collect()} for x in (w, tfidf.tfidf_weights(tf, vocab)))
        assert one == other and len({t for _, t in one}) == vocab.count() == min(cap, vocab.count())


def test_sums_within_tasks_match_rows(spark):
    """Sums of any number of words at a time against the n-gram rows; texts of fewer words than n, empty, null and repeated."""
    docs = [*DOCS, (7, "covid", None), (7, "covid", "zz"), (8, "covid", "zz zz zz zz"), (9, "climate", "the and"), (None, None, "yy Zz yy zz")]
    df = spark.createDataFrame(docs, "doc_id long, domain string, text_lemma string")
    for n in ((1, 2), (2, 3)):
        want = sorted(map(tuple, tfidf.term_frequencies(df, ngram_range=n).groupBy("term").agg(F.count(F.lit(1)), F.sum("tf")).collect()))
        for most in (1, 5, 10**6):
            assert sorted(map(tuple, tfidf.term_sums(df.coalesce(2), ngram_range=n, most=most).collect())) == want
    assert tfidf.term_sums(df.where("doc_id in (6, 9)")).count() == 0


def test_readers_of_weights_share_the_counts(spark):
    """Reused weights come from stored counts: no reader takes a text apart again, and an empty vocabulary has no weights."""
    stored = []

    def keep(x):
        stored.append(x.columns)
        return x.localCheckpoint(eager=True)

    df = spark.createDataFrame(DOCS, "doc_id long, domain string, text_lemma string")
    *_, once = tfidf.fit(df, min_df=1, max_df=1.0, materialize=keep)
    *_, w = tfidf.fit(df, min_df=1, max_df=1.0, materialize=keep, reused=True)
    assert stored == [["term", "df", "idf"]] * 2 + [["doc_id", "domain", "_ats", "_tfs"]]
    assert "regexp" not in w._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, once.collect()))
    assert tfidf.fit(df, min_df=100)[-1].collect() == []


def test_vocabulary_pruning_and_cap(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, domain string, text_lemma string")
    _, _, vocab, w = tfidf.fit(df, min_df=2, max_df=0.5, max_features=3)
    exp = brute_force(DOCS, min_df=2, max_df=0.5, max_features=3)
    assert {r.term for r in vocab.collect()} == {g for _, g in exp}


def test_top_terms_mean_includes_zero_docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, domain string, text_lemma string")
    top = tfidf.top_terms_per_domain(df, top_n=2, min_df=1, max_df=1.0, max_features=None)
    exp = brute_force(DOCS)
    rows = {(r.domain, r["rank"]): (r.term, r.mean_tfidf) for r in top.collect()}
    clim = sum(v for (i, g), v in exp.items() if g == "climate") / 3  # doc 6 is empty but counted
    assert rows[("climate", 1)][0] == "climate"
    assert rows[("climate", 1)][1] == pytest.approx(clim)


def test_term_context_record(spark):
    feats = spark.createDataFrame([
        (5, "covid", "a jab made my arm sore", "web_one", "blog", 0.4, 0.5, 0.1, -0.6, 0.1, 0.05, 0.35, 0.1, 0.2, 0.15, 0.05, "fear"),
        (9, "covid", "the jab came too late", "web_two", "forum", 0.3, 0.6, 0.1, -0.3, 0.15, 0.05, 0.1, 0.2, 0.3, 0.15, 0.05, "neutral"),
    ], "doc_id long, domain string, text string, dataset string, source string, vader_neg double, vader_neu double, "
       "vader_pos double, vader_compound double, anger double, disgust double, fear double, joy double, neutral double, "
       "sadness double, surprise double, dominant_emotion string")
    weights = spark.createDataFrame([(5, "covid", "jab", 1, 0.35), (9, "covid", "jab", 2, 0.8), (5, "covid", "arm", 1, 0.45)],
                                    "doc_id long, domain string, term string, tf long, score double")
    top = spark.createDataFrame([("covid", 1, "jab", 0.575), ("covid", 2, "absent", 0.2)],
                                "domain string, rank long, term string, mean_tfidf double")
    rec, ex = an.term_context(weights, feats, top, examples_per_term=2)
    r = rec.where("term = 'jab'").first()
    assert rec.count() == 1  # terms without a matching document are skipped
    assert r.document_frequency == 2 and r.avg_vader_compound == pytest.approx(-0.45)
    e = ex.where("term = 'jab'").orderBy("example_rank").collect()
    assert len(e) == 2 and e[0].dataset == "web_two"
    nested = an.term_context_nested(rec, ex).first()
    assert nested.representative_examples[0].dataset == "web_two"
    assert nested.average_vader.vader_compound == pytest.approx(-0.45)


def test_words_of_texts_match_the_pattern():
    """Words found in the bytes against the pattern: other alphabets, digits, single letters, ends of texts, empty texts, slices."""
    import pyarrow as pa
    texts = ["", "ab", "cd the Ef", "a b cc", "cafébar naïve µm 水x水yy", "don't 3rd x1yy _zz", "", "", "zz", "t", "the", "\U0001F600ok\U0001F600no ", "end"]
    found, stop = tfidf._words_fn(["the", "no"]), {"the", "no"}
    for i, j in ((0, len(texts)), (2, 9), (6, 8), (9, 11), (12, 13), (3, 3)):
        doc, numbers, names = found(pa.array(texts, pa.string()).slice(i, j - i))
        names = names.to_pylist()
        want = [(k, w) for k, t in enumerate(texts[i:j]) for w in re.findall("[a-zA-Z]{2,}", t) if w not in stop]
        assert [(k, names[n]) for k, n in zip(doc.tolist(), numbers.tolist())] == want and sorted(names) == sorted({w for _, w in want})


def test_texts_of_examples_are_not_shuffled(spark):
    """Not even where no table is small enough to be broadcast by itself: only the few best rows go to the texts."""
    feats = spark.createDataFrame([(i, "a", f"text {i}", "d", "s", *[0.1] * 11, "joy") for i in range(30)],
                                  "doc_id long, domain string, text string, dataset string, source string, " + "".join(f"{c} double, " for c in (
                                      "vader_neg", "vader_neu", "vader_pos", "vader_compound", *an.EMOTION_COLUMNS)) + "dominant_emotion string")
    weights = spark.createDataFrame([(i, "a", "zz", 1, i / 30) for i in range(30)], "doc_id long, domain string, term string, tf long, score double")
    top = spark.createDataFrame([("a", 1, "zz", 0.5)], "domain string, rank long, term string, mean_tfidf double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, ex = an.term_context(weights, feats, top, 3)
        assert [(r.doc_id, r.text) for r in ex.orderBy("example_rank").collect()] == [(29, "text 29"), (28, "text 28"), (27, "text 27")]
        p = ex._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in p and "hashpartitioning(doc_id" not in p


def test_stored_tables_are_read_by_column(spark):
    """Each reader of a stored table takes the columns it needs; null, empty and repeated rows come back as they were."""
    from contrasta.plans.catalog import materialize
    rows = [(1, "x", 0.5, None), (1, "x", 0.5, None), (None, "", float("nan"), None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    got = materialize(df)
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert materialize(df.where("doc_id > 5")).count() == 0
    assert "ReadSchema: struct<doc_id:bigint>" in got.select("doc_id")._jdf.queryExecution().executedPlan().toString()
