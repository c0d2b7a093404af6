"""Plan-shape checks for the scale properties the operators rely on."""

import random

from pyspark.sql import functions as F

from contrasta.functions.text import RETWEET_RE
from contrasta.operators import stats as st
from contrasta.operators import tfidf
from contrasta.operators.emotion import emotion_scores
from contrasta.operators.language import detect_language
from contrasta.operators.rhetoric import rhetoric_scores
from contrasta.operators.sentiment import sentiment_scores
from contrasta.operators.summaries import box_summary
from contrasta.plans.featurize import feature_table, with_lemmas
from contrasta.plans.preprocess import prepare_corpus
from contrasta.sources.driver import DRIVER_DOMAIN_RULES


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    means = spark.createDataFrame([("a", f"t{i}", float(i)) for i in range(50)], "domain string, term string, mean_tfidf double")
    p = _plan(tfidf.top_n_per_domain(means, 5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_order_statistics_move_rows_once(spark):
    """One exchange on (key, bucket) that all branches share; no range split and no checkpoint."""
    df = spark.range(200).select(F.lit("f").alias("feature"), F.when(F.col("id") % 2 == 0, "covid").otherwise("climate").alias("domain"),
                                 (F.col("id") % 37).cast("double").alias("value"))
    for made in (st.mann_whitney(df, "covid", "climate"), st.exact_quantiles(df, ["feature"], [0.5]), box_summary(df, ["feature"])):
        p = _plan(made).split("== Initial Plan ==")[0]
        assert p.count("REPARTITION_BY_COL") - p.count("ReusedExchange") <= 1 and "rangepartitioning" not in p
        assert "ExistingRDD" not in p and "SortMergeJoin" not in p


def test_cumulative_over_buckets(spark):
    """Hot values, ties, bounds that are few, null keys: against plain Python."""
    rng = random.Random(5)
    rows = [(k, rng.choice([-0.0, 0.0, 1.5, rng.random(), float("inf"), 7.0, rng.randrange(50) * 1.0]), rng.random() < 0.3) for k in ("a", "b", None) for _ in range(400)]
    rows += [("one", 3.0, True), ("hot", 2.0, False), *[("hot", 5.0, True)] * 500, *[("c", float(v), v % 3 == 0) for v in range(1000)]]
    df = spark.createDataFrame(rows, "k string, value double, x boolean")
    for buckets in (2, 40, 256):
        got = {(r.k, r.value): (r.t, r.n, r.cum_t, r.cum_n, r.total_t, r.total_n)
               for r in st.cumulative(df, ["k"], {"t": F.count(F.lit(1)), "n": F.count_if("x")}, buckets=buckets).collect()}
        assert len(got) == len({(k, v) for k, v, _ in rows})
        for (k, v), r in got.items():
            own = [(x, y) for kk, x, y in rows if kk == k]
            sums = [(len(z), sum(y for _, y in z)) for z in ([z for z in own if z[0] == v], [z for z in own if z[0] <= v], own)]
            assert r == (*sums[0], *sums[1], *sums[2])


def test_features_are_row_local(spark):
    """Between corpus and feature table: one tokenisation, no join, shuffle, generator or Python worker."""
    df = spark.createDataFrame([(1, "not good at all"), (2, "the of")], "doc_id long, text string")
    for made in (feature_table(df), sentiment_scores(df), emotion_scores(df), rhetoric_scores(df), with_lemmas(df)):
        p = _plan(made)
        assert not any(x in p for x in ("Exchange", "Join", "Generate", "EvalPython", "InArrow"))
        assert p.count("Project [") <= 4
    whole = feature_table(df)._jdf.queryExecution()
    for p in (whole.optimizedPlan().toString(), whole.sparkPlan().toString()):
        assert p.count("regexp_extract_all(lower(") == 1


def test_tfidf_shuffles_term_counts_only(spark):
    """No n-gram row is shuffled by document, joined to others or stored; the vocabulary is a bounded broadcast."""
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", f"{'xyz'[i % 3] * 3} {'pqrstuv'[i % 7] * 2} common") for i in range(40)],
                                 "doc_id long, domain string, text_lemma string")
    _, _, _, w = tfidf.fit(docs, min_df=1, max_features=10)
    p = _plan(w).split("== Initial Plan ==")[0]
    assert "TakeOrderedAndProject" in p and "BroadcastExchange" in p and "SortMergeJoin" not in p and "Window" not in p
    assert "hashpartitioning(doc_id" not in p and p.count("hashpartitioning(term") == 1


def test_corpus_is_cleaned_once_and_moved_once(spark):
    docs = spark.createDataFrame([(i, f"the text {i % 5} is here", None, "documents", f"src{i % 12}") for i in range(40)],
                                 "doc_id long, text string, label string, source string, dataset string")
    df = prepare_corpus(docs, DRIVER_DOMAIN_RULES)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert p.count(RETWEET_RE[:8]) == 1  # the cleaning chain
    q = df._jdf.queryExecution().executedPlan().toString()
    assert q.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in q
    assert "partial_min_by" in q


def test_language_is_a_row_function(spark):
    df = spark.createDataFrame([(1, "the cat is here")], "doc_id long, text string")
    p = _plan(detect_language(df))
    assert "Exchange" not in p and "Join" not in p
