"""Registered queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the given tables (or data Spark derives from them) and runs over
the whole tables. Float outputs are rounded to ``DIGITS`` decimals so results
compare exactly against the SQL oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from contrasta.functions.text import (char_count, clean_text, model_input, truncate_text, word_count)
from contrasta.functions.parse import extract_scores
from contrasta.operators import stats as st
from contrasta.operators import reports as rp
from contrasta.operators import summaries as sm
from contrasta.operators import tfidf
from contrasta.operators.dedupe import dedupe_keep_first
from contrasta.operators.domains import assign_domain, domain_rules, drop_credible
from contrasta.operators.emotion import EMOTION_COLUMNS, dominant_emotion, emotion_scores
from contrasta.operators.labels import harmonize_by_source, harmonize_labels
from contrasta.operators.language import language_of
from contrasta.operators.lemma import lemmatize
from contrasta.operators.rhetoric import rhetoric_scores
from contrasta.operators.sentiment import polarity_class, sentiment_scores
from contrasta.plans import analyze as an
from contrasta.plans.featurize import feature_table, with_lemmas
from contrasta.operators.tokens import computed_once
from contrasta.plans.preprocess import prepare_corpus, prepare_sources
from contrasta.session import ensure_checkpoint_dir
from contrasta.streaming.incremental import incremental_scores
from contrasta.sources import normalize as nz
from contrasta.sources.io import read_processed, write_processed
from contrasta.sources.driver import (DOMAIN_A, DOMAIN_B, DRIVER_DOMAIN_RULES, decorated_documents,
                                      documents_unified, table)

DIGITS = 6
A, B = DOMAIN_A, DOMAIN_B


def _rounded(c):
    """``DIGITS`` decimals, by way of 10: sums taken in another order then round alike at a tie."""
    return F.round(F.when(F.abs(c) < 1000, F.round(c, 10)).otherwise(c), DIGITS)


def finalize(df: DataFrame) -> DataFrame:
    """Round every floating column to ``DIGITS`` decimals."""
    cols = [_rounded(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the session's checkpoint folder and cut its lineage
    (used for tables that several branches of one query read, each its own columns)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- shared inputs

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_corpus(documents_unified(spark, sf), DRIVER_DOMAIN_RULES, materialize=materialize)


def two_domain_corpus(spark, sf) -> DataFrame:
    return corpus(spark, sf).where(F.col("domain").isin(A, B))


def features(spark, sf) -> DataFrame:
    return materialize(feature_table(two_domain_corpus(spark, sf)))


def tfidf_fit(spark, sf):
    docs = materialize(with_lemmas(two_domain_corpus(spark, sf)))
    return docs, tfidf.fit(docs, materialize=materialize)


# ---------------------------------------------------------------- text surface

def q_clean_text(spark, sf):
    d = decorated_documents(spark, sf)
    return d.select("doc_id", clean_text("text").alias("clean_text"))


def q_text_metrics(spark, sf):
    d = decorated_documents(spark, sf)
    return finalize(d.select("doc_id", char_count("text").alias("char_count"),
                             word_count("text").alias("word_count"),
                             truncate_text("text").alias("truncated"),
                             F.length(model_input("text")).cast("long").alias("model_input_chars")))


def q_parse_model_answer(spark, sf):
    return finalize(extract_scores(nz.model_answers(spark, sf), "answer", "event_id"))


# ---------------------------------------------------------------- preprocessing

def q_normalize_sources(spark, sf):
    return nz.all_sources_normalized(spark, sf)


def q_harmonize_labels(spark, sf):
    return harmonize_by_source(nz.raw_label_sources(spark, sf), "source").select("source", "doc_id", "label")


def q_domain_assign(spark, sf):
    d = assign_domain(documents_unified(spark, sf), DRIVER_DOMAIN_RULES)
    return d.select("doc_id", "dataset", "domain")


def q_drop_credible(spark, sf):
    raw = nz.raw_label_sources(spark, sf).where(F.col("source") == nz.SOURCE_GENERAL)
    h = harmonize_labels(raw, nz.SOURCE_GENERAL)
    return drop_credible(h).select("doc_id", "label")


def q_dedupe_keep_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return dedupe_keep_first(d, "text").select("doc_id")


def q_preprocess_corpus(spark, sf):
    return corpus(spark, sf).select("doc_id", "domain", "dataset", "text")


def q_corpus_from_sources(spark, sf):
    """From the raw source tables to the corpus in one plan."""
    docs = prepare_sources(nz.normalized_sources(spark, sf), domain_rules() | DRIVER_DOMAIN_RULES)
    return docs.select("doc_id", "domain", "source", "dataset", "label", "text")


def q_value_counts(spark, sf):
    c = corpus(spark, sf)
    return sm.value_counts(c, "dataset", ["domain"], top=10).select(
        "domain", "dataset", F.col("count").cast("long").alias("count"), F.col("rank").cast("long").alias("rank"))


def q_lang_detect(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", language_of("text").alias("lang_detected"))


def q_lang_accuracy(spark, sf):
    """Detector accuracy against the ``lang`` column, per true language."""
    d = table(spark, sf, "documents")
    j = computed_once(d.select("lang", "text"), language_of("text"), "lang_detected")
    return finalize(j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lang_detected") == F.col("lang")).alias("n_correct"),
        F.count_if(F.col("lang_detected").isNull()).alias("n_undecided"),
        (F.count_if(F.col("lang_detected") == F.col("lang")) / F.count(F.lit(1))).alias("accuracy")))


# ---------------------------------------------------------------- scoring

def q_lemmatize(spark, sf):
    return lemmatize(two_domain_corpus(spark, sf).select("doc_id", "text")).select("doc_id", "text_lemma")


def q_sentiment(spark, sf):
    s = sentiment_scores(corpus(spark, sf).select("doc_id", "text"))
    return finalize(s.withColumn("polarity", polarity_class("vader_compound")))


def q_emotion(spark, sf):
    e = emotion_scores(corpus(spark, sf).select("doc_id", "text"))
    return finalize(e.withColumn("dominant_emotion", dominant_emotion()))


def q_rhetoric(spark, sf):
    return finalize(rhetoric_scores(corpus(spark, sf).select("doc_id", "text")))


# ---------------------------------------------------------------- TF-IDF

def q_tfidf_weights(spark, sf):
    _, (tf, sizes, vocab, w) = tfidf_fit(spark, sf)
    return finalize(w.select("doc_id", "term", "tf", "score"))


def q_top_terms(spark, sf):
    _, (tf, sizes, vocab, w) = tfidf_fit(spark, sf)
    return finalize(tfidf.top_n_per_domain(tfidf.mean_scores(w, sizes), 25))


def _context(spark, sf):
    """Features with lemmas from one tokenisation, and the term context from counts that all its readers share."""
    f = features(spark, sf)
    _, sizes, _, w = tfidf.fit(f, materialize=materialize, reused=True)
    top = materialize(tfidf.top_n_per_domain(tfidf.mean_scores(w, sizes), 25))
    return f, *an.term_context(w, f, top, 3)


def q_term_context(spark, sf):
    _, rec, _ = _context(spark, sf)
    return finalize(rec.drop("rank"))


def q_term_examples(spark, sf):
    _, _, ex = _context(spark, sf)
    return finalize(ex.drop("rank"))


def q_term_payload(spark, sf):
    """The nested payload, flat again: a row per domain and term."""
    f, rec, ex = _context(spark, sf)
    p = an.term_context_payload(rec, ex, f, f)
    t = F.col("t")
    return finalize(p.select("domain", "document_count", F.posexplode("terms").alias("i", "t")).select(
        "domain", "document_count", (F.col("i") + 1).cast("long").alias("place"), t["term"].alias("term"), t["mean_tfidf_score"].alias("mean_tfidf"),
        t["document_frequency"].alias("document_frequency"), t["average_vader"]["vader_compound"].alias("compound"),
        F.size(t["representative_examples"]).cast("long").alias("examples")))


# ---------------------------------------------------------------- reuse and storage

def q_incremental_scores(spark, sf):
    """Stored scores of two thirds of the documents, a fifth of them of an older text: what is reused, what is scored again."""
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def scorer(d):
        return d.select("doc_id", F.length("text").cast("double").alias("score"))

    old = docs.where("doc_id % 3 < 2").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    stored = materialize(incremental_scores(old, None, scorer).withColumn("reused", F.lit(True)))
    out = incremental_scores(docs, stored, lambda d: scorer(d).withColumn("reused", F.lit(False)))
    return finalize(out.select("doc_id", "score", "reused"))


def q_domain_store(spark, sf):
    """The corpus written by domain and the documents of one domain read back: other domains' files are not opened."""
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    write_processed(prepare_corpus(documents_unified(spark, sf), DRIVER_DOMAIN_RULES), path)
    return read_processed(spark, path, [B]).select("doc_id", "domain", "dataset")


# ---------------------------------------------------------------- statistics

def q_mwu_features(spark, sf):
    return finalize(an.numeric_feature_results(features(spark, sf), A, B))


def q_mwu_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    long_df = li.select(F.col("l_returnflag").alias("domain"), "l_quantity", "l_extendedprice", "l_discount") \
        .unpivot(["domain"], ["l_quantity", "l_extendedprice", "l_discount"], "feature", "value")
    return finalize(st.mann_whitney(long_df.withColumn("value", F.col("value").cast("double")), "A", "R"))


def q_chi2_labels(spark, sf):
    d = assign_domain(documents_unified(spark, sf), DRIVER_DOMAIN_RULES).select("doc_id", "domain")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id").where(F.col("domain").isin(A, B))
    long_df = j.select("domain", F.col("quality").cast("string").alias("quality"),
                       F.col("toxic").cast("string").alias("toxic")) \
        .unpivot(["domain"], ["quality", "toxic"], "test", "flag")
    counts = long_df.groupBy("test", "domain", "flag").agg(F.count(F.lit(1)).alias("n"))
    return finalize(st.chi_square(counts, "test", "domain", "flag", "n"))


def q_dominant_emotion_test(spark, sf):
    return finalize(an.dominant_emotion_result(features(spark, sf), A, B))


def q_dominant_shares(spark, sf):
    c = an.dominant_emotion_counts(features(spark, sf), A, B)
    return finalize(c.withColumn("percent", F.col("share") * 100.0))


def q_share_frame(spark, sf):
    f = features(spark, sf)
    return finalize(an.share_frame(f, materialize(an.run_stats(f, A, B)), A, B))


def q_box_frame(spark, sf):
    f = features(spark, sf)
    out = an.box_frame(f, materialize(an.run_stats(f, A, B)), ["sadness", "anger"], A, B)
    return finalize(out.withColumn("n_outliers", F.col("n_outliers").cast("long")))


def q_summary_counts(spark, sf):
    return an.summary_counts(features(spark, sf))


def q_run_stats(spark, sf):
    return finalize(an.run_stats(features(spark, sf), A, B))


def q_top_findings(spark, sf):
    r = an.run_stats(features(spark, sf), A, B).limit(10)
    return finalize(r.select("feature_group", "feature", "test", f"{A}_median", f"{B}_median",
                             "p_value", "adjusted_p_value", "effect_size"))


def q_bh_adjust(spark, sf):
    r = an.run_stats(features(spark, sf), A, B)
    return finalize(r.select("feature_group", "feature", "p_value", "adjusted_p_value",
                             "significant_0_05", "fdr_significant_0_05"))


def q_holm_adjust(spark, sf):
    r = an.numeric_feature_results(features(spark, sf), A, B).select("feature_group", "feature", "p_value")
    return finalize(st.holm_bonferroni(r, family=["feature_group"]))


def q_rhetoric_tests(spark, sf):
    return finalize(an.rhetoric_tests(features(spark, sf), A, B))


def q_bootstrap_ci(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "value")
    ci = st.bootstrap_mean_ci(ev, ["event_type"], n_boot=2000, seed=42)
    mean = ev.groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return finalize(mean.join(ci, "event_type"))


def q_bootstrap_small(spark, sf):
    """Samples of each size: users' values by type, from none that is a number to hundreds."""
    ev = table(spark, sf, "events").select((F.col("user_id") % 97).alias("bin"), (F.col("user_id") % 5).alias("part"), "value")
    ev = ev.withColumn("value", F.when(F.col("bin") % 10 == 0, F.when(F.col("part") == 0, F.round("value", 0)))
                       .when(F.col("bin") % 10 == 1, F.lit(None).cast("double")).otherwise(F.round("value", 0)))
    ci = st.bootstrap_mean_ci(ev, ["bin"], n_boot=500, seed=7)
    n = ev.groupBy("bin").agg(F.count("value").alias("n"))
    return finalize(n.join(ci, "bin"))


def q_key_findings(spark, sf):
    return finalize(an.key_findings(features(spark, sf), A, B))


def q_domain_summary(spark, sf):
    return finalize(sm.domain_summary(features(spark, sf)))


def q_source_counts(spark, sf):
    f = features(spark, sf)
    c = sm.value_counts(f, "dataset", ["domain"])
    return c.select("domain", "dataset", F.col("count").cast("long").alias("count"))


def q_box_summary(spark, sf):
    long_df = st.to_long(features(spark, sf), ["sadness", "anger"]).select("domain", "feature", "value")
    return finalize(sm.box_summary(long_df, ["domain", "feature"]).withColumn(
        "n_outliers", F.col("n_outliers").cast("long")).withColumn("n", F.col("n").cast("long")))


def q_sentiment_means(spark, sf):
    f = features(spark, sf)
    g = f.groupBy("domain").agg(*[F.avg(c).alias(c.replace("vader_", "")) for c in
                                  ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]])
    return finalize(g)


def q_emotion_means(spark, sf):
    f = features(spark, sf)
    res = an.run_stats(f, A, B).where(F.col("feature_group") == "emotion").select("feature", "adjusted_p_value")
    long_df = st.to_long(f, EMOTION_COLUMNS)
    means = long_df.groupBy("feature").agg(
        F.avg(F.when(F.col("domain") == A, F.col("value"))).alias(f"{A}_mean"),
        F.avg(F.when(F.col("domain") == B, F.col("value"))).alias(f"{B}_mean"))
    out = means.join(res, "feature", "left").select(
        "feature", f"{A}_mean", f"{B}_mean", "adjusted_p_value",
        sm.significance_label("adjusted_p_value").alias("stars"))
    return finalize(out)


def q_report_formats(spark, sf):
    r = an.run_stats(features(spark, sf), A, B)
    return r.select("feature_group", "feature",
                    sm.format_mean(f"{A}_mean").alias("mean_a_text"),
                    sm.format_compact_p("p_value").alias("p_compact"),
                    sm.format_p_value("adjusted_p_value").alias("p_text"),
                    sm.significance_label("adjusted_p_value").alias("stars"),
                    sm.significance_label("p_value", "").alias("stars_plain"),
                    sm.numeric_test_label(F.col("test")).alias("test_label"))


def q_sentiment_frame(spark, sf):
    f = features(spark, sf)
    return finalize(rp.sentiment_frame(f, an.run_stats(f, A, B), A, B))


def q_top15_frame(spark, sf):
    _, (tf, sizes, vocab, w) = tfidf_fit(spark, sf)
    return finalize(tfidf.top_n_per_domain(tfidf.mean_scores(w, sizes), 25).where(F.col("rank") <= 15))


def q_context_frame(spark, sf):
    _, rec, ex = _context(spark, sf)
    return finalize(rp.context_frame(rec, ex, 6))


def q_rhetoric_frame(spark, sf):
    return finalize(rp.rhetoric_frame(an.rhetoric_tests(features(spark, sf), A, B), A, B))


def q_direction_summary(spark, sf):
    fr = rp.rhetoric_frame(an.rhetoric_tests(features(spark, sf), A, B), A, B)
    return rp.direction_summary(fr, A, B)


QUERIES = {
    "clean_text": q_clean_text,
    "text_metrics": q_text_metrics,
    "parse_model_answer": q_parse_model_answer,
    "normalize_sources": q_normalize_sources,
    "harmonize_labels": q_harmonize_labels,
    "domain_assign": q_domain_assign,
    "drop_credible": q_drop_credible,
    "dedupe_keep_first": q_dedupe_keep_first,
    "preprocess_corpus": q_preprocess_corpus,
    "corpus_from_sources": q_corpus_from_sources,
    "value_counts": q_value_counts,
    "lang_detect": q_lang_detect,
    "lang_accuracy": q_lang_accuracy,
    "lemmatize": q_lemmatize,
    "sentiment": q_sentiment,
    "emotion": q_emotion,
    "rhetoric": q_rhetoric,
    "tfidf_weights": q_tfidf_weights,
    "top_terms": q_top_terms,
    "term_context": q_term_context,
    "term_examples": q_term_examples,
    "mwu_features": q_mwu_features,
    "mwu_lineitem": q_mwu_lineitem,
    "chi2_labels": q_chi2_labels,
    "dominant_emotion_test": q_dominant_emotion_test,
    "dominant_shares": q_dominant_shares,
    "run_stats": q_run_stats,
    "top_findings": q_top_findings,
    "bh_adjust": q_bh_adjust,
    "holm_adjust": q_holm_adjust,
    "rhetoric_tests": q_rhetoric_tests,
    "bootstrap_ci": q_bootstrap_ci,
    "share_frame": q_share_frame,
    "box_frame": q_box_frame,
    "summary_counts": q_summary_counts,
    "term_payload": q_term_payload,
    "incremental_scores": q_incremental_scores,
    "domain_store": q_domain_store,
    "bootstrap_small": q_bootstrap_small,
    "key_findings": q_key_findings,
    "domain_summary": q_domain_summary,
    "source_counts": q_source_counts,
    "box_summary": q_box_summary,
    "sentiment_means": q_sentiment_means,
    "emotion_means": q_emotion_means,
    "report_formats": q_report_formats,
    "sentiment_frame": q_sentiment_frame,
    "top15_frame": q_top15_frame,
    "context_frame": q_context_frame,
    "rhetoric_frame": q_rhetoric_frame,
    "direction_summary": q_direction_summary,
}
