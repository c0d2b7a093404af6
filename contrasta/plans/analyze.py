"""Two-domain comparison over the feature table: numeric tests, dominant-emotion
chi-square, adjusted p-values, rhetoric tests, key findings, term context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrasta.operators import stats as st
from contrasta.operators.emotion import EMOTION_COLUMNS
from contrasta.operators.rhetoric import STRATEGIES
from contrasta.operators._util import with_scalar
from contrasta.operators.summaries import box_summary, category_counts, shares, significance_label
from contrasta.functions.text import truncate_text
from contrasta.plans.featurize import FEATURE_GROUPS

RESULT_COLUMNS = ["feature_group", "feature", "test", "statistic_name", "{a}_n", "{b}_n",
                  "{a}_mean", "{b}_mean", "{a}_median", "{b}_median", "mean_difference",
                  "median_difference", "statistic", "p_value", "effect_size", "effect_size_name", "notes"]


def result_columns(a: str, b: str) -> list[str]:
    return [c.format(a=a, b=b) for c in RESULT_COLUMNS]


def numeric_feature_results(features: DataFrame, a: str = "covid", b: str = "climate",
                            groups=FEATURE_GROUPS) -> DataFrame:
    """Mann-Whitney rows for every feature column present (group order kept)."""
    present = [(g, c) for g, cols in groups for c in cols if c in features.columns]
    long_df = st.to_long(features, [c for _, c in present], feature_groups={c: g for g, c in present})
    return st.numeric_results(long_df, a, b)


def dominant_emotion_counts(features: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """``(domain, dominant_emotion, ordinal, count, share)`` over the 7 fixed emotions."""
    c = category_counts(features, "dominant_emotion", EMOTION_COLUMNS, [a, b])
    return shares(c, ["domain"])


def dominant_emotion_result(features: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """One chi-square result row (Cramer's V as effect) in the result schema."""
    counts = dominant_emotion_counts(features, a, b).withColumn("test", F.lit("dominant_emotion"))
    chi = st.chi_square(counts, "test", "dominant_emotion", "domain", "count")
    n = counts.groupBy("test").agg(F.sum(F.when(F.col("domain") == a, F.col("count"))).alias("n_a"),
                                   F.sum(F.when(F.col("domain") == b, F.col("count"))).alias("n_b"))
    j = n.join(chi, "test", "left")
    ok = (F.col("n_a") > 0) & (F.col("n_b") > 0) & F.col("n_rows").isNotNull() & (F.col("n_rows") > 0)
    nul = F.lit(None).cast("double")
    return j.select(
        F.lit("emotion_distribution").alias("feature_group"), F.lit("dominant_emotion").alias("feature"),
        F.lit("chi_square").alias("test"), F.lit("chi2").alias("statistic_name"),
        F.col("n_a").cast("long").alias(f"{a}_n"), F.col("n_b").cast("long").alias(f"{b}_n"),
        *[nul.alias(c) for c in (f"{a}_mean", f"{b}_mean", f"{a}_median", f"{b}_median",
                                 "mean_difference", "median_difference")],
        F.when(ok, F.col("statistic")).alias("statistic"), F.when(ok, F.col("p_value")).alias("p_value"),
        F.when(ok, F.col("cramers_v")).alias("effect_size"), F.lit("cramers_v").alias("effect_size_name"),
        F.when(ok, F.concat(F.lit("dof="), F.col("dof").cast("string"))).otherwise("insufficient_data").alias("notes"))


def run_stats(features: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """All numeric tests + the dominant-emotion test, BH-adjusted, sorted by
    ``(adjusted_p, p, group, feature)`` with nulls last."""
    cols = result_columns(a, b)
    res = numeric_feature_results(features, a, b).select(*cols) \
        .unionByName(dominant_emotion_result(features, a, b).select(*cols))
    res = st.add_adjusted_p_values(res)
    return res.orderBy(F.col("adjusted_p_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(),
                       "feature_group", "feature")


def rhetoric_tests(features: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """Four Mann-Whitney tests on the scores and ratio, three Yates chi-square tests
    on the presence flags (with the presence rate of each domain)."""
    cont = STRATEGIES + ["authority_to_doubt_ratio"]
    long_df = st.to_long(features, cont)
    mw = st.mann_whitney(long_df, a, b).select(
        "feature", F.col("mean_a").alias(f"{a}_mean"), F.col("mean_b").alias(f"{b}_mean"),
        "p_value", F.lit("mann-whitney").alias("test"),
        F.lit(None).cast("double").alias(f"{a}_rate"), F.lit(None).cast("double").alias(f"{b}_rate"))
    flags = [f"{s}_presence" for s in STRATEGIES]
    fl = st.to_long(features.where(F.col("domain").isin(a, b)), flags) \
        .withColumn("flag", F.col("value").cast("int"))
    counts = fl.groupBy("feature", "domain", "flag").agg(F.count(F.lit(1)).alias("n"))
    chi = st.chi_square(counts, "feature", "domain", "flag", "n")
    rates = fl.groupBy("feature").agg(
        (F.sum(F.when(F.col("domain") == a, F.col("flag"))) / F.count_if(F.col("domain") == a)).alias(f"{a}_rate"),
        (F.sum(F.when(F.col("domain") == b, F.col("flag"))) / F.count_if(F.col("domain") == b)).alias(f"{b}_rate"))
    ch = chi.join(rates, "feature").select(
        "feature", F.lit(None).cast("double").alias(f"{a}_mean"), F.lit(None).cast("double").alias(f"{b}_mean"),
        "p_value", F.lit("chi-squared").alias("test"),
        F.coalesce(F.col(f"{a}_rate"), F.lit(0.0)).alias(f"{a}_rate"),
        F.coalesce(F.col(f"{b}_rate"), F.lit(0.0)).alias(f"{b}_rate"))
    return mw.unionByName(ch)


KEY_FINDINGS = ["sadness", "vader_compound", "anger", "auth_score"]


def key_findings(features: DataFrame, a: str = "covid", b: str = "climate", n_boot: int = 2000,
                 seed: int = 42, specs=KEY_FINDINGS) -> DataFrame:
    """Per key feature: means, bootstrap 95% intervals for both domains (seeds
    ``seed + i`` and ``seed + len(specs) + i``), U test, Holm-adjusted p."""
    k = len(specs)
    long_df = st.to_long(features.where(F.col("domain").isin(a, b)), specs)
    idx = F.create_map(*[F.lit(x) for i, f in enumerate(specs) for x in (f, i)])
    long_df = long_df.withColumn("_i", F.element_at(idx, F.col("feature")))
    long_df = long_df.withColumn("_seed", F.when(F.col("domain") == a, seed + F.col("_i"))
                                 .otherwise(seed + k + F.col("_i")))
    ci = st.bootstrap_mean_ci(long_df, ["feature", "domain"], n_boot=n_boot, seed_col="_seed")
    ci = ci.groupBy("feature").agg(
        F.first(F.when(F.col("domain") == a, F.col("ci_lower")), ignorenulls=True).alias(f"{a}_ci_lower"),
        F.first(F.when(F.col("domain") == a, F.col("ci_upper")), ignorenulls=True).alias(f"{a}_ci_upper"),
        F.first(F.when(F.col("domain") == b, F.col("ci_lower")), ignorenulls=True).alias(f"{b}_ci_lower"),
        F.first(F.when(F.col("domain") == b, F.col("ci_upper")), ignorenulls=True).alias(f"{b}_ci_upper"))
    mw = st.mann_whitney(long_df.drop("_i", "_seed"), a, b)
    out = mw.join(ci, "feature", "left").withColumn("ordinal", F.element_at(idx, F.col("feature")))
    out = st.holm_bonferroni(out.select(
        "ordinal", "feature", F.col("mean_a").alias(f"{a}_mean"), F.col("mean_b").alias(f"{b}_mean"),
        f"{a}_ci_lower", f"{a}_ci_upper", f"{b}_ci_lower", f"{b}_ci_upper",
        F.col("u").alias("statistic"), "p_value"))
    return out.withColumn("significant", F.coalesce(F.col("adjusted_p_value") < 0.05, F.lit(False)))


def term_context(weights: DataFrame, features: DataFrame, top: DataFrame,
                 examples_per_term: int = 3):
    """Per (domain, top term): matching documents (score > 0) of that domain, their
    count and share, mean sentiment and emotions, and the best examples.

    Only the <= 2 x top_n requested terms are joined (broadcast) to the weights.
    Returns ``(records, examples)`` as flat tables."""
    sizes = features.groupBy("domain").agg(F.count(F.lit(1)).alias("document_count"))
    t = top.select("domain", "term", "rank", "mean_tfidf")
    m = weights.join(F.broadcast(t), ["domain", "term"]).where(F.col("score") > 0)
    vader = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]
    # aggregates need only the numeric columns: no document text travels with the
    # (document, term) matches
    nums = features.select("doc_id", *vader, *EMOTION_COLUMNS)
    rec = m.join(nums, "doc_id").groupBy("domain", "term", "rank", "mean_tfidf").agg(
        F.count(F.lit(1)).alias("document_frequency"),
        *[F.avg(c).alias(f"avg_{c}") for c in vader + EMOTION_COLUMNS])
    rec = rec.join(F.broadcast(sizes), "domain").withColumn(
        "share_of_domain_docs", F.col("document_frequency") / F.col("document_count"))
    # examples: top-k per term first (limited map-side), then fetch text for those rows only,
    # which are no more than ``examples_per_term`` for each of the terms above: texts are not shuffled
    w = Window.partitionBy("domain", "term").orderBy(F.desc(F.round("score", 12)), F.asc("doc_id"))
    best = (m.withColumn("example_rank", F.row_number().over(w).cast("long"))
            .where(F.col("example_rank") <= examples_per_term))
    info = features.select("doc_id", "text", "dataset", "source", "vader_compound", "dominant_emotion")
    ex = F.broadcast(best).join(info, "doc_id").select(
        "domain", "term", "rank", "example_rank", "doc_id", truncate_text("text").alias("text"),
        F.coalesce(F.col("dataset").cast("string"), F.lit("")).alias("dataset"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("score").alias("term_tfidf_score"), "vader_compound", "dominant_emotion")
    return rec, ex


def term_context_payload(records: DataFrame, examples: DataFrame, docs: DataFrame, features: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per domain: its document count and its nested terms in rank order (as many as were asked for).

    The documents that were weighted and those that have features must be the same; the plan itself
    counts keys that only one side has, and any stops the job.
    """
    sides = docs.select(key, F.lit(1).alias("d")).unionByName(features.select(key, F.lit(-1).alias("d")))
    odd = sides.groupBy(key).agg(F.sum("d").alias("d")).where("d != 0").agg(F.count(F.lit(1)).alias("_odd"))
    terms = term_context_nested(records, examples)
    cols = [c for c in terms.columns if c not in ("domain", "document_count")]
    out = terms.groupBy("domain", "document_count").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("terms"))
    checked = F.when(F.col("_odd") > 0, F.raise_error(F.lit("TF-IDF rows do not match the documents of the domain tables."))).otherwise(F.col("document_count"))
    return with_scalar(out, odd).select("domain", checked.alias("document_count"), "terms")


def term_context_nested(records: DataFrame, examples: DataFrame) -> DataFrame:
    """One nested record per (domain, term) for JSON output, terms in rank order."""
    vader = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]
    exs = examples.groupBy("domain", "term").agg(
        F.array_sort(F.collect_list(F.struct("example_rank", "text", "dataset", "source", "term_tfidf_score",
                                             "vader_compound", "dominant_emotion"))).alias("ex"))
    r = records.join(exs, ["domain", "term"], "left")
    return r.select(
        "domain", "document_count", "rank", "term", F.col("mean_tfidf").alias("mean_tfidf_score"),
        "document_frequency", "share_of_domain_docs",
        F.struct(*[F.col(f"avg_{c}").alias(c) for c in vader]).alias("average_vader"),
        F.struct(*[F.col(f"avg_{c}").alias(c) for c in EMOTION_COLUMNS]).alias("average_emotions"),
        F.transform(F.coalesce("ex", F.array()), lambda e: e.dropFields("example_rank")).alias("representative_examples"))


def share_frame(features: DataFrame, stats: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """Shares of the dominant emotions with the test's adjusted p, stars and Cramer's V beside each."""
    test = stats.where(F.col("feature") == "dominant_emotion").select("adjusted_p_value", F.col("effect_size").alias("cramers_v"))
    out = with_scalar(dominant_emotion_counts(features, a, b).withColumn("percent", F.col("share") * 100.0), test)
    return out.withColumn("stars", significance_label("adjusted_p_value"))


def box_frame(features: DataFrame, stats: DataFrame, cols, a: str = "covid", b: str = "climate") -> DataFrame:
    """Box-plot numbers of the given features by domain with their adjusted p and stars."""
    long_df = st.to_long(features.where(F.col("domain").isin(a, b)), cols).select("domain", "feature", "value")
    tests = stats.where(F.col("feature").isin(*cols)).select("feature", "adjusted_p_value")
    out = box_summary(long_df, ["domain", "feature"]).join(F.broadcast(tests), "feature", "left")  # a row per given feature
    return out.withColumn("stars", significance_label("adjusted_p_value"))


def summary_counts(features: DataFrame) -> DataFrame:
    """``domain, kind, value, count``: documents of each source and each dataset of a domain, as rows of any number."""
    parts = [features.select("domain", F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("value")) for kind in ("source", "dataset")]
    return (parts[0].unionByName(parts[1]).where(F.col("value").isNotNull())
            .groupBy("domain", "kind", "value").agg(F.count(F.lit(1)).alias("count")))


def summary_payload(features: DataFrame, stats: DataFrame, a: str = "covid", b: str = "climate",
                    top: int = 10) -> DataFrame:
    """One-row nested summary: test names, per-domain summaries, dominant-emotion
    counts/percentages/expected counts, trust-cue column availability and the first ``top``
    findings; sets of any size (sources, datasets) are the rows of ``summary_counts``."""
    from contrasta.operators.summaries import domain_summary
    from contrasta.plans.featurize import TRUST_CUE_COLUMNS
    spark = features.sparkSession
    ds = domain_summary(features)
    doms = ds.where(F.col("domain").isin(a, b))
    dom = doms.agg(F.map_from_entries(F.collect_list(F.struct("domain", F.struct(*[c for c in doms.columns if c != "domain"])))).alias("domains"))
    dc = dominant_emotion_counts(features, a, b)
    emo = dc.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("dominant_emotion", "count"))).alias("counts"),
                                   F.map_from_entries(F.collect_list(F.struct("dominant_emotion", "share"))).alias("percentages"))
    emo = emo.agg(F.map_from_entries(F.collect_list(F.struct("domain", F.struct("counts", "percentages")))).alias("dominant_emotions"))
    exp = st.expected_counts(dc.withColumn("test", F.lit("d")), "test", "dominant_emotion", "domain", "count")
    exp = exp.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("dominant_emotion", "expected"))).alias("m")) \
             .agg(F.map_from_entries(F.collect_list(F.struct("domain", "m"))).alias("expected_counts"))
    avail = [c for c in TRUST_CUE_COLUMNS if c in features.columns]
    findings = stats.limit(top).agg(F.collect_list(F.struct(*stats.columns)).alias("top_findings"))
    head = spark.range(1).select(
        F.lit("mann_whitney_u").alias("numeric_test"), F.lit("rank_biserial_correlation").alias("numeric_effect_size"),
        F.array(*[F.lit(c) for c in avail]).cast("array<string>").alias("available_trust_cue_columns"),
        F.array(*[F.lit(c) for c in TRUST_CUE_COLUMNS if c not in avail]).cast("array<string>").alias("missing_trust_cue_columns"))
    out = head
    for part in (dom, emo, exp, findings):
        out = with_scalar(out, part)
    return out.drop("id")
