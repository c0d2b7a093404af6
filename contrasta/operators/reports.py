"""Report frames: the rows behind each figure of the comparison report, as tables
(the drawing itself is not part of the engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrasta.operators.summaries import significance_label

# Emotions shown in the term-context heat map, in this order.
CONTEXT_EMOTIONS = ["anger", "disgust", "fear", "sadness", "neutral", "joy"]
SENTIMENT_CATEGORIES = [("neg", "vader_neg"), ("neu", "vader_neu"), ("pos", "vader_pos"), ("compound", "vader_compound")]
SCORE_FEATURES = ["urgency", "authority", "doubt"]
RATE_FEATURES = ["urgency_presence", "authority_presence", "doubt_presence"]


def _ordinal(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    dim = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{col} string, ordinal int")
    return df.join(F.broadcast(dim), col)


def sentiment_frame(features: DataFrame, stats: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """Mean of each sentiment score per domain with the adjusted-p stars."""
    cats = [f for _, f in SENTIMENT_CATEGORIES]
    long_df = features.select("domain", *cats).unpivot(["domain"], cats, "feature", "value")
    means = long_df.groupBy("feature").agg(
        F.avg(F.when(F.col("domain") == a, F.col("value"))).alias(f"{a}_mean"),
        F.avg(F.when(F.col("domain") == b, F.col("value"))).alias(f"{b}_mean"))
    dim = features.sparkSession.createDataFrame([(c, f, i) for i, (c, f) in enumerate(SENTIMENT_CATEGORIES)],
                                                "category string, feature string, ordinal int")
    st = stats.where(F.col("feature_group") == "vader").select("feature", "adjusted_p_value")
    return (F.broadcast(dim).join(means, "feature", "left").join(st, "feature", "left")
            .select("ordinal", "category", "feature", f"{a}_mean", f"{b}_mean", "adjusted_p_value",
                    significance_label("adjusted_p_value").alias("stars")))


def context_frame(records: DataFrame, examples: DataFrame, top_n: int = 6) -> DataFrame:
    """First ``top_n`` term records per domain (rank order) with the heat-map
    emotions and the first example line ``term: "text"``."""
    w = Window.partitionBy("domain").orderBy("rank")
    r = records.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= top_n)
    first = examples.where(F.col("example_rank") == 1).select(
        "domain", "term", F.concat(F.col("term"), F.lit(': "'), F.col("text"), F.lit('"')).alias("example_line"))
    return r.join(first, ["domain", "term"], "left").select(
        "domain", "position", "term", "document_frequency", "share_of_domain_docs",
        F.col("avg_vader_compound").alias("vader_compound"),
        *[F.col(f"avg_{e}").alias(e) for e in CONTEXT_EMOTIONS], "example_line")


def rhetoric_frame(tests: DataFrame, a: str = "covid", b: str = "climate") -> DataFrame:
    """Score rows (means) and rate rows (presence rates) in fixed order with stars
    from the adjusted p when present, else the raw p."""
    p_col = "adjusted_p_value" if "adjusted_p_value" in tests.columns else "p_value"
    order = SCORE_FEATURES + RATE_FEATURES
    t = _ordinal(tests.where(F.col("feature").isin(*order)), "feature", order)
    is_score = F.col("feature").isin(*SCORE_FEATURES)
    return t.select(
        "ordinal", "feature", F.when(is_score, "score").otherwise("rate").alias("kind"),
        F.when(is_score, F.col(f"{a}_mean")).otherwise(F.col(f"{a}_rate")).alias(f"{a}_value"),
        F.when(is_score, F.col(f"{b}_mean")).otherwise(F.col(f"{b}_rate")).alias(f"{b}_value"),
        F.col(p_col).alias("p_value"), significance_label(p_col).alias("stars"))


def direction_summary(frame: DataFrame, a: str = "covid", b: str = "climate", label_a: str = "COVID",
                      label_b: str = "climate", limit: int = 3) -> DataFrame:
    """One sentence naming, for the first ``limit`` score rows, which domain is higher."""
    s = frame.where(F.col("kind") == "score")
    bit = (F.when(F.col(f"{b}_value") > F.col(f"{a}_value"), F.concat(F.lit(f"higher {label_b} "), F.col("feature")))
           .when(F.col(f"{a}_value") > F.col(f"{b}_value"), F.concat(F.lit(f"higher {label_a} "), F.col("feature"))))
    bits = s.select("ordinal", bit.alias("bit")).where(F.col("bit").isNotNull())
    agg = bits.agg(F.array_sort(F.collect_list(F.struct("ordinal", "bit"))).alias("l"))
    joined = F.array_join(F.transform(F.slice("l", 1, limit), lambda x: x["bit"]), "; ")
    text = F.concat(F.upper(F.substring(joined, 1, 1)), F.lower(F.substring(joined, 2, 1 << 20)), F.lit("."))
    return agg.select(text.alias("summary"))
