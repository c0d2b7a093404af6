"""Descriptive aggregates (G), row-wise helpers (H) and report formats (E17/E18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrasta.operators.stats import beside, exact_quantiles, quantiles_of, value_ranks


def value_counts(df: DataFrame, col: str, by=(), top: int | None = None) -> DataFrame:
    """Count per value (nulls excluded), descending, ties by value; optional top-n per group."""
    by = list(by)
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc(col))
    c = c.withColumn("rank", F.row_number().over(w))
    return c.where(F.col("rank") <= top) if top else c


def shares(counts: DataFrame, by, n_col: str = "count", out_col: str = "share") -> DataFrame:
    """``n / sum(n)`` within ``by``; 0.0 when the total is 0."""
    tot = F.sum(n_col).over(Window.partitionBy(*by))
    return counts.withColumn(out_col, F.when(tot == 0, 0.0).otherwise(F.col(n_col) / tot))


def category_counts(df: DataFrame, col: str, categories, groups, by: str = "domain") -> DataFrame:
    """Counts of ``col`` per ``by`` completed with zeros for every fixed category:
    a driver-built ``groups x categories`` dimension (a handful of rows) is
    left-joined to the observed counts."""
    dim = df.sparkSession.createDataFrame(
        [(g, c, i) for g in groups for i, c in enumerate(categories)], f"{by} string, {col} string, ordinal int")
    obs = df.where(F.col(by).isin(*groups)).groupBy(by, col).agg(F.count(F.lit(1)).alias("count"))
    return (F.broadcast(dim).join(obs, [by, col], "left")
            .select(by, col, "ordinal", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def domain_summary(features: DataFrame, by: str = "domain") -> DataFrame:
    """Rows, mean/median of character and word counts per domain."""
    long_df = features.select(by, F.col("char_count").cast("double").alias("c"),
                              F.col("word_count").cast("double").alias("w")) \
        .unpivot([by], ["c", "w"], "metric", "value")
    med = exact_quantiles(long_df, [by, "metric"], [0.5]).groupBy(by).pivot("metric", ["c", "w"]).agg(F.first("q_50"))
    agg = features.groupBy(by).agg(F.count(F.lit(1)).alias("rows"),
                                   F.avg("char_count").alias("mean_char_count"),
                                   F.avg("word_count").alias("mean_word_count"))
    return agg.join(med, by, "left").select(
        by, "rows", "mean_char_count", F.col("c").alias("median_char_count"),
        "mean_word_count", F.col("w").alias("median_word_count"))


def box_summary(long_df: DataFrame, keys) -> DataFrame:
    """Box-plot numbers per key: quartiles, whiskers at the furthest values within
    1.5 IQR of the box, and the count of points outside them."""
    keys = list(keys)
    ranks = value_ranks(long_df, keys)
    j = beside(ranks, quantiles_of(ranks, keys, [0.25, 0.5, 0.75]), keys)
    iqr = F.col("q_75") - F.col("q_25")
    lo, hi = F.col("q_25") - 1.5 * iqr, F.col("q_75") + 1.5 * iqr
    v = F.col("value")
    return j.groupBy(*keys).agg(
        F.first("q_25").alias("q1"), F.first("q_50").alias("median"), F.first("q_75").alias("q3"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when((v < lo) | (v > hi), F.col("t"))), F.lit(0)).alias("n_outliers"), F.sum("t").alias("n"))


def significance_label(p, ns_label: str = "ns") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**")
            .when(p < 0.05, "*").otherwise(ns_label))


def _fixed(x: Column, digits: int) -> Column:
    """Fixed digits, rounded from the binary value (2.675 -> 2.67), ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def format_mean(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(_fixed(x, 2))


def format_compact_p(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p.isNull() | F.isnan(p), "n/a").when(p == 0, "0.0")
            .when(p < 0.001, F.format_string("%.1e", p)).otherwise(_fixed(p, 3)))


def format_p_value(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p.isNull() | F.isnan(p), "p = n/a")
            .when(p < 0.001, F.concat(F.lit("p = "), F.format_string("%.1e", p)))
            .otherwise(F.concat(F.lit("p = "), _fixed(p, 3))))


def numeric_test_label(test_name) -> Column:
    t = F.col(test_name) if isinstance(test_name, str) else test_name
    return F.when(t == "mann_whitney_u", "Mann-Whitney U significance").otherwise("adjusted significance")

