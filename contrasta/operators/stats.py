"""Two-domain statistics as Spark jobs: Mann-Whitney U, exact quantiles,
chi-square with Yates, Cramer's V, rank-biserial effect, BH / Holm adjustment,
Poisson-weight bootstrap intervals.

Every numeric test runs on a long table ``(feature, domain, value)``. A mergeable
quantile sketch per feature gives value bounds, a table of bounded size; rows are
moved once, to the bucket of values between two bounds, and counted there by
value. Running counts within the buckets and the buckets' totals give exact
mid-ranks, medians and quantiles, and no feature or value lands in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contrasta.functions.mathx import chi2_sf, normal_two_sided_p

def _null_d():
    return F.lit(None).cast("double")


NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*$"


def numeric(text: Column) -> Column:
    """A double from text in decimal notation; anything else (also ``1d`` or ``0x1p3``) is null."""
    return F.when(F.lower(text).rlike(NUMBER_RE), text.try_cast("double"))


def clean_values(long_df: DataFrame, value_col: str = "value") -> DataFrame:
    """Numeric coercion: non-numeric -> null, then null and NaN dropped."""
    v = F.col(value_col).try_cast("double")
    return long_df.withColumn(value_col, v).where(v.isNotNull() & ~F.isnan(v))


def to_long(df: DataFrame, features, id_col: str = "doc_id", group_col: str = "domain",
            feature_groups: dict[str, str] | None = None) -> DataFrame:
    """Wide feature table -> ``(doc_id, domain, feature_group, feature, value)``."""
    feats = list(features)
    # text that is no plain number becomes null, it does not stop the job
    values = [(numeric(F.col(c)) if isinstance(df.schema[c].dataType, StringType) else F.col(c).cast("double")).alias(c) for c in feats]
    long_df = df.select(id_col, group_col, *values).unpivot([id_col, group_col], feats, "feature", "value")
    if feature_groups:
        g = F.create_map(*[F.lit(x) for kv in feature_groups.items() for x in kv])
        long_df = long_df.withColumn("feature_group", F.element_at(g, F.col("feature")))
    return long_df


def _pos_value(cum: Column, prev: Column, k: Column) -> Column:
    """Value whose cumulative-count interval (prev, cum] holds position k."""
    return F.min(F.when((prev < k) & (cum >= k), F.col("value")))


#: Value bounds per key, and the step of those that are searched first.
BUCKETS, COARSE = 256, 16


def value_bounds(rows: DataFrame, keys, value_col: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """``keys, bounds, coarse, hot``: approximate quantiles of each key in ascending order, each
    16th of them, and the values that fill a bucket or more alone."""
    q = F.col("q")
    found = rows.groupBy(*keys).agg(F.percentile_approx(value_col, [i / buckets for i in range(1, buckets)]).alias("q"))
    found = found.select(*keys, F.array_distinct(q).alias("bounds"),
                         F.array_distinct(F.filter(q, lambda x, i: x == F.get(q, i + 1))).alias("hot"))
    return found.withColumn("coarse", F.filter("bounds", lambda _, i: (i + 1) % COARSE == 0))


def _bucket(v: Column) -> Column:
    """Twice the number of bounds below ``v``; one more for a hot value, which has a bucket of its own."""
    first = F.size(F.filter("coarse", lambda b: b < v)) * COARSE
    # a one-element array binds the number that is used twice
    below = F.transform(F.array(first), lambda i: i + F.size(F.filter(F.slice("bounds", i + 1, COARSE), lambda b: b < v)))[0]
    return 2 * below + F.array_contains("hot", v).cast("int")


def _same(names) -> Column:
    """Null-safe equality of the columns with those of the other side, which start with ``_k_``."""
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return on


def beside(left: DataFrame, small: DataFrame, names) -> DataFrame:
    """``left`` with the columns of ``small``: a row for each key and bucket at most, broadcast."""
    other = small.withColumnsRenamed({c: f"_k_{c}" for c in names})
    return left.join(F.broadcast(other), _same(names)).drop(*[f"_k_{c}" for c in names])


def cumulative(rows: DataFrame, keys, counts: dict[str, Column], value_col: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """Histogram ``keys, value`` with the aggregates ``counts``, their inclusive running sums over the
    values of a key (``cum_<c>``) and the key's totals (``total_<c>``).

    Rows go to their ``(keys, bucket)`` in one exchange. There they are counted, sorted and summed;
    the totals of lower buckets (a table of keys x buckets) are added. Hot values, which the bounds
    show, are counted before they move. What is broadcast has a row for each key and bucket, so keys
    are expected to be features and groups, not documents.
    """
    keys, cols = list(keys), list(counts)
    at = [*keys, "_bucket"]
    r = beside(rows, value_bounds(rows, keys, value_col, buckets), keys).withColumn("_bucket", _bucket(F.col(value_col))).drop("bounds", "coarse", "hot")
    agg = [c.alias(name) for name, c in counts.items()]
    run = Window.partitionBy(*at).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    cold = r.where(F.col("_bucket") % 2 == 0).repartition(*at).groupBy(*at, value_col).agg(*agg)
    cold = cold.select("*", *[F.sum(c).over(run).alias(f"_run_{c}") for c in cols])
    hot = r.where(F.col("_bucket") % 2 == 1).groupBy(*at, value_col).agg(*agg)
    hot = hot.select("*", *[F.col(c).alias(f"_run_{c}") for c in cols])
    totals = cold.groupBy(*at).agg(*[F.max(f"_run_{c}").alias(f"_all_{c}") for c in cols])
    totals = totals.unionByName(hot.select(*at, *[F.col(c).alias(f"_all_{c}") for c in cols]))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(*at, *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols],
                            *[F.sum(f"_all_{c}").over(whole).alias(f"total_{c}") for c in cols])
    j = beside(cold.unionByName(hot), offsets, at)
    return j.select(*keys, value_col, *cols, *[(F.col(f"_run_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols],
                    *[f"total_{c}" for c in cols])


def mann_whitney(long_df: DataFrame, a: str, b: str, keys=("feature",),
                 group_col: str = "domain") -> DataFrame:
    """Per key: n, mean, median of both samples, U of sample ``a``, two-sided
    asymptotic p (tie and continuity corrected) and rank-biserial effect.

    Columns: keys, ``n_a, n_b, mean_a, mean_b, median_a, median_b, u, p_value,
    effect_size``. Samples are cleaned of null/NaN first.
    """
    keys = list(keys)
    d = F.col(group_col)
    rows = clean_values(long_df).where(d.isin(a, b)).select(*keys, (d == a).alias("_in_a"), "value")
    ranked = cumulative(rows, keys, {"t": F.count(F.lit(1)), "ca": F.count_if("_in_a"), "cb": F.count_if(~F.col("_in_a"))})
    ranked = (ranked.withColumnsRenamed({"cum_t": "cum", "cum_ca": "cum_a", "cum_cb": "cum_b",
                                         "total_ca": "na_all", "total_cb": "nb_all"})
              .withColumn("midrank", F.col("cum") - (F.col("t") - 1) / 2.0))
    out = ranked.groupBy(*keys).agg(
        F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"),
        F.sum(F.col("ca") * F.col("midrank")).alias("r_a"),
        F.sum(F.col("value") * F.col("ca")).alias("sum_a"), F.sum(F.col("value") * F.col("cb")).alias("sum_b"),
        F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"),
        _median("cum_a", "ca", "na_all").alias("median_a"),
        _median("cum_b", "cb", "nb_all").alias("median_b"))
    out = out.withColumn("mean_a", F.when(F.col("n_a") > 0, F.col("sum_a") / F.col("n_a"))) \
             .withColumn("mean_b", F.when(F.col("n_b") > 0, F.col("sum_b") / F.col("n_b")))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    u = F.col("r_a") - n_a * (n_a + 1) / 2.0
    mu = n_a * n_b / 2.0
    sigma = F.sqrt(n_a * n_b / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n_a * n_b - u) - mu - 0.5) / sigma
    ok = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    p = F.when(~ok, _null_d()).when(sigma.isNull() | (sigma <= 0), 1.0).otherwise(normal_two_sided_p(z))
    return out.select(
        *keys,
        F.coalesce("n_a", F.lit(0)).cast("long").alias("n_a"),
        F.coalesce("n_b", F.lit(0)).cast("long").alias("n_b"),
        "mean_a", "mean_b",
        "median_a", "median_b",
        F.when(ok, u).alias("u"),
        p.alias("p_value"),
        F.when(ok, 2.0 * u / (n_a * n_b) - 1.0).alias("effect_size"))


def _median(cum: str, cnt: str, n: str) -> Column:
    """Exact median from cumulative counts: mean of the values at positions
    floor((n+1)/2) and floor(n/2)+1 (1-based)."""
    prev = F.col(cum) - F.col(cnt)
    k1 = F.floor((F.col(n) + 1) / 2)
    k2 = F.floor(F.col(n) / 2) + 1
    return (_pos_value(F.col(cum), prev, k1) + _pos_value(F.col(cum), prev, k2)) / 2.0


def exact_quantiles(long_df: DataFrame, keys, probs, value_col: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation (numpy / SQL ``percentile``) from a
    value histogram and cumulative counts: ``keys, q_<p>...`` (p in percent)."""
    return quantiles_of(value_ranks(long_df, keys, value_col), keys, probs, value_col)


def value_ranks(long_df: DataFrame, keys, value_col: str = "value") -> DataFrame:
    """``keys, value, t, cum, n``: count of each value, running count and the key's count."""
    rows = clean_values(long_df, value_col).select(*keys, value_col)
    return cumulative(rows, keys, {"t": F.count(F.lit(1))}, value_col).withColumnsRenamed({"cum_t": "cum", "total_t": "n"})


def quantiles_of(ranks: DataFrame, keys, probs, value_col: str = "value") -> DataFrame:
    """``keys, q_<p>...`` from ``value_ranks``."""
    aggs = []
    v = F.col(value_col)
    prev = F.col("cum") - F.col("t")
    for q in probs:
        pos = (F.col("n") - 1) * q            # 0-based fractional position
        lo = F.floor(pos) + 1                 # 1-based positions around it
        hi = F.ceil(pos) + 1
        frac = pos - F.floor(pos)
        v_lo = F.min(F.when((prev < lo) & (F.col("cum") >= lo), v))
        v_hi = F.min(F.when((prev < hi) & (F.col("cum") >= hi), v))
        f = F.max(frac)
        aggs.append((v_lo + (v_hi - v_lo) * f).alias(f"q_{_pct(q)}"))
    return ranks.groupBy(*keys).agg(*aggs)


def _pct(q: float) -> str:
    s = f"{q * 100:g}".replace(".", "_")
    return s


def rank_biserial(u, n1, n2) -> Column:
    """``2U/(n1 n2) - 1``; null when a sample is empty."""
    u, n1, n2 = (F.col(x) if isinstance(x, str) else x for x in (u, n1, n2))
    return F.when((n1 > 0) & (n2 > 0), 2.0 * u / (n1 * n2) - 1.0)


def numeric_results(long_df: DataFrame, a: str = "covid", b: str = "climate",
                    group_col: str = "domain") -> DataFrame:
    """One Mann-Whitney result row per ``(feature_group, feature)``; columns are
    prefixed with the two domain names (``covid_n``, ``climate_mean``, ...)."""
    keys = ["feature_group", "feature"]
    m = mann_whitney(long_df, a, b, keys, group_col)
    # features present in the input but without any clean value still get a row
    present = long_df.select(*keys).distinct()
    m = present.join(m, keys, "left")
    ok = (F.coalesce("n_a", F.lit(0)) > 0) & (F.coalesce("n_b", F.lit(0)) > 0)
    return m.select(
        *keys, F.lit("mann_whitney_u").alias("test"), F.lit("u").alias("statistic_name"),
        F.coalesce("n_a", F.lit(0)).cast("long").alias(f"{a}_n"),
        F.coalesce("n_b", F.lit(0)).cast("long").alias(f"{b}_n"),
        F.col("mean_a").alias(f"{a}_mean"), F.col("mean_b").alias(f"{b}_mean"),
        F.col("median_a").alias(f"{a}_median"), F.col("median_b").alias(f"{b}_median"),
        (F.col("mean_a") - F.col("mean_b")).alias("mean_difference"),
        (F.col("median_a") - F.col("median_b")).alias("median_difference"),
        F.col("u").alias("statistic"), "p_value", "effect_size",
        F.lit("rank_biserial_correlation").alias("effect_size_name"),
        F.when(ok, "means_are_descriptive_only").otherwise("insufficient_data").alias("notes"))


# ---------------------------------------------------------------- chi-square

def chi_square(counts: DataFrame, test_col: str, row_col: str, col_col: str,
               n_col: str = "n") -> DataFrame:
    """Chi-square test of independence per ``test_col`` on a long contingency table.

    The table is completed with zero cells, all-zero rows are removed, Yates'
    correction is applied when dof = 1. Returns ``test, n_total, n_rows, n_cols,
    dof, statistic, p_value, cramers_v``.
    """
    c = counts.groupBy(test_col, row_col, col_col).agg(F.sum(n_col).cast("double").alias("o"))
    rows = c.groupBy(test_col, row_col).agg(F.sum("o").alias("r_tot")).where(F.col("r_tot") > 0)
    cols = c.groupBy(test_col, col_col).agg(F.sum("o").alias("c_tot"))
    grid = rows.join(cols, test_col)  # complete r x c grid per test (categories x groups)
    g = grid.join(c, [test_col, row_col, col_col], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    tot = Window.partitionBy(test_col)
    g = (g.withColumn("n_total", F.sum("o").over(tot))
         .withColumn("n_rows", F.size(F.collect_set(row_col).over(tot)))
         .withColumn("n_cols", F.size(F.collect_set(col_col).over(tot))))
    g = g.withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
    e = F.col("r_tot") * F.col("c_tot") / F.col("n_total")
    diff = F.abs(F.col("o") - e)
    corr = F.when(F.col("dof") == 1, F.least(F.lit(0.5), diff)).otherwise(0.0)
    g = g.withColumn("term", F.when(e > 0, (diff - corr) ** 2 / e).otherwise(0.0))
    res = g.groupBy(test_col).agg(
        F.first("n_total").cast("long").alias("n_total"), F.first("n_rows").alias("n_rows"),
        F.first("n_cols").alias("n_cols"), F.first("dof").cast("int").alias("dof"),
        F.sum("term").alias("statistic"))
    min_dim = F.least(F.col("n_rows") - 1, F.col("n_cols") - 1)
    v = F.when((F.col("n_total") > 0) & (min_dim > 0), F.sqrt(F.col("statistic") / (F.col("n_total") * min_dim)))
    return res.select(test_col, "n_total", "n_rows", "n_cols", "dof", "statistic",
                      chi2_sf(F.col("statistic"), F.col("dof")).alias("p_value"), v.alias("cramers_v"))


def expected_counts(counts: DataFrame, test_col: str, row_col: str, col_col: str,
                    n_col: str = "n") -> DataFrame:
    """Observed and expected cell counts (all-zero rows removed)."""
    c = counts.groupBy(test_col, row_col, col_col).agg(F.sum(n_col).cast("double").alias("observed"))
    rows = c.groupBy(test_col, row_col).agg(F.sum("observed").alias("r_tot")).where(F.col("r_tot") > 0)
    cols = c.groupBy(test_col, col_col).agg(F.sum("observed").alias("c_tot"))
    g = rows.join(cols, test_col).join(c, [test_col, row_col, col_col], "left")
    n = F.sum("observed").over(Window.partitionBy(test_col))
    g = g.withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return g.select(test_col, row_col, col_col, "observed",
                    (F.col("r_tot") * F.col("c_tot") / n).alias("expected"))


def cramers_v(stat, n, n_rows, n_cols) -> Column:
    stat, n, n_rows, n_cols = (F.col(x) if isinstance(x, str) else x for x in (stat, n, n_rows, n_cols))
    md = F.least(n_rows - 1, n_cols - 1)
    return F.when((n > 0) & (md > 0), F.sqrt(stat / (n * md)))


# ------------------------------------------------------- multiple comparisons

def benjamini_hochberg(df: DataFrame, p_col: str = "p_value", out_col: str = "adjusted_p_value",
                       family=()) -> DataFrame:
    """BH step-up adjusted p per ``family`` (null/NaN p stay null, not counted)."""
    valid = F.col(p_col).isNotNull() & ~F.isnan(F.col(p_col))
    fam = list(family)
    d = df.withColumn("_valid", valid)
    order = Window.partitionBy(*fam, "_valid").orderBy(F.col(p_col).asc())
    d = d.withColumn("_rank", F.row_number().over(order)) \
         .withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*fam, "_valid")))
    cand = F.col(p_col) * F.col("_m") / F.col("_rank")
    down = Window.partitionBy(*fam, "_valid").orderBy(F.col("_rank").desc()) \
                 .rowsBetween(Window.unboundedPreceding, 0)
    adj = F.least(F.lit(1.0), F.min(cand).over(down))
    return d.withColumn(out_col, F.when(F.col("_valid"), adj)).drop("_valid", "_rank", "_m")


def holm_bonferroni(df: DataFrame, p_col: str = "p_value", out_col: str = "adjusted_p_value",
                    family=()) -> DataFrame:
    """Holm step-down adjusted p per ``family`` (null/NaN p stay null)."""
    valid = F.col(p_col).isNotNull() & ~F.isnan(F.col(p_col))
    fam = list(family)
    d = df.withColumn("_valid", valid)
    order = Window.partitionBy(*fam, "_valid").orderBy(F.col(p_col).asc())
    d = d.withColumn("_rank", F.row_number().over(order)) \
         .withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*fam, "_valid")))
    cand = F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col(p_col))
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out_col, F.when(F.col("_valid"), F.max(cand).over(up))).drop("_valid", "_rank", "_m")


def add_adjusted_p_values(results: DataFrame) -> DataFrame:
    """BH-adjusted p plus ``significant_0_05`` and ``fdr_significant_0_05`` (null -> false)."""
    r = benjamini_hochberg(results)
    return (r.withColumn("significant_0_05", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
             .withColumn("fdr_significant_0_05", F.coalesce(F.col("adjusted_p_value") < 0.05, F.lit(False))))


# ---------------------------------------------------------------- bootstrap

#: Samples of at most this size are resampled value by value.
SMALL_SAMPLE = 100
#: Poisson counts are drawn for the binary digits of a value's count; from this digit on by a normal variate.
DIGITS = 10


def poisson_thresholds(mean: float) -> list[float]:
    """Cumulative Poisson probabilities P(K <= k), k = 0, 1, ... as far as doubles tell them from 1."""
    out, p, acc, k = [], math.exp(-mean), 0.0, 0
    while acc + p > acc or k < mean:
        acc += p
        out.append(acc)
        k += 1
        p *= mean / k
    return out


def uniform_from(seed: Column, rep: Column, row_id: Column) -> Column:
    """Deterministic U(0,1) per (seed, replicate, row): a 31-bit integer mixer
    (multiply / xor-shift rounds; every product stays below 2^62) over all 64 bits of the id."""
    m = 0x7FFFFFFF
    row = row_id.cast("long")
    x = ((seed.cast("long") * 7919 + rep) * 1000003 + row.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(m))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * 739982445).bitwiseAND(F.lit(m))
    x = x.bitwiseXOR(F.shiftright(x, 12))
    # the upper bits of the id join after the replicate is mixed in, so no two ids share all weights
    upper = F.shiftright(row, 31)
    x = (x + upper.bitwiseAND(F.lit(m)) * 999979 + F.shiftright(upper, 31).bitwiseAND(F.lit(m)) * 15485863).bitwiseAND(F.lit(m))
    x = (x * 695872825).bitwiseAND(F.lit(m))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    return x / 2147483648.0


MIX_M = 0x7FFFFFFF
MIX_A, MIX_B = 739982445, 695872825


def _replicate_sums_fn(keys, n_boot, most_groups=500):
    """Per-task replicate sums ``(keys, _b, _sx, _sw)`` of histogram rows with numpy (the integer
    mixer of ``uniform_from``); a value's weight is a Poisson count with its number of rows as mean."""
    import numpy as np
    import pandas as pd

    cuts = [np.array(poisson_thresholds(float(1 << k))) for k in range(DIGITS)]
    reps = np.arange(1, n_boot + 1, dtype=np.int64)[None, :]

    def uniform(seed, row):
        i = row[:, None]
        h = ((seed * 7919 + reps) * 1000003 + (i & MIX_M)) & MIX_M
        h ^= h >> 15
        h = (h * MIX_A) & MIX_M
        h ^= h >> 12
        h = (h + ((i >> 31) & MIX_M) * 999979 + ((i >> 62) & MIX_M) * 15485863) & MIX_M
        h = (h * MIX_B) & MIX_M
        return (h ^ h >> 15) / 2147483648.0

    def weights(seed, row, t):
        w = np.zeros((len(row), n_boot))
        for k in range(DIGITS):
            at = np.flatnonzero(t >> k & 1)
            if len(at):
                w[at] += np.searchsorted(cuts[k], uniform(seed, row[at] * 64 + k), side="right")
        if len(at := np.flatnonzero(t >> DIGITS)):
            many = (t[at] >> DIGITS << DIGITS).astype(np.float64)[:, None]
            z = np.sqrt(-2 * np.log(1 - uniform(seed, row[at] * 64 + DIGITS))) * np.cos(2 * np.pi * uniform(seed, row[at] * 64 + DIGITS + 1))
            w[at] += np.maximum(0, np.round(many + np.sqrt(many) * z + (z * z - 1) / 6))
        return w

    def run(batches):
        held = {}

        def rows():
            for kv, (sx, sw) in held.items():
                yield pd.DataFrame({**{k: [v] * n_boot for k, v in zip(keys, kv)}, "_b": reps[0], "_sx": sx, "_sw": sw})
            held.clear()

        for pdf in batches:
            for kv, g in pdf.groupby([*keys, "_seed"], sort=False, dropna=False):
                sx, sw = held.setdefault(kv[:-1], (np.zeros(n_boot), np.zeros(n_boot)))
                row, t, x = (g[c].to_numpy() for c in ("cum", "t", "value"))
                for start in range(0, len(g), 256):
                    part = slice(start, start + 256)
                    w = weights(int(kv[-1]), row[part], t[part])
                    sw += w.sum(axis=0)
                    sx += x[part] @ w
            if len(held) > most_groups:
                yield from rows()
        yield from rows()
    return run


def replicate_sums(ranks: DataFrame, keys, n_boot: int) -> DataFrame:
    """``keys, _b, _sx, _sw``: each task's weighted sums of its values, once per task."""
    src = ranks.select(*keys, "_seed", "value", "t", "cum")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys]
    return src.mapInPandas(_replicate_sums_fn(list(keys), n_boot), ", ".join([*types, "_b long", "_sx double", "_sw double"]))


def _resampled(ranks: DataFrame, keys, n_boot: int) -> DataFrame:
    """``keys, _b, value``: means of as many values drawn with replacement, for samples of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct("cum", "value", "t")))
    small = ranks.groupBy(*keys, "_seed", "n").agg(F.flatten(F.transform(rows, lambda x: F.array_repeat(x["value"], x["t"].cast("int")))).alias("_all"))
    small = small.select(*keys, "_seed", "n", "_all", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_b"))
    picked = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.get(
        F.col("_all"), F.floor(uniform_from(F.col("_seed"), F.col("_b"), i) * F.col("n")).cast("int")))
    return small.select(*keys, "_b", (F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("value"))


def bootstrap_mean_ci(long_df: DataFrame, keys, value_col: str = "value", n_boot: int = 2000, seed: int = 42, ci: float = 95.0,
                      seed_col: str | None = None) -> DataFrame:
    """``keys, ci_lower, ci_upper``: percentile interval of the mean from ``n_boot`` replicates.

    Replicate weights are Poisson counts (Chamandy et al. 2012). They are drawn for each distinct
    value of a key from a hash of (seed, replicate, place of the value), with the value's number of rows as mean, so
    the work follows distinct values, and a task emits ``keys x n_boot`` sums. Samples of up to
    ``SMALL_SAMPLE`` values are resampled value by value. ``seed_col`` is constant within a key;
    a key without values has null bounds.
    """
    keys = list(keys)
    d = long_df.select(*keys, (F.col(seed_col) if seed_col else F.lit(seed)).cast("long").alias("_seed"), F.col(value_col).alias("value"))
    ranks = value_ranks(d, [*keys, "_seed"])
    sums = replicate_sums(ranks.where(F.col("n") > SMALL_SAMPLE), keys, n_boot).groupBy(*keys, "_b").agg(F.sum("_sx").alias("_sx"), F.sum("_sw").alias("_sw"))
    rep = sums.where(F.col("_sw") > 0).select(*keys, "_b", (F.col("_sx") / F.col("_sw")).alias("value"))
    rep = rep.unionByName(_resampled(ranks.where(F.col("n") <= SMALL_SAMPLE), keys, n_boot))
    alpha = (100.0 - ci) / 2.0 / 100.0
    # a key has n_boot replicates: few enough for one exact percentile
    q = rep.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"))
    present = long_df.select(*keys).distinct()
    q = q.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    return present.join(q, _same(keys), "left").select(*keys, F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))
