"""Values of unusual size and kind, checked against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from contrasta.functions.text import decode_unicode_escapes
from contrasta.operators import stats
from contrasta.operators.emotion import EMOTION_COLUMNS
from contrasta.operators.summaries import box_summary, format_compact_p, format_mean
from contrasta.plans.featurize import prepare_domain_frame
from contrasta.sources.io import read_raw_csv


def test_means_of_any_size(spark):
    """Sums of doubles whatever the size of the values: one tiny value does not change how the others are summed."""
    groups = {"tiny": [3e-13, 1e-13], "huge": [2e12, 4e12, 1e300], "inf": [math.inf, 3.0], "mixed": [1e-9, 5e11, -7.25], "usual": [0.1] * 10,
              "small": [0.0011759259175, 0.00117592591758518519, 1e-4]}
    df = spark.createDataFrame([(k, d, v) for k, x in groups.items() for v in x for d in "ab"], "feature string, domain string, value double")
    got = {r.feature: (r.mean_a, r.mean_b) for r in stats.mann_whitney(df, "a", "b").collect()}
    for k, x in groups.items():
        assert all(math.isclose(m, sum(x) / len(x), rel_tol=1e-12) for m in got[k]), k


def test_text_that_is_no_number(spark):
    df = spark.createDataFrame([(1, "a", "bad"), (2, "a", "1d"), (3, "b", "0x1p3"), (4, "b", " 2.5e1 "), (5, "a", None), (6, "a", "-3")], "doc_id long, domain string, x string")
    got = {r.doc_id: r.value for r in stats.to_long(df, ["x"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 25.0, 5: None, 6: -3.0}


def test_domain_frame_from_strings(spark):
    row = {c: "0.1" for c in EMOTION_COLUMNS} | {"anger": "9.5e-05", "joy": "0.6", "doc_id": 1, "text": "so good"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in row))
    assert prepare_domain_frame(df).first().dominant_emotion == "joy"


def test_box_summary_ignores_missing(spark):
    df = spark.createDataFrame([("k", v) for v in [1.0, 2.0, 3.0, 4.0, 5.0, math.nan, None]], "key string, value double")
    r = box_summary(df, ["key"]).first()
    assert (r.n, r.n_outliers, r.median, r.whisker_low, r.whisker_high) == (5, 0, 3.0, 1.0, 5.0)


def test_escapes_are_decoded_once(spark):
    texts = ["<U+003C>U+0041> <U+0041>", "<u+1F600>x<U+D800><U+110000>", "a+b", None, "<U+0041><U+0042>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.d for r in df.orderBy("i").select(decode_unicode_escapes("t").alias("d")).collect()]
    assert got == ["<U+0041> A", "😀x<U+D800><U+110000>", "a+b", "", "AB"]


def test_formats_round_the_binary_value(spark):
    xs = [2.675, 0.125, 0.285, 1.005, 0.0625, 1234.5, -0.5, 0.004]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r.a, r.b) for r in df.select(format_mean("x").alias("a"), format_compact_p(F.abs("x")).alias("b")).collect()]
    assert [a for a, _ in got] == [f"{x:.2f}" for x in xs] and [b for _, b in got] == [f"{abs(x):.3f}" for x in xs]


def test_bootstrap_weights_use_all_bits_of_ids(spark):
    ids = [7, 7 + 3 * 2**33, 7 + 2**31, 2**62 + 7]
    df = spark.createDataFrame([(i, b) for i in ids for b in range(200)], "i long, b int")
    u = df.select("i", "b", stats.uniform_from(F.lit(42), F.col("b"), F.col("i")).alias("u")).collect()
    by = {i: np.array([r.u for r in sorted(u, key=lambda r: r.b) if r.i == i]) for i in ids}
    for a in ids:
        assert 0 <= by[a].min() and by[a].max() < 1
        assert all((by[a] != by[b]).mean() > 0.95 for b in ids if a != b)
    fn = stats._replicate_sums_fn(["g"], "i", "v", "s", 200, stats.poisson1_thresholds())
    import pandas as pd
    out = next(iter(fn([pd.DataFrame({"g": ["a"], "i": [ids[1]], "v": [1.0], "s": [42]})])))
    want = [np.searchsorted(stats.poisson1_thresholds(), r.u, side="right") for r in
            spark.range(1, 201).select(stats.uniform_from(F.lit(42), F.col("id"), F.lit(ids[1])).alias("u")).collect()]
    assert out["_sw"].tolist() == want


def test_csv_by_name_with_missing_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('tweet_text,claim\n"one, two",NaN\nNULL,"a\nb"\nN/A,none\n')
    assert [r.claim for r in read_raw_csv(spark, str(tmp_path / "a.csv"), ["claim"]).collect()] == [None, "a\nb", "none"]
    assert [r.tweet_text for r in read_raw_csv(spark, str(tmp_path / "a.csv")).collect()] == ["one, two", None, None]
