import pytest
from pyspark.sql import functions as F

from contrasta.operators.dedupe import dedupe_keep_first, keep_first_rows
from contrasta.operators.domains import assign_domain, domain_rules, drop_credible
from contrasta.operators.labels import DROP, KEEP, TARGETS, harmonize_by_source, harmonize_labels
from contrasta.operators.sentiment import VADER_COLUMNS, ensure_sentiment
from contrasta.plans.preprocess import IDS_PER_SOURCE, prepare_sources
from contrasta.sources import normalize as nz

FALSE, TRUE = TARGETS


def test_cdl_labels(spark):
    rows = [(1, "1"), (2, "0"), (3, "FAKE"), (4, "1.0"), (5, None), (6, "TRUE"), (7, "weird"), (8, "Supports")]
    df = spark.createDataFrame(rows, "doc_id int, label string")
    got = {r.doc_id: r.label for r in harmonize_labels(df, "cdl").collect()}
    assert got == {1: FALSE, 2: TRUE, 3: FALSE, 6: TRUE, 8: TRUE}


def test_quote_labels_pass_unmapped(spark):
    df = spark.createDataFrame([(1, "0_not_relevant"), (2, "5_science_unreliable"), (3, "x_new"), (4, None)],
                               "doc_id int, label string")
    got = {r.doc_id: r.label for r in harmonize_labels(df, "quotaclimat").collect()}
    assert got == {1: TRUE, 2: FALSE, 3: "x_new"}


def test_direct_and_check_labels(spark):
    df = spark.createDataFrame([(1, "0"), (2, "1"), (3, "2"), (4, "3"), (5, "4"), (6, "1.0")], "doc_id int, label string")
    got = {r.doc_id: r.label for r in harmonize_labels(df, "climate_fever_direct").collect()}
    assert got == {1: TRUE, 2: FALSE, 6: FALSE}
    df = spark.createDataFrame([(1, "0_ok"), (2, "1_bad"), (3, None)], "doc_id int, label string")
    got = {r.doc_id: r.label for r in harmonize_labels(df, "climatecheck").collect()}
    assert got == {1: TRUE, 2: FALSE, 3: FALSE}


def test_unknown_source_raises_before_job(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id int, label string")
    with pytest.raises(ValueError, match="Unknown source"):
        harmonize_labels(df, "nope")


def test_domain_rules_later_wins(spark):
    rules = domain_rules(covid=["a", "b"], climate=["b"])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "doc_id int, dataset string")
    got = {r.doc_id: r.domain for r in assign_domain(df, rules).collect()}
    assert got == {1: "covid", 2: "climate", 3: "general", 4: "general"}


def test_drop_credible_keeps_null(spark):
    df = spark.createDataFrame([(1, TRUE), (2, None), (3, FALSE)], "doc_id int, label string")
    assert sorted(r.doc_id for r in drop_credible(df).collect()) == [2, 3]


def test_dedupe_keep_first_and_idempotent(spark):
    rows = [(5, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", "y"), (1, None, "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    once = dedupe_keep_first(df, within=("domain",))
    assert sorted(r.doc_id for r in once.collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in dedupe_keep_first(once, within=("domain",)).collect()) == [1, 2, 3, 4]


def test_dedupe_plan_combines_before_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedupe_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_normalize_cdl_coalesce_and_na(spark):
    df = spark.createDataFrame([(1, "na", "claim text", None, "n/a", "1")],
                               "doc_id int, tweet_text string, claim string, text string, binary_label string, label string")
    r = nz.normalize_cdl(df).first()
    assert (r.text, r.label, r.source, r.dataset) == ("claim text", "1", "cdl", "complexdatalab")


def test_ensure_sentiment_replaces_partial_columns(spark):
    df = spark.createDataFrame([(1, "example one", 0.5), (2, "example two", -0.2)],
                               "doc_id long, text string, vader_compound double")
    out = ensure_sentiment(df)
    assert [c for c in out.columns if c.startswith("vader_")] == VADER_COLUMNS
    assert out.count() == 2


def test_one_broadcast_join_serves_all_sources(spark):
    rows = [(1, "cdl", "1"), (2, "quotaclimat", "0_not_relevant"), (3, "climatecheck", None), (4, "climate_fever_direct", "1.0"), (5, "princeton", None),
            (6, "climate_fever_direct", "2"), (7, "quotaclimat", None), (8, "cdl", "odd")]
    df = spark.createDataFrame(rows, "doc_id int, s string, label string")
    out = harmonize_by_source(df, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("Join") == 1 and "Union" not in plan
    assert {r.doc_id: r.label for r in out.collect()} == {1: FALSE, 2: TRUE, 3: FALSE, 4: FALSE, 5: None}
    one = {i: [r.label for r in harmonize_labels(df.where(f"doc_id = {i}"), s).collect()] for i, s, _ in rows}
    assert {i: x[0] for i, x in one.items() if x} == {r.doc_id: r.label for r in out.collect()}
    with pytest.raises(Exception, match="Unknown source: nope"):
        harmonize_by_source(df.withColumn("s", F.lit("nope")), "s").collect()


def test_own_rules_and_unmapped_policy(spark):
    table = [("m", "prefix", "no", FALSE, 2), ("m", "exact", "not sure", DROP, 1), ("m", "numeric", "2", TRUE, 1), ("m", "folded", "yes", TRUE, 1)]
    df = spark.createDataFrame([(1, "no way"), (2, "not sure"), (3, "2.0"), (4, "YES"), (5, "what"), (6, None)], "doc_id int, label string")
    for policy, rest in ((None, {}), (DROP, {}), (KEEP, {5: "what", 6: None}), ("other", {5: "other", 6: "other"})):
        got = {r.doc_id: r.label for r in harmonize_labels(df, "m", table=table, on_unmapped=policy).collect()}
        assert got == {1: FALSE, 3: TRUE, 4: TRUE} | rest
    with pytest.raises(ValueError, match="kind"):
        harmonize_labels(df, "m", table=[("m", "guess", "x", "y", 1)])


def test_tag_rows(spark):
    df = spark.createDataFrame([(1, "own")], "doc_id int, dataset string")
    assert [nz.tag_rows(df, "s", "d").first().dataset, nz.tag_rows(df, "s", "d", overwrite=True).first().dataset] == ["own", "d"]
    assert nz.tag_rows(df.drop("dataset"), "s").first().dataset == "s"


def test_ids_of_sources_never_collide(spark):
    schema = "doc_id long, text string, label string, source string, dataset string"
    rows = [(10**15 + 1, "one text of the first source", "fake", "g", "coaid"), (IDS_PER_SOURCE - 1, "the last id of that source", "fake", "g", "coaid")]
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "the text of another source", "fake", "g", "coaid")], schema)
    got = prepare_sources([(one, "cdl"), (two, "cdl")], english_domain=None).collect()
    assert sorted(r.doc_id for r in got) == [10**15 + 1, IDS_PER_SOURCE - 1, IDS_PER_SOURCE + 1]
    for bad in (-1, IDS_PER_SOURCE):
        with pytest.raises(Exception, match="outside a source"):
            prepare_sources([(two.withColumn("doc_id", F.lit(bad).cast("long")), "cdl")], english_domain=None).collect()


def test_check_alignment_raises_on_mismatch(spark):
    from contrasta.operators._util import check_alignment
    a = spark.createDataFrame([(1,), (2,)], "doc_id long")
    b = spark.createDataFrame([(1,), (3,)], "doc_id long")
    check_alignment(a, a)
    with pytest.raises(ValueError):
        check_alignment(a, b)


def test_keep_first_rows_agrees_and_leaves_one_row_per_text(spark):
    rows = [(5, "a", "x", 1), (2, "a", "x", 2), (3, "b", "x", 3), (4, "a", "y", 4), (1, None, "x", 5), (6, None, "x", 6), (None, "c", "x", 7),
            (2, "a", "x", 8), (9, "", None, 9), (8, "", None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, v int")
    got = keep_first_rows(df, within=("domain",))
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.domain) for r in got.where("text is not null and domain is not null").collect()) == [
        (2, "a", "x"), (3, "b", "x"), (4, "a", "y")]
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 8]
    assert keep_first_rows(df.limit(0), within=("domain",)).count() == 0


def test_sources_become_one_corpus_with_unique_ids(spark):
    schema = "doc_id long, text string, label string, source string, dataset string"
    one = spark.createDataFrame([(1, "the virus is a plot", "fake", "g", "coaid"), (2, "the virus is real", "true", "g", "coaid"),
                                 (3, "el virus es de los otros", "fake", "g", "coaid")], schema)
    two = spark.createDataFrame([(1, "The virus is a plot", FALSE, "h", "headlines"), (2, "the flu is new", FALSE, "h", "headlines")],
                                schema).withColumn("domain", F.lit("covid"))
    got = prepare_sources([(one, "cdl"), (two, "princeton")]).collect()
    assert sorted((r.doc_id, r.text, r.domain) for r in got) == [
        (1, "the virus is a plot", "covid"), (IDS_PER_SOURCE + 2, "the flu is new", "covid")]
