"""Source adapters: differently shaped raw tables -> the unified document schema
``doc_id, text, label, source, dataset`` (B1-B8), and the raw-label shapes the
label harmonisers take. ``*_raw`` functions derive each raw shape from the driver
tables (whole tables, Spark-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasta.functions.text import na_to_null
from contrasta.operators.dedupe import dedupe_keep_first
from contrasta.operators.labels import NAMES, TARGETS
from contrasta.sources.driver import table

# Candidate text and label columns of the general source, in priority order.
TEXT_CANDIDATES = ["tweet_text", "claim", "social_media_text", "article_headline", "article_title",
                   "false_claim", "canonical_sentence", "text"]
LABEL_CANDIDATES = ["binary_label", "veracity", "tweet_label", "claim_label", "label", "label_2",
                    "three_label"]
UNIFIED = ["doc_id", "text", "label", "source", "dataset"]
# Source tags and default dataset names written by the adapters.
SOURCE_GENERAL, DATASET_GENERAL = NAMES["source_general"], NAMES["dataset_general"]
SOURCE_HEADLINES, DATASET_HEADLINES = NAMES["source_headlines"], NAMES["dataset_headlines"]
DATASET_CLAIMS = NAMES["dataset_claims"]
SOURCE_QUOTES = DATASET_QUOTES = NAMES["source_quotes"]
SOURCE_DIRECT = DATASET_DIRECT = NAMES["source_direct"]
SOURCE_CHECK = DATASET_CHECK = NAMES["source_check"]
LABEL_SOURCES = [SOURCE_GENERAL, SOURCE_HEADLINES, SOURCE_QUOTES, SOURCE_DIRECT, SOURCE_CHECK]


def _first_present(df: DataFrame, candidates):
    cols = [na_to_null(F.col(c).cast("string")) for c in candidates if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def _default(df: DataFrame, col: str, value: str, overwrite: bool = False):
    """A column the table has stays, unless it is to be overwritten."""
    return F.col(col) if col in df.columns and not overwrite else F.lit(value)


def tag_rows(df: DataFrame, source: str, dataset: str | None = None, overwrite: bool = False) -> DataFrame:
    """Source tag and dataset name of every row; a dataset column that is there stays unless ``overwrite``."""
    name = _default(df, "dataset", source if dataset is None else dataset, overwrite)
    return df.withColumns({"source": F.lit(source), "dataset": name})


def normalize_cdl(df: DataFrame, dataset: str = DATASET_GENERAL) -> DataFrame:
    """First non-null (after NA tokens) of the candidate text and label columns."""
    return df.select("doc_id", _first_present(df, TEXT_CANDIDATES).alias("text"),
                     _first_present(df, LABEL_CANDIDATES).alias("label"), F.lit(SOURCE_GENERAL).alias("source"),
                     _default(df, "dataset", dataset).alias("dataset"))


def normalize_princeton(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("Title").alias("text"), F.lit(TARGETS[0]).alias("label"),
                     F.lit("covid").alias("domain"), F.lit(SOURCE_HEADLINES).alias("source"),
                     F.lit(DATASET_HEADLINES).alias("dataset"))


def normalize_climate_fever(df: DataFrame) -> DataFrame:
    d = df.drop("label") if "label" in df.columns else df
    d = d.withColumnsRenamed({"claim": "text", "veracity": "label"})
    return d.select("doc_id", "text", F.col("label").cast("string").alias("label"), F.lit(SOURCE_GENERAL).alias("source"),
                    _default(d, "dataset", DATASET_CLAIMS).alias("dataset"))


def normalize_quotaclimat(df: DataFrame) -> DataFrame:
    d = df.where(F.col("language") == "en").withColumnRenamed("quote", "text")
    return d.select("doc_id", "text", F.col("label").cast("string").alias("label"),
                    F.lit(SOURCE_QUOTES).alias("source"), _default(d, "dataset", DATASET_QUOTES).alias("dataset"))


def normalize_climate_fever_direct(df: DataFrame) -> DataFrame:
    d = df.withColumnsRenamed({"claim": "text", "claim_label": "label"})
    return d.select("doc_id", "text", F.col("label").cast("string").alias("label"),
                    F.lit(SOURCE_DIRECT).alias("source"),
                    _default(d, "dataset", DATASET_DIRECT).alias("dataset"))


def normalize_climatecheck(df: DataFrame) -> DataFrame:
    """Rename, then keep-first dedupe on the raw text (before labels)."""
    d = df.withColumnsRenamed({"claim": "text", "annotation": "label"})
    d = d.select("doc_id", "text", F.col("label").cast("string").alias("label"),
                 F.lit(SOURCE_CHECK).alias("source"), F.lit(DATASET_CHECK).alias("dataset"))
    return dedupe_keep_first(d, "text")


# ------------------------------------------------------------ driver-derived raw shapes

def cdl_raw(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    k4, k3 = F.col("doc_id") % 4, F.col("doc_id") % 3
    return d.select(
        "doc_id",
        F.when(k4 == 0, F.col("text")).when(k4 == 1, F.lit("na")).alias("tweet_text"),
        F.when(k4.isin(1, 2), F.col("text")).alias("claim"),
        F.col("text").alias("article_title"),
        F.when(k3 == 0, F.col("quality").cast("string")).when(k3 == 1, F.lit("n/a")).alias("binary_label"),
        F.col("toxic").cast("string").alias("label_2"),
        F.col("source").alias("dataset"))


def princeton_raw(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("Title"))


def _turns(spark, sf, role):
    c = table(spark, sf, "conversations").where(F.col("role") == role)
    return c.withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))


def climate_fever_raw(spark, sf) -> DataFrame:
    c = _turns(spark, sf, "user")
    ver = F.element_at(F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NOT_ENOUGH_INFO")),
                       (F.col("turn") % 3 + 1).cast("int"))
    return c.select("doc_id", F.col("text").alias("claim"), ver.alias("veracity"), F.lit("x").alias("label"))


def quotaclimat_raw(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    codes = F.array(*[F.lit(x) for x in ["0_not_relevant", "1_not_happening", "2_not_human", "3_not_bad",
                                         "4_solutions_harmful_unnecessary", "5_science_unreliable",
                                         "6_proponents_biased", "7_fossil_fuels_needed", "9_unlisted"]])
    lab = F.when(F.col("doc_id") % 10 == 9, F.lit(None).cast("string")) \
        .otherwise(F.element_at(codes, (F.col("doc_id") % 9 + 1).cast("int")))
    return d.select("doc_id", F.col("text").alias("quote"), lab.alias("label"), F.col("lang").alias("language"))


def climate_fever_direct_raw(spark, sf) -> DataFrame:
    c = _turns(spark, sf, "assistant")
    return c.select("doc_id", F.col("text").alias("claim"), (F.col("turn") % 5).alias("claim_label"))


def climatecheck_raw(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    ann = F.when(F.col("quality") == 0, "0_not_relevant").when(F.col("toxic") == 1, "1_misleading") \
        .otherwise(F.lit(None).cast("string"))
    return d.select("doc_id", F.col("text").alias("claim"), ann.alias("annotation"))


def normalized_sources(spark, sf) -> list[tuple[DataFrame, str]]:
    """Every source in the unified schema, with the name of its label rule."""
    return [(normalize_cdl(cdl_raw(spark, sf)), SOURCE_GENERAL),
            (normalize_princeton(princeton_raw(spark, sf)), SOURCE_HEADLINES),
            (normalize_climate_fever(climate_fever_raw(spark, sf)), SOURCE_GENERAL),
            (normalize_quotaclimat(quotaclimat_raw(spark, sf)), SOURCE_QUOTES),
            (normalize_climate_fever_direct(climate_fever_direct_raw(spark, sf)), SOURCE_DIRECT),
            (normalize_climatecheck(climatecheck_raw(spark, sf)), SOURCE_CHECK)]


def all_sources_normalized(spark, sf) -> DataFrame:
    parts = [df.select(UNIFIED) for df, _ in normalized_sources(spark, sf)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_label_sources(spark, sf) -> DataFrame:
    """``(source, doc_id, label)`` raw labels in the five label shapes."""
    lab = table(spark, sf, "labels")
    k = F.col("doc_id") % 7
    q, t = F.col("quality"), F.col("toxic")
    cdl = (F.when(k == 0, q.cast("string"))
           .when(k == 1, F.when(q == 1, "FAKE").otherwise("Real"))
           .when(k == 2, F.when(t == 1, "REFUTES").otherwise("supports"))
           .when(k == 3, q.cast("double").cast("string"))
           .when(k == 4, F.lit("TRUE"))
           .when(k == 5, F.lit(None).cast("string"))
           .otherwise(F.lit("unknown")))
    parts = [lab.select(F.lit(SOURCE_GENERAL).alias("source"), "doc_id", cdl.alias("label"))]
    parts.append(princeton_raw(spark, sf).select(F.lit(SOURCE_HEADLINES).alias("source"), "doc_id",
                                                 F.lit(TARGETS[0]).alias("label")))
    parts.append(quotaclimat_raw(spark, sf).select(F.lit(SOURCE_QUOTES).alias("source"), "doc_id", "label"))
    parts.append(climate_fever_direct_raw(spark, sf).select(
        F.lit(SOURCE_DIRECT).alias("source"), "doc_id", F.col("claim_label").cast("string").alias("label")))
    parts.append(climatecheck_raw(spark, sf).select(F.lit(SOURCE_CHECK).alias("source"), "doc_id",
                                                    F.col("annotation").alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_answers(spark, sf) -> DataFrame:
    """Free-text model answers derived from ``events`` (well-formed, partial,
    non-numeric, multi-line with trailing braces, and no JSON at all)."""
    ev = table(spark, sf, "events")
    v = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    k = F.col("event_id") % 5
    ans = (F.when(k == 0, F.concat(F.lit('Sure! {"urgency": '), v, F.lit(', "authority": 0.1, "doubt": '),
                                   F.concat(F.lit("0."), (F.col("user_id") % 10).cast("string")), F.lit("} hope it helps")))
           .when(k == 1, F.concat(F.lit('{"urgency": '), v, F.lit("}")))
           .when(k == 2, F.concat(F.lit('Here:\n{"urgency": "high",\n "doubt": '), v, F.lit('}\n{"doubt": 1}')))
           .when(k == 3, F.concat(F.lit("no idea "), F.col("event_type")))
           .otherwise(F.col("props")))
    return ev.select("event_id", ans.alias("answer"))
