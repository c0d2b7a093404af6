"""The driver's parquet tables as corpus sources.

``documents`` is the corpus (``source`` column = dataset name). Datasets
``src0``-``src7`` form the first domain (``covid``), ``src8``-``src14`` the second
(``climate``), the rest ``general``. Derived views (decorated texts, raw-label
shapes) are computed by Spark from the tables so their work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN_A, DOMAIN_B = "covid", "climate"
DRIVER_DOMAIN_RULES = {**{f"src{i}": DOMAIN_A for i in range(0, 8)},
                       **{f"src{i}": DOMAIN_B for i in range(8, 15)}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the unified schema ``doc_id, text, label, source, dataset``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.lit(None).cast("string").alias("label"),
                    F.lit("documents").alias("source"), F.col("source").alias("dataset"))


def decorated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the cleaning edge cases added by ``doc_id % 8``:
    retweet prefix, URL, hashtags, emoji in/out of range, escapes, contractions,
    surrounding whitespace, empty/null."""
    d = table(spark, sf_dir, "documents")
    t, k = F.col("text"), F.col("doc_id") % 8
    dec = (F.when(k == 0, F.concat(F.lit("RT @user1: "), t))
           .when(k == 1, F.concat(t, F.lit(" https://x.example/a?b=1")))
           .when(k == 2, F.concat(t, F.lit(" #Tag ##two")))
           .when(k == 3, F.concat(F.lit("\U0001F600"), t, F.lit(" \U0001F923 ✅x")))
           .when(k == 4, F.concat(t, F.lit(" <U+0430><u+1F600>")))
           .when(k == 5, F.concat(t, F.lit(" don't won't Can't")))
           .when(k == 6, F.concat(F.lit("\t\n "), t, F.lit("\r\n  ")))
           .otherwise(F.when(F.col("doc_id") % 16 == 7, F.lit(None).cast("string")).otherwise(F.lit(""))))
    return d.select("doc_id", dec.alias("text"), "lang", "source")
