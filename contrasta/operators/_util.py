"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest lookup table shipped to every task as a broadcast; above it a shuffle join is used.
MAX_BROADCAST_ROWS = 200_000


def lookup_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small driver-side table (label maps, lexicons) with a checked size."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    ``scalar`` is a global aggregate (exactly one row), so it is broadcast and
    joined on a constant key: no shuffle of ``df`` and no growth of rows.
    """
    return (df.withColumn("__one", F.lit(1))
            .join(F.broadcast(scalar.withColumn("__one", F.lit(1))), "__one")
            .drop("__one"))


def require_columns(df: DataFrame, required, what: str = "input") -> None:
    """Raise ``ValueError`` naming missing columns (schema only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing expected columns: {', '.join(missing)}")


def check_alignment(left: DataFrame, right: DataFrame, key: str = "doc_id") -> None:
    """Raise when the two tables do not hold the same keys (anti joins both ways)."""
    if not left.select(key).join(right.select(key), key, "left_anti").isEmpty() or \
            not right.select(key).join(left.select(key), key, "left_anti").isEmpty():
        raise ValueError("TF-IDF rows do not match the documents of the domain tables.")
