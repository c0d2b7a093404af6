"""Readers and writers: raw CSV with an all-string schema, JSON reports, the
partitioned processed tables, and landing a table from one format to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasta.functions.text import na_to_null


# Cells that a table reader takes as missing by default, then the sources' own marks.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null", "na")


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None, na_tokens=NA_TOKENS) -> DataFrame:
    """Header CSV with quoted multi-line fields; every column a string (no inference
    pass), NA tokens mapped to null. ``columns`` are chosen by name from the header."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    names = df.columns if columns is None else columns
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"{path} has no columns: {', '.join(missing)}")
    return df.select(*[na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in names])


def read_json_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "domain",
                    mode: str = "overwrite") -> None:
    """Write the unified documents, one folder per domain (partition pruning on read)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("quoteAll", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)


def read_processed(spark: SparkSession, path: str, domains, partition_by: str = "domain", schema=None) -> DataFrame:
    """Documents of the wanted domains from ``write_processed`` (Parquet); files of other domains are not opened.

    ``domains`` is a list, or a DataFrame with that column: its distinct values are broadcast and
    prune partitions while the job runs. With ``schema`` no file is opened to learn it.
    """
    stored = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if isinstance(domains, DataFrame):
        wanted = domains.select(partition_by).distinct()  # names of domains: as few as there are folders
        return stored.join(F.broadcast(wanted), partition_by, "left_semi").select(stored.columns)
    return stored.where(F.col(partition_by).isin(*domains))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested payload rows as JSON lines."""
    df.write.mode(mode).json(path)


def land(spark: SparkSession, src: str, src_fmt: str, dst: str, dst_fmt: str = "parquet",
         options: dict | None = None) -> None:
    """Land a raw table: read it in one format and write it in another."""
    spark.read.format(src_fmt).options(**(options or {})).load(src).write.mode("overwrite").format(dst_fmt).save(dst)
