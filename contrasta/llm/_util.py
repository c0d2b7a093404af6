"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasta.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan once and keeps the
    columns compressed; ``codec`` "zstd" is for tables of texts, which it makes smaller. Lost
    executors only cost the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col):
    return F.coalesce(col.cast("string"), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
