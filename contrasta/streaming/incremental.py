"""Reuse expensive scores: only documents whose ``(doc_id, text hash)`` is not in
the stored score table are scored again (an anti join).

The stored table is a log: each write is one folder ``epoch=<n>``, and writing an epoch again
replaces it. The newest row of an id holds, so a changed text replaces its stale score, and
``latest`` shows one row per id; ``compact`` writes that view as one epoch. ``score_stream`` runs a step on
every micro-batch of a streaming source (``foreachBatch``) with the batch's number as epoch, so a
replayed batch gives the same table. Log and checkpoint live in shared storage named by the caller.

Rows without id cannot be found again and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]
#: Spark's conditions for a table that is not there (or has no file yet); any other error is an error.
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def with_text_hash(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("text_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def pending(docs: DataFrame, scored: DataFrame | None, text_col: str = "text") -> DataFrame:
    """Documents without a valid stored score (new id or changed text), one row for each id and text."""
    d = with_text_hash(docs.where(F.col("doc_id").isNotNull()), text_col).dropDuplicates(["doc_id", "text_hash"])
    if scored is None:
        return d
    return d.join(scored.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")


def _fresh(todo: DataFrame, scorer: Scorer, text_col: str) -> DataFrame:
    return scorer(todo.select("doc_id", text_col)).join(todo.select("doc_id", "text_hash"), "doc_id")


def incremental_scores(docs: DataFrame, scored: DataFrame | None, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Stored scores that are still valid, plus fresh scores for the rest."""
    fresh = _fresh(pending(docs, scored, text_col), scorer, text_col)
    if scored is None:
        return fresh
    valid = scored.join(with_text_hash(docs, text_col).select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    return valid.unionByName(fresh)


def stored_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """The log at ``path``, or None if there is none; a table that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in MISSING:
            return None
        raise


def latest(log: DataFrame) -> DataFrame:
    """One row per id: that of its newest epoch."""
    rest = [c for c in log.columns if c != "doc_id"]
    newest = log.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("epoch", "text_hash")).alias("r"))
    return newest.select("doc_id", "r.*")


def upsert_scores(docs: DataFrame, path: str, scorer: Scorer, epoch: int, text_col: str = "text") -> None:
    """Score what the epochs before ``epoch`` do not hold and write it as that epoch, in place of an earlier try."""
    log = stored_scores(docs.sparkSession, path)
    before = None if log is None else latest(log.where(F.col("epoch") < epoch))
    _fresh(pending(docs, before, text_col), scorer, text_col).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def compact(spark: SparkSession, path: str, target: str, epoch: int) -> None:
    """The newest rows of the log at ``path`` as one epoch of a new log at ``target``."""
    log = stored_scores(spark, path)
    if log is not None:
        latest(log).drop("epoch").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")


def score_stream(stream: DataFrame, scorer: Scorer, sink_path: str, checkpoint_path: str, text_col: str = "text", trigger_once: bool = True):
    """Score each micro-batch of ``stream`` that ``sink_path`` does not hold yet; the batch's number is its epoch."""
    def step(batch: DataFrame, epoch: int) -> None:
        upsert_scores(batch, sink_path, scorer, epoch, text_col)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
