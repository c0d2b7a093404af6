"""Parsing of model answers: the first ``{...}`` block (dot matches newline,
non-greedy) or the whole text when there is none, read as JSON; a missing,
unparsable or non-numeric score becomes 0.0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_RE = r"(?s)\{.*?\}"


def extract_json_object(col):
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    m = F.regexp_extract(c, OBJECT_RE, 0)
    return F.when(m != "", m).otherwise(c)


def extract_scores(df: DataFrame, answer_col: str, id_col: str,
                   fields=("urgency", "authority", "doubt")) -> DataFrame:
    """``(id, field...)`` doubles parsed from a free-text answer (default 0.0)."""
    obj = extract_json_object(answer_col)
    cols = [F.coalesce(F.get_json_object(obj, f"$.{f}").try_cast("double"), F.lit(0.0)).alias(f)
            for f in fields]
    return df.select(id_col, *cols)
