"""Rhetoric scores (urgency, authority, doubt) in [0, 1] with presence flags and the
authority-to-doubt ratio.

(a) Cue lexicon: ``least(1, hits * weight / tokens)`` per strategy, cue tokens picked by a
hash-set probe within the row: no shuffle.
(b) A model answer (free text holding a JSON object) is parsed by
``functions.parse.extract_scores`` and finished by ``finish``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.operators.rowlocal import Layers, score_rows
from contrasta.operators.tokens import matching

STRATEGIES = ["urgency", "authority", "doubt"]
RATIO_EPS = 1e-6


def default_cues() -> list[tuple[str, str]]:
    return [(c, s) for c, s in lexicons.table("rhetoric")]


def finish(df: DataFrame) -> DataFrame:
    """Add ``*_presence`` (score > 0) and ``authority_to_doubt_ratio``."""
    out = df
    for s in STRATEGIES:
        out = out.withColumn(f"{s}_presence", (F.col(s) > 0).cast("int"))
    return out.withColumn("authority_to_doubt_ratio", F.col("authority") / (F.col("doubt") + RATIO_EPS))


def rhetoric_layers(text: Column, tokens: Column, cues=None, weight: float = 10.0) -> Layers:
    """Cue words of the text, and the three scores made from them."""
    by = {s: sorted({c for c, x in (default_cues() if cues is None else cues) if x == s}) for s in STRATEGIES}
    every, n, hits = sorted(set().union(*by.values())), F.col("__n_tokens"), F.col("__rhetoric_hits")
    score = {s: F.least(F.lit(1.0), F.size(matching(hits, by[s])) * weight / n) if by[s] else F.lit(0.0) for s in STRATEGIES}
    return ({"__rhetoric_hits": matching(tokens, every) if every else F.array().cast("array<string>"), "__n_tokens": F.size(tokens)},
            {s: F.when(n > 0, score[s]).otherwise(0.0) for s in STRATEGIES})


def rhetoric_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    cues=None, weight: float = 10.0) -> DataFrame:
    """``(doc_id, urgency, authority, doubt, *_presence, authority_to_doubt_ratio)`` for every row."""
    texts = df.select(id_col, F.col(text_col).alias("__text"))
    return finish(score_rows(texts, "__text", [lambda x, t: rhetoric_layers(x, t, cues, weight)]).drop("__text"))


def add_alias_scores(df: DataFrame) -> DataFrame:
    """``auth_score`` / ``urg_score`` copies when the source columns exist."""
    out = df
    if "authority" in df.columns:
        out = out.withColumn("auth_score", F.col("authority"))
    if "urgency" in df.columns:
        out = out.withColumn("urg_score", F.col("urgency"))
    return out
