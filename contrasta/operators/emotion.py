"""Emotion distribution per document (7 scores) and the dominant emotion.

(a) Lexicon scorer: the whole text is tokenised (a user may cap it), the tokens that are cue
words are picked by a hash-set probe, and each emotion's score is its share of
the hits; a text without hits is fully ``neutral``; a blank text scores 0.0
everywhere. All within the row: no shuffle. (b) A user model can be plugged in through ``hooks.model_scores``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.functions.text import model_input, strip_ws
from contrasta.operators.rowlocal import Layers, score_rows
from contrasta.operators.tokens import matching

# The seven emotion labels, in this order.
EMOTION_COLUMNS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
CUE_EMOTIONS = [e for e in EMOTION_COLUMNS if e != "neutral"]


def default_lexicon() -> list[tuple[str, str]]:
    return [(w, e) for w, e in lexicons.table("emotion")]


def emotion_layers(text: Column, tokens: Column, lexicon=None) -> Layers:
    """Cue words of the text, and the seven scores made from them."""
    by = {e: sorted({w for w, x in (default_lexicon() if lexicon is None else lexicon) if x == e}) for e in CUE_EMOTIONS}
    hits = F.col("__emotion_hits")
    n = {e: F.size(matching(hits, by[e])) if by[e] else F.lit(0) for e in CUE_EMOTIONS}
    total = sum(n.values(), F.lit(0))
    score = {e: F.when(total == 0, 1.0).otherwise(0.0) if e == "neutral" else F.when(total == 0, 0.0).otherwise(n[e] / total) for e in EMOTION_COLUMNS}
    every = sorted(set().union(*by.values()))
    return ({"__emotion_hits": matching(tokens, every) if every else F.array().cast("array<string>"), "__blank": strip_ws(text) == ""},
            {e: F.when(F.col("__blank"), 0.0).otherwise(score[e]) for e in EMOTION_COLUMNS})


def emotion_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   lexicon=None, max_chars: int | None = None) -> DataFrame:
    """``(doc_id, anger, disgust, fear, joy, neutral, sadness, surprise)`` for every row."""
    head = F.coalesce(F.col(text_col), F.lit("")) if max_chars is None else model_input(text_col, max_chars)
    return score_rows(df.select(id_col, head.alias("__text")), "__text", [lambda x, t: emotion_layers(x, t, lexicon)]).drop("__text")


def dominant_emotion(cols=EMOTION_COLUMNS) -> Column:
    """Row-wise argmax over the emotion columns: first wins on ties, null/NaN skipped."""
    vals = [F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols]
    best = F.greatest(*vals)
    return F.element_at(F.array(*[F.lit(c) for c in cols]),
                        F.array_position(F.array(*vals), best).cast("int"))
