"""Feature table keyed by ``doc_id``: lemmas, emotions, sentiment, rhetoric,
corpus counts and the dominant emotion. All scorers share one tokenisation within
the row: no shuffle or join between the corpus and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasta.functions.text import char_count, strip_ws, word_count
from contrasta.operators.emotion import EMOTION_COLUMNS, dominant_emotion, emotion_layers
from contrasta.operators.lemma import lemma_text, lemmatize
from contrasta.operators.rhetoric import add_alias_scores, finish, rhetoric_layers
from contrasta.operators.rowlocal import score_rows
from contrasta.operators.sentiment import VADER_COLUMNS, sentiment_layers
from contrasta.operators.stats import numeric

TRUST_CUE_COLUMNS = ["auth_score", "urg_score"]
CORPUS_COLUMNS = ["char_count", "word_count"]
FEATURE_GROUPS = [("vader", VADER_COLUMNS), ("emotion", EMOTION_COLUMNS),
                  ("corpus", CORPUS_COLUMNS), ("trust_cue", TRUST_CUE_COLUMNS)]


def with_lemmas(corpus: DataFrame) -> DataFrame:
    """Lemma text added; documents whose lemma text is blank are dropped."""
    d = lemmatize(corpus, "text", "text_lemma")
    return d.where(strip_ws("text_lemma") != "")


def feature_table(corpus: DataFrame, lemmas: bool = True) -> DataFrame:
    """All features of every document, row by row; documents with blank lemmas are dropped if ``lemmas``."""
    f = score_rows(corpus, "text", [emotion_layers, sentiment_layers, rhetoric_layers], lemma_text if lemmas else None)
    f = add_alias_scores(finish(f))
    return (f.withColumn("char_count", char_count("text"))
             .withColumn("word_count", word_count("text"))
             .withColumn("dominant_emotion", dominant_emotion()))


def prepare_domain_frame(df: DataFrame) -> DataFrame:
    """A feature table read back from storage: requires ``text`` and the seven
    emotion columns (error names the missing ones), null text -> '', adds counts
    and the dominant emotion, and completes the sentiment columns."""
    from contrasta.operators._util import require_columns
    from contrasta.operators.sentiment import ensure_sentiment
    require_columns(df, ["text"], "domain frame")
    require_columns(df, EMOTION_COLUMNS, "domain frame (emotion columns)")
    numbers = [c for c in EMOTION_COLUMNS + VADER_COLUMNS if c in df.columns]  # text in a table read from CSV
    d = df.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit("")),
                        **{c: numeric(F.col(c).cast("string")) for c in numbers}})
    d = (d.withColumn("char_count", char_count("text")).withColumn("word_count", word_count("text"))
          .withColumn("dominant_emotion", dominant_emotion()))
    return ensure_sentiment(d, "text")
