"""Tokenisers, stop-word removal and n-grams shared by the text operators."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons

# Words (letters/digits/underscore) with optional apostrophe suffixes: "don't" stays one token.
WORD_TOKEN_RE = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*"
# TF-IDF token pattern: runs of two or more ASCII letters, after lower-casing.
TFIDF_TOKEN_RE = r"[a-zA-Z]{2,}"


def english_stop_words() -> list[str]:
    """Spark's default English stop-word list (181 words)."""
    return list(lexicons.words("stopwords_english"))


def word_tokens(col) -> Column:
    """Lower-cased word tokens in text order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD_TOKEN_RE), 0)


def tfidf_tokens(col) -> Column:
    """Lower-case, then every match of ``[a-zA-Z]{2,}`` (no word boundary)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TFIDF_TOKEN_RE), 0)


def remove_stop_words(df: DataFrame, in_col: str, out_col: str, stop_words=None) -> DataFrame:
    """Drop stop words from an array column, order kept (hash-set lookup in the JVM)."""
    words = english_stop_words() if stop_words is None else list(stop_words)
    return StopWordsRemover(inputCol=in_col, outputCol=out_col, stopWords=words,
                            caseSensitive=True).transform(df)


def ngrams(col, n_min: int = 1, n_max: int = 2) -> Column:
    """All n-grams for n in [n_min, n_max] over a token array, joined by one space,
    unigrams first, then bigrams, ... each in text order. Built with ``zip_with`` over
    shifted slices (no per-element array allocation)."""
    arr = F.col(col) if isinstance(col, str) else col
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(arr)
            continue
        width = F.greatest(F.size(arr) - n + 1, F.lit(0))
        grams = F.slice(arr, 1, width)
        for j in range(1, n):
            grams = F.zip_with(grams, F.slice(arr, j + 1, width),
                               lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def once(expr: Column) -> Column:
    """``expr``, evaluated once for each row however often the column is used.

    Catalyst substitutes the expression of a column into filters and projections above it, so an
    expensive one is computed again for each use (within a lambda for each element). It leaves
    non-deterministic columns alone; the condition, which always holds, makes this one such.
    """
    return F.when(F.spark_partition_id() >= 0, expr)


def computed_once(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Add ``name = expr`` so that later uses of it do not re-evaluate ``expr``."""
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, once(expr).alias(name))


def matching(tokens: Column, words) -> Column:
    """The tokens that are among ``words``: one hash-set probe for each token."""
    return F.filter(tokens, lambda t: t.isin(*words))
