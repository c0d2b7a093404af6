"""Language identification by function-word profile, and the English filter.

A row function: the word tokens of a text that are function words of any language (Spark's default
stop-word lists) are picked with one hash-set probe each and counted by language; the language
with most hits wins (ties: alphabetical); no hit -> null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.functions.text import decode_unicode_escapes
from contrasta.operators.tokens import computed_once, matching, word_tokens

LANGUAGES = {"de": "stopwords_german", "en": "stopwords_english",
             "es": "stopwords_spanish", "fr": "stopwords_french"}


def language_of(text, decode: bool = True) -> Column:
    """Language code of ``text``, null when it has no function word; cleaned text needs no ``decode``."""
    langs = sorted(LANGUAGES)
    words = {lang: lexicons.words(LANGUAGES[lang]) for lang in langs}
    tokens = word_tokens(decode_unicode_escapes(text) if decode else text)

    def best(hits: Column) -> Column:
        def chosen(n: Column) -> Column:
            most = F.greatest(*[n[lang] for lang in langs])
            return F.when(most > 0, F.coalesce(*[F.when(n[lang] == most, F.lit(lang)) for lang in langs]))
        counts = F.struct(*[F.size(matching(hits, words[lang])).alias(lang) for lang in langs])
        return F.transform(F.array(counts), chosen)[0]

    # arrays of one element bind a value that is used several times
    return F.transform(F.array(matching(tokens, sorted(set().union(*words.values())))), best)[0]


def detect_language(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_detected)`` for each row with at least one function-word hit
    (left-join it: a missing row means undecidable)."""
    d = computed_once(df.select(id_col, text_col), language_of(text_col), "lang_detected")
    return d.select(id_col, "lang_detected").where(F.col("lang_detected").isNotNull())


def filter_language(df: DataFrame, lang: str = "en", text_col: str = "text") -> DataFrame:
    """Rows detected as ``lang``; blank or undecidable texts are dropped."""
    return computed_once(df, language_of(text_col), "_lang").where(F.col("_lang") == lang).drop("_lang")
