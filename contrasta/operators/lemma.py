"""Rule-based lemmatiser: stop words removed, irregular forms from a small
dictionary, plural/3rd-person endings by the S-stemmer rules (Harman 1991) on
words longer than three letters. Row-local: no shuffle, text order kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.operators.tokens import computed_once, english_stop_words, word_tokens


def exceptions_map() -> dict[str, str]:
    return dict(lexicons.table("lemma_exceptions"))


def lemma_of(t: Column, exc: dict[str, str]) -> Column:
    """Dictionary form if listed, else the first S-stemmer rule that applies."""
    n = F.length(t)
    body3 = F.substring(t, F.lit(1), n - 3)
    body2 = F.substring(t, F.lit(1), n - 2)
    body1 = F.substring(t, F.lit(1), n - 1)
    rules = (F.when(~t.endswith("s") | (n <= 3), t)  # all endings end in s
             .when(t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies"), F.concat(body3, F.lit("y")))
             .when(t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes"),
                   F.concat(body2, F.lit("e")))
             .when(t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss"), body1)
             .otherwise(t))
    if not exc:
        return rules
    m = F.create_map(*[F.lit(x) for kv in sorted(exc.items()) for x in kv])
    return F.when(t.isin(*sorted(exc)), F.element_at(m, t)).otherwise(rules)  # the set is hashed, the map is not


def lemma_text(tokens: Column, stop_words=None, exceptions: dict[str, str] | None = None) -> Column:
    """Space-joined lemmas of the word tokens that are not stop words."""
    exc = exceptions_map() if exceptions is None else exceptions
    stops = english_stop_words() if stop_words is None else list(stop_words)
    kept = F.filter(tokens, lambda t: ~t.isin(*stops)) if stops else tokens
    return F.array_join(F.transform(kept, lambda t: lemma_of(t, exc)), " ")


def lemmatize(df: DataFrame, text_col: str = "text", out_col: str = "text_lemma",
              stop_words=None, exceptions: dict[str, str] | None = None) -> DataFrame:
    """Add ``out_col``: space-joined lemmas of the non-stop-word tokens; blank -> ''."""
    return computed_once(df, lemma_text(word_tokens(text_col), stop_words, exceptions), out_col)
