"""Row-local scoring: all lexicon scorers of a text in one projection, without a shuffle.

A text is tokenised once. Each scorer gives two layers of columns: what it picks from the tokens
(few hits), and scores made from the hits. Several scorers share the tokens, and the layers of all of them are
three projections within the stage of the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta.operators.tokens import computed_once, once, word_tokens

#: Hit columns (names start with two underscores), and score columns made from them.
Layers = tuple[dict[str, Column], dict[str, Column]]
TOKENS = "__tokens"


def score_rows(df: DataFrame, text_col: str, scorers: Iterable[Callable[[Column, Column], Layers]],
               lemmas: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the score columns of all ``scorers`` to every row; a null text counts as empty.

    ``lemmas`` adds ``text_lemma`` from the same tokens; rows whose lemma text is blank are dropped.
    """
    keep = [c for c in df.columns if not (lemmas and c == "text_lemma")]
    d = computed_once(df, word_tokens(text_col), TOKENS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [s(text, F.col(TOKENS)) for s in scorers]
    hits = {name: once(c) for picked, _ in found for name, c in picked.items()}
    if lemmas:
        hits["text_lemma"] = once(lemmas(F.col(TOKENS)))
    scores = {name: c for _, made in found for name, c in made.items()}
    d = d.select(*keep, *[c.alias(name) for name, c in hits.items()])
    if lemmas:
        d, keep = d.where(F.trim("text_lemma") != ""), [*keep, "text_lemma"]
    return d.select(*[c for c in keep if c not in scores], *[c.alias(name) for name, c in scores.items()])
