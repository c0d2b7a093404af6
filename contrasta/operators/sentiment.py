"""Lexicon sentiment (valence rules after Hutto & Gilbert 2014) as a Spark job.

Per valenced token: booster words up to three tokens back add +/-0.293 (damped
0.95 / 0.9 at distance 2 / 3), each negation word in those three positions
multiplies by -0.74, and a ``but`` scales earlier valences by 0.5 and later ones
by 1.5. Per document: ``!`` (at most 4) adds 0.292 each and 2-3 ``?`` add 0.18
each (more: 0.96) to the dominant side; ``compound = s / sqrt(s^2 + 15)``;
``pos``/``neg``/``neu`` are shares of positive (+1 per word), negative (-1 per
word) and neutral-word mass. Tokens of one character are ignored.

Caps: where some but not all words of a text are in capitals, 0.733 goes to the side of a valenced
token in capitals, and to a booster in capitals before the damping. Lower-cased corpora skip this.

A row function: positions of valenced tokens are picked by a hash-set probe, and each looks back
by index. No explode, join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.operators.rowlocal import Layers, score_rows
from contrasta.operators.tokens import WORD_TOKEN_RE, word_tokens

VADER_COLUMNS = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]
NEGATION_SCALAR = -0.74
ALPHA = 15.0
# Fixed value: what a word in capitals adds.
CAPS = 0.733


def default_lexicon() -> dict[str, float]:
    return {w: float(v) for w, v in lexicons.table("sentiment")}


def default_modifiers():
    rows = lexicons.table("sentiment_modifiers")
    neg = sorted(w for w, k, _ in rows if k == "negation")
    boost = {w: float(v) for w, k, v in rows if k == "booster"}
    return neg, boost


def sentiment_tokens(col) -> Column:
    return _longer(word_tokens(col))


def _longer(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > 1)


def _value_of(t: Column, values: dict[str, float]) -> Column:
    """The value of a token that is among the keys: one set of words for each value."""
    by: dict[float, list[str]] = {}
    for w, v in sorted(values.items()):
        by.setdefault(float(v), []).append(w)
    return F.coalesce(*[F.when(t.isin(*ws), F.lit(v)) for v, ws in sorted(by.items())], F.lit(0.0))


def sentiment_layers(text: Column, tokens: Column, lexicon: dict[str, float] | None = None, negations=None,
                     boosters: dict[str, float] | None = None) -> Layers:
    """Valences of the text's valenced tokens, and the four scores made from them."""
    lex = default_lexicon() if lexicon is None else lexicon
    dneg, dboost = default_modifiers()
    negs = dneg if negations is None else list(negations)
    boost = dboost if boosters is None else boosters

    def valences(x: Column) -> Column:
        """``x``: tokens, the place of ``but`` and, where capitals matter, the tokens as written."""
        def valence(i: Column) -> Column:
            def emphasis(at: Column, size: float) -> Column:
                raw = F.get(x["raw"], at)
                return F.when(x["raw"].isNotNull() & (raw == F.upper(raw)) & (raw != F.lower(raw)), size).otherwise(0.0)

            def before(k: int, damped: float) -> Column:
                p = F.get(x["t"], i - k)
                b = _value_of(p, boost) if boost else F.lit(0.0)
                loud = F.when(b != 0, b + F.when(b > 0, 1.0).otherwise(-1.0) * emphasis(i - k, CAPS)).otherwise(0.0)
                n = F.when(p.isin(*negs), NEGATION_SCALAR).otherwise(1.0) if negs else F.lit(1.0)
                return F.struct((loud * damped).alias("b"), n.alias("n"))

            def sign(v: Column) -> Column:
                return F.when(v < 0, -1.0).otherwise(1.0)

            start = F.transform(F.array(_value_of(F.get(x["t"], i), lex)), lambda v: v + sign(v) * emphasis(i, CAPS))[0]
            s = F.aggregate(F.array(before(1, 1.0), before(2, 0.95), before(3, 0.9)), start, lambda v, k: (v + k["b"] * sign(v)) * k["n"])
            but = x["but"]
            return s * F.when((but > 0) & (i + 1 < but), 0.5).when((but > 0) & (i + 1 > but), 1.5).otherwise(1.0)

        places = F.when(F.size(x["t"]) > 0, F.filter(F.sequence(F.lit(0), F.size(x["t"]) - 1), lambda i: F.get(x["t"], i).isin(*sorted(lex))))
        return F.coalesce(F.transform(places, valence), F.array().cast("array<double>"))

    low = _longer(tokens)
    written = F.when(text != F.lower(text), _longer(F.regexp_extract_all(text, F.lit(WORD_TOKEN_RE), 0)))
    capital = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    some = lambda x: F.exists(x, capital) & ~F.forall(x, capital)
    raw = F.transform(F.array(written), lambda x: F.when(some(x), x))[0]
    parts = F.struct(low.alias("t"), raw.alias("raw"))
    bound = F.transform(F.array(parts), lambda x: F.struct(
        x["t"].alias("t"), F.array_position(x["t"], "but").alias("but"), F.when(F.size(x["raw"]) == F.size(x["t"]), x["raw"]).alias("raw")))[0]

    n_excl = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(4))
    n_q = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    ep = n_excl * 0.292 + F.when(n_q > 1, F.when(n_q <= 3, n_q * 0.18).otherwise(0.96)).otherwise(0.0)

    vals, ep_c, n_words = F.col("__valences"), F.col("__emphasis"), F.col("__n_words")
    add = lambda f: F.aggregate(vals, F.lit(0.0), lambda a, v: a + f(v))
    sum_s = add(lambda v: v)
    adj = F.when(sum_s > 0, sum_s + ep_c).when(sum_s < 0, sum_s - ep_c).otherwise(sum_s)
    compound = F.greatest(F.least(adj / F.sqrt(adj * adj + ALPHA), F.lit(1.0)), F.lit(-1.0))
    pos_sum = add(lambda v: F.when(v > 0, v + 1.0).otherwise(0.0))
    neg_sum = add(lambda v: F.when(v < 0, v - 1.0).otherwise(0.0))
    pos2 = F.when(pos_sum > F.abs(neg_sum), pos_sum + ep_c).otherwise(pos_sum)
    neg2 = F.when(pos_sum < F.abs(neg_sum), neg_sum - ep_c).otherwise(neg_sum)
    neu = (n_words - F.size(F.filter(vals, lambda v: v != 0))).cast("double")
    total = pos2 + F.abs(neg2) + neu
    has, z = n_words > 0, F.lit(0.0)
    # shares are reported to 3 decimals and compound to 4, as the lexicon method does
    return ({"__valences": F.transform(F.array(bound), valences)[0], "__n_words": F.size(low), "__emphasis": ep},
            {"vader_neg": F.round(F.when(has, F.abs(neg2 / total)).otherwise(z), 3),
             "vader_neu": F.round(F.when(has, F.abs(neu / total)).otherwise(z), 3),
             "vader_pos": F.round(F.when(has, F.abs(pos2 / total)).otherwise(z), 3),
             "vader_compound": F.round(F.when(has, compound).otherwise(z), 4)})


def sentiment_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     lexicon: dict[str, float] | None = None, negations=None,
                     boosters: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, vader_neg, vader_neu, vader_pos, vader_compound)`` for every row."""
    texts = df.select(id_col, F.col(text_col).alias("__text"))
    return score_rows(texts, "__text", [lambda x, t: sentiment_layers(x, t, lexicon, negations, boosters)]).drop("__text")


def polarity_class(compound) -> Column:
    """positive above 0.05, negative below -0.05, else neutral."""
    c = F.col(compound) if isinstance(compound, str) else compound
    return F.when(c > 0.05, "positive").when(c < -0.05, "negative").otherwise("neutral")


def ensure_sentiment(df: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """Keep a complete set of the four sentiment columns; if any is missing, drop the
    partial set and recompute all four (appended in their fixed order)."""
    if all(c in df.columns for c in VADER_COLUMNS):
        return df
    base = df.drop(*[c for c in VADER_COLUMNS if c in df.columns])
    return score_rows(base, text_col, [lambda x, t: sentiment_layers(x, t, **kw)])
