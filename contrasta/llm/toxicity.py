"""Toxicity by a classifier chain over categories.

The categories have an order. The linear model of a category sees the hashed words of a text and
the probabilities that the earlier categories' models give it. In training these probabilities are
out of fold: each comes from a model that has not seen the row, so later models learn how far the
earlier ones can be trusted. For prediction one model per category is fitted on all sampled rows.

``fit`` takes 0/1 labels per category; ``with_term_categories`` derives the first two from a plain
label by the words of two lists. The fit uses at most ``sample_rows`` labelled rows
of each value of the last category, drawn by a seeded hash of the id; row weights restore the shares
they have among all labelled rows.

Defined cases: null texts, empty texts and texts without a letter have probability 0 in every
category; null labels count as unlabelled; without labelled rows of both values every probability is
0; very long texts are read whole; repeated rows and null ids are scored row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BITS = 18
_WORDS = re.compile(r"[^\W\d_]+")

# Names called, and words of contempt.
INSULTS = ("clown", "fool", "idiot", "idiots", "imbecile", "jerk", "loser", "losers", "moron", "morons", "stupid")
CONTEMPT = ("disgusting", "filth", "garbage", "pathetic", "scum", "trash", "vermin", "worthless")


class Hasher:
    """Distinct lower-cased words of a text as ascending positions."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self._known, set()
        for w in set(_WORDS.findall((text or "").lower())):
            h = known.get(w)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w) >> (64 - BITS)
            out.add(h)
        return np.sort(np.fromiter(out, dtype=np.int32, count=len(out)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(idx: np.ndarray, ends: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, *, rounds: int = 80, l2: float = 1e-4,
               least_rows: int = 3) -> np.ndarray:
    """Logistic regression by Adam. Row i has the words idx[ends[i]:ends[i + 1]] and the dense columns
    extra[i]. A word's value is the log ratio of its shares in the rows of either label, so words that
    say nothing are small; words of fewer than ``least_rows`` rows are left out. Returns weights of
    words (times their values), then of the columns, then the bias.
    """
    words, k = 1 << BITS, extra.shape[1]
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    pos, neg = (np.bincount(idx[part[row]], minlength=words) for part in (y > 0.5, y <= 0.5))
    ratio = np.log((pos + 1) / ((y > 0.5).sum() + 2)) - np.log((neg + 1) / ((y <= 0.5).sum() + 2))
    kept = (pos + neg >= least_rows)[idx]
    used, at = np.unique(idx[kept], return_inverse=True)
    row, value = row[kept], ratio[idx[kept]]
    w, m, v = (np.zeros(len(used) + k + 1) for _ in range(3))
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[at] * value, minlength=len(y)) + extra @ w[len(used):-1] + w[-1]
        g = weight * (sigmoid(z) - y)
        grad = np.concatenate([np.bincount(at, weights=g[row] * value, minlength=len(used)), g @ extra, [g.sum()]])
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-3)
    out = np.zeros(words + k + 1)
    out[used], out[words:] = w[:len(used)] * ratio[used], w[len(used):]
    return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class ChainModel:
    categories: tuple[str, ...]
    weights: list[np.ndarray]

    def row(self, idx: np.ndarray) -> list[float]:
        """Probabilities of one text's categories, each fed to the next."""
        earlier: list[float] = []
        for w in self.weights:
            z = w[idx].sum() + w[-1]
            if earlier:
                z += logit(np.array(earlier)) @ w[1 << BITS:-1]
            earlier.append(float(sigmoid(z)))
        return earlier

    def probabilities(self, text: Column) -> Column:
        """struct with one double per category."""
        model = self

        @pandas_udf(", ".join(f"{c} double" for c in self.categories))
        def chained(texts: pd.Series) -> pd.DataFrame:
            hasher, out = Hasher(), []
            for t in texts:
                idx = hasher(t)
                out.append(model.row(idx) if len(idx) and model.weights else [0.0] * len(model.categories))
            return pd.DataFrame(out, columns=list(model.categories))
        return chained(text)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, categories: tuple[str, ...], folds: int = 3, **linear) -> ChainModel:
    """``labels`` [rows, categories]. Later models see out-of-fold probabilities of earlier ones."""
    n = len(rows)
    fold = np.arange(n) % folds
    ends = np.cumsum([0, *map(len, rows)])
    idx = np.concatenate(rows) if n else np.empty(0, np.int32)

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return idx[np.repeat(mask, np.diff(ends))], np.cumsum([0, *np.diff(ends)[mask]])

    earlier, weights = np.empty((n, 0)), []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        weights.append(fit_linear(idx, ends, logit(earlier), y, weight, **linear))
        if c + 1 < len(categories):
            out = np.zeros(n)
            for f in range(folds):
                train, test = fold != f, fold == f
                w = fit_linear(*part(train), logit(earlier[train]), y[train], weight[train], **linear)
                own, own_ends = part(test)
                z = np.bincount(np.repeat(np.arange(test.sum()), np.diff(own_ends)), weights=w[own], minlength=int(test.sum()))
                out[test] = sigmoid(z + logit(earlier[test]) @ w[1 << BITS:-1] + w[-1])
            earlier = np.column_stack([earlier, out])
    return ChainModel(categories, weights)


def with_term_categories(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Adds ``insult`` and ``contempt``: labelled 1 and holding a word of the list."""
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")
    has = {c: F.arrays_overlap(words, F.array(*[F.lit(w) for w in terms])) for c, terms in (("insult", INSULTS), ("contempt", CONTEMPT))}
    return labelled.withColumns({c: ((F.col(label_col) == 1) & x).cast("int") for c, x in has.items()})


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("insult", "contempt", "toxic"), *, id_col: str = "doc_id", text_col: str = "text",
        derive: Callable[[DataFrame], DataFrame] = with_term_categories, sample_rows: int = 5000, seed: int = 29, **params) -> ChainModel:
    """A chain for ``categories``, in this order; the last is a 0/1 column of ``labels``.

    The labels are sampled first, so only the drawn documents' texts are gathered. ``derive`` adds
    the other categories to (id, text, label) rows; labels may also bring them along.
    """
    last = categories[-1]
    given = [c for c in categories if c in labels.columns]
    marks = labels.select(F.col(id_col).alias("__id"), *[(F.col(c) != 0).cast("int").alias(c) for c in given]).dropna()
    counts = {r[last]: r["n"] for r in marks.groupBy(last).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ChainModel(categories, [])
    draw = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = [marks.where((F.col(last) == v) & (draw < min(1.0, 0.95 * sample_rows / n))).limit(sample_rows) for v, n in sorted(counts.items())]
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(drawn[0].union(drawn[1])), "__id")  # at most 2 * sample_rows labels
    if set(categories) - set(given):
        rows = derive(rows)

    @pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series([hasher(t) for t in texts])

    table = rows.select("__id", hashed("text").alias("idx"), *categories).toPandas().sort_values("__id", kind="stable")
    if table[last].nunique() < 2:
        return ChainModel(categories, [])
    share = table[last].value_counts()
    table = table.iloc[np.random.default_rng(seed).permutation(len(table))]  # folds hold both values
    weight = np.array([counts[v] / share[v] for v in table[last]])
    return fit_chain([np.asarray(x, dtype=np.int32) for x in table["idx"]], (table[list(categories)].to_numpy() != 0), weight, categories, **params)


def score(docs: DataFrame, model: ChainModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each, and ``is_<last category>``."""
    said = docs.select(F.col(id_col).alias("doc_id"), model.probabilities(F.col(text_col).cast("string")).alias("p"))
    last = model.categories[-1]
    return said.select("doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in model.categories], (F.col(f"p.{last}") >= threshold).alias(f"is_{last}"))
