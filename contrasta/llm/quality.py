"""Quality classifier from weak labels: heuristic labellers, EM over their votes, hashed linear scorer.

1. Heuristic labellers look at one text each and vote good (1), bad (0) or abstain (2). They
   overlap: one bad text usually trips several of them.
2. The votes of all documents are counted by pattern (at most 3 ** labellers rows, whatever the
   corpus). Expectation-maximisation over these counts estimates the share of bad documents and,
   for each labeller, how often it gives each vote on good and on bad texts.
3. The posterior of each pattern is the soft label of its documents. A logistic regression over
   hashed features (character-shape trigrams and binned text statistics) is trained on a sample of
   at most ``sample_rows`` documents, drawn by a seeded hash of the id; then every text is scored.

Defined cases: null and blank texts score 0 and are rejected; very long texts are read whole;
repeated rows score alike; null ids are scored; an empty table gives no rows (and no model).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._util import give_back

GOOD, BAD, NONE = 1, 0, 2
DIMS = 2048

# Frequent function words of the languages served (English, French, German, Spanish).
FUNCTION_WORDS = frozenset("""the of and to in is that it for with was on are as be this by at or an from
le la les de des du et en un une est que qui dans pour par sur au
der die das und in zu den von mit ist ein eine nicht auf des dem als
el los las y en un una que es por con para del se su al""".split())

#: Character shapes: lower case, upper case, digit, blank, line break, and each common mark by itself.
_MARKS = "!#$%&'()*+,-./:;<=>?@[]_|~"
N_SHAPES = 6 + len(_MARKS)


def _shape_table() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.int32)
    for c in range(0x10000):
        ch = chr(c)
        table[c] = (3 if ch in "\n\r" else 4 if ch.isspace() else 2 if ch.isdigit() else 1 if ch.isupper() else 0 if ch.isalpha()
                    else 6 + _MARKS.index(ch) if ch in _MARKS else 5)
    return table


_TABLE: list[np.ndarray] = []


def shapes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_shape_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[0][np.minimum(codes, 0xFFFF)]


@dataclass
class Signals:
    chars: int
    words: int
    letters: float
    upper: float
    marks: float
    bangs: float
    bars: float
    function_words: float
    distinct: float
    top_word: float
    line_repeat: float
    same_again: float


def signals(text: str, shape: np.ndarray) -> Signals:
    n = max(1, len(text))
    count = np.bincount(shape, minlength=N_SHAPES)
    words = text.split()
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    low = [w for w in seen if w.lower().strip(".,!?;:#$%&*") in FUNCTION_WORDS]
    lines = text.split("\n")
    w = max(1, len(words))
    mark = lambda c: count[6 + _MARKS.index(c)]
    return Signals(len(text), len(words), (count[0] + count[1]) / n, count[1] / max(1, count[0] + count[1]),
                   sum(mark(c) for c in "#$%&*<=>@~_+") / w, mark("!") / w, mark("|") / w, sum(seen[x] for x in low) / w,
                   len(seen) / w, max(seen.values(), default=0) / w, 1 - len(set(lines)) / len(lines),
                   sum(map(str.__eq__, words, words[1:])) / w)


def votes(s: Signals) -> list[int]:
    """One vote of each labeller; short texts make most of them abstain."""
    few = s.words < 12
    return [
        BAD if s.marks > 0.15 else GOOD if s.marks < 0.03 else NONE,
        BAD if s.letters < 0.7 else GOOD if s.letters > 0.76 else NONE,
        BAD if s.upper > 0.3 else GOOD if s.upper < 0.1 else NONE,
        BAD if s.bangs > 0.1 else GOOD if s.bangs == 0 else NONE,
        BAD if s.bars > 0.1 else GOOD if s.bars == 0 else NONE,
        NONE if few else BAD if s.function_words < 0.05 else GOOD if s.function_words > 0.12 else NONE,
        NONE if few else BAD if s.distinct < 0.25 and s.words < 800 or s.distinct < 0.08 else GOOD if s.distinct > 0.4 else NONE,
        NONE if few else BAD if s.top_word > 0.25 else GOOD if s.top_word < 0.15 else NONE,
        NONE if few else BAD if s.same_again > 0.2 else GOOD if s.same_again < 0.05 else NONE,
        NONE if few else BAD if s.distinct < 0.12 and s.words < 2500 else GOOD if s.distinct > 0.3 else NONE,
    ]


N_LABELLERS = 10


def features(s: Signals, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features as (positions, values): relative shape-trigram counts and binned statistics."""
    idx, val = np.empty(0, dtype=np.int64), np.empty(0)
    if len(shape) >= 3:
        tri = (shape[:-2] * N_SHAPES + shape[1:-1]) * N_SHAPES + shape[2:]
        count = np.bincount(((tri.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64) % DIMS, minlength=DIMS)
        idx = np.flatnonzero(count)
        val = np.sqrt(count[idx] / len(tri))
    bins = []
    for k, x in enumerate((s.letters, s.upper, s.marks, s.bangs, s.bars, s.function_words, s.distinct, s.top_word, s.line_repeat,
                           s.same_again)):
        bins.append((k * 64 + int(min(x, 1.5) * 20) + 1) * 40503 % DIMS)
    return np.concatenate([idx, bins]).astype(np.int32), np.concatenate([val, np.full(len(bins), 0.5)]).astype(np.float32)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, ``p[class, labeller, vote]`` and the posterior of good per pattern.

    Starts from the majority vote; one count is added to each vote so that none is impossible.
    Whoever abstains says nothing: p is over the votes good and bad, and 1 for abstaining.
    """
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    # one bad vote weighs as much as two good ones: clean texts please every labeller
    post = np.clip((good + 0.5) / (good + 2 * bad + 1.0), 0.02, 0.98)
    onehot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        p = np.einsum("cn,nlv->clv", weight, onehot) + 1
        p /= p.sum(2, keepdims=True)
        log = np.einsum("nlv,clv->cn", onehot, np.log(p))
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(share), np.concatenate([p, np.ones_like(p[:, :, :1])], axis=2), new


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = DIMS, rounds: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels; both classes weigh the same."""
    x = np.zeros((len(rows), dims + 1), dtype=np.float32)
    x[:, dims] = 1
    for i, (idx, val) in enumerate(rows):
        np.add.at(x[i], idx, val)
    good = labels.sum()
    weight = np.where(labels > 0.5, 0.5 / max(good, 1), 0.5 / max(len(labels) - good, 1)).astype(np.float32)
    w, m, v = np.zeros(dims + 1, np.float32), np.zeros(dims + 1, np.float32), np.zeros(dims + 1, np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - labels)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def _per_text(texts: pd.Series, what: Callable) -> Iterator:
    for t in texts:
        t = t or ""
        shape = shapes(t)
        yield what(signals(t, shape), shape)
    give_back()


def vote_pattern(text: Column) -> Column:
    """All votes of a text as one number in base 3."""
    @pandas_udf("int")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_per_text(texts, lambda s, _: sum(v * 3 ** i for i, v in enumerate(votes(s))))), dtype="int32")
    return pattern(text)


@dataclass
class QualityModel:
    weights: np.ndarray
    good_share: float
    votes: np.ndarray

    def score(self, text: Column) -> Column:
        """Probability that the text is good; null and blank texts get 0."""
        weights = self.weights

        @pandas_udf("double")
        def probability(texts: pd.Series) -> pd.Series:
            def one(s: Signals, shape: np.ndarray) -> float:
                if not s.words:
                    return 0.0
                idx, val = features(s, shape)
                return float(1 / (1 + np.exp(-np.clip(weights[idx] @ val + weights[-1], -30, 30))))
            return pd.Series(list(_per_text(texts, one)), dtype="float64")
        return probability(text)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 6000, seed: int = 11) -> QualityModel:
    """Labeller accuracies from the votes of all documents, weights from at most ``sample_rows`` of them."""
    text = F.col(text_col).cast("string")
    found = docs.where(text.isNotNull() & (F.trim(text) != "")).groupBy(vote_pattern(text).alias("pattern")).agg(F.count("*").alias("n")).collect()
    codes, counts = np.array([r.pattern for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=float)
    if not len(codes):
        return QualityModel(np.zeros(DIMS + 1, np.float32), 0.5, np.full((2, N_LABELLERS, 3), 1 / 3))
    patterns = np.stack([codes // 3 ** i % 3 for i in range(N_LABELLERS)], axis=1)
    share, p, post = expectation_maximisation(patterns, counts)
    label = dict(zip(codes.tolist(), post.tolist(), strict=True))

    part = min(1.0, 0.9 * sample_rows / counts.sum())
    # with the text: ids may be null or repeated
    picked = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))

    @pandas_udf("pattern int, idx array<int>, val array<float>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        def one(s: Signals, shape: np.ndarray) -> tuple:
            return sum(v * 3 ** i for i, v in enumerate(votes(s))), *features(s, shape)
        return pd.DataFrame(list(_per_text(texts, one)), columns=["pattern", "idx", "val"])

    rows = docs.where(picked & text.isNotNull()).limit(sample_rows).select(hashed(text).alias("f")).select("f.*").toPandas()
    labels = np.array([label.get(x, share) for x in rows["pattern"]], dtype=np.float32)
    return QualityModel(fit_linear(list(zip(rows["idx"], rows["val"], strict=True)), labels), share, p)


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, model: QualityModel | None = None,
             **params) -> DataFrame:
    """``doc_id, score, keep`` for every row; in doubt a document stays. The model is fitted on ``docs`` if none is given."""
    model = model or fit(docs, id_col=id_col, text_col=text_col, **params)
    scored = docs.select(F.col(id_col).alias("doc_id"), model.score(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("keep", F.col("score") >= threshold)
