"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Every text becomes hashed counts of its character 1-, 2- and 3-grams (letters lower-cased,
   all else one blank).
2. Document frequencies of the hashed n-grams are counted over all training documents.
3. At most ``sample_rows`` training documents, drawn by a seeded hash of the id, train the model by
   follow-the-regularised-leader with elastic-net penalties: per-coordinate learning rates, L1 for
   sparsity, L2 for stability. Further training documents that the fit has not seen calibrate one
   temperature, which divides the logits and leaves the predictions as they are.

Only text and labels of training documents are learnt from. Defined cases: null texts and texts
without a letter give ``und`` with score 0; without any training label every text gives ``und``;
null labels are skipped; very long texts are read whole; repeated rows and null ids are predicted
row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DIMS = 1 << 14
_LETTER = regex.compile(r"\p{L}")
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> its lower-cased letter, or a blank; kept once per process."""
    if not _LETTERS:
        table = np.full(0x30000, 32, dtype=np.uint32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()) if len(ch.lower()) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram positions (ascending) and their counts."""
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letter_table()[np.minimum(codes, 0x2FFFF)]
    blank = codes == 32
    codes = codes[np.append(True, ~(blank[1:] & blank[:-1]))]
    with np.errstate(over="ignore"):
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (codes[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (DIMS - 1).bit_length())
    count = np.bincount(np.concatenate([(x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)]).astype(np.int64),
                        minlength=DIMS)
    idx = np.flatnonzero(count)
    return idx.astype(np.int32), count[idx]


def weighted(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, scaled to length 1."""
    val = (1 + np.log(count)) * idf[idx]
    return (val / max(float(np.sqrt(val @ val)), 1e-12)).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and how many texts there are."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df[ngram_counts(t)[0]] += 1
                df[DIMS] += 1
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(df[idx])], names=["gram", "n"])

    out = np.zeros(DIMS + 1, dtype=np.int64)
    for r in texts.mapInArrow(rows, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most DIMS + 1 rows
        out[r.gram] = r.n
    return out[:DIMS], int(out[DIMS])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, rounds: int = 3, alpha: float = 0.3, beta: float = 1.0,
             l1: float = 0.02, l2: float = 0.5, seed: int = 3) -> np.ndarray:
    """Weights [DIMS + 1, classes] by per-coordinate FTRL-proximal; the last row is the bias."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            idx, val = np.append(idx, DIMS), np.append(val, 1.0)
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            g = val[:, None] * (softmax(val @ w) - np.eye(classes)[labels[i]])
            new = ni + g * g
            z[idx] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            n[idx] = new
    return weights(z, n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    classes: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, idx: np.ndarray, count: np.ndarray) -> np.ndarray:
        return weighted(idx, count, self.idf) @ self.weights[idx] + self.weights[-1]

    def predict(self, text: Column) -> Column:
        """struct<lang_pred, score> of a text column."""
        model = self

        @pandas_udf("lang_pred string, score double")
        def predicted(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                if not model.classes or t is None or not _LETTER.search(t):
                    out.append(("und", 0.0))
                    continue
                p = softmax(model.logits(*ngram_counts(t)) / model.temperature)
                out.append((model.classes[int(p.argmax())], float(p.max())))
            return pd.DataFrame(out, columns=["lang_pred", "score"])
        return predicted(text)


def fit(training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 6000,
        calibration_rows: int = 2000, seed: int = 23, **ftrl) -> LanguageModel:
    """A model of the labels of ``training``: statistics of all its rows, weights of a bounded sample."""
    rows = training.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("text is not null and label is not null")
    df, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    # the fit and the calibration draw from two ranges of one hash
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fit_part, all_part = (min(share, 0.9 * k / max(total, 1)) for share, k in ((0.75, sample_rows), (0.25, calibration_rows)))

    @pandas_udf("idx array<int>, n array<long>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ngram_counts(t) for t in texts], columns=["idx", "n"])

    def drawn(low: float, high: float, most: int) -> pd.DataFrame:
        return rows.where((draw >= low) & (draw < high)).limit(most).select("label", counts("text").alias("f")).select("label", "f.*").toPandas()

    train, held = drawn(0.0, fit_part, sample_rows), drawn(0.75, 0.75 + all_part, calibration_rows)
    classes = sorted(set(train["label"]))
    if not classes:
        return LanguageModel([], np.zeros((DIMS + 1, 0)), idf, 1.0)
    at = {c: i for i, c in enumerate(classes)}
    feats = [(i, weighted(i, n, idf)) for i, n in zip(train["idx"], train["n"], strict=True)]
    model = LanguageModel(classes, fit_ftrl(feats, np.array([at[x] for x in train["label"]]), len(classes), **ftrl), idf, 1.0)
    held = held[held["label"].isin(classes)]
    logits = np.array([model.logits(i, n) for i, n in zip(held["idx"], held["n"], strict=True)])
    model.temperature = fit_temperature(logits, np.array([at[x] for x in held["label"]], dtype=np.int64))
    return model


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % folds == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5,
             model: LanguageModel | None = None, **params) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; the model learns from the rows that are not held out.

    A null id is held out, so that it is never learnt from.
    """
    out = F.coalesce(held_out(F.col(id_col), folds), F.lit(True))
    if model is None:
        model = fit(docs.where(~out), id_col=id_col, text_col=text_col, label_col=label_col, **params)
    said = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), model.predict(F.col(text_col).cast("string")).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score")
