"""Model hooks: plug a user scorer (emotion classifier, rhetoric model) into the
pipeline as an Arrow-batched ``mapInPandas`` stage.

The scorer is built once per task (``load``) and called on batches of at most
``batch_size`` texts; a failing batch is retried row by row and any row that
still fails gets the default scores (zeros) with ``defaulted = true``, so one bad
document never stops the job. Text is capped with ``model_input`` only if ``max_chars`` is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from contrasta.functions.parse import extract_scores
from contrasta.functions.text import model_input
from contrasta.operators.rhetoric import STRATEGIES, finish


def model_scores(df: DataFrame, load: Callable[[], Callable[[list[str]], list[dict]]],
                 labels: list[str], text_col: str = "text", id_col: str = "doc_id",
                 batch_size: int = 32, max_chars: int | None = None) -> DataFrame:
    """``(doc_id, <labels...>, defaulted)`` from a user model.

    ``load()`` returns ``score(texts) -> list[dict label -> float]``. Blank texts
    score 0.0 for every label without calling the model.
    """
    src = df.select(F.col(id_col).alias("_id"), (F.coalesce(F.col(text_col), F.lit("")) if max_chars is None else model_input(text_col, max_chars)).alias("_text"))
    schema = f"{id_col} long, " + ", ".join(f"`{l}` double" for l in labels) + ", defaulted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        zero = {l: 0.0 for l in labels}

        def safe(texts):
            try:
                out = score(texts)
                if len(out) != len(texts):
                    raise ValueError("scorer returned a different number of rows")
                return [(dict(zero, **{k: float(v) for k, v in o.items() if k in zero}), False) for o in out]
            except Exception:
                if len(texts) == 1:
                    return [(zero, True)]
                return [r for t in texts for r in safe([t])]

        for pdf in batches:
            rows = []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                texts = chunk["_text"].fillna("").tolist()
                live = [i for i, t in enumerate(texts) if t.strip()]
                res = [(zero, False)] * len(texts)
                for i, r in zip(live, safe([texts[i] for i in live]) if live else []):
                    res[i] = r
                rows.extend(res)
            out = pd.DataFrame([r[0] for r in rows], columns=labels)
            out.insert(0, id_col, pdf["_id"].values)
            out["defaulted"] = [r[1] for r in rows]
            yield out

    return src.mapInPandas(run, schema)


def model_answers(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]],
                  text_col: str = "text", id_col: str = "doc_id", batch_size: int = 32) -> DataFrame:
    """``(doc_id, answer, defaulted)``: free-text answers of a user model (e.g. an LLM asked
    for a JSON object); failures give an empty answer, which parses to zeros, and are flagged."""
    src = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        ask = load()

        def safe(texts):
            try:
                got = [None if a is None else str(a) for a in ask(texts)]
                if len(got) != len(texts):
                    raise ValueError("model returned a different number of answers")
                return [("" if a is None else a, a is None) for a in got]
            except Exception:
                return [("", True)] if len(texts) == 1 else [x for t in texts for x in safe([t])]

        for pdf in batches:
            rows = [x for start in range(0, len(pdf), batch_size) for x in safe(pdf["_text"].iloc[start:start + batch_size].tolist())]
            yield pd.DataFrame({id_col: pdf["_id"].values, "answer": [a for a, _ in rows], "defaulted": [d for _, d in rows]})

    return src.mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, answer string, defaulted boolean")


def observed(scores: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; once they have been computed, ``observation.get`` has ``rows`` and ``defaulted``."""
    return scores.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if("defaulted").alias("defaulted"))


def rhetoric_from_model(df: DataFrame, load, text_col: str = "text", id_col: str = "doc_id",
                        batch_size: int = 32) -> DataFrame:
    """Model-based rhetoric scores: one model call per document, the three scores
    parsed from the answer (missing / invalid -> 0.0), then flags and ratio."""
    ans = model_answers(df, load, text_col, id_col, batch_size)
    return finish(extract_scores(ans, "answer", id_col, STRATEGIES))
