"""I-Match fingerprints over randomised lexicons.

A term is a lower-cased word. The lexicon keeps the terms whose document frequency lies between
``low`` and ``high`` of all documents, a band of the inverse document frequency: rarer terms are
mostly noise, more frequent ones say nothing. A document's lexicon terms are sorted and hashed once
for each of several random subsets of the lexicon; a small edit leaves most of these hashes alone.
Subsets keep 1/2, 1/8, 1/32 and 1/128 of the lexicon, so that slight and heavy edits both show.

The fingerprint lists one hash per subset (``-`` where the document has no term of it), joined by
commas. A document without lexicon terms in any subset is named by the hash of its whole text.
``likeness`` is the share of subsets with equal hashes among those in which either has terms.

The lexicon has at most (distinct terms per document) / ``low`` terms, whatever the number of
documents; its 8-byte hashes are broadcast after ``max_terms`` has been checked.

Defined cases: null texts are empty; equal texts have equal fingerprints; two texts without terms
are alike (1) if they are equal, else 0; very long texts are read whole; an empty table gives no
rows; other columns are ignored. ``edited`` takes the documents by ascending id, nulls last, rows
of one id by text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._util import text_or_empty

_WORDS = re.compile(r"\w+")
SHIFTS = (1, 1, 1, 3, 3, 3, 5, 5, 5, 5, 7, 7, 7, 7, 7, 7)


class Terms:
    """Distinct term hashes of a text."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        known, words = self._known, set(_WORDS.findall(text.lower()))
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return [known[w] for w in words]


def lexicon(docs: DataFrame, *, low: float, high: float, max_terms: int) -> np.ndarray:
    """Ascending hashes of the terms inside the band; counts cover all documents."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen = Terms(), 0
        df: Counter[int] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df.update(terms(t or ""))
                seen += 1
            if len(df) > 1_500_000:  # bounded memory: the groups are summed after the shuffle anyway
                yield packed(df)
                df.clear()
        yield packed(df)

    def packed(df: Counter) -> pa.RecordBatch:
        keys = np.fromiter(df.keys(), dtype=np.uint64, count=len(df)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(df.values(), dtype=np.int64, count=len(df)))], names=["term", "n"])

    total = docs.count()
    counted = docs.select("text").mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= high * total)).select("term")
    found = band.limit(max_terms + 1).toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64)
    if len(found) > max_terms:
        raise ValueError(f"more than {max_terms} terms in the band; raise low or max_terms")
    return np.sort(found)


class Fingerprinter:
    def __init__(self, words: np.ndarray, seed: int) -> None:
        self.words, self.terms = words, Terms()
        # one draw per term and subset; a subset keeps the terms whose draw has its lowest bits clear
        with np.errstate(over="ignore"):
            x = words[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(SHIFTS) + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        self.kept = (x >> np.uint64(40)) & ((np.uint64(1) << np.array(SHIFTS, dtype=np.uint64)) - np.uint64(1)) == 0

    def __call__(self, text: str) -> str:
        h = np.unique(np.array(self.terms(text), dtype=np.uint64))
        if len(h) and len(self.words):
            at = np.minimum(self.words.searchsorted(h), len(self.words) - 1)
            at = at[self.words[at] == h]
            parts = [self.words[at[self.kept[at, s]]] for s in range(len(SHIFTS))] if len(at) else []
            if any(map(len, parts)):
                return ",".join(f"{xxhash.xxh3_64_intdigest(p.tobytes()):016x}" if len(p) else "-" for p in parts)
        return "text:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.split(","), b.split(",")
    if len(x) != len(y) or len(x) == 1:
        return 0.0
    both = [(p, q) for p, q in zip(x, y, strict=True) if p != "-" or q != "-"]
    return sum(p == q for p, q in both) / len(both) if both else 0.0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = 0.002, high: float = 0.2, max_terms: int = 1_000_000,
                 seed: int = 7) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(lexicon(rows, low=low, high=high, max_terms=max_terms))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(words.value, seed)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(made, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, last, doc_id, text) in which the row after a document, in its range, holds the next document.

    Ids are cut into ranges; each range gets the first document of the following one as an extra
    row (``extra`` 1), the last range the very first. Only one id per range reaches the driver.
    """
    ids = rows.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000).alias("at")).first()
    cuts = sorted(set(ids["at"] or []))

    @pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series([len(cuts) if x is None or x != x else bisect_left(cuts, x) for x in ids], dtype="int32")

    rows = rows.withColumn("range", of("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", F.xxhash64("text").alias("h"))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min(order).alias("first")).collect()}
    if not firsts:
        return rows.withColumn("extra", F.lit(0))
    at = sorted(firsts)
    before = {at[i]: at[i - 1] for i in range(len(at))}  # the first range's first document follows the last range
    wanted = rows.sparkSession.createDataFrame([(r, before[r], f["doc_id"], f["h"]) for r, f in firsts.items()], "range int, goes int, w_id long, w_h long")
    extra = (rows.join(F.broadcast(wanted), "range")  # one row per range
             .where(F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_h")))
             .dropDuplicates(["range"]).select(F.col("goes").alias("range"), "doc_id", "text", F.lit(1).alias("extra")))
    return rows.select("range", "doc_id", "text", F.lit(0).alias("extra")).unionByName(extra)


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = 0.002, high: float = 0.2, max_terms: int = 1_000_000,
           seed: int = 7, range_rows: int = 2000) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are to it and to the next document's.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document (or all, if that is shorter); after the last document comes the first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    words: Broadcast = docs.sparkSession.sparkContext.broadcast(lexicon(rows, low=low, high=high, max_terms=max_terms))
    ranges = max(1, min(1 << 16, docs.count() // range_rows))
    placed = with_next(rows, ranges)
    parts = max(ranges // 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (placed.repartition(parts, "range")
               .sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(words.value, seed)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None  # range, extra, id, text, fingerprint
        for batch in batches:
            out: list[tuple] = []
            for r, key, text, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                now = (r, extra, key, text, of(text))
                if last is not None and not last[1] and last[0] == r:
                    n, body = len(last[3]), last[3]
                    new = body[:n - n // 2] + text[:n // 2]
                    mine = of(new)
                    out.append((last[2], n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[4], mine,
                                likeness(last[4], mine), likeness(last[4], now[4])))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

    return ordered.select("range", "doc_id", "text", "extra").mapInArrow(
        made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
