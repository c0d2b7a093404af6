"""Ranked lexical search over bit-sliced Bloom signatures.

``index`` writes, in one pass without moving a text, blocks of documents of similar size. A block has
a Bloom signature of every document for each of a few levels of term frequency (a term is in
level ``l`` if it occurs at least ``LEVELS[l]`` times), stored by slices: one bitmap over the
documents of the block for each signature bit. Each task adds its terms' document counts (the lexicon).

``search`` scores items (queries) in three steps:

1. A term's slices, and-ed, are a bitmap of the documents that may hold it at that level: never too
   few. With the documents' sizes, which the block keeps, the weighted sum over an item's terms is an
   upper bound of each document's score.
2. The documents with the largest bounds are scored exactly; the ``k``-th best score is a threshold.
3. All documents whose bound reaches their item's threshold are scored exactly from their texts. The
   others are provably not among the ``k`` best, so the result is exact.

A score sums ``w * ((10^9 tf) div (1000 tf + 20 m))`` over an item's distinct terms, where
``w = floor(1000 ln((2N+2) / (2df+1)))`` and ``m = 50 + (50 n N) div L``: documents with terms ``N``, all their
terms ``L``, the document's ``n``, those holding the term ``df``.

Terms are runs of ASCII letters, digits and characters above 127; only A-Z is lower-cased. Items are
taken in groups of about ``group_terms`` (item, term) pairs, which bounds what is sent to the tasks. Documents
to be scored are found by id and hash of the text: broadcast up to ``broadcast_rows`` of them, else joined.

Defined cases: null and empty texts have no terms and are never found; an item without terms, or whose
terms no document has, has no rows; rows of a repeated item each get their own ranks; repeated
documents each take a rank; equal scores by ascending id, nulls last; long texts are read whole; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import materialize

#: Least term frequencies of the signature levels.
LEVELS = (1, 2, 3, 5, 9)
#: Signature bits for each term of the block's largest document, and probes for each term.
BITS, PROBES = 12, 4
BLOCK_DOCS, SORTED_DOCS = 512, 4096
#: At most so many distinct terms wait in a task, and so many signature bits are made at once.
WAITING_TERMS, BLOCK_BITS = 1_500_000, 1 << 26
TASK_TERMS = 100_000
#: ASCII to terms' characters and blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Signature bits of terms: ``(terms, PROBES)``."""
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def slices(docs: list[np.ndarray]) -> tuple[int, bytes]:
    """Signature length and slices, bit by bit, of documents given by their terms' hashes."""
    bits = max(64, BITS * max(map(len, docs)))
    at = positions(np.concatenate(docs), bits)
    grid = np.zeros((bits, len(docs)), dtype=bool)
    grid[at, np.repeat(np.arange(len(docs)), [len(d) for d in docs])[:, None]] = True
    return bits, np.packbits(grid, axis=1).tobytes()


class Blocks:
    """The documents that wait in a task, and the terms it has seen."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self._forget()
        self._docs: list[tuple] = []
        self._waiting = 0

    def _forget(self) -> None:
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._hashes, self._df = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def add(self, key: object, text_hash: int, text: bytes) -> Iterator[pa.RecordBatch]:
        count = Counter(terms(text))
        if not count:
            return
        known = len(self._number)
        at = np.fromiter(map(self._number.__getitem__, count), np.int64, len(count))
        tf = np.fromiter(count.values(), np.int64, len(count))
        if (size := len(self._number)) > known:
            if size > len(self._hashes):
                more = np.zeros(size, np.uint64)
                self._hashes, self._df = np.concatenate([self._hashes, more]), np.concatenate([self._df, more.astype(np.int64)])
            for t, i in zip(count, at.tolist(), strict=True):
                if i >= known:
                    self._hashes[i] = xxhash.xxh3_64_intdigest(t)
        self._df[at] += 1
        self._docs.append((len(at), key, text_hash, int(tf.sum()), self._hashes[at], np.minimum(tf, LEVELS[-1]).astype(np.uint8)))
        self._waiting += len(at)
        if self._waiting > WAITING_TERMS or len(self._docs) >= SORTED_DOCS:
            yield from self.flush()
        if size > TASK_TERMS:
            yield self.lexicon()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Blocks of the waiting documents, those of similar size together."""
        self._docs.sort(key=lambda d: d[0])
        while self._docs:
            fits = max(1, min(BLOCK_DOCS, BLOCK_BITS // (BITS * self._docs[-1][0])))
            block, self._docs = self._docs[-fits:], self._docs[:-fits]
            made = [slices([h[tf >= least] for *_, h, tf in block]) for least in LEVELS]
            yield pa.RecordBatch.from_pylist([{"ids": [d[1] for d in block], "hashes": [d[2] for d in block], "sizes": [d[3] for d in block],
                                               "bits": [b for b, _ in made], "slices": [s for _, s in made], "term": None, "df": None}], schema=self.schema)
        self._waiting = 0

    def lexicon(self) -> pa.RecordBatch:
        """The terms seen so far, with the number of documents that hold them; they are forgotten then."""
        n, none = len(self._number), {f.name: pa.nulls(len(self._number), f.type) for f in self.schema}
        out = none | {"term": pa.array(list(self._number), pa.binary()), "df": pa.array(self._df[:n])}
        self._forget()
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of signatures (``term`` is null) and each task's lexicon (``term, df``), as one written table."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if made is None:
                made = Blocks(pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                                         ("bits", pa.list_(pa.int64())), ("slices", pa.list_(pa.binary())), ("term", pa.binary()), ("df", pa.int64())]))
            for i in range(batch.num_rows):
                if text := batch.column(2)[i].as_py():
                    yield from made.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), text)
        if made:
            yield from made.flush()
            yield made.lexicon()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(rows.where("text is not null").mapInArrow(
        blocks, f"ids array<{id_type}>, hashes array<long>, sizes array<long>, bits array<long>, slices array<binary>, term binary, df long"), "lexical-index")


class Queries:
    """A group of items: their terms, and the positions and weights of each item's terms."""

    def __init__(self, pairs: list[tuple[int, bytes, int]], documents: int, total: int) -> None:
        self.documents, self.total = documents, total
        self.number = {t: i for i, t in enumerate(sorted({t for _, t, _ in pairs}))}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.number], dtype=np.uint64)
        by: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, term, df in pairs:
            by[item].append((self.number[term], math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))))
        self.items = {item: (np.array([i for i, _ in x]), np.array([w for _, w in x], dtype=np.float64)) for item, x in by.items()}

    def norm(self, n: int) -> int:
        return 50 + 50 * n * self.documents // self.total

    def bounds(self, sizes: list[int], bits: list[int], parts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Each item's upper bounds of the scores of a block's documents."""
        n, m = np.array(sizes, dtype=np.float64), np.array([self.norm(s) for s in sizes], dtype=np.float64)
        most = [np.minimum(n, t) for t in [x - 1 for x in LEVELS[1:]] + [np.inf]]
        gain = [1e9 * t / (1000 * t + 20 * m) for t in most]
        bound, holds = np.zeros((len(self.hashes), len(n))), None
        for level, (length, data) in enumerate(zip(bits, parts, strict=True)):
            rows = np.frombuffer(data, np.uint8).reshape(length, -1)
            found = np.bitwise_and.reduce(rows[positions(self.hashes, length)], axis=1)
            holds = found if holds is None else holds & found
            bound += np.unpackbits(holds, axis=1, count=len(n)) * (gain[level] - (gain[level - 1] if level else 0))
        for item, (at, w) in self.items.items():
            yield item, w @ bound[at] * (1 + 1e-9)

    def score(self, text: bytes, items: list[int]) -> list[int]:
        found = Counter(terms(text))
        m = 20 * self.norm(found.total())
        tf = {self.number[t]: 10**9 * c // (1000 * c + m) for t, c in found.items() if t in self.number}
        return [sum(int(w) * tf.get(i, 0) for i, w in zip(at.tolist(), weight.tolist(), strict=True)) for at, weight in (self.items[x] for x in items)]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, item_id, terms``: the distinct terms of each item, by row."""
    id_type = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(x or b""))) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(split, f"row long, item_id {id_type}, terms array<binary>"), "search-items")


def largest_bounds(blocks: DataFrame, queries: Broadcast[Queries], first: int) -> DataFrame:
    """``item, id, hash``: for each item the ``first`` documents with the largest bounds."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for id_kind, block in ((batch.schema.field(0).type.value_type, batch.slice(i, 1).to_pylist()[0]) for batch in batches for i in range(batch.num_rows)):
            ids, hashes = np.empty(len(block["ids"]), object), np.array(block["hashes"])
            ids[:] = block["ids"]
            for item, bound in queries.value.bounds(block["sizes"], block["bits"], block["slices"]):
                b, i, h = kept.get(item, (np.zeros(0), ids[:0], hashes[:0]))
                b, i, h = np.concatenate([b, bound]), np.concatenate([i, ids]), np.concatenate([h, hashes])
                at = np.argpartition(-b, first - 1)[:first] if len(b) > first else np.arange(len(b))
                at = at[b[at] > 0]
                kept[item] = b[at], i[at], h[at]
        for item, (b, i, h) in kept.items():
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b)), pa.array(b), pa.array(i.tolist(), id_kind), pa.array(h), pa.array([TaskContext.get().partitionId() % 64] * len(b))],
                                                 names=["item", "bound", "id", "hash", "salt"])

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    found = blocks.mapInArrow(best, f"item long, bound double, id {id_type}, hash long, salt long")
    for by in (["item", "salt"], ["item"]):
        order = Window.partitionBy(*by).orderBy(F.desc("bound"), F.asc_nulls_last("id"), "hash")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).drop("place")
    return found.select("item", "id", "hash")


def not_excluded(blocks: DataFrame, queries: Broadcast[Queries], least: Broadcast[dict]) -> DataFrame:
    """``item, id, hash``: all documents whose bound reaches their item's threshold."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids, hashes = batch.column(0)[i].values, np.array(block["hashes"])
                for item, bound in queries.value.bounds(block["sizes"], block["bits"], block["slices"]):
                    at = np.flatnonzero(bound >= least.value.get(item, 1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(at)), ids.take(pa.array(at)), pa.array(hashes[at])], names=["item", "id", "hash"])

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(reach, f"item long, id {id_type}, hash long")


def exact_scores(docs: DataFrame, found: DataFrame, queries: Broadcast[Queries], id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """``item, doc_id, score`` of each document row for each item that it was found for."""
    asked = materialize(found.groupBy(F.col("id").alias("of"), "hash").agg(F.collect_set("item").alias("items")), "search-candidates")
    pairs = asked.agg(F.sum(F.size("items"))).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = rows.join(F.broadcast(asked) if pairs <= broadcast_rows else asked,
                     (F.xxhash64("text") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(2)[i].as_py()
                score = queries.value.score(batch.column(1)[i].as_py(), items)
                yield pa.RecordBatch.from_arrays([pa.array(items), batch.column(0).slice(i, 1).take(pa.array([0] * len(items))), pa.array(score)],
                                                 names=["item", "doc_id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return both.select("doc_id", F.col("text").cast("binary").alias("text"), "items").mapInArrow(scored, f"item long, doc_id {id_type}, score long")


def best_scores(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(indexed: DataFrame, docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", first: int = 64, group_terms: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each item, from ``index(docs)``."""
    spark = docs.sparkSession
    blocks = indexed.where("term is null").select("ids", "hashes", "sizes", "bits", "slices")
    lexicon = indexed.where("term is not null").select("term", "df")
    documents, total = blocks.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    asked = item_terms(items, item_col, item_text_col)
    groups = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / group_terms))
    pairs = asked.select("row", F.explode("terms").alias("term"))
    held = materialize(lexicon.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), "search-terms")
    pairs = pairs.join(held, "term").select("row", "term", "df")
    out = None
    for g in range(groups):
        own = [(r.row, bytes(r.term), r.df) for r in pairs.where(F.pmod(F.hash("row"), F.lit(groups)) == g).collect()]
        if not own:
            continue
        queries = spark.sparkContext.broadcast(Queries(own, documents, total))
        tops = best_scores(exact_scores(docs, largest_bounds(blocks, queries, max(first, k)), queries, id_col, text_col, broadcast_rows), k)
        least = {r.item: r.score for r in tops.where(F.col("rank") == k).select("item", "score").collect()}
        found = exact_scores(docs, not_excluded(blocks, queries, spark.sparkContext.broadcast(least)), queries, id_col, text_col, broadcast_rows)
        best = materialize(best_scores(found, k), "search-found")
        out = best if out is None else out.unionByName(best)
    empty = asked.where(F.lit(False)).select(F.col("row").alias("item"), F.lit(0).alias("rank"), F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"),
                                             F.lit(0).cast("long").alias("score"))
    out = empty if out is None else out
    return out.join(asked.select(F.col("row").alias("item"), "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
