"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

1. Inner products become distances: with M the largest norm, a vector gets the extra component
   ``sqrt(M**2 - |x|**2)`` and a query is scaled to norm M with 0 there, so the nearest point has the
   largest inner product.
2. Every projection is one hash function with one sorted array. The ``projections`` directions are
   drawn as whole orthogonal bases, which spreads them evenly.
3. A query opens windows around its own projection in the ``opened`` sorted arrays in which it lies
   farthest out: few vectors lie there, so a collision says most. Virtual rehashing widens all its
   windows by ``growth`` at a time; only the newly covered stretches are counted. Vectors inside at
   least ``threshold`` of the windows are candidates. Widening stops when ``verify`` candidates
   are there (or all vectors), and these are verified by exact inner products in double precision.

Vectors are dealt by a hash of their id into blocks of about ``block_rows``, each with its own
sorted arrays; queries into chunks of about ``chunk_rows``. A task holds one block and one chunk,
whatever the size of the table, and returns at most ``k`` rows per query; a ranked merge over the
blocks leaves the ``k`` best.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without id; a row is no candidate of queries with its own id;
repeated rows are candidates each; equal scores go to the smaller id; fewer candidates than ``k``
give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def directions(dims: int, projections: int, seed: int) -> np.ndarray:
    """[dims, projections]: orthogonal bases side by side, each direction of length sqrt(dims)."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-projections // dims))]
    return np.concatenate(bases, axis=1)[:, :projections] * np.sqrt(dims)


class Block:
    """The sorted projection arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, projections: int, seed: int) -> None:
        self.ids, self.vectors, self.norm = ids, vectors, norm
        extra = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0.0))
        self.axes = directions(vectors.shape[1] + 1, projections, seed)
        hashed = (np.concatenate([vectors, extra[:, None]], axis=1) @ self.axes).T
        self.order = np.argsort(hashed, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashed, self.order, axis=1)
        self.step = float(hashed.std(axis=1).mean()) or 1.0

    def _bounds(self, arrays: np.ndarray, values: np.ndarray, side: str) -> np.ndarray:
        """For each value its place in the sorted array that ``arrays`` names for it."""
        out = np.empty(values.shape, dtype=np.int64)
        for a in np.unique(arrays):
            out[arrays == a] = self.sorted[a].searchsorted(values[arrays == a], side)
        return out

    def candidates(self, queries: np.ndarray, *, opened: int, threshold: float, verify: int, first: float, growth: float) -> list[np.ndarray]:
        """For each query the rows of the block that collide with it in enough windows."""
        n, h = len(self.ids), min(opened, len(self.order))
        if n <= verify:
            return [np.arange(n)] * len(queries)
        norms = np.sqrt((queries * queries).sum(1, keepdims=True))
        at = (queries * (self.norm / norms)) @ self.axes[:-1]
        arrays = np.argpartition(-np.abs(at), h - 1, axis=1)[:, :h]
        at = np.take_along_axis(at, arrays, axis=1)
        need = int(np.ceil(threshold * h))
        count = np.zeros((len(queries), n), dtype=np.int32)
        low = self._bounds(arrays, at, "left")
        high, radius, found, open_ = low.copy(), first * self.step, [np.arange(n)] * len(queries), np.arange(len(queries))
        while len(open_):
            new_low = self._bounds(arrays[open_], at[open_] - radius, "left")
            new_high = self._bounds(arrays[open_], at[open_] + radius, "right")
            still = []
            for i, q in enumerate(open_):
                rings = [self.order[a, x:y] for a, x, y in zip(arrays[q], new_low[i], low[q], strict=True)]
                rings += [self.order[a, x:y] for a, x, y in zip(arrays[q], high[q], new_high[i], strict=True)]
                count[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int32)
                near = np.flatnonzero(count[q] >= need)
                if len(near) >= verify:
                    found[q] = near
                elif (new_high[i] - new_low[i]).min() < n:
                    still.append(q)
            low[open_], high[open_], radius, open_ = new_low, new_high, radius * growth, np.array(still, dtype=np.int64)
        return found

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, *, at_once: int = 64, **windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores of the ``k`` best rows for each query; ``at_once`` queries share their look-ups."""
        parts = []
        for i in range(0, len(queries), at_once):
            asked = queries[i:i + at_once]
            for q, x, found in zip(query_ids[i:i + at_once], asked, self.candidates(asked, **windows), strict=True):
                found = found[self.ids[found] != q]
                score = (self.vectors[found] * x).sum(axis=1)
                if len(found) > k:  # all that tie with the k-th stay for the order by id
                    best = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[best], score[best]
                best = np.lexsort((self.ids[found], -score))[:k]
                parts.append((np.full(len(best), q), self.ids[found[best]], score[best]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(table: DataFrame, query_where: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 128,
           opened: int = 48, threshold: float = 0.5, verify: int = 1024, first: float = 0.9, growth: float = 1.15, block_rows: int = 16384,
           chunk_rows: int = 2048, seed: int = 41) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, nearest first."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), query_where.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = (rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asked").alias("q"),
                                                       F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
             .orderBy(F.desc("n"), "d").first())
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rows = rows.where(F.size("v") == sizes.d)
    # a block must not shrink below what is verified anyway
    blocks, chunks = max(1, round(sizes.n / block_rows)), max(1, -(-sizes.q // chunk_rows))
    norm = float(np.sqrt(sizes.top)) * (1 + 1e-12)
    dealt = F.xxhash64(F.lit(seed), "id")
    vectors = rows.select("id", "v", F.lit(False).alias("query"), F.pmod(dealt, F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    queries = rows.where("asked").select("id", "v", F.lit(True).alias("query"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                                         F.pmod(dealt, F.lit(chunks)).alias("chunk"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["query"].to_numpy(dtype=bool)
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if asked.all() or not asked.any():
            return none
        ids, v = pdf["id"].to_numpy(dtype=np.int64), np.stack(pdf["v"].to_numpy())
        own = np.argsort(ids[~asked], kind="stable")  # the same whatever order the rows came in
        block = Block(ids[~asked][own], v[~asked][own], norm, projections, seed)
        near = block.search(ids[asked], v[asked], k, opened=opened, threshold=threshold, verify=max(verify, 2 * k), first=first, growth=growth)
        return pd.DataFrame(dict(zip(none.columns, near, strict=True)))

    best = vectors.unionByName(queries).groupBy("block", "chunk").applyInPandas(found, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(table: DataFrame, query_where: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same by comparing every query with every row: for measuring recall on samples."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), query_where.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    pairs = rows.where("asked").select(F.col("id").alias("query_id"), F.col("v").alias("q")).crossJoin(rows.select(F.col("id").alias("vec_id"), "v"))
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.where("query_id != vec_id").select("query_id", "vec_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
