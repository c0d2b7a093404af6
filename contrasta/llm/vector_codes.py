"""Product-quantised vector codes by exact integer matrix products.

Each component ``x`` becomes the integer ``floor(scale * x)``; a vector is cut into ``parts`` equal
consecutive parts (zeros fill up the last one). The codebook of a part position starts as that part of
the vectors with the ``entries`` smallest ids. A round assigns every part to its nearest entry and
replaces each entry by the componentwise ``floor(sum / count)`` of its parts; unused entries stay.

Distances are exact: ``|x|^2 - 2 x.c + |c|^2`` in int64, where the dot products come from float64 BLAS.
Integers are split into limbs of so few bits that a sum of limb products stays below 2^53, so
each product matrix is exact; they are shifted and added up in int64. The first smallest distance wins.

The integers are written once, packed. A round reads them in place, sends its codebooks (bounded:
parts x entries) to the tasks and shuffles one row of sums per task, part and entry.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; null ids
come last, rows of one id by their components; a vector whose length differs from that of the first
one that is not empty has null code and error (errors of null add nothing to their label's sum); fewer vectors
than ``entries`` give a shorter codebook; repeated rows count one by one; an empty table gives no rows;
other columns are ignored. Components beyond ``2^27 / scale`` raise a ValueError, since squared
distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize

#: Integers stay within this, so that 64 squared differences fit 63 bits.
LARGEST = 1 << 27
#: Sums of products in float64 are exact up to this many bits.
EXACT_BITS = 53
SLICE = 8_192
#: Up to so many labels their sums are broadcast; beyond it they are joined by salted keys.
BROADCAST_LABELS = 100_000


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of ``bits`` bits as float64, lowest first; the last one carries the sign."""
    out = []
    while x.size and (x.min() < -(1 << bits) or x.max() >= 1 << bits):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact ``x @ c.T`` of int64 matrices."""
    widest = (EXACT_BITS - 1 - int(np.ceil(np.log2(max(2, x.shape[1]))))) // 2
    bits = min(bits or widest, widest)
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``c``, ties to the lower one, and the squared distance."""
    far = (x * x).sum(1)[:, None] - 2 * dots(x, c, bits) + (c * c).sum(1)[None, :]
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = 1024) -> DataFrame:
    """``vec_id, label, packed``: kept vectors as int32 bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            flat, sizes = v.flatten(), v.value_lengths().to_numpy(zero_copy_only=False)
            got = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(got) and np.abs(got).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST / scale:g}: squared distances would leave 64 bits")
            data, ends = got.astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                                             names=["vec_id", "label", "packed"])

    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return (vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
            .mapInArrow(packed, f"vec_id {types[id_col]}, label {types[label_col]}, packed binary"))


def matrices(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and int64 rows of the vectors of ``size`` components, in slices."""
    right = np.flatnonzero(np.asarray(pc.binary_length(column)) == 4 * size)
    for a in range(0, len(right), SLICE):
        at = right[a:a + SLICE]
        data = b"".join(column.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(data, "<i4").reshape(len(at), size).astype(np.int64)


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    """``(rows, parts, components of a part)``."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def sums(rows: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """``part, entry, n`` and sums ``s0, s1...`` of the parts assigned to each entry, one row per task."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x in matrices(batch.column(0), size):
                cut = padded(x, parts)
                for p in range(parts):
                    best, _ = nearest(cut[:, p], c[p])
                    n[p] += np.bincount(best, minlength=entries)
                    np.add.at(total[p], best, cut[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(total[p, e, i]) for i in range(width))], names=names)

    return rows.select("packed").mapInArrow(summed, ", ".join(f"{x} long" for x in names))


def train(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[np.ndarray, int]:
    """Codebooks ``(parts, entries, components)`` after the rounds, and the vectors' size."""
    order = [F.col("vec_id").asc_nulls_last(), F.hex("packed")]
    one = rows.where(F.length("packed") > 0).orderBy(*order).select("packed").head()
    if not one:
        return np.zeros((parts, 0, 0), np.int64), 0
    size = len(one.packed) // 4
    first = rows.where(F.length("packed") == 4 * size).orderBy(*order).select("packed").limit(entries).collect()
    start = np.array([np.frombuffer(r.packed, "<i4") for r in first], dtype=np.int64)
    books = padded(start, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        new = sums(rows, books, size)
        of = new.groupBy("part", "entry").agg(*(F.sum(x).alias(x) for x in new.columns[2:]))
        for part, entry, n, *total in of.collect():
            books[part, entry] = [s // n for s in total]
    return books, size


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """``vec_id, label, code, error`` of each row of ``integers``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        digits = max(2, len(f"{max(1, c.shape[1]) - 1:x}"))
        for batch in batches:
            code: list[str | None] = [None] * batch.num_rows
            error: list[int | None] = [None] * batch.num_rows
            for at, x in matrices(batch.column(2), size) if size else ():
                found = [nearest(part, book) for part, book in zip(padded(x, len(c)).transpose(1, 0, 2), c, strict=True)]
                for i, k, e in zip(at.tolist(), np.array([b for b, _ in found]).T.tolist(), sum(d for _, d in found).tolist(), strict=True):
                    code[i], error[i] = "".join(f"{b:0{digits}x}" for b in k), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(coded, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def with_label_error(coded: DataFrame, *, broadcast_labels: int = BROADCAST_LABELS, salts: int = 32) -> DataFrame:
    """Adds ``label_error``: the errors of all rows with that label."""
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if total.count() <= broadcast_labels:
        return coded.join(F.broadcast(total), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    spread = total.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("at", F.col("at").cast("long"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))).drop("of", "salt", "at")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024,
             parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of each kept vector."""
    rows = materialize(integers(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale), "vector-integers")
    books, size = train(rows, parts=parts, entries=entries, rounds=rounds)
    coded = materialize(encode(rows, books, size), "vector-codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
