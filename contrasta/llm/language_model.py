"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

``fit`` counts the n-grams of the training documents exactly. A count ``c`` becomes a level, the
number of steps of a ladder ``ceil(base^j)`` that are at most ``c``; an n-gram of level ``q`` is put into the filter
with each of 1, 2, ... ``q``. A reader probes 1, 2, ... until a probe fails: the last level found is never too
low, and rarely too high. The middle of the level's counts is the count.

The probability of a word after the words before it is smoothed towards shorter contexts,
``P(w | h) = (min(c(hw), c(h)) + strength P(w | h')) / (c(h) + strength)``, down to ``(c(w) + alpha) / (N + alpha (V+1))``.
A text is its lower-cased words and one end; the end also stands before the first word.

The filter grows with the distinct n-grams, without a cutoff. It is made in buckets of about ``bucket_tokens``
tokens, each by one task. Up to ``broadcast_bytes`` it is broadcast to the workers; beyond that each
bucket goes to one task, to which the documents' distinct n-grams come to be probed, those of all bundles at
once and each a single time. Both give the same scores.

Tokens are read once: each task writes its documents in bundles of about ``bundle_tokens`` tokens, as numbers
into the bundle's own list of words. All that is shuffled is combined by bundle first, so no word is
hot: a bundle asks once for each of its distinct words and is answered with the word's exact count.

Defined cases: null and empty texts have the end alone; rows of null or repeated ids count one by one, a null id
is not held out; a text of any length stays whole in a bundle; without training tokens all counts
are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize

END = b""
U = np.uint64
MAX_LEVELS = 120
#: Bits of a filter's block: all probes for an n-gram and level lie in one block.
BLOCK = 512


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words (A-Z only, ASCII white space between them) and the end."""
    return [*text.lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit integers."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with members, and their positions in ascending order."""
    of = bucket_of(hashes, buckets)
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(at):
            yield int(of[at[0]]), at


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def ladder(base: float) -> np.ndarray:
    """Least count of each level."""
    steps = sorted({int(np.ceil(base**j - 1e-9)) for j in range(MAX_LEVELS) if base**j < 2**62})
    return np.array(steps, dtype=np.int64)


@dataclass
class Shape:
    """Parameters of the filter and the model."""

    order: int = 2
    base: float = 1.5
    bits: float = 10.0
    probes: int = 6
    alpha: float = 0.5
    strength: float = 4.0

    def probed(self, keys: np.ndarray, level: int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key with that level its block, and the hash that chooses bits of the block."""
        x = mix(keys * U(0x9E3779B97F4A7C15) + U(level))
        return (x >> U(32)) * np.asarray(blocks, dtype=U) >> U(32), mix(x)

    @staticmethod
    def bit(y: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash and its bit of the block for a probe; 7 probes use up a hash."""
        y = mix(y) if probe and probe % 7 == 0 else y
        return y, y >> U(9 * (probe % 7)) & U(BLOCK - 1)

    def filled(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The filter of one bucket, as packed bits."""
        level = np.searchsorted(ladder(self.base), counts, side="right")
        blocks = max(1, -(-int(self.bits * level.sum()) // BLOCK))
        grid = np.zeros(blocks * BLOCK, dtype=bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            block, y = self.probed(keys[level >= j].astype(U), j, blocks)
            for i in range(self.probes):
                y, bit = self.bit(y, i)
                grid[block * U(BLOCK) + bit] = True
        return np.packbits(grid, bitorder="little")

    def levels(self, keys: np.ndarray, packed: np.ndarray, blocks: np.ndarray | int, start: np.ndarray | int = 0) -> np.ndarray:
        """Levels found for keys whose filter has that many blocks from block ``start`` of ``packed``: probed upwards until a probe fails."""
        found, keys = np.zeros(len(keys), np.uint8), keys.astype(U)
        blocks, start = (np.broadcast_to(np.asarray(x, dtype=U), keys.shape) for x in (blocks, start))
        alive = np.flatnonzero(blocks)
        for j in range(1, MAX_LEVELS):
            block, y = self.probed(keys[alive], j, blocks[alive])
            base = (start[alive] + block) * U(BLOCK)
            for i in range(self.probes):
                y, bit = self.bit(y, i)
                at = base + bit
                ok = packed[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1 == 1
                alive, base, y = alive[ok], base[ok], y[ok]
            if not len(alive):
                return found
            found[alive] = j
        return found

    def counts(self, levels: np.ndarray) -> np.ndarray:
        """The middle of the counts of each level; 0 for level 0."""
        steps = ladder(self.base).astype(np.float64)
        middle = np.concatenate([[0], (steps[:-1] + steps[1:] - 1) / 2, steps[-1:]])
        return middle[np.minimum(levels, len(steps))]


class Filter:
    """All buckets of a filter one after the other, as sent to the workers."""

    def __init__(self, rows: list[tuple[int, bytes]], buckets: int) -> None:
        self.buckets, self.packed = buckets, np.frombuffer(b"".join(x for _, x in rows), np.uint8)
        self.blocks, self.start = np.zeros(buckets, U), np.zeros(buckets, U)
        sizes = np.array([len(x) * 8 // BLOCK for _, x in rows], dtype=U)
        at = [k for k, _ in rows]
        self.blocks[at], self.start[at] = sizes, np.cumsum(sizes) - sizes

    def levels(self, grams: np.ndarray, shape: Shape) -> np.ndarray:
        """Levels of n-grams in ascending order: buckets follow each other, so probes lie close together."""
        of = bucket_of(grams, self.buckets)
        return shape.levels(grams.astype(np.uint32), self.packed, self.blocks[of], self.start[of])


class Bundle:
    """Some documents' tokens as numbers into a list of words; number 0 is the end."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        self.ids, self.held = row["ids"], np.array(row["held"], dtype=bool)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.words = unpack(row["words"]).split(b"\n")
        data, n = unpack(row["tokens"]), int(self.sizes.sum())
        self.tokens = np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], dtype=U)
        self.train = np.repeat(~self.held, self.sizes)
        self.place = np.arange(n) - np.repeat(self.starts, self.sizes)

    def grams(self, order: int) -> list[np.ndarray]:
        """For n from 1 to ``order`` the hash of the n-gram that ends at each token (beyond the document's start: of no use)."""
        own = self.hashes[self.tokens]
        start, out = mix(self.hashes[:1] + U(1)), [mix(own + U(1))]
        for _ in range(1, order):
            out.append(mix(np.concatenate([start, out[-1][:-1]]) * U(0xD6E8FEB86659FD93) + own))
        return out

    def exists(self, n: int) -> np.ndarray:
        """Whether the n-gram that ends at a token lies in its document, the end before it included."""
        return self.place >= n - 2


def bundles(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", bundle_tokens: int = 300_000) -> DataFrame:
    """``bundle, ids, held, sizes, words, tokens, n_words, n_tokens``: written, one row per bundle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=3).compress

        def fresh() -> tuple:
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            number[END]  # noqa: B018  gets number 0
            return number, [], [], [], []

        number, ids, held, sizes, parts = fresh()

        def flush() -> pa.RecordBatch:
            all_tokens = np.concatenate(parts)
            data = all_tokens.astype(np.uint16 if len(number) <= 1 << 16 else np.uint32).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([ids], pa.list_(arrow_id)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([pack(b"\n".join(number))], pa.binary()), pa.array([pack(data)], pa.binary()), pa.array([len(number)]), pa.array([len(all_tokens)])],
                names=["bundle", "ids", "held", "sizes", "words", "tokens", "n_words", "n_tokens"])

        waiting = 0
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for i in range(batch.num_rows):
                own = tokens(batch.column(2)[i].as_py() or b"")
                parts.append(np.fromiter(map(number.__getitem__, own), np.uint32, len(own)))
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(1)[i].as_py())
                sizes.append(len(own))
                waiting += len(own)
                if waiting >= bundle_tokens:
                    yield flush()
                    made, waiting = made + 1, 0
                    number, ids, held, sizes, parts = fresh()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(bundled, f"bundle long, ids array<{id_type}>, held array<boolean>, sizes array<long>, words binary, tokens binary, "
                                                "n_words long, n_tokens long"), "lm-bundles")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Bundle]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("bundle")[i].as_py(), Bundle(batch.slice(i, 1).to_pylist()[0])


def word_counts(bundled: DataFrame, buckets: int) -> DataFrame:
    """``bundle, kind, bucket, data, n, distinct``: each bundle's words' exact training counts, and sums by bucket in one row of it."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in rows_of(batches):
            count = np.bincount(b.tokens[b.train], minlength=len(b.words)).astype(np.uint32)
            rows = [(k, name, b"\n".join([b.words[i] for i in at.tolist()]), count[at].tobytes()) for k, at in by_bucket(mix(b.hashes), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["bucket", "bundle", "words", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        own = [np.fromiter(map(number.__getitem__, w.split(b"\n")), np.int64) for w in asked["words"].to_pylist()]
        total = np.zeros(len(number), np.int64)
        for at, c in zip(own, asked["counts"].to_pylist(), strict=True):
            total[at] += np.frombuffer(c, np.uint32)  # a bundle names a word once
        n, none = asked.num_rows, [None] * (asked.num_rows - 1)
        return pa.table({"bundle": asked["bundle"], "kind": pa.array([0] * n, pa.int32()), "bucket": asked["bucket"],
                         "data": pa.array([total[at].tobytes() for at in own], pa.binary()),
                         "n": pa.array([int(total.sum()), *none], pa.int64()), "distinct": pa.array([int((total > 0).sum()), *none], pa.int64())})

    asked = bundled.mapInArrow(ask, "bucket long, bundle long, words binary, counts binary")
    return materialize(asked.groupBy("bucket").applyInArrow(answer, "bundle long, kind int, bucket long, data binary, n long, distinct long"), "lm-words")


def fit(bundled: DataFrame, shape: Shape, buckets: int, *, task_grams: int = 1_500_000) -> DataFrame:
    """``bucket, filter, grams``: the filter of each bucket with n-grams."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            grams, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k, at in by_bucket(grams, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([grams[at].astype(np.uint32).tobytes()], pa.binary()),
                                                  pa.array([counts[at].astype(np.uint32).tobytes()], pa.binary())], names=["bucket", "keys", "counts"])
            held.clear()

        for _, b in rows_of(batches):
            for n, grams in enumerate(b.grams(shape.order), 1):
                held.append(np.unique(grams[b.train & b.exists(n)], return_counts=True))
            if sum(len(g) for g, _ in held) > task_grams:
                yield from flush()
        if held:
            yield from flush()

    def fill(rows: pa.Table) -> pa.Table:
        read = [np.frombuffer(b"".join(rows[c].to_pylist()), np.uint32) for c in ("keys", "counts")]
        keys, counts = summed(read[0], read[1].astype(np.int64))
        return pa.table({"bucket": rows["bucket"][:1], "filter": pa.array([shape.filled(keys, counts).tobytes()], pa.binary()), "grams": pa.array([len(keys)])})

    parts = bundled.mapInArrow(count, "bucket long, keys binary, counts binary")
    return materialize(parts.groupBy("bucket").applyInArrow(fill, "bucket long, filter binary, grams long"), "lm-filter")


def asked_grams(b: Bundle, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bundle's distinct n-grams, and where among them those that end at each token stand."""
    each = b.grams(order)
    grams, at = np.unique(np.concatenate(each), return_inverse=True)
    return grams, np.split(at, order)


def probed(bundled: DataFrame, filters: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """``bundle, kind, bucket, data``: levels of each bundle's n-grams, probed where the bucket's filter is."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in rows_of(batches):
            grams, _ = asked_grams(b, shape.order)
            rows = [(k, name, grams[at].astype(np.uint32).tobytes()) for k, at in by_bucket(grams, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["bucket", "bundle", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        packed = np.frombuffer(own["filter"][0].as_py() if own.num_rows else b"", np.uint8)
        keys = asked["keys"].to_pylist()
        distinct, at = np.unique(np.frombuffer(b"".join(keys), np.uint32), return_inverse=True)  # many bundles ask for the same
        found = shape.levels(distinct, packed, len(packed) * 8 // BLOCK)[at]
        ends = np.cumsum([0, *(len(k) // 4 for k in keys)]).tolist()
        return pa.table({"bundle": asked["bundle"], "kind": pa.array([1] * len(keys), pa.int32()), "bucket": asked["bucket"],
                         "data": pa.array([found[a:b].tobytes() for a, b in pairwise(ends)], pa.binary())})

    asked = bundled.mapInArrow(ask, "bucket long, bundle long, keys binary")
    return (asked.groupBy("bucket").cogroup(filters.select("bucket", "filter").groupBy("bucket"))
            .applyInArrow(answer, "bundle long, kind int, bucket long, data binary"))


def scores_of(b: Bundle, count: np.ndarray, levels: np.ndarray, at: list[np.ndarray], shape: Shape, n: int, distinct: int) -> tuple[np.ndarray, ...]:
    """``n_known, base_score, score`` of each document; ``count``: exact, by word."""
    add = lambda x: np.add.reduceat(x, b.starts)
    base = np.log10((count + 1) / (n + distinct + 1))
    est = [shape.counts(levels[a]) for a in at]
    before = np.concatenate([shape.counts(levels[at[0][-1:]]), est[0][:-1]])  # the last token is an end
    p = np.minimum(1, (est[0] + shape.alpha) / (n + shape.alpha * (distinct + 1)))
    for k in range(1, shape.order):
        after = (np.minimum(est[k], before) + shape.strength * p) / (before + shape.strength)
        p = np.where(b.exists(k + 1), after, p)
        before = np.concatenate([[0], est[k][:-1]])
    return add((count > 0)[b.tokens].astype(np.int64)), add(base[b.tokens]), add(np.log10(p))


def scored(bundled: DataFrame, replies: DataFrame, shared: Broadcast[Filter] | None, shape: Shape, n: int, distinct: int,
           word_buckets: int, gram_buckets: int) -> DataFrame:
    """One row per document; n-grams are probed in ``shared``, or their levels are among the replies."""
    id_type = bundled.schema["ids"].dataType.elementType

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bundle(rows.slice(0, 1).to_pylist()[0])
        got = {(k, c): d for k, c, d in zip(*(answers[x].to_pylist() for x in ("kind", "bucket", "data")), strict=True)}
        count = np.zeros(len(b.words), np.int64)
        for k, at in by_bucket(mix(b.hashes), word_buckets):
            count[at] = np.frombuffer(got[0, k], np.int64)
        grams, where = asked_grams(b, shape.order)
        if shared is not None:
            levels = shared.value.levels(grams, shape)
        else:
            levels = np.zeros(len(grams), np.uint8)
            for k, at in by_bucket(grams, gram_buckets):
                levels[at] = np.frombuffer(got[1, k], np.uint8)
        known, base, own = scores_of(b, count, levels, where, shape, n, distinct)
        return pa.table({"doc_id": pa.array(b.ids, rows.schema.field("ids").type.value_type), "held_out": pa.array(b.held),
                         "n_tokens": pa.array(b.sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), n, np.int64)),
                         "base_score": pa.array(base), "score": pa.array(own)})

    own = bundled.select("bundle", "ids", "held", "sizes", "words", "tokens")
    return own.groupBy("bundle").cogroup(replies.groupBy("bundle")).applyInArrow(
        score, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_seventh(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 7 is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def language_model_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None,
                          bundle_tokens: int = 300_000, bucket_words: int = 400_000, bucket_tokens: int = 1_000_000,
                          broadcast_bytes: int = 160_000_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``base_score`` uses exact counts with add-one smoothing, ``score`` the filter's.
    """
    shape = shape or Shape()
    bundled = bundles(docs, held_out, id_col=id_col, text_col=text_col, bundle_tokens=bundle_tokens)
    words, all_tokens = bundled.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_buckets, gram_buckets = (max(1, -(-(x or 0) // y)) for x, y in ((words, bucket_words), (all_tokens, bucket_tokens)))
    counts = word_counts(bundled, word_buckets)
    n, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.sum("distinct")).first())
    filters = fit(bundled, shape, gram_buckets)
    replies, shared = counts.select("bundle", "kind", "bucket", "data"), None
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= broadcast_bytes:
        rows = filters.select("bucket", "filter").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Filter(list(zip(rows["bucket"].to_pylist(), rows["filter"].to_pylist(), strict=True)), gram_buckets))
    else:
        replies = replies.unionByName(probed(bundled, filters, shape, gram_buckets))
    return scored(bundled, replies, shared, shape, n, distinct, word_buckets, gram_buckets)
