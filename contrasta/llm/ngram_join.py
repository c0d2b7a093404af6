"""Exact Jaccard self-join on word shingles by filters under several global token orders.

A document's set holds the 64-bit hashes of its distinct ``n``-word shingles. For a threshold ``t``
two sets of Jaccard similarity ``t`` or more share a token among the first
``size - ceil(t * size) + 1`` tokens of both, under every total order of the tokens. Two orders are
used: A puts long shingles first (these are rare, so few sets meet by chance), B is a hash order;
both put the corpus's most frequent shingles last, so that shared passages do not meet. A pair is
verified only if its sizes allow it and it passes both filters. For B the prefixes are also
compared: up to where both are known, they must not differ by more than linked sets may.

0. Shingles that are frequent in some batch are counted over all batches; the ``frequent`` most
   frequent go last. This only chooses the orders: results do not depend on it.
1. Rows with equal sets collapse into a class named by one of its rows, so copies are never paired.
2. Postings (token, class) of the A prefixes are counted. Tokens of at most ``cold_rows`` classes
   give all their pairs; those whose B prefixes meet too are verified.
3. Tokens of more classes never emit all pairs. Their *pivot* is the class that has most such
   tokens. Classes that cannot be linked to it and whose B prefix has less than half in common with
   the pivot's are *far*: they merely share a passage. They meet all classes of their token, with
   sizes and B filter as condition, and their sets are only made if a pair passes. The others are
   compared with the pivot. Those whose difference to it is at most half their size form its ring;
   the rest (and those a little closer) stay with the token and meet each other as the far ones do.
   So any two linked classes of a token meet: with a far one in the token, else both in the ring or
   both among those that stay. In a ring, classes linked to the pivot are in one component already;
   for the rest only differences to the pivot are compared, in blocks of bounded size that report a
   spanning forest of their links. Two linked classes of which one is not linked to the pivot share
   a token of these differences (else their own difference would exceed that of the one to the
   pivot, which is too large already).
4. Links become components by repeated minimum propagation.

Rows are told apart by a number of their own, so ids may be null or repeated, with equal or different texts.

Defined cases: null or blank texts have the empty set and are linked with nothing; a row without id
links as any other, and its component is the smallest id in it, or null; rows of one id with different
texts each have their own class; repeated rows are equals; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import give_back, materialize

#: The bytes of A-Z become those of a-z, and all that separates words becomes a space.
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LEN_BITS, _TOP = np.uint64(56), np.uint64(1 << 63)
CACHE_WORDS = 50_000
#: Rows whose texts and sets a task holds at once, within an Arrow batch.
SLICE_ROWS = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingles of a text as sorted uint64.

    The top bit is set for shingles in ``last``; the next 7 hold 127 minus the shingle's length in
    bytes (at least 0), the others a hash: in ascending order long shingles come first. Order B is
    ascending ``reorder`` of the tokens.
    """

    def __init__(self, n: int, last: np.ndarray | None = None) -> None:
        self.n, self._known, self.last = n, {}, last

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ")
        words = [w for w in words if w]
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = self._word_hashes(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        k = min(self.n, len(words))
        m = len(words) - k + 1
        with np.errstate(over="ignore"):
            token, length = np.full(m, np.uint64(k)), np.zeros(m, dtype=np.int64)
            for i in range(k):
                token = _mix(token * _M1 + h[i:m + i])
                length += size[i:m + i]
        rank = (127 - np.minimum(length, 127)).astype(np.uint64)
        tokens = np.unique(rank << _LEN_BITS | token >> np.uint64(8))
        if self.last is not None and len(self.last):
            at = np.minimum(np.searchsorted(self.last, tokens), len(self.last) - 1)
            tokens[self.last[at] == tokens] |= _TOP
            tokens.sort()
        return tokens


def reorder(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((tokens & np.uint64((1 << 56) - 1)) * _M2 + _M3) >> np.uint64(1) | tokens & _TOP


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    """With the top bit flipped signed numbers sort as the unsigned ones do."""
    return (x ^ _TOP).view(np.int64)


def frequent_shingles(docs: DataFrame, n: int, most: int, in_batch: int = 4) -> np.ndarray:
    """At most ``most`` of the shingles that many different sets hold, most frequent first chosen.

    A batch reports the shingles that ``in_batch`` or more of its different sets hold.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            sets = {}
            for part in _slices(batch):
                for s in map(shingles, part.column(0).to_pylist()):
                    sets.setdefault(xxhash.xxh3_128_digest(s.tobytes()), s)
            if sets:
                tokens = np.concatenate(list(sets.values()))
                sets.clear()
                token, count = np.unique(tokens, return_counts=True)
                many = count >= in_batch
                yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many].astype(np.int64))], names=["token", "m"])
        give_back()

    counted = docs.select("text").mapInArrow(rows, "token long, m long").groupBy("token").agg(F.sum("m").alias("m"))
    found = counted.orderBy(F.desc("m"), "token").limit(most).select("token").toPandas()
    return np.sort(found["token"].to_numpy(dtype=np.int64).view(np.uint64))


def filters(docs: DataFrame, n: int, percent: int, last: Broadcast) -> DataFrame:
    """Id, text hash, class signature and size of every row, its A prefix ``p`` and the upper halves ``q`` of its B prefix.

    Rows of one slice with equal sets leave the prefixes to the first one.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n, last.value)
        for batch in (part for whole in batches for part in _slices(whole)):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            best: dict[bytes, int] = {}
            for i, sig in enumerate(sigs):
                if len(sets[i]):
                    best.setdefault(sig, i)
            first, second = [np.empty(0, np.uint64)] * len(sets), [np.empty(0, np.int32)] * len(sets)
            for i in best.values():
                k = prefix_length(len(sets[i]), percent)
                first[i] = sets[i][:k]
                second[i] = (np.unique(np.sort(reorder(sets[i]))[:k] >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), _lists([_signed(x) for x in first]),
                 _lists(second, np.int32)], names=["doc_id", "hash", "sig", "n", "p", "q"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(rows, f"doc_id {kind}, hash long, sig binary, n int, p array<long>, q array<int>")


def whole_sets(docs: DataFrame, n: int, last: Broadcast) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n, last.value)
        for batch in (part for whole in batches for part in _slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([_signed(shingles(t)) for t in batch.column(1).to_pylist()])], names=["rep", "tokens"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(rows, f"rep {docs.schema['doc_id'].dataType.simpleString()}, tokens array<long>")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE_ROWS) for i in range(0, batch.num_rows, SLICE_ROWS))


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) with both sets ``sa``, ``sb`` and whether they are linked."""
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("sa")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("sb")), "b")
            .withColumn("shared", F.size(F.array_intersect("sa", "sb"))))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return both.withColumn("linked", 100 * F.col("shared") >= percent * union)


def _may_differ(a: Column, b: Column, percent: int) -> Column:
    """Tokens in which linked sets of sizes a and b differ at most."""
    return F.floor((a + b) * F.lit(100 - percent) / F.lit(100 + percent))


def _near_prefixes(percent: int) -> Column:
    """The filter of order B on columns na, nb, qa, qb.

    Below the end of the shorter known stretch, tokens of one prefix that the other lacks differ.
    """
    end = F.least(F.element_at("qa", -1), F.element_at("qb", -1))
    shared = F.size(F.array_intersect("qa", "qb"))
    differ = F.size(F.filter("qa", lambda x: x < end)) + F.size(F.filter("qb", lambda x: x < end)) - 2 * shared
    return (shared > 0) & (differ <= _may_differ(F.col("na"), F.col("nb"), percent))


def _prefix_distance(hot: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Class ``a`` of size n, its pivot ``b``, and whether they are ``far``: not linked, and more than half apart as far as B prefixes tell."""
    end = F.least(F.element_at("qa", -1), F.element_at("qb", -1))
    known = F.size(F.filter("qa", lambda x: x <= end)) + F.size(F.filter("qb", lambda x: x <= end))
    apart = 4 * F.size(F.array_intersect("qa", "qb")) < known
    both = (hot.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
            .join(prefixes.select(F.col("rep").alias("a"), F.col("q").alias("qa"), F.col("n").alias("na")), "a")
            .join(prefixes.select(F.col("rep").alias("b"), F.col("q").alias("qb"), F.col("n").alias("nb")), "b"))
    return both.select("a", "b", F.col("na").alias("n"), (apart & ~_near_prefixes(percent)).alias("far")).distinct()


def _side(members: DataFrame, name: str) -> DataFrame:
    return members.select("key", F.col("rep").alias(name), F.col("n").alias(f"n{name}"), F.col("q").alias(f"q{name}"), F.col("far").alias(f"out_{name}"))


def _near(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the filter of order B; ``prefixes``: rep, n, q."""
    known = (pairs.join(prefixes.select(F.col("rep").alias("a"), F.col("q").alias("qa"), F.col("n").alias("na")), "a")
             .join(prefixes.select(F.col("rep").alias("b"), F.col("q").alias("qb"), F.col("n").alias("nb")), "b"))
    return known.where(_near_prefixes(percent)).select("a", "b")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, n) of keys that several classes have, with their number ``m``."""
    keys = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return materialize(rows.join(keys, "key"), "join-postings")


def _shared_postings(postings: DataFrame) -> DataFrame:
    """Postings (key, rep, n) of keys that more than one row has.

    Keys of frequent shingles (not negative: the flipped top bit) are counted with pre-aggregation
    and joined, so a hot one can be split; the others are few rows each and are counted in place.
    """
    hot = postings.where("key >= 0")
    keys = hot.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    rare = (postings.where("key < 0").withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1").drop("m"))
    return rare.unionByName(hot.join(keys, "key").select("key", "rep", "n"))


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _cold_pairs(counted: DataFrame, cold_rows: int, percent: int) -> DataFrame:
    """The pairs of each cold key that sizes allow; each pair once."""
    members = (counted.where(F.col("m") <= cold_rows).groupBy("key")
               .agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("all")))
    return (members.select(F.posexplode("all").alias("i", "x"), "all")
            .select("x", F.explode(F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda y: _near_sizes(F.col("x.n"), y["n"], percent))).alias("y"))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def _with_pivots(counted: DataFrame, cold_rows: int) -> DataFrame:
    """Rows (key, rep, n, pivot) of hot keys; the pivot is the class with most hot keys."""
    hot = counted.where(F.col("m") > cold_rows).select("key", "rep", "n")
    often = hot.groupBy("rep").agg(F.count("*").alias("keys"))
    best = (hot.join(often, "rep").groupBy("key").agg(F.min(F.struct(-F.col("keys"), "rep")).alias("best"))
            .select("key", F.col("best.rep").alias("pivot")))
    return materialize(hot.join(best, "key"), "join-pivots")


def _ring_links(rings: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Links inside the rings (pivot, a, n, linked, d), from blocks of at most about ``block_rows`` classes."""
    sizes = rings.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"), F.min("linked").alias("all"))
    dealt = rings.join(sizes.where("not all").select("pivot", "blocks"), "pivot").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # every block meets every block once
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    kind = rings.schema["a"].dataType.simpleString()

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, linked = pdf["a"].tolist(), pdf["n"].tolist(), pdf["linked"].tolist()
        d = [x.tolist() for x in pdf["d"]]
        holders: dict[int, list[int]] = {}
        for v, tokens in enumerate(d):
            for t in tokens:
                holders.setdefault(t, []).append(v)
        up = list(range(len(ids)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        star = next((v for v, x in enumerate(linked) if x), 0)
        for v, x in enumerate(linked):  # these are joined by the pivot
            if x:
                up[v] = star
        out = []
        for u, x in enumerate(linked):
            if x:
                continue
            for v, c in Counter(v for t in d[u] for v in holders[t]).items():
                differ = len(d[u]) + len(d[v]) - 2 * c
                if differ * (100 + percent) <= (n[u] + n[v]) * (100 - percent) and root(u) != root(v):
                    up[root(u)] = root(v)
                    out.append((ids[u], ids[v]))
        return pd.DataFrame(out, columns=["a", "b"])

    return met.groupBy("pivot", "i", "j").applyInPandas(forest, f"a {kind}, b {kind}")


def links(rows: DataFrame, names: DataFrame, texts_of: Callable[[DataFrame], DataFrame], last: Broadcast, *, n: int = 5, percent: int = 80,
          cold_rows: int = 16, block_rows: int = 1024) -> DataFrame:
    """Linked pairs ``a < b`` of classes, enough of them to connect all linked classes.

    ``rows``: as made by ``filters``, with the row's number as ``doc_id``; ``names``: doc_id, rep for the
    rows that do not name their class themselves; ``texts_of``: doc_id, text for such numbers, from which
    the sets of classes that pass the filters are made.
    """
    shared = _shared_postings(rows.select(F.explode("p").alias("key"), F.col("doc_id").alias("rep"), "n"))
    named = (shared.join(names.select(F.col("doc_id").alias("rep"), F.col("rep").alias("name")), "rep", "left")
             .select("key", F.coalesce("name", "rep").alias("rep"), "n").distinct())
    counted = _counted(materialize(named, "join-shared"))
    prefixes = rows.where(F.size("q") > 0).select(F.col("doc_id").alias("rep"), "n", "q")
    pairs = materialize(_near(_cold_pairs(counted, cold_rows, percent), prefixes, percent), "join-pairs")
    hot = _with_pivots(counted, cold_rows)
    any_hot = not hot.isEmpty()
    if any_hot:
        star = materialize(_prefix_distance(hot, prefixes, percent), "join-distance")
        members = materialize(hot.where("rep != pivot").join(star.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "far"), ["rep", "pivot"])
                              .join(prefixes.select("rep", "q"), "rep").distinct(), "join-members")
        one, other = _side(members, "a").where("out_a"), _side(members, "b")
        once = (F.col("a") != F.col("b")) & (~F.col("out_b") | (F.col("a") < F.col("b")))
        apart = one.join(other, "key").where(once & _near_sizes(F.col("na"), F.col("nb"), percent)).where(_near_prefixes(percent))
        pairs = materialize(pairs.union(apart.select("a", "b")).distinct(), "join-pairs")
        star = star.where("not far").select("a", "b", "n")
    wanted = pairs.select("a").union(pairs.select("b"))
    compared = pairs.select("a", "b", F.lit(None).cast("int").alias("n"))
    if any_hot:
        wanted, compared = wanted.union(star.select("a")).union(star.select("b")), compared.union(star)
    wanted = materialize(wanted.distinct().withColumnRenamed("a", "doc_id"), "join-wanted")
    sets = materialize(whole_sets(texts_of(wanted), n, last), "join-sets")
    apart_by = F.size("sa") + F.size("sb") - 2 * F.col("shared")
    ring = percent * apart_by <= (135 - percent) * F.col("n")  # .35 / t + (1 - t) / t: whatever is linked to one that does not stay
    known = materialize(_compared(compared, sets, percent).where("linked or n is not null").select(
        "a", "b", "n", "linked", (100 * apart_by > 35 * F.col("n")).alias("stays"),
        F.when(ring, F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))).alias("d")), "join-compared")
    found = [known.where("linked").select("a", "b")]
    if any_hot:
        found.append(_ring_links(known.where("d is not null").select(F.col("b").alias("pivot"), "a", "n", "linked", "d"), percent, block_rows))
        stay = members.join(known.where("stays").select(F.col("a").alias("rep"), F.col("b").alias("pivot")), ["rep", "pivot"])
        left = (_side(stay, "a").join(_side(stay, "b"), "key").where(F.col("a") < F.col("b"))
                .where(_near_sizes(F.col("na"), F.col("nb"), percent)).where(_near_prefixes(percent)).select("a", "b").distinct())
        found.append(_compared(materialize(left, "join-pairs"), sets, percent).where("linked").select("a", "b"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``edges`` (a, b)."""
    pairs = materialize(edges.select("a", "b").union(edges.select("b", "a")), "join-edges")
    label = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "join-labels")
    for _ in range(most_rounds):
        near = (pairs.join(label.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = label.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        # the label of one's label: paths halve in every round
        jump = step.join(label.select(F.col("node").alias("low"), F.col("component").alias("far")), "low")
        new = materialize(jump.select("node", F.least("low", "far").alias("component"),
                                      (F.least("low", "far") < F.col("component")).alias("moved")), "join-labels")
        label = new.select("node", "component")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                          cold_rows: int = 16, block_rows: int = 1024, frequent: int = 1 << 17) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable
    over links of Jaccard similarity ``percent`` / 100 or more.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    last = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n, frequent))  # 8 bytes each
    rows = materialize(filters(docs, n, percent, last).withColumn("row", F.monotonically_increasing_id()), "join-filters")
    holder = F.when(F.size("p") > 0, F.col("row"))
    classes = materialize(rows.where("n > 0").groupBy("sig").agg(F.min(holder).alias("rep"), F.min("doc_id").alias("least")), "join-classes")
    names = (rows.where(F.size("p") > 0).select(F.col("row").alias("doc_id"), "sig").join(classes.select("sig", "rep"), "sig")
             .where("doc_id != rep").select("doc_id", "rep"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """A row is found again by its id and the hash of its text; repeated rows hold one text."""
        place = rows.select(F.col("row").alias("of_row"), F.col("doc_id").alias("of_id"), "hash").join(
            wanted.withColumnRenamed("doc_id", "of_row"), "of_row")
        found = docs.join(place, (F.xxhash64("text") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
        return found.select(F.col("of_row").alias("doc_id"), "text").dropDuplicates(["doc_id"])

    linked = components(links(rows.select(F.col("row").alias("doc_id"), "n", "p", "q"), names, texts_of, last, n=n, percent=percent,
                              cold_rows=cold_rows, block_rows=block_rows))
    low = classes.join(linked, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("least").alias("low"))
    named = classes.join(linked.join(low, "component").select("node", "low"), F.col("rep") == F.col("node"), "left").select(
        "sig", "least", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("low")).alias("low"))
    out = rows.select("doc_id", "sig", "n").join(named, "sig", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, with all its columns.

    Rows without id come last in their group. Blank texts are in no group: one row of each id and text stays.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows", "zstd")
    groups = near_duplicate_groups(rows, id_col="__row", text_col=text_col, n=n, percent=percent)
    names = rows.select(F.col("__row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    blank = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = [F.when(~blank, F.col("component_id")).alias("a"), F.when(blank, F.col("id")).alias("b"), F.when(blank, F.col("hash")).alias("c")]
    firsts = (groups.withColumnRenamed("doc_id", "__row").join(names, "__row").groupBy(*group)
              .agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first")))
    return rows.join(firsts.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(docs.columns)
