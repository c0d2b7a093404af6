"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by (source, exact length).
2. Source targets share the whole size by weight; a target stops at ``max_repeat`` times its
   source's size and the excess goes to the others by weight, until none is above.
3. Each source takes all its documents ``floor(target / size)`` times. The rest of its target is a
   bounded subset-sum problem over the length counts: every length first gives its proportional
   share, longer lengths close the gap down to ``window`` words, and bounded-knapsack dynamic
   programming over the lengths still available fits what is left.
4. Which documents of a length are taken is decided by a seeded hash of the id. Lengths with many
   documents are cut into hash ranges first, so no task ranks a whole hot length.

Only counts by length reach the fitting step, one source at a time; texts are read once.

Defined cases: null and blank texts have size 0 and are never taken (``copies`` 0); null sources
form the last source; rows with the same id and size are interchangeable, so any of them may be
taken; rows without id are chosen by a hash of their text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import materialize, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def source_key(col: Column) -> Column:
    """Sorts by code point, nulls last, and joins like any string."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """``key, source_size, target``: one row per source, so the ordered windows stay small.

    Sorted by cap / weight, the sources whose target stops at its cap come first: a source is
    capped if the share of what its predecessors leave would exceed its own cap.
    """
    order = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    per = (sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
           .withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
           .withColumn("ratio", F.col("cap") / F.col("w")))
    per = (per.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))))
    # the first source that stays below its cap sets the level of all that do
    per = per.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(every))
    return per.select("key", "source_size", F.when(F.col("level") <= F.col("ratio"), F.col("w") * F.col("common.level"))
                      .otherwise(F.col("cap")).alias("target"))


def knapsack(room: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many of each length to take so that the sum is as close to ``room`` as it can be from below.

    Reachable sums are the bits of an integer; counts are split into powers of two.
    """
    take, items, reach = [0] * len(lengths), [], [1]
    full = (1 << (room + 1)) - 1
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        c, k = min(c, room // n) if n else 0, 1
        while c > 0 and not reach[-1] >> room & 1:
            k = min(k, c)
            items.append((i, k))
            reach.append((reach[-1] | reach[-1] << (n * k)) & full)
            c, k = c - k, 2 * k
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    for j in range(len(items), 0, -1):
        if not reach[j - 1] >> at & 1:
            i, k = items[j - 1]
            take[i] += k
            at -= lengths[i] * k
    return take


def fit_lengths(lengths: list[int], counts: list[int], target: float, max_repeat: int = 3,
                window: int = 65536) -> tuple[int, list[int]]:
    """Whole rounds over all documents, and how many of each length to take once more."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if size <= 0:
        return 0, [0] * len(lengths)
    rounds = min(max_repeat, math.floor(target / size))
    budget = 0 if rounds == max_repeat else min(size, max(0, round(target - rounds * size)))
    take = [c * budget // size if n else 0 for n, c in zip(lengths, counts, strict=True)]
    room = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if room <= window or not lengths[i]:
            break
        k = min(counts[i] - take[i], (room - window) // lengths[i])
        take[i], room = take[i] + k, room - lengths[i] * k
    # long lengths first: few of them come near, the shorter ones then fill the rest
    order = sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= room and counts[i] > take[i]), key=lambda i: -lengths[i])
    for i, k in zip(order, knapsack(room, [lengths[i] for i in order], [counts[i] - take[i] for i in order]), strict=True):
        take[i] += k
    return rounds, take


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 17, window: int = 65536,
        rank_rows: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the columns ``carry`` for every row of ``docs``.

    ``copies`` says how often the mix takes the document, ``taken`` is ``copies * size`` words.
    """
    text = text_or_empty(F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                        F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("without_id"), *carry)
    sizes = materialize(sizes.withColumn("key", source_key(F.col("source")))
                        .withColumn("pick", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("without_id"))), "mix-sizes")
    targets = source_targets(sizes, weights, max_repeat)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        rounds, take = fit_lengths([int(x) for x in rows["size"]], [int(x) for x in rows["n"]],
                                   float(rows["target"].iloc[0]), max_repeat, window)
        return rows.assign(rounds=rounds, take=take)[["key", "size", "n", "source_size", "target", "rounds", "take"]]

    lengths = sizes.groupBy("key", "size").agg(F.count("*").alias("n"))
    plan = materialize(lengths.join(targets, "key").groupBy("key").applyInPandas(
        fit, "key string, size long, n long, source_size long, target double, rounds long, take long"), "mix-plan")

    ranges = F.ceil(F.col("n") / F.lit(rank_rows))
    part = F.when(F.col("n") <= rank_rows, F.lit(0).cast("long")).otherwise(
        F.floor(F.pmod(F.col("pick"), F.lit(1 << 30)) * ranges / F.lit(1 << 30)))
    rows = sizes.join(plan, ["key", "size"]).withColumn("part", part)
    # documents of the same length in earlier hash ranges; only lengths with several ranges have any
    parts = rows.where(F.col("n") > rank_rows).groupBy("key", "size", "part").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "size", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("pick", "doc_id"))
    rows = (rows.withColumn("rank", rank).join(parts, ["key", "size", "part"], "left")
            .withColumn("copies", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(
                F.col("rounds") + (F.coalesce("before", F.lit(0)) + F.col("rank") <= F.col("take")).cast("long"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; ids may be null or repeated."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows", "zstd")
    copies = mix(rows, **params, carry=("__row",)).select("__row", "copies").where("copies > 0")
    return (rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(docs.columns))
