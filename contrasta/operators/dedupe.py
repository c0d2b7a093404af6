"""Keep-first de-duplication on text with a total order (smallest ``doc_id`` wins).

Two phases so that a hot text (one string holding a third of all rows) never lands
in one task with its payload: (1) ``(group, text-hash) -> min(doc_id)`` is combined
map-side, so the shuffle carries at most one 8-byte id per hash per partition;
(2) a semi join on the unique ``doc_id`` keeps the winners (uniform keys). The
hash is a 96-bit pair plus the text length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_key(col: str = "text"):
    c = F.col(col)
    return [F.xxhash64(c).alias("_h1"), F.hash(c).alias("_h2"), F.length(c).alias("_len")]


def dedupe_keep_first(df: DataFrame, text_col: str = "text", order_col: str = "doc_id",
                      within=()) -> DataFrame:
    """Rows of ``df`` whose text (inside each ``within`` group) was not seen at a
    smaller ``order_col``. Null texts form one group, as in pandas."""
    keys = [F.col(c) for c in within] + text_key(text_col)
    winners = (df.select(order_col, *keys)
               .groupBy(*[k for k in ["_h1", "_h2", "_len", *within]])
               .agg(F.min(order_col).alias(order_col)))
    return df.join(winners.select(order_col), order_col, "left_semi")


def keep_first_rows(df: DataFrame, text_col: str = "text", order_col: str = "doc_id", within=()) -> DataFrame:
    """The same decision in one pass, for rows that are costly to make twice.

    Rows are grouped on the text itself and carry those of the smallest ``order_col`` along;
    copies collapse map-side, so a hot text leaves one row per task and texts move once.
    Rows without ``order_col`` are never first. One row is left per text and group.
    """
    keys = [*within, text_col]
    rest = [c for c in df.columns if c not in keys]
    first = (df.where(F.col(order_col).isNotNull()).groupBy(*keys)
             .agg(F.min_by(F.struct(*rest), order_col).alias("_first")))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])
