"""Label harmonisation by one rule table ``(source, kind, raw, action, priority)``.

Every source's rules are rows of ``lexicons/label_rules.csv``; no source has code of its own. A
row's source brings its few rules along (one broadcast join for all sources), and the first rule that
matches the raw label decides: a label, ``=`` to keep the raw label, or nothing to drop the row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.operators._util import lookup_table
from contrasta.operators.tokens import computed_once

NAMES = dict(lexicons.table("names"))
TARGETS = (NAMES["label_false"], NAMES["label_true"])
KEEP, DROP = "=", ""
KINDS = ("null", "exact", "folded", "numeric", "prefix", "any")
Rule = tuple[str, str, str, str, int]
_RULES = "array<struct<kind:string,raw:string,action:string>>"


def label_rules() -> list[Rule]:
    return [(s, k, raw, action, int(p)) for s, k, raw, action, p in lexicons.table("label_rules")]


def _by_source(table: Iterable[Rule], on_unmapped: str | None) -> dict[str, list[tuple[str, str, str]]]:
    """Each source's rules, those of least priority first; ``on_unmapped`` replaces its last resort."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for source, kind, raw, action, _ in sorted(table, key=lambda r: r[4]):
        if kind not in KINDS:
            raise ValueError(f"Unknown kind of rule: {kind}")
        if kind != "any" or on_unmapped is None:
            out.setdefault(source, []).append((kind, raw, action))
        else:
            out.setdefault(source, [])
    for rules in out.values():
        rules.append(("any", "", DROP if on_unmapped is None else on_unmapped))
    return out


def _matches(label: Column, rule: Column) -> Column:
    kind, raw, text = rule["kind"], rule["raw"], F.coalesce(label, F.lit("nan"))  # so a missing value reads as text
    hit = (F.when(kind == "null", label.isNull()).when(kind == "exact", label == raw).when(kind == "folded", F.lower(text) == raw)
           .when(kind == "numeric", label.try_cast("double") == raw.try_cast("double")).when(kind == "prefix", text.startswith(raw)).otherwise(True))
    return F.coalesce(hit, F.lit(False))


def harmonize_by_source(df: DataFrame, source_col: str, label_col: str = "label", table: Iterable[Rule] | None = None,
                        on_unmapped: str | None = None) -> DataFrame:
    """Harmonised labels of rows of any sources; a source without rules stops the job.

    ``on_unmapped`` says what becomes of labels that no rule names: ``""`` drops the row, ``"="`` keeps
    the label, anything else is the new label. By default the table's ``any`` rule says so, else they are dropped.
    """
    by = _by_source(label_rules() if table is None else table, on_unmapped)
    rules = lookup_table(df.sparkSession, sorted(by.items()), f"_source string, _rules {_RULES}")
    d = df.join(rules, F.col(source_col) == F.col("_source"), "left")
    known = F.when(F.col("_rules").isNull(), F.raise_error(F.concat(F.lit("Unknown source: "), F.coalesce(source_col, F.lit("null")))).cast(_RULES)) \
        .otherwise(F.col("_rules"))
    return _decided(d, known, label_col).select(df.columns)


def harmonize_labels(df: DataFrame, source: str, label_col: str = "label", table: Iterable[Rule] | None = None,
                     on_unmapped: str | None = None) -> DataFrame:
    """Harmonised labels of rows of one source; unknown sources raise before any job."""
    by = _by_source(label_rules() if table is None else table, on_unmapped)
    if source not in by:
        raise ValueError(f"Unknown source: {source}")
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("raw"), F.lit(a).alias("action")) for k, r, a in by[source]])
    return _decided(df, rules, label_col).select(df.columns)


def _decided(df: DataFrame, rules: Column, label_col: str) -> DataFrame:
    label = F.col(label_col).cast("string")
    d = computed_once(df, F.get(F.filter(rules, lambda r: _matches(label, r)), 0)["action"], "_action").where(F.col("_action") != DROP)
    return d.withColumn(label_col, F.when(F.col("_action") == KEEP, label).otherwise(F.col("_action")))
