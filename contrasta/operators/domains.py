"""Domain assignment and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasta import lexicons
from contrasta.operators._util import lookup_table
from contrasta.operators.labels import TARGETS

_ROUTED = lexicons.table("dataset_domains")
COVID_DATASETS, CLIMATE_DATASETS = ([d for d, to in _ROUTED if to == domain] for domain in ("covid", "climate"))


def domain_rules(covid=COVID_DATASETS, climate=CLIMATE_DATASETS, **others) -> dict[str, str]:
    """dataset -> domain; assignments later in the argument order override earlier ones."""
    out: dict[str, str] = {}
    for domain, names in [("covid", covid), ("climate", climate), *others.items()]:
        for n in names:
            out[n] = domain
    return out


def assign_domain(df: DataFrame, rules: dict[str, str] | None = None,
                  dataset_col: str = "dataset", default: str = "general") -> DataFrame:
    """Set ``domain`` from the dataset name: broadcast lookup, ``default`` when unlisted.

    A domain that a source has set itself stays.
    """
    rules = domain_rules() if rules is None else rules
    m = lookup_table(df.sparkSession, sorted(rules.items()), "_ds string, _dom string")
    out = df.join(m, F.col(dataset_col) == F.col("_ds"), "left")
    cols = [c for c in df.columns if c != "domain"]
    preset = [F.col("domain")] if "domain" in df.columns else []
    return out.select(*cols, F.coalesce(*preset, F.col("_dom"), F.lit(default)).alias("domain"))


def route(df: DataFrame, domain: str) -> DataFrame:
    """Rows of one domain (prunes partitions when the table is partitioned by domain)."""
    return df.where(F.col("domain") == domain)


def drop_credible(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Drop rows labelled ``credible``; null labels stay."""
    return df.where(~F.col(label_col).eqNullSafe(TARGETS[1]))
