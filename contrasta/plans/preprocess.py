"""Corpus preparation: domain -> clean -> drop empty -> English filter on one domain
-> keep-first dedupe per domain. Each document is cleaned once, in the scan's stage;
the dedupe is the only shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasta.functions.text import clean_text
from contrasta.operators.dedupe import keep_first_rows
from contrasta.operators.domains import assign_domain, drop_credible
from contrasta.operators.labels import harmonize_by_source
from contrasta.operators.language import language_of
from contrasta.operators.tokens import computed_once

UNIFIED = ["doc_id", "text", "label", "domain", "source", "dataset"]
# ids of one source lie between its position times this and the next source's; generated ids of 2^25 tasks fit
IDS_PER_SOURCE = 1 << 58
MOST_SOURCES = 1 << 5


def prepare_corpus(docs: DataFrame, rules: dict[str, str] | None = None,
                   english_domain: str | None = "covid", assign: bool = True, materialize=None) -> DataFrame:
    """Unified documents, cleaned and de-duplicated; rows without id are dropped.

    Equal texts of a domain have one language, so the language filter may stand before the
    dedupe, where it is part of the scan's stage. ``materialize`` (e.g. a checkpoint into the
    shared checkpoint folder) is applied to the result.
    """
    d = docs.where(F.col("doc_id").isNotNull())
    d = assign_domain(d, rules) if assign else d
    d = computed_once(d, clean_text("text"), "text").where(F.col("text") != "")
    if english_domain is not None:
        is_target = F.col("domain").eqNullSafe(english_domain)
        d = computed_once(d, F.when(is_target, F.coalesce(language_of("text", decode=False), F.lit(""))), "_lang")
        d = d.where(F.col("_lang").isNull() | (F.col("_lang") == "en")).drop("_lang")
    d = keep_first_rows(d.select(*[c for c in UNIFIED if c in d.columns]), "text", within=("domain",))
    return materialize(d) if materialize is not None else d


def prepare_sources(sources: Iterable[tuple[DataFrame, str]], rules: dict[str, str] | None = None,
                    english_domain: str | None = "covid", materialize=None) -> DataFrame:
    """The corpus of several normalised sources, each with the name of its label rule.

    All are united first: one rule join harmonises the labels of every source, domains are assigned (a
    source's own domain stays) and credible rows dropped. Ids become unique over the sources and keep
    their order: position of the source, then the source's own id; an id outside 0 to
    ``IDS_PER_SOURCE`` would run into another source's and stops the job.
    """
    docs, sources = None, list(sources)
    if not 0 < len(sources) <= MOST_SOURCES:
        raise ValueError("no sources given" if not sources else f"more than {MOST_SOURCES} sources")
    for i, (df, rule) in enumerate(sources):
        own = F.col("doc_id").cast("long")
        fits = own.isNull() | own.between(0, IDS_PER_SOURCE - 1)
        unique = F.when(fits, own + F.lit(i * IDS_PER_SOURCE).cast("long")).otherwise(
            F.raise_error(F.concat(F.lit("id outside a source's range: "), own.cast("string"))).cast("long"))
        domain = F.col("domain") if "domain" in df.columns else F.lit(None).cast("string")
        part = df.select(unique.alias("doc_id"), "text", F.col("label").cast("string").alias("label"), domain.alias("domain"), "source", "dataset", F.lit(rule).alias("_rule"))
        docs = part if docs is None else docs.unionByName(part)
    docs = drop_credible(assign_domain(harmonize_by_source(docs, "_rule"), rules)).select(UNIFIED)
    return prepare_corpus(docs, english_domain=english_domain, assign=False, materialize=materialize)
