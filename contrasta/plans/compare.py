"""End-to-end comparison of two domains: the three stages of the original tool
(prepare, featurise, compare) as one function over Spark tables.

Intermediate tables that several outputs read (the corpus, the feature table,
the TF-IDF weights) are checkpointed once into the session's checkpoint folder;
outputs are returned as DataFrames and optionally written (parquet partitioned
by domain for documents, JSON for nested payloads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasta.operators import reports as rp
from contrasta.operators import tfidf
from contrasta.plans import analyze as an
from contrasta.plans.featurize import feature_table, with_lemmas
from contrasta.plans.preprocess import prepare_corpus
from contrasta.session import ensure_checkpoint_dir
from contrasta.sources import io


def _materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compare_corpora(raw_docs: DataFrame, rules: dict[str, str], a: str = "covid", b: str = "climate",
                    top_n: int = 25, examples_per_term: int = 3, n_boot: int = 2000,
                    out_dir: str | None = None) -> dict[str, DataFrame]:
    corpus = prepare_corpus(raw_docs, rules, english_domain=a, materialize=_materialize)
    docs = _materialize(with_lemmas(corpus.where(F.col("domain").isin(a, b))))
    feats = _materialize(feature_table(docs, lemmas=False))
    _, sizes, _, weights = tfidf.fit(docs, materialize=_materialize)
    weights = _materialize(weights)
    top = _materialize(tfidf.top_n_per_domain(tfidf.mean_scores(weights, sizes), top_n))
    records, examples = an.term_context(weights, feats, top, examples_per_term)
    stats = _materialize(an.run_stats(feats, a, b))
    rhet = an.rhetoric_tests(feats, a, b)
    out = {
        "documents": corpus,
        "features": feats,
        "top_terms": top,
        "term_context": an.term_context_payload(records, examples, docs, feats),
        "statistical_tests": stats,
        "rhetoric_tests": rhet,
        "rhetoric_frame": rp.rhetoric_frame(rhet, a, b),
        "sentiment_frame": rp.sentiment_frame(feats, stats, a, b),
        "key_findings": an.key_findings(feats, a, b, n_boot=n_boot),
        "summary": an.summary_payload(feats, stats, a, b),
        "summary_counts": an.summary_counts(feats),
    }
    if out_dir:
        io.write_processed(corpus, f"{out_dir}/processed")
        for name in ("features", "top_terms", "statistical_tests", "rhetoric_tests", "key_findings", "summary_counts"):
            out[name].write.mode("overwrite").parquet(f"{out_dir}/analysis/{name}")
        io.write_json(out["term_context"], f"{out_dir}/analysis/term_context")
        io.write_json(out["summary"], f"{out_dir}/analysis/summary")
    return out
