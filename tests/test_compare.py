import os
import tempfile

import pytest

from contrasta.operators.emotion import EMOTION_COLUMNS
from contrasta.operators.sentiment import VADER_COLUMNS
from contrasta.plans import analyze as an
from contrasta.plans.compare import compare_corpora
from contrasta.sources.driver import DRIVER_DOMAIN_RULES, documents_unified

SF = "/root/testdata/sf0.001"


def test_compare_corpora_end_to_end(spark):
    out_dir = tempfile.mkdtemp(prefix="contrasta-e2e-", dir="/tmp")
    out = compare_corpora(documents_unified(spark, SF), DRIVER_DOMAIN_RULES, n_boot=200, out_dir=out_dir)
    stats = out["statistical_tests"].collect()
    assert len(stats) == 16
    assert {r.domain for r in out["top_terms"].collect()} == {"covid", "climate"}
    assert out["key_findings"].count() == 4
    summary = out["summary"].first()
    assert summary.numeric_test == "mann_whitney_u" and set(summary.domains) == {"covid", "climate"}
    assert os.path.isdir(os.path.join(out_dir, "processed", "domain=covid"))
    payload = spark.read.json(os.path.join(out_dir, "analysis", "summary")).first()
    assert len(payload.top_findings) == 10 and "expected_counts" in payload.asDict()
    ctx = spark.read.json(os.path.join(out_dir, "analysis", "term_context"))
    assert ctx.count() == 2 and {"domain", "document_count", "terms"} == set(ctx.columns)
    first = ctx.where("domain = 'covid'").first().terms
    assert [t.rank for t in first] == sorted(t.rank for t in first) and first[0].representative_examples
    kinds = {(r.domain, r.kind) for r in out["summary_counts"].collect()}
    assert kinds == {(d, k) for d in ("covid", "climate") for k in ("source", "dataset")}


def test_payload_stops_on_unmatched_documents(spark):
    rec = spark.createDataFrame([("covid", "w", 1, 0.5, 1, 2, 0.5, *([0.1] * 11))], "domain string, term string, rank long, mean_tfidf double, document_frequency long, "
                                "document_count long, share_of_domain_docs double, " + ", ".join(f"avg_{c} double" for c in [*VADER_COLUMNS, *EMOTION_COLUMNS]))
    ex = spark.createDataFrame([], "domain string, term string, example_rank long, text string, dataset string, source string, term_tfidf_score double, "
                               "vader_compound double, dominant_emotion string")
    docs, other = (spark.createDataFrame([(i,) for i in x], "doc_id long") for x in ([1, 2], [1, 3]))
    assert an.term_context_payload(rec, ex, docs, docs).first().terms[0].term == "w"
    with pytest.raises(Exception, match="do not match"):
        an.term_context_payload(rec, ex, docs, other).collect()
