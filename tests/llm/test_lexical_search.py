import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasta.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted((tuple(r) for r in ls.search(ls.index(docs), docs, items, **more).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ÄRA", "ära", "x-ray", "日本", "a.b", "K"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " .;\x00\x7f "), (None, "w5 w5 w6"), (None, docs[3][1]),
                                                        (3, "w1 other"), (3, docs[3][1]), (3, docs[3][1]), (2003, "w9 " * 30_000 + "w300 w301")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(50, docs[9][1]), (51, None), (52, ""), (53, "unknown zzz"), (54, "w1"), (54, "w1"), (None, "w2 W2 w3"), (55, "w300 STRASSE straße")]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"first": 3, "group_terms": 40, "broadcast_rows": 0, "k": 3}])
def test_whole_result_matches_brute_force(spark, corpus, more):
    docs, items = corpus
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score long, item_id string").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = ls.search(ls.index(d), d, b, **more)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, more.get("k", 50))


def test_small_blocks_and_task_lexicons(spark, corpus, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(ls, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ls, "SORTED_DOCS", 17)
    monkeypatch.setattr(ls, "TASK_TERMS", 50)
    monkeypatch.setattr(ls, "BLOCK_BITS", 10_000)
    import pyarrow as pa
    blocks = ls.Blocks(pa.schema([("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
                                  ("slices", pa.list_(pa.binary())), ("term", pa.binary()), ("df", pa.int64())]))
    rows = [r for i, (k, t) in enumerate(docs) if t for b in blocks.add(k, i, t.encode()) for r in b.to_pylist()]
    rows += [r for b in [*blocks.flush(), blocks.lexicon()] for r in b.to_pylist()]
    df = Counter()
    for r in rows:
        if r["term"] is not None:
            df[r["term"].decode()] += r["df"]
    assert df == Counter(t for _, x in docs for t in set(split(x)))
    made = [r for r in rows if r["term"] is None]
    assert sorted(h for r in made for h in r["hashes"]) == [i for i, (_, t) in enumerate(docs) if split(t)]
    # a bitmap never misses a document, and a bound is never below the score
    n, total = len([1 for _, t in docs if split(t)]), sum(len(split(t)) for _, t in docs)
    queries = ls.Queries([(0, t.encode(), df[t]) for t in sorted(df)[:60]] + [(1, t.encode(), df[t]) for t in sorted(df)[50:55]], n, total)
    for r in made:
        for item, bound in queries.bounds(r["sizes"], r["bits"], r["slices"]):
            for h, b in zip(r["hashes"], bound, strict=True):
                assert b >= queries.score(docs[h][1].encode(), [item])[0]


def test_most_documents_are_excluded(spark):
    """The bounds are close: of 1,000 documents few are scored for an item beyond the 50 best."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    index = ls.index(docs)
    blocks, lexicon = index.where("term is null"), index.where("term is not null")
    documents, total = blocks.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    df = {bytes(r.term): r.df for r in lexicon.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    pairs = [(r.item_id, t, df[t]) for r in items.collect() for t in set(ls.terms(r.text.encode())) if t in df]
    queries = spark.sparkContext.broadcast(ls.Queries(pairs, documents, total))
    best = ls.search(index, docs, items)
    least = {r.item_id: r.score for r in best.where("rank = 50").collect()}
    scored = ls.not_excluded(blocks, queries, spark.sparkContext.broadcast(least)).count()
    assert 50 * len(least) <= scored < 150 * len(least)


def test_positions_and_slices():
    docs = [np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(0, np.uint64), np.array([7], np.uint64)]
    bits, data = ls.slices(docs)
    rows = np.frombuffer(data, np.uint8).reshape(bits, 1)
    for i, d in enumerate(docs):
        assert all((rows[ls.positions(d, bits)] >> (7 - i) & 1).ravel()) and np.unpackbits(rows, axis=1)[:, i].sum() <= ls.PROBES * len(d)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(docs, items) == []
    assert found(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)) == []
    assert found(spark.createDataFrame([(1, "a"), (2, None)], docs.schema), items) == brute([(1, "a"), (2, None)], [(1, "a b")], 50)
