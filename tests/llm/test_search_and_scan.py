import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasta.llm import ann, imatch, licenses

SF = "/root/testdata/sf0.01"


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    big = table.withColumn("vec_id", F.col("vec_id") + 0)
    asked = F.col("vec_id") % 20 == 0
    got = ann.search(big, asked, verify=60, block_rows=200, chunk_rows=10).collect()
    want = {(r.query_id, r.vec_id): r.score for r in ann.exact(big, asked).collect()}
    assert len(got) == len(want)
    near = {(r.query_id, r.vec_id): r.score for r in got}
    hit = set(near) & set(want)
    assert len(hit) >= 0.9 * len(want)
    assert all(abs(near[x] - want[x]) < 1e-12 for x in hit)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    for q, rows in by.items():
        assert [r.rank for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [2.0, 5.0]), (7, [2.0, -5.0]),
            (8, [1.0]), (None, [9.0, 9.0]), (20, [-1.0, 0.5]), (6, [2.0, 5.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 2.0), (0, 2, 6, 2.0), (0, 3, 7, 2.0), (0, 4, 20, -1.0), (20, 1, 6, 0.5), (20, 2, 6, 0.5), (20, 3, 0, -1.0), (20, 4, 7, -4.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_longer_vectors_are_nearer_by_inner_product():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    block = ann.Block(np.arange(3000), v, float(np.sqrt((v * v).sum(1).max())), 128, 1)
    hit = 0
    for q in range(40):
        _, ids, _ = block.search(np.array([q]), v[q:q + 1], 10, opened=48, threshold=0.5, verify=300, first=0.9, growth=1.15)
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(ids) & set(np.argsort(-s)[:10]))
    assert hit >= 0.9 * 400


PHRASES = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT license", "CC-BY", "cc by 4.0", "All Rights Reserved.",
           "GNU General Public License v3", "general  public\nlicense", "Permission is hereby granted, free of charge, to any person obtaining a copy",
           "creative commons attribution share alike", "cc", "by", "ücc by", "all rights", "reserved", "Redistribution and use in source and binary forms"]


def license_texts():
    rng = random.Random(8)
    out = [None, "", " .,; ", "cc by", "CC.BY cc by by cc-by", "x " * 40000 + "all rights reserved", "all rights reserved reserved"]
    for _ in range(150):
        out.append(rng.choice([" ", ". ", "\n"]).join(rng.choice(["lorem", "é1", "Ü", "999", *PHRASES]) for _ in range(rng.randint(1, 25))))
    return out


def test_license_base_places(spark):
    texts = license_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "cc by", "y"), (3, "cc by", "x")], "doc_id long, text string, labels string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts) + 2
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in rows:
        t = "cc by" if r.doc_id is None else texts[r.doc_id]
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert 0 <= r.score <= 1 and bool(r.score) == bool(r.labels)
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_rules():
    rules = licenses.rules()
    assert len(rules) >= 200
    scan = {t: licenses.scan_text(t) for t in PHRASES}
    assert scan[PHRASES[0]][5] == "apache-2.0" and scan[PHRASES[1]][5] == "mit" and scan[PHRASES[7]][5] == "mit"
    assert scan[PHRASES[5]][5] == "gpl,gpl-3.0" and scan[PHRASES[8]][5] == "cc-by-sa" and scan[PHRASES[3]][5] == "cc-by,cc-by-4.0"
    # an inner match of a later rule is suppressed, one that only overlaps is not
    assert [x[2] for x in scan[PHRASES[0]][-1]] == ["apache-2.0"]


def fingerprints_of(texts, words, seed=7):
    of = imatch.Fingerprinter(words, seed)
    return [of(t or "") for t in texts]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 300))) for _ in range(120)]
    texts += [texts[0], texts[0].replace(" w1 ", " w2 ", 1), None, "", "", "zzz only once", "é😀 " * 3, "w5 " * 20000]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_lexicon_is_the_band(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = imatch.lexicon(df.select("text"), low=0.02, high=0.2, max_terms=10_000)
    count = {}
    for _, t in corpus:
        for w in set(re.findall(r"\w+", (t or "").lower())):
            count[w] = count.get(w, 0) + 1
    import xxhash
    n = len(corpus)
    assert set(got.tolist()) == {xxhash.xxh3_64_intdigest(w) for w, c in count.items() if max(2, 0.02 * n) <= c <= 0.2 * n}
    with pytest.raises(ValueError, match="max_terms"):
        imatch.lexicon(df.select("text"), low=0.0, high=1.0, max_terms=10)


@pytest.mark.parametrize("range_rows", [7, 10_000])
def test_edited_matches_brute_force(spark, corpus, range_rows):
    df = spark.createDataFrame([(*r, "x") for r in corpus], "doc_id long, text string, fingerprint string").repartition(6)
    words = imatch.lexicon(df.select("text"), low=0.02, high=0.2, max_terms=10_000)
    rows = sorted(corpus)
    of = imatch.Fingerprinter(words, 7)
    want = {}
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        new = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        want[k] = (len(t), hashlib.sha256(new.encode()).hexdigest(), of(t), of(new), imatch.likeness(of(t), of(new)), imatch.likeness(of(t), of(nxt)))
    got = imatch.edited(df, low=0.02, high=0.2, range_rows=range_rows).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r)[1:] for r in got} == want


def test_fingerprints(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df, low=0.02).collect()}
    by = {}
    for k, t in corpus:
        by.setdefault(t or "", set()).add(got[k])
    assert all(len(x) == 1 for x in by.values())
    ids = [k for k, _ in corpus]
    assert imatch.likeness(got[ids[0]], got[ids[121]]) > 0.4 and imatch.likeness(got[ids[0]], got[ids[1]]) < 0.2
    assert imatch.edited(df.limit(0)).count() == 0
    one = imatch.edited(df.limit(1), low=0.0, high=1.0).collect()
    assert len(one) == 1
    with_null = spark.createDataFrame([(None, "b b"), (2, "a a"), (2, "a a"), (None, None)], "doc_id long, text string")
    assert imatch.edited(with_null).count() == 4
