import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasta.llm import language_model as lm

SCHEMA = "doc_id long, text string, score string"
END = ""


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


def brute(docs, shape):
    """Exact counts and dictionaries; counts of the model rounded to the middle of their level."""
    grams = [Counter() for _ in range(shape.order)]
    for k, t in docs:
        if not held(k):
            w = [END, *split(t), END]
            for n in range(1, shape.order + 1):
                grams[n - 1].update(tuple(w[i - n + 1:i + 1]) for i in range(1, len(w)) if i - n + 1 >= 0)
    n, v = grams[0].total(), len(grams[0])
    steps = lm.ladder(shape.base).tolist()

    def est(g):
        c = grams[len(g) - 1][g]
        j = sum(s <= c for s in steps)
        return 0 if not j else (steps[j - 1] + steps[j] - 1) / 2

    out = []
    for k, t in docs:
        w = [END, *split(t), END]
        base = own = known = 0
        for i in range(1, len(w)):
            c = grams[0][(w[i],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = min(1, (est((w[i],)) + shape.alpha) / (n + shape.alpha * (v + 1)))
            for m in range(2, shape.order + 1):
                if i - m + 1 >= 0:
                    h = est(tuple(w[i - m + 1:i]))
                    p = (min(est(tuple(w[i - m + 1:i + 1])), h) + shape.strength * p) / (h + shape.strength)
            own += math.log10(p)
        out.append((k, held(k), len(w) - 1, known, n, base, own))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(got, want, tolerance=1e-9):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-12, abs=1e-12) and a[6] == pytest.approx(b[6], rel=tolerance, abs=1e-12)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)] + ["Über", "über", "ÜBER", "x y", "a\x1cb", "É."]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 60])))) for i in range(150)]
    docs += [(500 + i, docs[7][1]) for i in range(20)] + [(600, None), (601, ""), (602, " \n "), (None, "w1 W1 w2"), (None, None), (3, "w1"), (3, "w1"),
                                                        (603, "w5 " * 3000 + "rare words here"), (13, "never seen words")]
    return docs


@pytest.mark.parametrize("order", [1, 2, 3])
def test_whole_result_matches_brute_force(spark, corpus, order):
    """With many bits no probe finds what is not there, so the model equals one with exact levels."""
    shape = lm.Shape(order=order, bits=48, probes=12)
    df = spark.createDataFrame([(*r, "x") for r in corpus], SCHEMA).repartition(3)
    want = brute(corpus, shape)
    assert any(r[1] for r in want) and any(r[3] < r[2] for r in want)
    small = dict(bundle_tokens=200, bucket_words=37, bucket_tokens=150)
    got = lm.language_model_scores(df, lm.held_out_seventh(), shape=shape, **small)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(rows_of(got), want)
    if order == 2:
        same(rows_of(lm.language_model_scores(df, lm.held_out_seventh(), shape=shape)), want)
        same(rows_of(lm.language_model_scores(df, lm.held_out_seventh(), shape=shape, broadcast_bytes=0, **small)), want)


def test_both_ways_to_probe_give_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = (rows_of(lm.language_model_scores(docs, lm.held_out_seventh(), bucket_tokens=20_000, bundle_tokens=10_000, broadcast_bytes=b)) for b in (10**9, 0))
    same(one, other)
    exact = brute([(r.doc_id, r.text) for r in docs.collect()], lm.Shape())
    same([(*r[:6], 0) for r in one], [(*r[:6], 0) for r in exact])
    # a word found too often moves its log10 by 1 or so; over all texts that is little
    assert all(abs(a[6] - b[6]) <= 2 + 0.1 * abs(b[6]) for a, b in zip(one, exact, strict=True))
    assert sum(abs(a[6] - b[6]) for a, b in zip(one, exact, strict=True)) < 0.005 * sum(abs(b[6]) for b in exact)


def test_each_bucket_is_probed_once_for_all_bundles(spark, tmp_path):
    """Bundles of the same words ask for the same n-grams: the probes don't grow with bundles times buckets."""
    class Counted(lm.Shape):
        def levels(self, keys, packed, blocks, start=0):
            (tmp_path / uuid.uuid4().hex).write_text(str(len(keys)))
            return super().levels(keys, packed, blocks, start)

    words = [f"w{i}" for i in range(20)]
    docs = [(i, " ".join(words), "x") for i in range(70)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(2)
    small = dict(bundle_tokens=50, bucket_tokens=300)
    got = rows_of(lm.language_model_scores(df, lm.held_out_seventh(), shape=Counted(), broadcast_bytes=0, **small))
    probed = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert len(probed) <= -(-70 * 21 // 300)
    assert sum(probed) == 21 + 21  # words and the end; bigrams
    same(got, rows_of(lm.language_model_scores(df, lm.held_out_seventh(), broadcast_bytes=10**9, **small)))


def test_filter_never_loses_and_seldom_invents():
    rng = np.random.default_rng(2)
    shape = lm.Shape()
    keys = rng.choice(1 << 32, 40_000, replace=False).astype(np.uint32)
    counts = np.minimum(rng.zipf(1.6, 20_000), 10**12)
    packed = shape.filled(keys[:20_000], counts)
    want = np.searchsorted(lm.ladder(shape.base), counts, side="right")
    got, none = (shape.levels(k, packed, len(packed) * 8 // lm.BLOCK) for k in (keys[:20_000], keys[20_000:]))
    assert (got >= want).all() and (got == want).mean() > 0.98 and (none == 0).mean() > 0.98
    middle = shape.counts(want)
    assert (middle[counts <= 3] == counts[counts <= 3]).all() and (np.abs(middle / counts - 1) < 0.5).all()


def test_learns_word_order(spark):
    """Texts of a Markov chain: held-out texts are likelier by the model than by word counts alone."""
    rng = random.Random(9)
    follow = {f"s{i}": [f"s{rng.randrange(80)}" for _ in range(3)] for i in range(80)}
    docs = []
    for i in range(300):
        w = ["s0"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        docs.append((i, " ".join(w), "x"))
    got = lm.language_model_scores(spark.createDataFrame(docs, SCHEMA), lm.held_out_seventh()).where("held_out")
    base, own = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert own > 0.45 * base


def test_empty_and_untrained(spark):
    assert rows_of(lm.language_model_scores(spark.createDataFrame([], SCHEMA), lm.held_out_seventh())) == []
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], SCHEMA)
    assert rows_of(lm.language_model_scores(df, F.lit(True))) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    for least in (10**9, 0):
        assert lm.language_model_scores(df, F.lit(None).cast("boolean"), broadcast_bytes=least).where("n_known = n_tokens").count() == 2
