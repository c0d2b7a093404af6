import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contrasta.llm import packing, queries

TEXTS = [None, "", " ", "a", "Hello  world \n x", "tail ", "The cat.\nThe  dog's 12 ½ né ☃ <|endoftext|>!", "\n\n a\tb  ",
         "word " * 5000, "x" * 3000, "The cat.\nThe  dog's 12 ½ né ☃ <|endoftext|>!", "one two three"]


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_match_the_json_tokenizer():
    rng = random.Random(5)
    chunks = ["the", "  ", "\n", " ", "don't", "é", "12", "½", "²", "…", " ", "ſ", "中文", "x́", "\r\n", "\t", "'ll", "😀", "A.", "_"]
    texts = [x for x in TEXTS if x] + ["".join(rng.choice(chunks) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    enc = packing.encoder(None)
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(enc(text), "<u2").tolist() == ids[:-1], text


def test_query_gives_special_strings_their_id(spark, tmp_path):
    """As ``tokenizers`` encodes by default, without ``encode_special_tokens``."""
    rng, end = random.Random(6), "<|endoftext|>"
    chunks = [end, "the", " ", "  ", "\n", "don't", "é", "12", "<|", "|>", "endoftext", "中文", "\t", " dog"]
    texts = [f"a {end} b", end, end * 3, f" {end} ", f"x  {end}  y", f"a{end}b c", f"w {end}\n\n z", "plain", "", "<|endoftext|",
             *("".join(rng.choice(chunks) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array([*e.ids, 0], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0].tolist() == [64, 220, 50256, 275, 0]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_packing(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == set(range(len(texts)))
    for k, x in out.groupby("doc_id"):
        assert x.length.sum() == len(want[k]) and (x.doc_tokens == len(want[k])).all(), texts[k]
        assert all(r.ids_crc32 == zlib.crc32(want[k][r.start:r.start + r.length].tobytes()) for r in x.itertuples()), texts[k]


def test_round_trip(spark):
    rows = [(i, t, "dup") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (5, "tail ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").coalesce(1)
    out = packing.pack(df, group_tokens=4000).toPandas()
    want = dict(zip([i if i is not None else -1 for i, _, _ in rows[:-1]], reference_ids([t for _, t, _ in rows[:-1]]), strict=True))
    for key, x in out.assign(doc_id=out.doc_id.fillna(-1)).groupby("doc_id"):
        ids = want[int(key)]
        n = 2 if key == 5 else 1  # a repeated row is packed twice
        assert x.length.sum() == n * len(ids) and set(x.doc_tokens) == {len(ids)}
        for r in x.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum()[:-1]]
        n = x.length.sum()
        assert n == x.sequence_length.iloc[0] <= 1024 and (n == 1024 or n & (n - 1) == 0)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_assignment_is_exact(lengths):
    pieces = packing.assign(lengths, 16, 1.0, 0.1)
    for d, n in enumerate(lengths):
        own = sorted((a, k) for i, a, k, _, _ in pieces if i == d)
        assert [a for a, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1]] and sum(k for _, k in own) == n
    caps = packing.capacities(sum(lengths), 16)
    for s, cap in enumerate(caps):
        own = sorted((o, k) for _, _, k, i, o in pieces if i == s)
        assert sum(k for _, k in own) == cap and [o for o, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1]]


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.randint(5, 900) for _ in range(2000)]
    cost = np.zeros(len(packing.capacities(sum(lengths), 1024)))
    for _, _, n, s, _ in packing.assign(lengths, 1024, 1.0, 1 / 2048):
        cost[s] += n + n * n / 2048
    in_order, s, at = np.zeros(len(cost) + 1), 0, 0
    for n in lengths:  # documents laid one after the other
        while n:
            k = min(n, 1024 - at)
            in_order[s] += k + k * k / 2048
            at, n = (at + k) % 1024, n - k
            s += at == 0
    full = np.array(packing.capacities(sum(lengths), 1024)) == 1024
    assert cost[full].std() < in_order[:len(cost)][full].std()
