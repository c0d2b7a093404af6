import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from contrasta.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """Rows (vec_id, list, label) one by one with Python integers."""
    kept = [(k, [math.floor(scale * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:entries]
    width = len(order[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[best(cut(v, p), books[p])[1]].append(cut(v, p))
            for i, xs in of.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], defaultdict(int)
    for k, v, lab in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] += error
        out.append((k, "".join(f"{i:02x}" for _, i in found), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, c, e, by_label[lab], sha) for k, c, e, lab in out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_whole_result_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 280")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want = brute(rows)
    assert rows_of(vc.compress(table)) == want
    assert rows_of(vc.compress(table.repartition(7, "embedding"))) == want


def test_ties_nulls_copies_and_large_values(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i * 3, [float(x) for x in rng.integers(-3, 4, 8) * (40_000.0 if i % 9 == 0 else 1 / 1024)], [1, None, 7][i % 3]) for i in range(60)]
    rows += [(200 + i, rows[4][1], None) for i in range(20)]
    odd = [(1, None, 1), (2, [nan] * 8, 1), (4, [inf] + [0.0] * 7, 1), (5, [None] + [0.0] * 7, 1), (7, [-inf] * 8, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA)
    assert rows_of(vc.compress(df, entries=16)) == brute(rows, entries=16)
    coded = vc.encode(vc.integers(df), *vc.train(vc.integers(df), entries=16))
    one, other = (sorted(map(str, vc.with_label_error(coded, broadcast_labels=n).collect())) for n in (0, 10))
    assert one == other


def test_defined_cases(spark):
    assert vc.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0], 1, "x"), (3, [1.0, 2.0, 3.0], 1, "x"), (3, [1.0, 2.0, 3.0], 1, "x"), (4, [1.0], 2, "x"), (2, [], 2, "x")], SCHEMA)
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vc.compress(df, parts=2).collect()}
    # repeated vectors tie: the lowest of the equal entries
    assert got == {(None, "0000", 0, 0), (3, "0000", 0, 0), (4, None, None, None), (2, None, None, None)}
    with pytest.raises(Exception, match="64 bits"):
        vc.compress(spark.createDataFrame([(1, [3e5], 1, "x")], SCHEMA)).count()


def test_limbs_are_exact():
    rng = np.random.default_rng(5)
    x, c = (rng.integers(-(1 << 27), 1 << 27, (n, 16)) for n in (50, 30))
    x[0], c[0] = 1 << 27, -(1 << 27)
    want = np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x])
    for bits in (3, 8, 13, 24, None):
        assert (vc.dots(x, c, bits) == want).all()
        for a in (x, c):
            assert (sum(y.astype(np.int64) << ((bits or 24) * i) for i, y in enumerate(vc.limbs(a, bits or 24))) == a).all()
    assert len(vc.limbs(x, 24)) == 2 and len(vc.limbs(x >> 8, 24)) == 1
    i, d = vc.nearest(x, c, 9)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert d.tolist() == [min(r) for r in far] and i.tolist() == [r.index(min(r)) for r in far]


def test_no_vector_leaves_its_task_for_training(spark):
    rows = vc.integers(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    books, size = vc.train(rows, rounds=1)
    assert books.shape == (4, 256, 16) and size == 64
    assert vc.sums(rows, books, size).count() <= 4 * 256 * max(1, rows.rdd.getNumPartitions())
