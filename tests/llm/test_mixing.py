import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from contrasta.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        if not (over := {s for s in free if share[s] > most * sizes[s]}):
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 120))
def test_knapsack_is_optimal(counts, room):
    lengths = sorted(counts, reverse=True)
    take = mixing.knapsack(room, lengths, [counts[n] for n in lengths])
    assert all(0 <= k <= counts[n] for n, k in zip(lengths, take, strict=True))
    got = sum(n * k for n, k in zip(lengths, take, strict=True))
    best = max((x for ks in itertools.product(*[range(counts[n] + 1) for n in lengths])
                if (x := sum(n * k for n, k in zip(lengths, ks, strict=True))) <= room), default=0)
    assert got == best


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 3000), st.integers(1, 500), min_size=3, max_size=40), st.floats(0, 3.5), st.integers(50, 5000))
def test_fit_comes_near(counts, ratio, window):
    lengths = sorted(counts)
    size = sum(n * c for n, c in counts.items())
    rounds, take = mixing.fit_lengths(lengths, [counts[n] for n in lengths], ratio * size, 3, window)
    assert all(0 <= k <= counts[n] for n, k in zip(lengths, take, strict=True))
    got = rounds * size + sum(n * k for n, k in zip(lengths, take, strict=True))
    assert got <= 3 * size and abs(min(ratio, 3) * size - got) <= max(lengths) + 1


ROWS = ([(i, "a b c " * (i % 7 + 1), "x") for i in range(300)] + [(1000 + i, "one two\tthree", "hot") for i in range(700)]
        + [(2000 + i, "w " * (i + 1), None) for i in range(30)] + [(3000, None, "y"), (3001, "", "y"), (3002, " \n", "z"), (None, "n n", "x"),
           (1, "a b c " * 2, "x"), (4000, "long " * 30000, "w"), (4001, "  v", "é")])


def test_mix(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'c' as copies", "0 as key")
    got = mixing.mix(df, rank_rows=64).toPandas()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mixing.WORD, t or ""))
    want = brute_targets(sizes)
    by = {None if k == "<null>" else k: x for k, x in got.assign(source=got.source.fillna("<null>")).groupby("source")}
    assert set(by) == set(sizes)
    for s, x in by.items():
        assert (x.source_size == sizes[s]).all() and (abs(x.target - want[s]) < 1e-6 * max(1, want[s])).all()
        assert (x.taken == x["size"] * x.copies).all() and (x.taken <= 3 * x["size"]).all()
        assert abs(x.taken.sum() - want[s]) <= max(x["size"].max(), 1)
    again = mixing.mix(df.repartition(5), rank_rows=64).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or \
        (got[key].fillna(-1).sort_values(key).reset_index(drop=True) == again[key].fillna(-1).sort_values(key).reset_index(drop=True)).all().all()


def test_mixed_documents_and_empty(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    rows = mixing.mixed_documents(df)
    assert rows.columns == df.columns
    count = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert count == {k: v for k, v in copies.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0
