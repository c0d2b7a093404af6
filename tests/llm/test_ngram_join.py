import random
import re

import pytest

from contrasta.llm import ngram_join


def brute(rows, n=3, percent=90):
    """Sets, and the smallest id reachable over all linked pairs."""
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(rng, base, most):
    w = list(base)
    for _ in range(rng.randint(0, most)):
        w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
    return " ".join(w)


def corpus(seed, groups=6, per=25, words=90):
    rng = random.Random(seed)
    out = []
    common = [f"c{i}" for i in range(70)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(words)]
        out += [near_copies(rng, base, 6) for _ in range(per)]
    out += [" ".join([*(f"x{rng.randrange(9999)}" for _ in range(rng.randint(0, 12))), *common]) for _ in range(60)]
    out += ["", None, "  \n", "one", "one two", "ONE two", "a b c", "A\tb\x0bc", "a b c d", "é É ñ", "é É Ñ", "word " * 4000, "the the the the"]
    rows = [(7 * i + 3, t) for i, t in enumerate(out)]
    return [*rows, rows[0], (None, out[1]), (None, "only here once"), (1, out[0])]


@pytest.mark.parametrize(("seed", "cold", "block"), [(1, 16, 1024), (2, 4, 7), (3, 2, 20)])
def test_components_are_exact(spark, seed, cold, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rep int, sig string")
    got = ngram_join.near_duplicate_groups(df, n=3, percent=90, cold_rows=cold, block_rows=block, frequent=200 if seed % 2 else 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_that_share_a_passage(spark, seed):
    """Copies 0 to 20 words from their bases; one passage in all groups makes most classes far from the pivots they share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(90)]
        rows += [(len(rows) + i, " ".join([*passage, near_copies(rng, base, 20)])) for i in range(20)]
    rows += [(len(rows) + i, " ".join([*passage[:40], *(f"x{rng.randrange(9999)}" for _ in range(40))])) for i in range(30)]
    got = ngram_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90, cold_rows=2, block_rows=9, frequent=8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize(("seed", "cold", "block"), [(6, 16, 1024), (7, 4, 7), (8, 2, 20)])
def test_components_are_exact_at_five_words(spark, seed, cold, block):
    """As the pipeline calls it; with a shared passage and copies up to 12 words from their bases."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = corpus(seed) + [(5000 + i, f"{passage} {near_copies(rng, [f'h{i % 3}w{j}' for j in range(200)], 12)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicate_groups(df, n=5, percent=80, cold_rows=cold, block_rows=block, frequent=200 if seed % 2 else 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n=5, percent=80)


def test_rows_without_id_link_others(spark):
    """The row between two documents has no id; rows of one id with different texts are not mixed up."""
    base = [f"w{i}" for i in range(400)]
    rows = [(4, " ".join(base)), (None, " ".join(base[:365])), (9, " ".join(base[:335])), (None, " ".join(base[:365])),
            (7, "one text of this id and its words"), (7, "quite another text that says different things"), (7, "quite another text that says different things"),
            (8, "quite another text that says different things"), (2, "one text of this id and its words"), (None, "alone without id here"), (None, None), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        want = brute(rows, n, percent)
        got = ngram_join.near_duplicate_groups(df, n=n, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert (9, 333, 4) in brute(rows) and {r.class_id for r in got if r.n_shingles == 333 and r.doc_id is None} <= {None}
    assert sorted(r.class_id for r in got if r.doc_id == 7) == [2, 7, 7]


def test_keep_first(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, "a"), (5, base, "b"), (3, base + " more", "c"), (8, "", "d"), (8, "", "e"), (8, None, "f"), (None, " ", "g"), (6, "short text", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_id2 string")
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, base + " more"), (8, ""), (8, None), (None, " "), (6, "short text")], key=str)


def test_empty_and_hash_order(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicate_groups(df).count() == 0
    s = ngram_join.Shingler(3)("a b a b a b cccccccc")
    assert len(s) == 3 and list(s) == sorted(s) and int(s[0]) >> 56 == 127 - 10
    t = ngram_join.Shingler(3, s[:1])("a b a b a b cccccccc")
    assert set(t & ~ngram_join._TOP) == set(s) and t[-1] == s[0] | ngram_join._TOP and int((t >> 63).sum()) == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7)], "a long, b long")
    got = {r.node: r.component for r in ngram_join.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}
