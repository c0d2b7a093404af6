from pyspark.sql import functions as F

from contrasta.functions import text as tx
from contrasta.functions.text import clean_text, decode_unicode_escapes, truncate_text, word_count, char_count

EDGE = [
    (0, None, ""),
    (1, "RT @abc: Look https://t.co/x @bob #Wow", "look url user wow"),
    (2, "Don't and don't", "don't and do not"),
    (3, "a\U0001F600b\U0001F680c✂d\U0001F923e", "abcd\U0001F923e"),
    (4, "x <U+0430>", "x а"),
    (5, "##a #b", "#a b"),
    (6, "mail me@host.org", "mail meuser.org"),
    (7, "one\r\ntwo", "one two"),
    (8, "\U0001F600", ""),
    (9, " \t padded 　", "padded"),
]


def test_clean_text_edge_rows(spark):
    df = spark.createDataFrame(EDGE, "id int, text string, exp string")
    got = {r.id: r.c for r in df.select("id", clean_text("text").alias("c")).collect()}
    assert got == {i: e for i, _, e in EDGE}


def test_clean_text_idempotent_without_escapes(spark):
    # free of escapes, nested marks and capitalised contractions (those change on a second pass)
    rows = [("Hello World #x @y https://a.b/c",), ("  cannot stop  ",), ("plain text",)]
    df = spark.createDataFrame(rows, "t string").select(clean_text("t").alias("once"))
    twice = df.select("once", clean_text("once").alias("twice")).collect()
    assert all(r.once == r.twice for r in twice)


def test_decode_escapes_cases(spark):
    df = spark.createDataFrame([("a<u+0041><U+1F600>",), ("<U+110000> stays",), (None,)], "t string")
    got = [r.d for r in df.select(decode_unicode_escapes("t").alias("d")).collect()]
    assert got == ["aA\U0001F600", "<U+110000> stays", ""]


def test_counts_and_truncation(spark):
    long_text = "word " * 100
    df = spark.createDataFrame([("a b_c d9", "x  y"), (None, long_text)], "t string, u string")
    r = df.select(word_count("t").alias("w"), char_count("t").alias("c"), truncate_text("u").alias("tr")).collect()
    assert [x.w for x in r] == [3, 0]
    assert [x.c for x in r] == [8, 0]
    assert r[0].tr == "x y"
    assert len(r[1].tr) == 240 and r[1].tr.endswith("...")
    assert r[1].tr == " ".join(long_text.split())[:237].rstrip() + "..."


def test_cleaning_plan_stays_in_jvm(spark):
    df = spark.createDataFrame([("x",)], "t string").select(clean_text("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_strip_and_emoji_only_where_found(spark):
    """Texts that need no strip or emoji removal skip the patterns; the results are those of the patterns."""
    ends = ["", " ", "\t\n", "\u00a0", "\u2003x\x1c", "\x0b", "\x85", "\u3000", "\u200b", "é", "\U0001F600", "\u2702", "a"]
    texts = [None, *[a + mid + b for a in ends for mid in ("", "b", "b  c\n", "\U0001F5FF d") for b in ends]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = tx._rx(tx._rx(F.col("t"), tx.EMOJI_RE, ""), tx.STRIP_RE, "")
    emoji = tx._where(F.col("t"), lambda x: F.octet_length(x) > F.length(x), lambda x: tx._rx(x, tx.EMOJI_RE, ""))
    assert df.where(~tx.strip_ws(emoji).eqNullSafe(plain)).count() == 0
    assert df.where(~tx.strip_ws("t").eqNullSafe(tx._rx(F.col("t"), tx.STRIP_RE, ""))).count() == 0
