import math
import re

import pytest

from contrasta.operators.emotion import emotion_scores
from contrasta.operators.language import detect_language
from contrasta.operators.lemma import lemmatize
from contrasta.operators.rhetoric import rhetoric_scores
from contrasta.operators.sentiment import default_lexicon, default_modifiers, sentiment_scores

SENTENCES = [
    "this is good",
    "this is not good",
    "very good but stupid!!",
    "not very bad, extremely awful?? really",
    "the idiot and the moron were never happy",
    "plain words only",
    "",
    "a",
    "barely good hardly terrible but great great!!!!!",
]


def reference_sentiment(text):
    """Straight Python restatement of the documented valence rules."""
    lex = default_lexicon()
    negs, boost = default_modifiers()
    toks = [t for t in re.findall(r"[\w]+(?:'[\w]+)*", text.lower()) if len(t) > 1]
    if not toks:
        return 0.0, 0.0, 0.0, 0.0
    but = toks.index("but") + 1 if "but" in toks else 0
    scores = []
    for i, t in enumerate(toks):
        if t not in lex:
            scores.append(0.0)
            continue
        v = lex[t]
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            p = toks[i - k] if i - k >= 0 else None
            sign = -1.0 if v < 0 else 1.0
            v = (v + boost.get(p, 0.0) * damp * sign) * (-0.74 if p in negs else 1.0)
        pos = i + 1
        if but and pos < but:
            v *= 0.5
        elif but and pos > but:
            v *= 1.5
        scores.append(v)
    ep = min(text.count("!"), 4) * 0.292
    qm = text.count("?")
    ep += (qm * 0.18 if qm <= 3 else 0.96) if qm > 1 else 0.0
    s = sum(scores)
    s = s + ep if s > 0 else (s - ep if s < 0 else s)
    comp = max(min(s / math.sqrt(s * s + 15), 1.0), -1.0)
    pos_sum = sum(x + 1 for x in scores if x > 0)
    neg_sum = sum(x - 1 for x in scores if x < 0)
    neu = sum(1 for x in scores if x == 0)
    if pos_sum > abs(neg_sum):
        pos_sum += ep
    elif pos_sum < abs(neg_sum):
        neg_sum -= ep
    tot = pos_sum + abs(neg_sum) + neu
    return round(abs(neg_sum / tot), 3), round(abs(neu / tot), 3), round(abs(pos_sum / tot), 3), round(comp, 4)


def test_sentiment_matches_reference_rules(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    got = {r.doc_id: (r.vader_neg, r.vader_neu, r.vader_pos, r.vader_compound) for r in sentiment_scores(df).collect()}
    for i, t in enumerate(SENTENCES):
        assert got[i] == pytest.approx(reference_sentiment(t), abs=1.5e-3 if i else 1e-9), t


def test_negation_flips_and_boosters_scale(spark):
    df = spark.createDataFrame([(0, "good"), (1, "not good"), (2, "very good")], "doc_id long, text string")
    c = {r.doc_id: r.vader_compound for r in sentiment_scores(df).collect()}
    assert c[1] < 0 < c[0] < c[2]


def test_capitals_add_emphasis(spark):
    """0.733 for a valenced word or booster in capitals, unless all words are; other case does not matter."""
    v = default_lexicon()["good"]
    texts = {"this is good": v, "this is GOOD": v + 0.733, "This Is Good": v, "THIS IS GOOD": v, "it is VERY good": v + 0.293 + 0.733,
             "it was NOT good": -0.74 * v, "it was not GOOD": -0.74 * (v + 0.733), "A good I": v}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.vader_compound for r in sentiment_scores(df).collect()}
    for i, s in enumerate(texts.values()):
        assert got[i] == pytest.approx(s / math.sqrt(s * s + 15), abs=6e-5), list(texts)[i]


def test_rows_are_scored_one_by_one(spark):
    """Null and repeated ids and null texts keep their rows; clashing names of other columns do not matter."""
    df = spark.createDataFrame([(None, "good fear now", 1), (2, "good fear now", 2), (2, "nothing", 3), (3, None, 4), (None, "", 5)], "doc_id long, text string, t int")
    for scores in (sentiment_scores, emotion_scores, rhetoric_scores):
        rows = scores(df).collect()
        assert len(rows) == 5 and rows[0][1:] == rows[1][1:]
    assert {w: sentiment_scores(df, lexicon={}).first()[w] for w in ("vader_neu", "vader_compound")} == {"vader_neu": 1.0, "vader_compound": 0.0}
    assert emotion_scores(df, lexicon=[]).first().neutral == 1.0 and rhetoric_scores(df, cues=[]).first().urgency == 0.0
    many = {f"w{i}": float(i % 7 - 3) for i in range(3000)}
    big = spark.createDataFrame([(1, "w5 w6 w7 other")], "doc_id long, text string")
    s = 2.0 + 3.0 - 3.0
    assert sentiment_scores(big, lexicon=many).first().vader_compound == pytest.approx(s / math.sqrt(s * s + 15), abs=6e-5)


def test_emotion_shares_and_blank(spark):
    df = spark.createDataFrame([(0, "idiot idiot fear happy"), (1, "   "), (2, "nothing here")], "doc_id long, text string")
    r = {x.doc_id: x for x in emotion_scores(df).collect()}
    assert r[0].anger == 0.5 and r[0].fear == 0.25 and r[0].joy == 0.25 and r[0].neutral == 0.0
    assert all(r[1][e] == 0.0 for e in ["anger", "neutral", "joy"])
    assert r[2].neutral == 1.0


def test_emotion_reads_whole_texts_unless_capped(spark):
    df = spark.createDataFrame([(0, "x " * 20000 + "idiot")], "doc_id long, text string")
    assert emotion_scores(df).first().anger == 1.0
    assert emotion_scores(df, max_chars=2000).first().neutral == 1.0


def test_rhetoric_scores_flags_ratio(spark):
    df = spark.createDataFrame([(0, "experts say act now, it is a hoax"), (1, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in rhetoric_scores(df).collect()}
    assert r[0].urgency == pytest.approx(min(1.0, 2 * 10.0 / 8)) and r[0].authority_presence == 1
    assert r[0].authority_to_doubt_ratio == pytest.approx(r[0].authority / (r[0].doubt + 1e-6))
    assert r[1].urgency == 0.0 and r[1].doubt_presence == 0


def test_lemmatizer(spark):
    df = spark.createDataFrame([(0, "green turtles swim slowly"), (1, "one turtle went home yesterday"),
                                (2, "the stories of flies and glasses"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text_lemma for r in lemmatize(df).collect()}
    assert got[0] == "green turtle swim slowly"
    assert got[1] == "one turtle go home yesterday"
    assert got[2] == "story fly glasse"  # S-stemmer: "es" -> "e" unless aes/ees/oes
    assert got[3] == ""


def test_language_detection(spark):
    df = spark.createDataFrame([(0, "the cat is on the table and it is happy"), (1, "le chat est sur la table et il est"),
                                (2, "der Hund und die Katze sind nicht hier"), (3, "el perro y la casa de los amigos"),
                                (4, "zzz qqq")], "doc_id long, text string")
    got = {r.doc_id: r.lang_detected for r in detect_language(df).collect()}
    assert got == {0: "en", 1: "fr", 2: "de", 3: "es"}
