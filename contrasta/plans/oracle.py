"""Independent SQL (DuckDB dialect) for every registered query.

The SQL restates each operator's semantics relationally (window dedupe, list
lambdas, UNPIVOT, quantile_cont) over the same driver views; it shares only the
fixed values (patterns, word lists, lexicons, constants) with the Spark side.
"""

from __future__ import annotations

import math

from contrasta import lexicons
from contrasta.functions import text as tx
from contrasta.operators import labels as lb
from contrasta.operators.domains import domain_rules
from contrasta.operators.emotion import CUE_EMOTIONS, EMOTION_COLUMNS
from contrasta.operators.language import LANGUAGES
from contrasta.operators.lemma import exceptions_map
from contrasta.operators.rhetoric import STRATEGIES
from contrasta.operators.sentiment import default_lexicon, default_modifiers
from contrasta.operators.stats import DIGITS, SMALL_SAMPLE, poisson_thresholds
from contrasta.operators.tokens import TFIDF_TOKEN_RE, WORD_TOKEN_RE, english_stop_words
from contrasta.sources.driver import DRIVER_DOMAIN_RULES

FALSE, TRUE = lb.TARGETS
D = 6  # rounding digits, as on the Spark side


def xmean(x: str) -> str:
    return f"avg(({x})::DOUBLE)"


A, B = "covid", "climate"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def slist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def r(expr: str) -> str:
    x = f"({expr})::DOUBLE"
    return f"round(CASE WHEN abs({x}) < 1000 THEN round({x}, 10) ELSE {x} END, {D})"


# ------------------------------------------------------------------ text

def decode(x: str) -> str:
    t = f"coalesce({x}, '')"
    cp = "('0x' || h)::BIGINT"
    return (f"(CASE WHEN instr({t}, '+') > 0 THEN list_reduce("
            f"list_filter(list_distinct(regexp_extract_all({t}, {q(tx.ESCAPE_RE)}, 1)), "
            f"lambda h: {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343)), "
            f"lambda a, h: replace(replace(a, '<u+' || h || '>', chr({cp}::INTEGER)), '<U+' || h || '>', chr({cp}::INTEGER)), "
            f"{t}) ELSE {t} END)")


def clean(x: str) -> str:
    t = decode(x)
    t = f"regexp_replace({t}, {q(tx.RETWEET_RE)}, '')"
    t = f"regexp_replace({t}, {q(tx.URL_RE)}, 'URL', 'g')"
    t = f"regexp_replace({t}, {q(tx.MENTION_RE)}, 'USER', 'g')"
    t = f"regexp_replace({t}, {q(tx.HASHTAG_RE)}, '\\1', 'g')"
    t = f"regexp_replace({t}, {q(tx.EMOJI_RE)}, '', 'g')"
    for a, b in tx.CONTRACTIONS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    t = f"replace(replace(lower({t}), chr(10), ' '), chr(13), '')"
    return f"regexp_replace({t}, {q(tx.STRIP_RE)}, '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(tx.STRIP_RE)}, '', 'g')"


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(WORD_TOKEN_RE)})"


def truncate(x: str, limit: int = 240) -> str:
    t = f"regexp_replace(regexp_replace(coalesce({x}::VARCHAR, ''), '[{tx.WS}]+', ' ', 'g'), '^ | $', '', 'g')"
    return (f"(CASE WHEN length({t}) <= {limit} THEN {t} "
            f"ELSE rtrim(substring({t}, 1, {limit - 3}), ' ') || '...' END)")


def decorated() -> str:
    return """decorated AS (
  SELECT doc_id, lang, source, CASE doc_id % 8
    WHEN 0 THEN 'RT @user1: ' || text
    WHEN 1 THEN text || ' https://x.example/a?b=1'
    WHEN 2 THEN text || ' #Tag ##two'
    WHEN 3 THEN chr(128512) || text || ' ' || chr(129315) || ' ' || chr(9989) || 'x'
    WHEN 4 THEN text || ' <U+0430><u+1F600>'
    WHEN 5 THEN text || ' don''t won''t Can''t'
    WHEN 6 THEN chr(9) || chr(10) || ' ' || text || chr(13) || chr(10) || '  '
    ELSE CASE WHEN doc_id % 16 = 7 THEN NULL ELSE '' END END AS text
  FROM documents)"""


# ------------------------------------------------------------------ corpus

def domain_case(col: str = "dataset", rules: dict[str, str] = DRIVER_DOMAIN_RULES) -> str:
    by = {}
    for ds, dom in rules.items():
        by.setdefault(dom, []).append(ds)
    parts = " ".join(f"WHEN {col} IN ({', '.join(q(x) for x in sorted(v))}) THEN {q(k)}" for k, v in by.items())
    return f"CASE {parts} ELSE 'general' END"


def lang_profile() -> str:
    parts = [f"SELECT unnest({slist(lexicons.words(f))}) AS word, {q(l)} AS lang" for l, f in sorted(LANGUAGES.items())]
    return "lang_profile AS (SELECT DISTINCT word, lang FROM (" + " UNION ALL ".join(parts) + "))"


def corpus_ctes() -> str:
    return f"""{lang_profile()},
c_dom AS (SELECT doc_id, text, source AS dataset, {domain_case('source')} AS domain FROM documents),
c_clean AS (SELECT doc_id, dataset, domain, {clean('text')} AS text FROM c_dom),
c_dedup AS (SELECT * FROM c_clean WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY domain, text ORDER BY doc_id) = 1),
c_tok AS (SELECT doc_id, unnest({word_tokens(decode('text'))}) AS word FROM c_dedup WHERE domain = 'covid'),
c_hits AS (SELECT t.doc_id, p.lang, count(*) AS n FROM c_tok t JOIN lang_profile p USING (word) GROUP BY ALL),
c_lang AS (SELECT doc_id, lang AS lang_detected FROM c_hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1),
corpus AS (SELECT d.doc_id, d.text, NULL::VARCHAR AS label, d.domain, 'documents' AS source, d.dataset
           FROM c_dedup d LEFT JOIN c_lang l USING (doc_id) WHERE d.domain <> 'covid' OR l.lang_detected = 'en')"""


def lemma_expr(t: str = "t") -> str:
    exc = exceptions_map()
    m = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(exc.items())) + "}"
    rules = (f"CASE WHEN length({t}) <= 3 THEN {t} "
             f"WHEN suffix({t}, 'ies') AND NOT suffix({t}, 'eies') AND NOT suffix({t}, 'aies') THEN substring({t}, 1, length({t}) - 3) || 'y' "
             f"WHEN suffix({t}, 'es') AND NOT suffix({t}, 'aes') AND NOT suffix({t}, 'ees') AND NOT suffix({t}, 'oes') THEN substring({t}, 1, length({t}) - 2) || 'e' "
             f"WHEN suffix({t}, 's') AND NOT suffix({t}, 'us') AND NOT suffix({t}, 'ss') THEN substring({t}, 1, length({t}) - 1) "
             f"ELSE {t} END")
    return f"coalesce({m}[{t}], {rules})"


STOP = slist(english_stop_words())


def lemma_ctes(src: str = "corpus") -> str:
    return f"""lem AS (SELECT *, array_to_string(list_transform(list_filter({word_tokens('text')}, lambda t: NOT list_contains({STOP}, t)), lambda t: {lemma_expr('t')}), ' ') AS text_lemma
          FROM {src} WHERE domain IN ('covid', 'climate'))"""


# ------------------------------------------------------------------ scorers

def sentiment_ctes(src: str = "corpus") -> str:
    lex = default_lexicon()
    negs, boost = default_modifiers()
    bmap = "MAP {" + ", ".join(f"{q(k)}: {v!r}::DOUBLE" for k, v in sorted(boost.items())) + "}"
    neg = ", ".join(q(w) for w in negs)
    lex_rows = ", ".join(f"({q(k)}, {v!r}::DOUBLE)" for k, v in sorted(lex.items()))

    def B(p):
        return f"coalesce({bmap}[{p}], 0.0)"

    def N(p):
        return f"(CASE WHEN {p} IN ({neg}) THEN -0.74 ELSE 1.0 END)"

    def S(v):
        return f"(CASE WHEN {v} < 0 THEN -1.0 ELSE 1.0 END)"

    txt = "coalesce(text, '')"
    return f"""s_lex(t, v) AS (VALUES {lex_rows}),
s_doc AS (SELECT doc_id, {txt} AS txt, list_filter({word_tokens('text')}, lambda t: length(t) > 1) AS toks FROM {src}),
s_doc2 AS (SELECT doc_id, toks, len(toks) AS n_words, coalesce(list_position(toks, 'but'), 0) AS but_pos,
                  least(length(txt) - length(replace(txt, '!', '')), 4) * 0.292
                  + CASE WHEN length(txt) - length(replace(txt, '?', '')) > 1 THEN
                      CASE WHEN length(txt) - length(replace(txt, '?', '')) <= 3 THEN (length(txt) - length(replace(txt, '?', ''))) * 0.18 ELSE 0.96 END
                    ELSE 0.0 END AS ep FROM s_doc),
s_exp AS (SELECT doc_id, but_pos, toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM s_doc2),
s_ctx AS (SELECT doc_id, but_pos, pos, t, CASE WHEN pos > 1 THEN toks[pos - 1] END AS p1,
                 CASE WHEN pos > 2 THEN toks[pos - 2] END AS p2, CASE WHEN pos > 3 THEN toks[pos - 3] END AS p3 FROM s_exp),
s_v0 AS (SELECT c.*, l.v FROM s_ctx c JOIN s_lex l USING (t)),
s_v1 AS (SELECT *, (v + {B('p1')} * {S('v')}) * {N('p1')} AS v1 FROM s_v0),
s_v2 AS (SELECT *, (v1 + {B('p2')} * 0.95 * {S('v1')}) * {N('p2')} AS v2 FROM s_v1),
s_v3 AS (SELECT *, (v2 + {B('p3')} * 0.9 * {S('v2')}) * {N('p3')} AS v3 FROM s_v2),
s_s AS (SELECT doc_id, CASE WHEN but_pos > 0 AND pos < but_pos THEN v3 * 0.5 WHEN but_pos > 0 AND pos > but_pos THEN v3 * 1.5 ELSE v3 END AS s FROM s_v3),
s_agg AS (SELECT doc_id, sum(s) AS sum_s, sum(CASE WHEN s > 0 THEN s + 1.0 ELSE 0.0 END) AS pos_sum,
                 sum(CASE WHEN s < 0 THEN s - 1.0 ELSE 0.0 END) AS neg_sum, count(*) FILTER (WHERE s <> 0) AS n_sent FROM s_s GROUP BY doc_id),
s_j AS (SELECT d.doc_id, d.n_words, d.ep, coalesce(a.sum_s, 0.0) AS sum_s, coalesce(a.pos_sum, 0.0) AS pos_sum,
               coalesce(a.neg_sum, 0.0) AS neg_sum, coalesce(a.n_sent, 0) AS n_sent FROM s_doc2 d LEFT JOIN s_agg a USING (doc_id)),
s_k AS (SELECT *, CASE WHEN sum_s > 0 THEN sum_s + ep WHEN sum_s < 0 THEN sum_s - ep ELSE sum_s END AS adj,
               CASE WHEN pos_sum > abs(neg_sum) THEN pos_sum + ep ELSE pos_sum END AS pos2,
               CASE WHEN pos_sum < abs(neg_sum) THEN neg_sum - ep ELSE neg_sum END AS neg2,
               (n_words - n_sent)::DOUBLE AS neu FROM s_j),
sentiment AS (SELECT doc_id,
     round(CASE WHEN n_words > 0 THEN abs(neg2 / (pos2 + abs(neg2) + neu)) ELSE 0.0 END, 3) AS vader_neg,
     round(CASE WHEN n_words > 0 THEN abs(neu / (pos2 + abs(neg2) + neu)) ELSE 0.0 END, 3) AS vader_neu,
     round(CASE WHEN n_words > 0 THEN abs(pos2 / (pos2 + abs(neg2) + neu)) ELSE 0.0 END, 3) AS vader_pos,
     round(CASE WHEN n_words > 0 THEN greatest(least(adj / sqrt(adj * adj + 15.0), 1.0), -1.0) ELSE 0.0 END, 4) AS vader_compound
   FROM s_k)"""


def emotion_ctes(src: str = "corpus") -> str:
    rows = ", ".join(f"({q(w)}, {q(e)})" for w, e in sorted(set(lexicons.table("emotion"))))
    cnt = ", ".join(f"count(*) FILTER (WHERE l.emotion = {q(e)}) AS n_{e}" for e in CUE_EMOTIONS)
    tot = " + ".join(f"coalesce(n_{e}, 0)" for e in CUE_EMOTIONS)
    cols = []
    for e in EMOTION_COLUMNS:
        val = (f"CASE WHEN ({tot}) = 0 THEN 1.0 ELSE 0.0 END" if e == "neutral"
               else f"CASE WHEN ({tot}) = 0 THEN 0.0 ELSE coalesce(n_{e}, 0) / ({tot}) END")
        cols.append(f"CASE WHEN blank THEN 0.0 ELSE {val} END AS {e}")
    return f"""e_lex(t, emotion) AS (VALUES {rows}),
e_doc AS (SELECT doc_id, coalesce(text, '') AS head FROM {src}),
e_doc2 AS (SELECT doc_id, {strip('head')} = '' AS blank, {word_tokens('head')} AS toks FROM e_doc),
e_hits AS (SELECT x.doc_id, {cnt} FROM (SELECT doc_id, unnest(toks) AS t FROM e_doc2) x JOIN e_lex l USING (t) GROUP BY x.doc_id),
emotion AS (SELECT d.doc_id, {', '.join(cols)} FROM e_doc2 d LEFT JOIN e_hits h USING (doc_id))"""


def dominant(prefix: str = "") -> str:
    cols = [f"{prefix}{e}" for e in EMOTION_COLUMNS]
    g = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {g} THEN {q(e)}" for c, e in zip(cols, EMOTION_COLUMNS)) + " END"


def rhetoric_ctes(src: str = "corpus", weight: float = 10.0) -> str:
    rows = ", ".join(f"({q(c)}, {q(s)})" for c, s in sorted(set(lexicons.table("rhetoric"))))
    cnt = ", ".join(f"count(*) FILTER (WHERE l.strategy = {q(s)}) AS h_{s}" for s in STRATEGIES)
    sc = ", ".join(f"CASE WHEN n > 0 THEN least(1.0, coalesce(h_{s}, 0) * {weight} / n) ELSE 0.0 END AS {s}"
                   for s in STRATEGIES)
    pres = ", ".join(f"({s} > 0)::INTEGER AS {s}_presence" for s in STRATEGIES)
    return f"""r_lex(t, strategy) AS (VALUES {rows}),
r_doc AS (SELECT doc_id, {word_tokens('text')} AS toks FROM {src}),
r_hits AS (SELECT x.doc_id, {cnt} FROM (SELECT doc_id, unnest(toks) AS t FROM r_doc) x JOIN r_lex l USING (t) GROUP BY x.doc_id),
r_sc AS (SELECT d.doc_id, {sc} FROM (SELECT doc_id, len(toks) AS n FROM r_doc) d LEFT JOIN r_hits h USING (doc_id)),
rhetoric AS (SELECT doc_id, urgency, authority, doubt, {pres}, authority / (doubt + 1e-6) AS authority_to_doubt_ratio FROM r_sc)"""


def feature_ctes() -> str:
    return f"""{corpus_ctes()},
{lemma_ctes()},
f_base AS (SELECT * FROM lem WHERE text_lemma <> ''),
{emotion_ctes('f_base')},
{sentiment_ctes('f_base')},
{rhetoric_ctes('f_base')},
features AS (SELECT b.doc_id, b.text, b.label, b.domain, b.source, b.dataset, b.text_lemma,
   {', '.join('e.' + c for c in EMOTION_COLUMNS)}, s.vader_neg, s.vader_neu, s.vader_pos, s.vader_compound,
   r.urgency, r.authority, r.doubt, r.urgency_presence, r.authority_presence, r.doubt_presence, r.authority_to_doubt_ratio,
   r.authority AS auth_score, r.urgency AS urg_score,
   length(coalesce(b.text, ''))::BIGINT AS char_count,
   len(regexp_extract_all(b.text, {q(tx.WORD_RUN_RE)}))::BIGINT AS word_count,
   {dominant('e.')} AS dominant_emotion
 FROM f_base b JOIN emotion e USING (doc_id) JOIN sentiment s USING (doc_id) JOIN rhetoric r USING (doc_id))"""


# ------------------------------------------------------------------ TF-IDF

def tfidf_ctes(src: str = "f_base", max_features: int = 5000, min_df: int = 5, max_df: float = 0.95) -> str:
    return f"""t_docs AS (SELECT doc_id, domain, text_lemma FROM {src}),
t_kept AS (SELECT doc_id, domain, list_filter(regexp_extract_all(lower(text_lemma), {q(TFIDF_TOKEN_RE)}), lambda t: NOT list_contains({STOP}, t)) AS k FROM t_docs),
t_terms AS (SELECT doc_id, domain, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM t_kept),
tf AS (SELECT doc_id, domain, term, count(*) AS tf FROM t_terms GROUP BY ALL),
t_dom AS (SELECT domain, count(*) AS n_domain FROM t_docs GROUP BY domain),
t_n AS (SELECT count(*) AS n_docs FROM t_docs),
t_stats AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM tf GROUP BY term),
vocab AS (SELECT term, df, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf FROM t_stats, t_n
          WHERE df >= {min_df} AND df <= {max_df} * n_docs ORDER BY total_tf DESC, term LIMIT {max_features}),
t_w AS (SELECT tf.doc_id, tf.domain, tf.term, tf.tf, (1.0 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v USING (term)),
weights AS (SELECT doc_id, domain, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM t_w),
means AS (SELECT m.domain, m.term, m.s / d.n_domain AS mean_tfidf
          FROM (SELECT domain, term, sum(score) AS s FROM weights GROUP BY domain, term) m JOIN t_dom d USING (domain)),
top AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY round(mean_tfidf, 12) DESC, term) AS rank, term, mean_tfidf
        FROM means QUALIFY rank <= 25)"""


# ------------------------------------------------------------------ special functions

SQRT_PI = math.sqrt(math.pi)


def erfc_sql(x: str) -> str:
    ax = f"abs({x})"
    series = (f"(1.0 - (2.0 / {SQRT_PI!r}) * exp(-{ax} * {ax}) * list_reduce(range(1, 61), "
              f"lambda acc, n: {{'a': acc.a * (2.0 * {ax} * {ax}) / (2.0 * n + 1.0), "
              f"'s': acc.s + acc.a * (2.0 * {ax} * {ax}) / (2.0 * n + 1.0)}}, {{'a': {ax}, 's': {ax}}}).s)")
    cf = (f"(exp(-{ax} * {ax}) / ({SQRT_PI!r} * list_reduce(range(200, 0, -1), "
          f"lambda acc, k: {ax} + (k / 2.0) / acc, {ax}::DOUBLE)))")
    pos = f"(CASE WHEN {ax} < 1.2 THEN {series} ELSE {cf} END)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} < 0 THEN 2.0 - {pos} ELSE {pos} END)"


def chi2_sf_sql(x: str, k: str) -> str:
    h = f"(({x}) / 2.0)"
    m = f"(({k}) // 2)"
    even = (f"(exp(-{h}) * list_reduce(range(1, {m}), lambda acc, j: {{'t': acc.t * {h} / j, 's': acc.s + acc.t * {h} / j}}, "
            f"{{'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}}).s)")
    mo = f"((({k}) - 1) // 2)"
    first = f"(sqrt({h}) / ({SQRT_PI!r} / 2.0))"
    odd_sum = (f"list_reduce(range(2, {mo} + 1), lambda acc, j: {{'t': acc.t * {h} / (j - 0.5), 's': acc.s + acc.t * {h} / (j - 0.5)}}, "
               f"{{'t': {first}, 's': {first}}}).s")
    odd = f"({erfc_sql(f'sqrt({h})')} + CASE WHEN {mo} >= 1 THEN exp(-{h}) * {odd_sum} ELSE 0.0 END)"
    p = f"(CASE WHEN ({k}) % 2 = 0 THEN {even} ELSE {odd} END)"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({k}) IS NULL THEN NULL "
            f"WHEN ({k}) <= 0 OR ({x}) <= 0 THEN 1.0 ELSE least(1.0, {p}) END)")


def mwu_ctes(long_view: str, keys: list[str], a: str, b: str, name: str = "mwu") -> str:
    """Histogram + window mid-ranks + exact medians, as on the Spark side."""
    k = ", ".join(keys)
    w = f"PARTITION BY {k} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def med(cum, cnt, n):
        prev = f"({cum} - {cnt})"
        k1 = f"floor(({n} + 1) / 2)"
        k2 = f"(floor({n} / 2) + 1)"
        return (f"((min(CASE WHEN {prev} < {k1} AND {cum} >= {k1} THEN value END) + "
                f"min(CASE WHEN {prev} < {k2} AND {cum} >= {k2} THEN value END)) / 2.0)")

    sigma = "sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1))))"
    z = f"((greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / {sigma})"
    return f"""{name}_h AS (SELECT {k}, value, count(*) AS t, count(*) FILTER (WHERE domain = {q(a)}) AS ca
          FROM {long_view} WHERE domain IN ({q(a)}, {q(b)}) AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
{name}_r AS (SELECT *, t - ca AS cb, sum(t) OVER ({w}) AS cum, sum(ca) OVER ({w}) AS cum_a, sum(t - ca) OVER ({w}) AS cum_b,
          sum(ca) OVER (PARTITION BY {k}) AS na_all, sum(t - ca) OVER (PARTITION BY {k}) AS nb_all FROM {name}_h),
{name}_m AS (SELECT {k}, {xmean(f"CASE WHEN domain = {q(a)} THEN value END")} AS mean_a, {xmean(f"CASE WHEN domain = {q(b)} THEN value END")} AS mean_b
          FROM {long_view} WHERE domain IN ({q(a)}, {q(b)}) AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
{name}_g0 AS (SELECT {k}, sum(ca)::DOUBLE AS n_a, sum(cb)::DOUBLE AS n_b,
          sum(ca * (cum - (t - 1) / 2.0)) AS r_a, sum(power(t::DOUBLE, 3) - t) AS ties,
          {med('cum_a', 'ca', 'na_all')} AS median_a, {med('cum_b', 'cb', 'nb_all')} AS median_b FROM {name}_r GROUP BY {k}),
{name}_g AS (SELECT g.*, m.mean_a, m.mean_b FROM {name}_g0 g LEFT JOIN {name}_m m USING ({k})),
{name}_u AS (SELECT *, r_a - n_a * (n_a + 1) / 2.0 AS u FROM {name}_g),
{name} AS (SELECT {k}, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b,
          mean_a, mean_b,
          median_a, median_b, CASE WHEN n_a > 0 AND n_b > 0 THEN u END AS u,
          CASE WHEN NOT (n_a > 0 AND n_b > 0) THEN NULL WHEN {sigma} IS NULL OR {sigma} <= 0 THEN 1.0
               ELSE least(1.0, {erfc_sql(f'({z}) / sqrt(2.0)')}) END AS p_value,
          CASE WHEN n_a > 0 AND n_b > 0 THEN 2.0 * u / (n_a * n_b) - 1.0 END AS effect_size FROM {name}_u)"""


def chi_ctes(counts_view: str, test: str, row: str, col: str, n: str, name: str = "chi") -> str:
    return f"""{name}_c AS (SELECT {test}, {row}, {col}, sum({n})::DOUBLE AS o FROM {counts_view} GROUP BY ALL),
{name}_rows AS (SELECT {test}, {row}, sum(o) AS r_tot FROM {name}_c GROUP BY ALL HAVING sum(o) > 0),
{name}_cols AS (SELECT {test}, {col}, sum(o) AS c_tot FROM {name}_c GROUP BY ALL),
{name}_g AS (SELECT r.{test}, r.{row}, c.{col}, r.r_tot, c.c_tot, coalesce(x.o, 0.0) AS o
             FROM {name}_rows r JOIN {name}_cols c USING ({test}) LEFT JOIN {name}_c x USING ({test}, {row}, {col})),
{name}_t AS (SELECT *, sum(o) OVER (PARTITION BY {test}) AS n_total,
             count(DISTINCT {row}) OVER (PARTITION BY {test}) AS n_rows, count(DISTINCT {col}) OVER (PARTITION BY {test}) AS n_cols FROM {name}_g),
{name}_e AS (SELECT *, (n_rows - 1) * (n_cols - 1) AS dof, r_tot * c_tot / n_total AS e FROM {name}_t),
{name}_s AS (SELECT {test}, first(n_total)::BIGINT AS n_total, first(n_rows)::INTEGER AS n_rows, first(n_cols)::INTEGER AS n_cols,
             first(dof)::INTEGER AS dof,
             sum(CASE WHEN e > 0 THEN power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0.0 END, 2) / e ELSE 0.0 END) AS statistic
             FROM {name}_e GROUP BY {test}),
{name} AS (SELECT {test}, n_total, n_rows, n_cols, dof, statistic, {chi2_sf_sql('statistic', 'dof')} AS p_value,
           CASE WHEN n_total > 0 AND least(n_rows - 1, n_cols - 1) > 0 THEN sqrt(statistic / (n_total * least(n_rows - 1, n_cols - 1))) END AS cramers_v
           FROM {name}_s)"""


# ------------------------------------------------------------------ per-query SQL

def feature_long(features: str = "features", cols=None) -> str:
    from contrasta.plans.featurize import FEATURE_GROUPS
    groups = FEATURE_GROUPS if cols is None else cols
    sel = " UNION ALL ".join(f"SELECT doc_id, domain, {q(g)} AS feature_group, {q(c)} AS feature, {c}::DOUBLE AS value FROM {features}"
                             for g, cs in groups for c in cs)
    return sel


def sql_clean_text() -> str:
    return f"WITH {decorated()} SELECT doc_id, {clean('text')} AS clean_text FROM decorated"


def sql_text_metrics() -> str:
    return f"""WITH {decorated()}
SELECT doc_id, length(coalesce(text, ''))::BIGINT AS char_count,
       coalesce(len(regexp_extract_all(text, {q(tx.WORD_RUN_RE)})), 0)::BIGINT AS word_count,
       {truncate('text')} AS truncated, length(substring(coalesce(text, ''), 1, 2000))::BIGINT AS model_input_chars
FROM decorated"""


def sql_parse_model_answer() -> str:
    v = "('0.' || lpad((event_id % 100)::VARCHAR, 2, '0'))"
    ans = f"""CASE event_id % 5
      WHEN 0 THEN 'Sure! {{"urgency": ' || {v} || ', "authority": 0.1, "doubt": ' || ('0.' || (user_id % 10)::VARCHAR) || '}} hope it helps'
      WHEN 1 THEN '{{"urgency": ' || {v} || '}}'
      WHEN 2 THEN 'Here:' || chr(10) || '{{"urgency": "high",' || chr(10) || ' "doubt": ' || {v} || '}}' || chr(10) || '{{"doubt": 1}}'
      WHEN 3 THEN 'no idea ' || event_type
      ELSE props END"""
    fields = ", ".join(
        f"{r(f'coalesce(CASE WHEN json_valid(obj) THEN TRY_CAST(json_extract(obj, {q(chr(36) + chr(46) + f)}) AS DOUBLE) END, 0.0)')} AS {f}"
        for f in STRATEGIES)
    return f"""WITH a AS (SELECT event_id, coalesce({ans}, '') AS answer FROM events),
o AS (SELECT event_id, CASE WHEN regexp_extract(answer, '(?s)\\{{.*?\\}}', 0) <> '' THEN regexp_extract(answer, '(?s)\\{{.*?\\}}', 0) ELSE answer END AS obj FROM a)
SELECT event_id, {fields} FROM o"""


def _first(cols):
    return "coalesce(" + ", ".join(f"CASE WHEN {c} NOT IN ('na', 'n/a') THEN {c} END" for c in cols) + ")"


def source_ctes() -> str:
    codes = ["0_not_relevant", "1_not_happening", "2_not_human", "3_not_bad", "4_solutions_harmful_unnecessary",
             "5_science_unreliable", "6_proponents_biased", "7_fossil_fuels_needed", "9_unlisted"]
    return f"""cdl_raw AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 4 = 0 THEN d.text WHEN d.doc_id % 4 = 1 THEN 'na' END AS tweet_text,
    CASE WHEN d.doc_id % 4 IN (1, 2) THEN d.text END AS claim,
    d.text AS article_title,
    CASE WHEN d.doc_id % 3 = 0 THEN l.quality::VARCHAR WHEN d.doc_id % 3 = 1 THEN 'n/a' END AS binary_label,
    l.toxic::VARCHAR AS label_2, d.source AS dataset
  FROM documents d LEFT JOIN labels l USING (doc_id)),
cdl AS (SELECT doc_id, {_first(['tweet_text', 'claim', 'article_title'])} AS text, {_first(['binary_label', 'label_2'])} AS label,
        'cdl' AS source, dataset FROM cdl_raw),
princeton AS (SELECT item_id AS doc_id, text, {q(FALSE)} AS label, 'princeton' AS source, {q(lb.NAMES['dataset_headlines'])} AS dataset FROM benchmark),
cf AS (SELECT conv_id * 1000 + turn AS doc_id, text, (['SUPPORTS', 'REFUTES', 'NOT_ENOUGH_INFO'])[turn % 3 + 1] AS label,
       'cdl' AS source, 'climate_fever' AS dataset FROM conversations WHERE role = 'user'),
qc AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE ({slist(codes)})[doc_id % 9 + 1] END AS label,
       'quotaclimat' AS source, 'quotaclimat' AS dataset FROM documents WHERE lang = 'en'),
cfd AS (SELECT conv_id * 1000 + turn AS doc_id, text, (turn % 5)::VARCHAR AS label, 'climate_fever_direct' AS source,
        'climate_fever_direct' AS dataset FROM conversations WHERE role = 'assistant'),
cc_raw AS (SELECT d.doc_id, d.text AS text,
        CASE WHEN l.quality = 0 THEN '0_not_relevant' WHEN l.toxic = 1 THEN '1_misleading' END AS label
        FROM documents d JOIN labels l USING (doc_id)),
cc AS (SELECT doc_id, text, label, 'climatecheck' AS source, 'climatecheck' AS dataset FROM cc_raw
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"""


def sql_normalize_sources() -> str:
    return f"""WITH {source_ctes()}
SELECT * FROM cdl UNION ALL SELECT * FROM princeton UNION ALL SELECT * FROM cf UNION ALL SELECT * FROM qc
UNION ALL SELECT * FROM cfd UNION ALL SELECT * FROM cc"""


def sql_corpus_from_sources() -> str:
    return f"""WITH {source_ctes()}, {lang_profile()},
united AS (SELECT 0 AS i, *, NULL AS preset FROM cdl UNION ALL SELECT 1, *, 'covid' FROM princeton UNION ALL SELECT 2, *, NULL FROM cf
  UNION ALL SELECT 3, *, NULL FROM qc UNION ALL SELECT 4, *, NULL FROM cfd UNION ALL SELECT 5, *, NULL FROM cc),
labelled AS (SELECT i * 288230376151711744 + doc_id AS doc_id, text, source, dataset,
  coalesce(preset, {domain_case('dataset', domain_rules() | DRIVER_DOMAIN_RULES)}) AS domain,
  CASE WHEN i IN (0, 2) THEN {_map_sql(_rules('cdl'))}[lower(coalesce(label, 'nan'))]
       WHEN i = 3 THEN coalesce({_map_sql(_rules('quotaclimat'))}[label], label)
       WHEN i = 4 THEN CASE TRY_CAST(label AS DOUBLE) WHEN 0 THEN {q(TRUE)} WHEN 1 THEN {q(FALSE)} END
       WHEN i = 5 THEN CASE WHEN starts_with(coalesce(label, 'nan'), '0_') THEN {q(TRUE)} ELSE {q(FALSE)} END
       ELSE label END AS label FROM united),
cleaned AS (SELECT doc_id, domain, source, dataset, label, {clean('text')} AS text FROM labelled WHERE label <> {q(TRUE)}),
firsts AS (SELECT * FROM cleaned WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY domain, text ORDER BY doc_id) = 1),
tok AS (SELECT doc_id, unnest({word_tokens(decode('text'))}) AS word FROM firsts WHERE domain = 'covid'),
hits AS (SELECT t.doc_id, p.lang, count(*) AS n FROM tok t JOIN lang_profile p USING (word) GROUP BY ALL),
best AS (SELECT doc_id, lang FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT f.* FROM firsts f LEFT JOIN best b USING (doc_id) WHERE f.domain <> 'covid' OR b.lang = 'en'"""


def raw_labels_cte() -> str:
    codes = ["0_not_relevant", "1_not_happening", "2_not_human", "3_not_bad", "4_solutions_harmful_unnecessary",
             "5_science_unreliable", "6_proponents_biased", "7_fossil_fuels_needed", "9_unlisted"]
    return f"""raw AS (
  SELECT 'cdl' AS source, doc_id, CASE doc_id % 7
      WHEN 0 THEN quality::VARCHAR
      WHEN 1 THEN CASE WHEN quality = 1 THEN 'FAKE' ELSE 'Real' END
      WHEN 2 THEN CASE WHEN toxic = 1 THEN 'REFUTES' ELSE 'supports' END
      WHEN 3 THEN quality::DOUBLE::VARCHAR
      WHEN 4 THEN 'TRUE'
      WHEN 5 THEN NULL
      ELSE 'unknown' END AS label FROM labels
  UNION ALL SELECT 'princeton', item_id, {q(FALSE)} FROM benchmark
  UNION ALL SELECT 'quotaclimat', doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE ({slist(codes)})[doc_id % 9 + 1] END FROM documents
  UNION ALL SELECT 'climate_fever_direct', conv_id * 1000 + turn, (turn % 5)::VARCHAR FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'climatecheck', d.doc_id, CASE WHEN l.quality = 0 THEN '0_not_relevant' WHEN l.toxic = 1 THEN '1_misleading' END
            FROM documents d JOIN labels l USING (doc_id))"""


def _rules(source: str) -> dict:
    return {raw: action for s, kind, raw, action, _ in lb.label_rules() if s == source and kind in ("folded", "exact")}


def _map_sql(d: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def sql_harmonize_labels() -> str:
    cdl = _map_sql(_rules('cdl'))
    quote = _map_sql(_rules('quotaclimat'))
    return f"""WITH {raw_labels_cte()},
h AS (
  SELECT source, doc_id, {cdl}[lower(coalesce(label, 'nan'))] AS label FROM raw WHERE source = 'cdl'
  UNION ALL SELECT source, doc_id, label FROM raw WHERE source = 'princeton'
  UNION ALL SELECT source, doc_id, coalesce({quote}[label], label) FROM raw WHERE source = 'quotaclimat'
  UNION ALL SELECT source, doc_id, CASE TRY_CAST(label AS DOUBLE) WHEN 0 THEN {q(TRUE)} WHEN 1 THEN {q(FALSE)} END
            FROM raw WHERE source = 'climate_fever_direct'
  UNION ALL SELECT source, doc_id, CASE WHEN starts_with(coalesce(label, 'nan'), '0_') THEN {q(TRUE)} ELSE {q(FALSE)} END
            FROM raw WHERE source = 'climatecheck')
SELECT source, doc_id, label FROM h
WHERE label IS NOT NULL AND (source <> 'cdl' OR label IN ({q(FALSE)}, {q(TRUE)}))"""


def sql_domain_assign() -> str:
    return f"SELECT doc_id, source AS dataset, {domain_case('source')} AS domain FROM documents"


def sql_drop_credible() -> str:
    cdl = _map_sql(_rules('cdl'))
    return f"""WITH {raw_labels_cte()},
h AS (SELECT doc_id, {cdl}[lower(coalesce(label, 'nan'))] AS label FROM raw WHERE source = 'cdl')
SELECT doc_id, label FROM h WHERE label IN ({q(FALSE)}, {q(TRUE)}) AND label IS DISTINCT FROM {q(TRUE)}"""


def sql_dedupe_keep_first() -> str:
    return "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"


def sql_preprocess_corpus() -> str:
    return f"WITH {corpus_ctes()} SELECT doc_id, domain, dataset, text FROM corpus"


def sql_value_counts() -> str:
    return f"""WITH {corpus_ctes()},
c AS (SELECT domain, dataset, count(*) AS count FROM corpus WHERE dataset IS NOT NULL GROUP BY ALL)
SELECT domain, dataset, count, row_number() OVER (PARTITION BY domain ORDER BY count DESC, dataset) AS rank
FROM c QUALIFY rank <= 10"""


def sql_lang_detect() -> str:
    return f"""WITH {lang_profile()},
tok AS (SELECT doc_id, unnest({word_tokens(decode('text'))}) AS word FROM documents),
hits AS (SELECT t.doc_id, p.lang, count(*) AS n FROM tok t JOIN lang_profile p USING (word) GROUP BY ALL),
best AS (SELECT doc_id, lang AS lang_detected FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT d.doc_id, d.lang, b.lang_detected FROM documents d LEFT JOIN best b USING (doc_id)"""


def sql_lang_accuracy() -> str:
    return f"""WITH {lang_profile()},
tok AS (SELECT doc_id, unnest({word_tokens(decode('text'))}) AS word FROM documents),
hits AS (SELECT t.doc_id, p.lang, count(*) AS n FROM tok t JOIN lang_profile p USING (word) GROUP BY ALL),
best AS (SELECT doc_id, lang AS lang_detected FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1),
j AS (SELECT d.lang, b.lang_detected FROM documents d LEFT JOIN best b USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang_detected = lang) AS n_correct,
       count(*) FILTER (WHERE lang_detected IS NULL) AS n_undecided,
       {r('count(*) FILTER (WHERE lang_detected = lang) / count(*)')} AS accuracy
FROM j GROUP BY lang"""


def sql_lemmatize() -> str:
    return f"WITH {corpus_ctes()}, {lemma_ctes()} SELECT doc_id, text_lemma FROM lem"


def sql_sentiment() -> str:
    cols = ", ".join(f"{r(c)} AS {c}" for c in ["vader_neg", "vader_neu", "vader_pos", "vader_compound"])
    return f"""WITH {corpus_ctes()}, {sentiment_ctes('corpus')}
SELECT doc_id, {cols}, CASE WHEN vader_compound > 0.05 THEN 'positive' WHEN vader_compound < -0.05 THEN 'negative' ELSE 'neutral' END AS polarity
FROM sentiment"""


def sql_emotion() -> str:
    cols = ", ".join(f"{r(c)} AS {c}" for c in EMOTION_COLUMNS)
    return f"WITH {corpus_ctes()}, {emotion_ctes('corpus')} SELECT doc_id, {cols}, {dominant()} AS dominant_emotion FROM emotion"


def sql_rhetoric() -> str:
    return f"""WITH {corpus_ctes()}, {rhetoric_ctes('corpus')}
SELECT doc_id, {r('urgency')} AS urgency, {r('authority')} AS authority, {r('doubt')} AS doubt,
       urgency_presence, authority_presence, doubt_presence, {r('authority_to_doubt_ratio')} AS authority_to_doubt_ratio FROM rhetoric"""


def _tfidf_prefix() -> str:
    return f"""WITH {corpus_ctes()}, {lemma_ctes()},
f_base AS (SELECT * FROM lem WHERE text_lemma <> ''),
{tfidf_ctes('f_base')}"""


def sql_tfidf_weights() -> str:
    return f"{_tfidf_prefix()} SELECT doc_id, term, tf, {r('score')} AS score FROM weights"


def sql_top_terms() -> str:
    return f"{_tfidf_prefix()} SELECT domain, rank, term, {r('mean_tfidf')} AS mean_tfidf FROM top"


def _context_prefix() -> str:
    return f"""WITH {feature_ctes()},
{tfidf_ctes('features')},
m AS (SELECT w.doc_id, w.domain, w.term, w.score, t.rank, t.mean_tfidf FROM weights w JOIN top t USING (domain, term) WHERE w.score > 0),
j AS (SELECT m.*, f.text, f.dataset, f.source, f.dominant_emotion, f.vader_neg, f.vader_neu, f.vader_pos, f.vader_compound,
             {', '.join('f.' + e for e in EMOTION_COLUMNS)} FROM m JOIN features f USING (doc_id)),
sizes AS (SELECT domain, count(*) AS document_count FROM features GROUP BY domain)"""


def sql_term_context() -> str:
    cols = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"] + EMOTION_COLUMNS
    avgs = ", ".join(f"{r(xmean(c))} AS avg_{c}" for c in cols)
    return f"""{_context_prefix()}
SELECT j.domain, j.term, {r('first(mean_tfidf)')} AS mean_tfidf, count(*) AS document_frequency, {avgs},
       first(s.document_count) AS document_count, {r('count(*) / first(s.document_count)')} AS share_of_domain_docs
FROM j JOIN sizes s USING (domain) GROUP BY j.domain, j.term"""


def sql_term_examples() -> str:
    return f"""{_context_prefix()}
SELECT domain, term, row_number() OVER (PARTITION BY domain, term ORDER BY round(score, 12) DESC, doc_id) AS example_rank, doc_id,
       {truncate('text')} AS text, coalesce(dataset, '') AS dataset, coalesce(source, '') AS source,
       {r('score')} AS term_tfidf_score, {r('vader_compound')} AS vader_compound, dominant_emotion
FROM j QUALIFY example_rank <= 3"""


def _result_cols(view: str = "mwu") -> str:
    return f"""feature_group, feature, 'mann_whitney_u' AS test, 'u' AS statistic_name, coalesce(n_a, 0)::BIGINT AS {A}_n,
  coalesce(n_b, 0)::BIGINT AS {B}_n, mean_a AS {A}_mean, mean_b AS {B}_mean, median_a AS {A}_median, median_b AS {B}_median,
  mean_a - mean_b AS mean_difference, median_a - median_b AS median_difference, u AS statistic, p_value, effect_size,
  'rank_biserial_correlation' AS effect_size_name,
  CASE WHEN coalesce(n_a, 0) > 0 AND coalesce(n_b, 0) > 0 THEN 'means_are_descriptive_only' ELSE 'insufficient_data' END AS notes"""


RESULT_NUM = [f"{A}_n", f"{B}_n", f"{A}_mean", f"{B}_mean", f"{A}_median", f"{B}_median", "mean_difference",
              "median_difference", "statistic", "p_value", "effect_size"]


def _round_results(cols_extra=()) -> str:
    out = ["feature_group", "feature", "test", "statistic_name"]
    for c in RESULT_NUM:
        out.append(c if c.endswith("_n") else f"{r(c)} AS {c}")
    out += ["effect_size_name", "notes", *cols_extra]
    return ", ".join(out)


def _numeric_results_ctes() -> str:
    return f"""{feature_ctes()},
flong AS ({feature_long()}),
{mwu_ctes('flong', ['feature_group', 'feature'], A, B)},
num AS (SELECT {_result_cols()} FROM (SELECT DISTINCT feature_group, feature FROM flong) p LEFT JOIN mwu USING (feature_group, feature))"""


def _dominant_ctes() -> str:
    dims = " UNION ALL ".join(f"SELECT {q(d)} AS domain, {q(e)} AS dominant_emotion, {i} AS ordinal"
                             for d in (A, B) for i, e in enumerate(EMOTION_COLUMNS))
    return f"""dim AS ({dims}),
obs AS (SELECT domain, dominant_emotion, count(*) AS n FROM features WHERE domain IN ({q(A)}, {q(B)}) GROUP BY ALL),
dcounts AS (SELECT 'dominant_emotion' AS test, d.domain, d.dominant_emotion, d.ordinal, coalesce(o.n, 0)::BIGINT AS count
            FROM dim d LEFT JOIN obs o USING (domain, dominant_emotion)),
{chi_ctes('dcounts', 'test', 'dominant_emotion', 'domain', 'count', 'dchi')},
dn AS (SELECT test, sum(CASE WHEN domain = {q(A)} THEN count END) AS n_a, sum(CASE WHEN domain = {q(B)} THEN count END) AS n_b
       FROM dcounts GROUP BY test),
dres AS (SELECT 'emotion_distribution' AS feature_group, 'dominant_emotion' AS feature, 'chi_square' AS test, 'chi2' AS statistic_name,
   n.n_a::BIGINT AS {A}_n, n.n_b::BIGINT AS {B}_n, NULL::DOUBLE AS {A}_mean, NULL::DOUBLE AS {B}_mean, NULL::DOUBLE AS {A}_median,
   NULL::DOUBLE AS {B}_median, NULL::DOUBLE AS mean_difference, NULL::DOUBLE AS median_difference,
   CASE WHEN ok THEN c.statistic END AS statistic, CASE WHEN ok THEN c.p_value END AS p_value,
   CASE WHEN ok THEN c.cramers_v END AS effect_size, 'cramers_v' AS effect_size_name,
   CASE WHEN ok THEN 'dof=' || c.dof::VARCHAR ELSE 'insufficient_data' END AS notes
 FROM (SELECT *, n_a > 0 AND n_b > 0 AS ok0 FROM dn) n LEFT JOIN dchi c USING (test)
 CROSS JOIN LATERAL (SELECT n.ok0 AND c.n_rows IS NOT NULL AND c.n_rows > 0 AS ok))"""


def _run_stats_ctes() -> str:
    return f"""{_numeric_results_ctes()},
{_dominant_ctes()},
allr AS (SELECT * FROM num UNION ALL BY NAME SELECT * FROM dres),
v AS (SELECT *, p_value IS NOT NULL AND NOT isnan(p_value) AS valid FROM allr),
rk AS (SELECT *, row_number() OVER (PARTITION BY valid ORDER BY p_value) AS rnk, count(*) OVER (PARTITION BY valid) AS m FROM v),
bh AS (SELECT *, CASE WHEN valid THEN least(1.0, min(p_value * m / rnk) OVER (PARTITION BY valid ORDER BY rnk DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS adjusted_p_value FROM rk),
stats AS (SELECT * EXCLUDE (valid, rnk, m), coalesce(p_value < 0.05, false) AS significant_0_05,
          coalesce(adjusted_p_value < 0.05, false) AS fdr_significant_0_05 FROM bh)"""


def sql_mwu_features() -> str:
    return f"WITH {_numeric_results_ctes()} SELECT {_round_results()} FROM num"


def sql_mwu_lineitem() -> str:
    return f"""WITH li AS (SELECT l_returnflag AS domain, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice,
                   l_discount::DOUBLE AS l_discount FROM lineitem),
lilong AS (UNPIVOT li ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE value),
{mwu_ctes('lilong', ['feature'], 'A', 'R')}
SELECT feature, n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('median_a')} AS median_a, {r('median_b')} AS median_b,
       {r('u')} AS u, {r('p_value')} AS p_value, {r('effect_size')} AS effect_size FROM mwu"""


def sql_chi2_labels() -> str:
    return f"""WITH d AS (SELECT doc_id, {domain_case('source')} AS domain FROM documents),
j AS (SELECT d.domain, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic FROM d JOIN labels l USING (doc_id)
      WHERE d.domain IN ({q(A)}, {q(B)})),
lg AS (UNPIVOT j ON quality, toxic INTO NAME test VALUE flag),
cnt AS (SELECT test, domain, flag, count(*) AS n FROM lg GROUP BY ALL),
{chi_ctes('cnt', 'test', 'domain', 'flag', 'n')}
SELECT test, n_total, n_rows, n_cols, dof, {r('statistic')} AS statistic, {r('p_value')} AS p_value, {r('cramers_v')} AS cramers_v FROM chi"""


def sql_dominant_emotion_test() -> str:
    return f"WITH {feature_ctes()}, {_dominant_ctes()} SELECT {_round_results()} FROM dres"


def sql_dominant_shares() -> str:
    return f"""WITH {feature_ctes()}, {_dominant_ctes()},
sh AS (SELECT domain, dominant_emotion, ordinal, count,
       CASE WHEN sum(count) OVER (PARTITION BY domain) = 0 THEN 0.0 ELSE count / sum(count) OVER (PARTITION BY domain) END AS share FROM dcounts)
SELECT domain, dominant_emotion, ordinal::INTEGER AS ordinal, count, {r('share')} AS share, {r('share * 100.0')} AS percent FROM sh"""


def _stars(p: str) -> str:
    return f"CASE WHEN {p} IS NULL OR isnan({p}) THEN '' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def sql_share_frame() -> str:
    return f"""WITH {_run_stats_ctes()},
t AS (SELECT adjusted_p_value, effect_size AS cramers_v FROM stats WHERE feature = 'dominant_emotion'),
sh AS (SELECT domain, dominant_emotion, ordinal, count,
       CASE WHEN sum(count) OVER (PARTITION BY domain) = 0 THEN 0.0 ELSE count / sum(count) OVER (PARTITION BY domain) END AS share FROM dcounts)
SELECT domain, dominant_emotion, ordinal::INTEGER AS ordinal, count, {r('share')} AS share, {r('share * 100.0')} AS percent,
       {r('adjusted_p_value')} AS adjusted_p_value, {r('cramers_v')} AS cramers_v, {_stars('adjusted_p_value')} AS stars FROM sh, t"""


def sql_box_frame() -> str:
    return f"""WITH {_run_stats_ctes()}, {_box_ctes()}, box AS ({_box_select()})
SELECT box.*, {r('s.adjusted_p_value')} AS adjusted_p_value, {_stars('s.adjusted_p_value')} AS stars
FROM box LEFT JOIN stats s USING (feature)"""


def sql_summary_counts() -> str:
    return f"""WITH {feature_ctes()}
SELECT domain, 'source' AS kind, source AS value, count(*) AS count FROM features WHERE source IS NOT NULL GROUP BY ALL
UNION ALL SELECT domain, 'dataset', dataset, count(*) FROM features WHERE dataset IS NOT NULL GROUP BY ALL"""


def sql_term_payload() -> str:
    return f"""{_context_prefix()}
SELECT j.domain, first(s.document_count) AS document_count, row_number() OVER (PARTITION BY j.domain ORDER BY first(j.rank)) AS place, j.term,
       {r('first(mean_tfidf)')} AS mean_tfidf, count(*) AS document_frequency, {r('avg(vader_compound)')} AS compound, least(3, count(*)) AS examples
FROM j JOIN sizes s USING (domain) GROUP BY j.domain, j.term"""


def sql_incremental_scores() -> str:
    return "SELECT doc_id, length(text)::DOUBLE AS score, doc_id % 3 < 2 AND doc_id % 5 <> 0 AS reused FROM documents"


def sql_domain_store() -> str:
    return f"WITH {corpus_ctes()} SELECT doc_id, domain, dataset FROM corpus WHERE domain = {q(B)}"


def sql_run_stats() -> str:
    extra = [f"{r('adjusted_p_value')} AS adjusted_p_value", "significant_0_05", "fdr_significant_0_05"]
    return f"WITH {_run_stats_ctes()} SELECT {_round_results(extra)} FROM stats"


def sql_top_findings() -> str:
    return f"""WITH {_run_stats_ctes()}
SELECT feature_group, feature, test, {r(A + '_median')} AS {A}_median, {r(B + '_median')} AS {B}_median, {r('p_value')} AS p_value,
       {r('adjusted_p_value')} AS adjusted_p_value, {r('effect_size')} AS effect_size
FROM stats ORDER BY adjusted_p_value ASC NULLS LAST, p_value ASC NULLS LAST, feature_group, feature LIMIT 10"""


def sql_bh_adjust() -> str:
    return f"""WITH {_run_stats_ctes()}
SELECT feature_group, feature, {r('p_value')} AS p_value, {r('adjusted_p_value')} AS adjusted_p_value, significant_0_05, fdr_significant_0_05 FROM stats"""


def sql_holm_adjust() -> str:
    return f"""WITH {_numeric_results_ctes()},
v AS (SELECT feature_group, feature, p_value, p_value IS NOT NULL AND NOT isnan(p_value) AS valid FROM num),
rk AS (SELECT *, row_number() OVER (PARTITION BY feature_group, valid ORDER BY p_value) AS rnk,
       count(*) OVER (PARTITION BY feature_group, valid) AS m FROM v)
SELECT feature_group, feature, {r('p_value')} AS p_value,
  {r("CASE WHEN valid THEN max(least(1.0, (m - rnk + 1) * p_value)) OVER (PARTITION BY feature_group, valid ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END")} AS adjusted_p_value
FROM rk"""


def _rhetoric_ctes() -> str:
    flags = [f"{s}_presence" for s in STRATEGIES]
    cont = STRATEGIES + ["authority_to_doubt_ratio"]
    long_c = " UNION ALL ".join(f"SELECT domain, {q(c)} AS feature, {c}::DOUBLE AS value FROM features" for c in cont)
    long_f = " UNION ALL ".join(f"SELECT domain, {q(c)} AS feature, {c}::INTEGER AS flag FROM features WHERE domain IN ({q(A)}, {q(B)})"
                                for c in flags)
    return f"""{feature_ctes()},
rl AS ({long_c}),
{mwu_ctes('rl', ['feature'], A, B)},
fl AS ({long_f}),
fc AS (SELECT feature, domain, flag, count(*) AS n FROM fl GROUP BY ALL),
{chi_ctes('fc', 'feature', 'domain', 'flag', 'n')},
rates AS (SELECT feature, sum(CASE WHEN domain = {q(A)} THEN flag END) / count(*) FILTER (WHERE domain = {q(A)}) AS ra,
                 sum(CASE WHEN domain = {q(B)} THEN flag END) / count(*) FILTER (WHERE domain = {q(B)}) AS rb FROM fl GROUP BY feature),
rt AS (SELECT feature, mean_a AS {A}_mean, mean_b AS {B}_mean, p_value, 'mann-whitney' AS test,
       NULL::DOUBLE AS {A}_rate, NULL::DOUBLE AS {B}_rate FROM mwu
       UNION ALL
       SELECT c.feature, NULL::DOUBLE, NULL::DOUBLE, c.p_value, 'chi-squared', coalesce(ra, 0.0), coalesce(rb, 0.0)
       FROM chi c JOIN rates USING (feature))"""


def sql_rhetoric_tests() -> str:
    return f"""WITH {_rhetoric_ctes()}
SELECT feature, {r(A + '_mean')} AS {A}_mean, {r(B + '_mean')} AS {B}_mean, {r('p_value')} AS p_value, test,
       {r(A + '_rate')} AS {A}_rate, {r(B + '_rate')} AS {B}_rate FROM rt"""


def _rhetoric_frame_ctes() -> str:
    order = ["urgency", "authority", "doubt", "urgency_presence", "authority_presence", "doubt_presence"]
    dims = " UNION ALL ".join(f"SELECT {q(f)} AS feature, {i} AS ordinal" for i, f in enumerate(order))
    return f"""{_rhetoric_ctes()},
rdim AS ({dims}),
rframe AS (SELECT d.ordinal, rt.feature, CASE WHEN rt.feature IN ('urgency', 'authority', 'doubt') THEN 'score' ELSE 'rate' END AS kind,
   CASE WHEN rt.feature IN ('urgency', 'authority', 'doubt') THEN {A}_mean ELSE {A}_rate END AS {A}_value,
   CASE WHEN rt.feature IN ('urgency', 'authority', 'doubt') THEN {B}_mean ELSE {B}_rate END AS {B}_value,
   p_value, {_stars('p_value')} AS stars FROM rt JOIN rdim d USING (feature))"""


def sql_rhetoric_frame() -> str:
    return f"""WITH {_rhetoric_frame_ctes()}
SELECT ordinal::INTEGER AS ordinal, feature, kind, {r(A + '_value')} AS {A}_value, {r(B + '_value')} AS {B}_value,
       {r('p_value')} AS p_value, stars FROM rframe"""


def sql_direction_summary() -> str:
    bit = (f"CASE WHEN {B}_value > {A}_value THEN 'higher climate ' || feature "
           f"WHEN {A}_value > {B}_value THEN 'higher COVID ' || feature END")
    return f"""WITH {_rhetoric_frame_ctes()},
bits AS (SELECT ordinal, {bit} AS bit FROM rframe WHERE kind = 'score'),
j AS (SELECT array_to_string(list_slice(coalesce(list(bit ORDER BY ordinal) FILTER (WHERE bit IS NOT NULL), []), 1, 3), '; ') AS s FROM bits)
SELECT upper(substring(s, 1, 1)) || lower(substring(s, 2)) || '.' AS summary FROM j"""


def sql_sentiment_frame() -> str:
    dims = " UNION ALL ".join(f"SELECT {q(c)} AS category, {q(f)} AS feature, {i} AS ordinal"
                             for i, (c, f) in enumerate([("neg", "vader_neg"), ("neu", "vader_neu"), ("pos", "vader_pos"), ("compound", "vader_compound")]))
    long_v = " UNION ALL ".join(f"SELECT domain, {q(c)} AS feature, {c}::DOUBLE AS value FROM features"
                                for c in ["vader_neg", "vader_neu", "vader_pos", "vader_compound"])
    return f"""WITH {_run_stats_ctes()},
sdim AS ({dims}),
vl AS ({long_v}),
mm AS (SELECT feature, {xmean(f"CASE WHEN domain = {q(A)} THEN value END")} AS ma, {xmean(f"CASE WHEN domain = {q(B)} THEN value END")} AS mb FROM vl GROUP BY feature),
res AS (SELECT feature, adjusted_p_value FROM stats WHERE feature_group = 'vader')
SELECT d.ordinal::INTEGER AS ordinal, d.category, d.feature, {r('ma')} AS {A}_mean, {r('mb')} AS {B}_mean,
       {r('adjusted_p_value')} AS adjusted_p_value, {_stars('adjusted_p_value')} AS stars
FROM sdim d LEFT JOIN mm USING (feature) LEFT JOIN res USING (feature)"""


def sql_top15_frame() -> str:
    return f"{_tfidf_prefix()} SELECT domain, rank, term, {r('mean_tfidf')} AS mean_tfidf FROM top WHERE rank <= 15"


def sql_context_frame() -> str:
    emos = ["anger", "disgust", "fear", "sadness", "neutral", "joy"]
    return f"""{_context_prefix()},
rec AS (SELECT j.domain, j.term, first(rank) AS rank, count(*) AS document_frequency,
        count(*) / first(s.document_count) AS share_of_domain_docs, {xmean('vader_compound')} AS vader_compound,
        {', '.join(f"{xmean(e)} AS {e}" for e in emos)} FROM j JOIN sizes s USING (domain) GROUP BY j.domain, j.term),
pos AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank) AS position FROM rec QUALIFY position <= 6),
ex AS (SELECT domain, term, term || ': "' || {truncate('text')} || '"' AS example_line FROM j
       QUALIFY row_number() OVER (PARTITION BY domain, term ORDER BY round(score, 12) DESC, doc_id) = 1)
SELECT domain, position, term, document_frequency, {r('share_of_domain_docs')} AS share_of_domain_docs,
       {r('vader_compound')} AS vader_compound, {', '.join(f"{r(e)} AS {e}" for e in emos)}, example_line
FROM pos LEFT JOIN ex USING (domain, term)"""


def uniform_sql(seed: str, b: str, row_id: str) -> str:
    m = "2147483647"
    x = f"((({seed})::BIGINT * 7919 + {b}) * 1000003 + ({row_id})::BIGINT) & {m}"
    x = f"xor({x}, ({x}) >> 15)"
    x = f"(({x}) * 739982445) & {m}"
    x = f"xor({x}, ({x}) >> 12)"
    x = f"(({x}) * 695872825) & {m}"
    x = f"xor({x}, ({x}) >> 15)"
    return f"(({x}) / 2147483648.0)"


def bootstrap_ctes(src: str, keys: list[str], seed_expr: str, n_boot: int = 2000, name: str = "boot") -> str:
    """Weights of the distinct values, drawn digit by digit of their counts; small samples value by value."""
    k = ", ".join(keys)

    def weight() -> str:
        parts = [f"CASE WHEN (t >> {d}) & 1 = 1 THEN len(list_filter({poisson_thresholds(float(1 << d))}, lambda c: c <= {uniform_sql('seed', 'b', f'(cum * 64 + {d})')})) ELSE 0 END"
                 for d in range(DIGITS)]
        many = f"((t >> {DIGITS}) << {DIGITS})"
        u, v = (uniform_sql("seed", "b", f"(cum * 64 + {DIGITS + i})") for i in (0, 1))
        z = f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"
        return " + ".join(parts) + f" + CASE WHEN {many} > 0 THEN greatest(0, round({many} + sqrt({many}) * {z} + ({z} * {z} - 1) / 6)) ELSE 0 END"

    return f"""{name}_h AS (SELECT {k}, ({seed_expr})::BIGINT AS seed, value, count(*)::BIGINT AS t FROM {src} WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
{name}_r AS (SELECT *, (sum(t) OVER (PARTITION BY {k} ORDER BY value))::BIGINT AS cum, sum(t) OVER (PARTITION BY {k}) AS n FROM {name}_h),
{name}_x AS (SELECT {k}, b, value, {weight()} AS w FROM (SELECT * FROM {name}_r WHERE n > {SMALL_SAMPLE}) s, (SELECT unnest(range(1, {n_boot + 1})) AS b) r),
{name}_s AS (SELECT {k}, ({seed_expr})::BIGINT AS seed, list(value ORDER BY value) AS vs FROM {src} WHERE value IS NOT NULL AND NOT isnan(value)
      GROUP BY ALL HAVING count(*) <= {SMALL_SAMPLE}),
{name}_y AS (SELECT {k}, list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[1 + floor({uniform_sql('seed', 'b', 'i')} * len(vs))::BIGINT])) / len(vs) AS m
      FROM {name}_s, (SELECT unnest(range(1, {n_boot + 1})) AS b) r),
{name}_rep AS (SELECT {k}, sum(w * value) / sum(w) AS m FROM {name}_x GROUP BY {k}, b HAVING sum(w) > 0 UNION ALL SELECT {k}, m FROM {name}_y),
{name}_q AS (SELECT {k}, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM {name}_rep GROUP BY {k}),
{name} AS (SELECT * FROM (SELECT DISTINCT {k} FROM {src}) p LEFT JOIN {name}_q USING ({k}))"""


def sql_bootstrap_ci() -> str:
    return f"""WITH ev AS (SELECT event_id, event_type, value FROM events),
{bootstrap_ctes('ev', ['event_type'], '42')},
mean AS (SELECT event_type, avg(value) AS mean, count(*) AS n FROM ev GROUP BY event_type)
SELECT m.event_type, {r('mean')} AS mean, n, {r('ci_lower')} AS ci_lower, {r('ci_upper')} AS ci_upper
FROM mean m JOIN boot USING (event_type)"""


def sql_bootstrap_small() -> str:
    return f"""WITH ev AS (SELECT user_id % 97 AS bin, CASE WHEN user_id % 97 % 10 = 0 THEN CASE WHEN user_id % 5 = 0 THEN round(value, 0) END
                               WHEN user_id % 97 % 10 = 1 THEN NULL ELSE round(value, 0) END AS value FROM events),
{bootstrap_ctes('ev', ['bin'], '7', 500)},
n AS (SELECT bin, count(value) AS n FROM ev GROUP BY bin)
SELECT bin, n, {r('ci_lower')} AS ci_lower, {r('ci_upper')} AS ci_upper FROM n JOIN boot USING (bin)"""


def sql_key_findings() -> str:
    specs = ["sadness", "vader_compound", "anger", "auth_score"]
    long_k = " UNION ALL ".join(
        f"SELECT doc_id, domain, {q(c)} AS feature, {i} AS ordinal, {c}::DOUBLE AS value FROM features WHERE domain IN ({q(A)}, {q(B)})"
        for i, c in enumerate(specs))
    seed = f"CASE WHEN domain = {q(A)} THEN 42 + ordinal ELSE 42 + {len(specs)} + ordinal END"
    return f"""WITH {feature_ctes()},
kl AS ({long_k}),
{bootstrap_ctes('kl', ['feature', 'domain'], seed)},
{mwu_ctes('kl', ['feature'], A, B)},
ci AS (SELECT feature, max(CASE WHEN domain = {q(A)} THEN ci_lower END) AS al, max(CASE WHEN domain = {q(A)} THEN ci_upper END) AS au,
              max(CASE WHEN domain = {q(B)} THEN ci_lower END) AS bl, max(CASE WHEN domain = {q(B)} THEN ci_upper END) AS bu
       FROM boot GROUP BY feature),
o AS (SELECT DISTINCT feature, ordinal FROM kl),
j AS (SELECT o.ordinal, m.*, ci.al, ci.au, ci.bl, ci.bu FROM mwu m JOIN o USING (feature) LEFT JOIN ci USING (feature)),
v AS (SELECT *, p_value IS NOT NULL AND NOT isnan(p_value) AS valid FROM j),
rk AS (SELECT *, row_number() OVER (PARTITION BY valid ORDER BY p_value) AS rnk, count(*) OVER (PARTITION BY valid) AS m FROM v),
h AS (SELECT *, CASE WHEN valid THEN max(least(1.0, (m - rnk + 1) * p_value)) OVER (PARTITION BY valid ORDER BY rnk
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS adj FROM rk)
SELECT ordinal::INTEGER AS ordinal, feature, {r('mean_a')} AS {A}_mean, {r('mean_b')} AS {B}_mean, {r('al')} AS {A}_ci_lower,
       {r('au')} AS {A}_ci_upper, {r('bl')} AS {B}_ci_lower, {r('bu')} AS {B}_ci_upper, {r('u')} AS statistic,
       {r('p_value')} AS p_value, {r('adj')} AS adjusted_p_value, coalesce(adj < 0.05, false) AS significant FROM h"""


def sql_domain_summary() -> str:
    return f"""WITH {feature_ctes()}
SELECT domain, count(*) AS rows, {r('avg(char_count)')} AS mean_char_count, {r('quantile_cont(char_count::DOUBLE, 0.5)')} AS median_char_count,
       {r('avg(word_count)')} AS mean_word_count, {r('quantile_cont(word_count::DOUBLE, 0.5)')} AS median_word_count
FROM features GROUP BY domain"""


def sql_source_counts() -> str:
    return f"WITH {feature_ctes()} SELECT domain, dataset, count(*) AS count FROM features WHERE dataset IS NOT NULL GROUP BY ALL"


def _box_ctes() -> str:
    return """bl AS (SELECT domain, 'sadness' AS feature, sadness::DOUBLE AS value FROM features UNION ALL
       SELECT domain, 'anger', anger::DOUBLE FROM features),
qs AS (SELECT domain, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
       FROM bl WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
bj AS (SELECT b.*, q.q1, q.med, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi FROM bl b JOIN qs q USING (domain, feature))"""


def _box_select() -> str:
    return f"""SELECT domain, feature, {r('first(q1)')} AS q1, {r('first(med)')} AS median, {r('first(q3)')} AS q3,
       {r('min(CASE WHEN value >= lo THEN value END)')} AS whisker_low, {r('max(CASE WHEN value <= hi THEN value END)')} AS whisker_high,
       count(*) FILTER (WHERE value < lo OR value > hi) AS n_outliers, count(*) AS n
FROM bj GROUP BY domain, feature"""


def sql_box_summary() -> str:
    return f"""WITH {feature_ctes()},
{_box_ctes()}
{_box_select()}"""


def sql_sentiment_means() -> str:
    return f"""WITH {feature_ctes()}
SELECT domain, {r(xmean('vader_neg'))} AS neg, {r(xmean('vader_neu'))} AS neu, {r(xmean('vader_pos'))} AS pos, {r(xmean('vader_compound'))} AS compound
FROM features GROUP BY domain"""


def _stars(p: str, ns: str = "ns") -> str:
    return (f"CASE WHEN {p} IS NULL OR isnan({p}) THEN '' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' "
            f"WHEN {p} < 0.05 THEN '*' ELSE {q(ns)} END")


def sql_emotion_means() -> str:
    long_e = " UNION ALL ".join(f"SELECT domain, {q(e)} AS feature, {e}::DOUBLE AS value FROM features" for e in EMOTION_COLUMNS)
    return f"""WITH {_run_stats_ctes()},
el AS ({long_e}),
mm AS (SELECT feature, {xmean(f"CASE WHEN domain = {q(A)} THEN value END")} AS ma, {xmean(f"CASE WHEN domain = {q(B)} THEN value END")} AS mb FROM el GROUP BY feature),
res AS (SELECT feature, adjusted_p_value FROM stats WHERE feature_group = 'emotion')
SELECT feature, {r('ma')} AS {A}_mean, {r('mb')} AS {B}_mean, {r('adjusted_p_value')} AS adjusted_p_value, {_stars('adjusted_p_value')} AS stars
FROM mm LEFT JOIN res USING (feature)"""


def sql_report_formats() -> str:
    p = "p_value"
    ap = "adjusted_p_value"
    return f"""WITH {_run_stats_ctes()}
SELECT feature_group, feature,
  CASE WHEN {A}_mean IS NULL OR isnan({A}_mean) THEN 'n/a' ELSE printf('%.2f', {A}_mean) END AS mean_a_text,
  CASE WHEN {p} IS NULL OR isnan({p}) THEN 'n/a' WHEN {p} = 0 THEN '0.0' WHEN {p} < 0.001 THEN printf('%.1e', {p}) ELSE printf('%.3f', {p}) END AS p_compact,
  CASE WHEN {ap} IS NULL OR isnan({ap}) THEN 'p = n/a' WHEN {ap} < 0.001 THEN 'p = ' || printf('%.1e', {ap}) ELSE 'p = ' || printf('%.3f', {ap}) END AS p_text,
  {_stars(ap)} AS stars, {_stars(p, '')} AS stars_plain,
  CASE WHEN test = 'mann_whitney_u' THEN 'Mann-Whitney U significance' ELSE 'adjusted significance' END AS test_label
FROM stats"""


ORACLE = {
    "clean_text": sql_clean_text,
    "text_metrics": sql_text_metrics,
    "parse_model_answer": sql_parse_model_answer,
    "normalize_sources": sql_normalize_sources,
    "harmonize_labels": sql_harmonize_labels,
    "domain_assign": sql_domain_assign,
    "drop_credible": sql_drop_credible,
    "dedupe_keep_first": sql_dedupe_keep_first,
    "preprocess_corpus": sql_preprocess_corpus,
    "corpus_from_sources": sql_corpus_from_sources,
    "value_counts": sql_value_counts,
    "lang_detect": sql_lang_detect,
    "lang_accuracy": sql_lang_accuracy,
    "lemmatize": sql_lemmatize,
    "sentiment": sql_sentiment,
    "emotion": sql_emotion,
    "rhetoric": sql_rhetoric,
    "tfidf_weights": sql_tfidf_weights,
    "top_terms": sql_top_terms,
    "term_context": sql_term_context,
    "term_examples": sql_term_examples,
    "mwu_features": sql_mwu_features,
    "mwu_lineitem": sql_mwu_lineitem,
    "chi2_labels": sql_chi2_labels,
    "dominant_emotion_test": sql_dominant_emotion_test,
    "dominant_shares": sql_dominant_shares,
    "run_stats": sql_run_stats,
    "top_findings": sql_top_findings,
    "bh_adjust": sql_bh_adjust,
    "holm_adjust": sql_holm_adjust,
    "rhetoric_tests": sql_rhetoric_tests,
    "bootstrap_ci": sql_bootstrap_ci,
    "share_frame": sql_share_frame,
    "box_frame": sql_box_frame,
    "summary_counts": sql_summary_counts,
    "term_payload": sql_term_payload,
    "incremental_scores": sql_incremental_scores,
    "domain_store": sql_domain_store,
    "bootstrap_small": sql_bootstrap_small,
    "key_findings": sql_key_findings,
    "domain_summary": sql_domain_summary,
    "source_counts": sql_source_counts,
    "box_summary": sql_box_summary,
    "sentiment_means": sql_sentiment_means,
    "emotion_means": sql_emotion_means,
    "report_formats": sql_report_formats,
    "sentiment_frame": sql_sentiment_frame,
    "top15_frame": sql_top15_frame,
    "context_frame": sql_context_frame,
    "rhetoric_frame": sql_rhetoric_frame,
    "direction_summary": sql_direction_summary,
}


def all_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}
