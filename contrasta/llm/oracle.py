"""DuckDB SQL for the queries whose whole result SQL can state."""

#: Scores all documents: terms, document counts and sizes by grouping, no signatures.
LEXICAL_SEARCH = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents WHERE text IS NOT NULL),
item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
norms AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // words AS m FROM sizes, totals),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counts, totals GROUP BY term, docs),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id)
    GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: All pairs that share a shingle are counted; components by recursion.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(a.n) AND count(*) = any_value(b.n) AS same
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM links WHERE same GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, least(doc_id, coalesce(class_id, doc_id)) AS class_id
FROM sets JOIN components USING (doc_id) LEFT JOIN classes USING (doc_id)
"""



def vector_codes(rounds: int = 4) -> str:
    """All distances of every part to every entry, round by round; doubles are exact for these integers."""
    def nearest(k: int) -> str:
        return f"""near{k} AS (
    SELECT p, vec_id, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS best
    FROM parts JOIN book{k} USING (p) GROUP BY p, vec_id)"""

    def means(k: int) -> str:
        return f"""sums{k} AS (
    SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT p, n.best.e AS e, x, unnest(range(1, 17)) AS i FROM near{k - 1} n JOIN parts USING (p, vec_id))
    GROUP BY p, e, i),
book{k} AS (
    SELECT b.p, b.e, coalesce(s.c, b.c) AS c
    FROM book{k - 1} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM sums{k} GROUP BY p, e) s USING (p, e))"""

    steps = ",\n".join([nearest(0), *(x for k in range(1, rounds + 1) for x in (means(k), nearest(k)))])
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * 16 + 1:p * 16 + 16] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
    FROM parts JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id)),
{steps},
digest AS (
    SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(c) AS x, unnest(range(1, 17)) AS i FROM book{rounds})),
coded AS (
    SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE: dict[str, str] = {"op10_ngram_join": NGRAM_JOIN, "op11_lexical_search": LEXICAL_SEARCH, "op13_vector_codes": vector_codes()}
