"""SQL of the queries that SQL can express, each over the whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
            FROM ok q JOIN ok r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
            FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared WHERE 100 * o >= 80 * (nx + ny - o)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, to_id) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.to_id = b.x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
        FROM sets s JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
    """,
    "op8_chat": """
        WITH t AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(text)) AS place FROM t),
        convs AS (
            SELECT conv_id, count(*) AS n_turns, list(sha256(concat(length(role), '|', role, '|', text)) ORDER BY place) AS names,
                string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' ORDER BY place) || '<|end|>' AS text
            FROM n GROUP BY conv_id),
        prefixes AS (SELECT DISTINCT list_slice(names, 1, k) AS p FROM (SELECT names, unnest(range(1, n_turns)) AS k FROM convs)),
        kept AS (
            SELECT names, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM convs
            WHERE names NOT IN (SELECT p FROM prefixes) GROUP BY names),
        parts AS (SELECT conv_id, list_slice(names, 1, k) AS p FROM (SELECT conv_id, names, unnest(range(1, len(names))) AS k FROM kept)),
        seen AS (SELECT parts.conv_id, count(*) AS n FROM parts JOIN convs ON convs.names = p GROUP BY 1)
        SELECT c.conv_id, c.n_turns, k.n_collapsed, coalesce(s.n, 0) AS n_snapshots, c.text FROM kept k JOIN convs c USING (conv_id) LEFT JOIN seen s ON s.conv_id = k.conv_id
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        f1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM words) GROUP BY ALL HAVING count(*) >= 10),
        f2 AS (SELECT lang, p[1] AS x, p[2] AS y, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM words) GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, p[1] AS x, p[2] AS y, p[3] AS z, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS p FROM words) GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (
            SELECT f2.lang, x || ' ' || y AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.p = x JOIN f1 r ON r.lang = f2.lang AND r.p = y
            WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f AND (f3.x = f2.x AND f3.y = f2.y OR f3.y = f2.x AND f3.z = f2.y))
            UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.p = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = z
            UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.p = z),
        scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
