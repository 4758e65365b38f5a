"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), r AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM r
"""

OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

OP5 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
        ELSE list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), r(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), l AS (
    SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9 = """
WITH RECURSIVE n AS (
    SELECT source, CAST(count(*) AS DOUBLE) AS n, pow(CAST(count(*) AS DOUBLE), 0.7) AS target FROM documents GROUP BY source
), r AS (
    SELECT source, target / (SELECT sum(target) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n
), m AS (
    SELECT source, rate, CAST(greatest(1, ceil(rate / 200)) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / 200)) AS mean FROM r
), c AS (
    SELECT source, rate, draws, mean, 0 AS i, exp(-mean) AS term, exp(-mean) AS cum FROM m
    UNION ALL
    SELECT source, rate, draws, mean, i + 1, term * mean / (i + 1), cum + term * mean / (i + 1) FROM c WHERE i < ceil(mean + 12 * sqrt(mean) + 20)
), t AS (
    SELECT source, rate, draws, list(cum ORDER BY i) AS cdf FROM c GROUP BY source, rate, draws
), d AS (
    SELECT *, md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, '-'))) AS h FROM documents
), u AS (
    SELECT d.*, t.rate, t.cdf, list_transform(list_transform(range(t.draws), lambda j: CASE WHEN j = 0 THEN h ELSE md5(concat_ws('|', 'draw', h, CAST(j AS VARCHAR))) END),
           lambda x: CAST('0x' || substr(x, 1, 13) AS BIGINT) / 4503599627370496.0) AS us
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
    SELECT doc_id, text, lang, source, n_chars, rate, CAST(list_sum(list_transform(us, lambda x: len(list_filter(cdf, lambda q: q <= x)))) AS BIGINT) AS copies FROM u
)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, CAST(unnest(range(copies)) AS INTEGER) AS mix_copy,
       md5(concat_ws('|', 'order17', CAST(doc_id AS VARCHAR), CAST(unnest(range(copies)) AS VARCHAR), md5(coalesce(text, '-')))) AS mix_order
FROM k
"""

ORACLE = {"op1_warc_revisit": OP1, "op3_exact_topk": OP3, "op5_minhash_neardup": OP5, "op9_poisson_mixing": OP9}
