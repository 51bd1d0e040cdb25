"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), grams AS (
    SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) AS r(k) GROUP BY doc_id
), m AS (
    SELECT d.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals,
           length(t) - length(translate(t, '!', '')) AS marks,
           len(regexp_extract_all(t, '(?:\.\.\.|…)[\x20\x09-\x0D]*(?:\n|\z)')) AS open_lines
    FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * marks > 3 * n_words OR 10 * capitals > 5 * word_chars
            OR (n_lines >= 10 AND 10 * open_lines > 3 * n_lines)) AS kept
FROM m
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(10)) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)
), reach AS (
    SELECT doc_id AS id, doc_id AS root FROM documents
    UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
)
SELECT id AS doc_id, min(root) AS class_id, (SELECT count(*) FROM links WHERE links.a = id) AS n_links, id = min(root) AS kept
FROM reach GROUP BY id
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS id, vec_id AS root FROM embeddings
    UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
)
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = id) AS n_links, min(root) AS component_id, id = min(root) AS kept
FROM reach GROUP BY id
"""

WARC_ZIP = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), h AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS holder FROM p
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM h
"""

PREFIX_TRIE = """
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)
), turns AS (
    SELECT conv_id, role, text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), sizes AS (
    SELECT conv_id, count(*) AS n FROM turns GROUP BY 1
), convs AS (
    SELECT s.conv_id, s.n, s.conv_id - s.conv_id % 5 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(CAST(s.conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(s.conv_id AS VARCHAR)[i]) AS BIGINT))),
        lambda c, b: xor(crc.t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) % 9 AS h
    FROM sizes AS s, crc
), starts AS (
    SELECT c.*, least(h, coalesce(b.n, 0)) AS m FROM convs AS c LEFT JOIN sizes AS b ON b.conv_id = base
), rebuilt AS (
    SELECT conv_id, pos - h + m AS pos, role, text FROM turns JOIN starts USING (conv_id) WHERE pos > h
    UNION ALL SELECT s.conv_id, pos, role, text FROM turns AS t JOIN starts AS s ON s.base = t.conv_id WHERE pos <= m
), prefixes AS (
    SELECT conv_id, pos AS depth, strlen(text) AS n_bytes, list(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS node
    FROM rebuilt UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM sizes
), nodes AS (
    SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(n_bytes) AS n_bytes FROM prefixes GROUP BY node
), childless AS (
    SELECT n.node, count(c.node) AS n_children FROM nodes AS n LEFT JOIN nodes AS c ON c.depth > 0 AND c.node[:-2] = n.node GROUP BY n.node
), ups AS (
    SELECT node[:k] AS node, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * n_bytes AS saved
    FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes JOIN childless USING (node))
), sums AS (
    SELECT node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM ups GROUP BY node
), lengths AS (
    SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY 1
), ends AS (
    SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM prefixes JOIN lengths USING (conv_id, depth) GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes AS n JOIN childless USING (node) JOIN sums USING (node) LEFT JOIN ends USING (node)
LEFT JOIN nodes AS p ON n.depth > 0 AND p.node = n.node[:-2]
"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLES = {
    "op13_hard_negatives": HARD_NEGATIVES,
    "op11_prefix_trie": PREFIX_TRIE,
    "op5_jaccard_join": JACCARD_JOIN,
    "op8_warc_zip": WARC_ZIP,
    "op10_vector_links": VECTOR_LINKS,
    "op4_quality_rules": QUALITY_RULES,
}
