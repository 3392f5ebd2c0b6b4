"""DuckDB statements for the operators that SQL can express."""

from . import chat, licenses

ORACLE: dict[str, str] = {"op2_licenses": licenses.oracle(), "op5_chat": chat.ORACLE}

ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""

ORACLE["op10_minhash"] = """
WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM lowered
), sizes AS (
  SELECT doc_id, len(s)::BIGINT AS n FROM sets
), items AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ l JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * l.n >= 80 * (p.n + q.n - l.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sizes JOIN reach ON a = doc_id GROUP BY doc_id, n
"""

ORACLE["op9_decontamination"] = """
WITH rows_ AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), lowered AS (
  SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM rows_
), items AS (
  SELECT side, id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS x FROM lowered
), sizes AS (
  SELECT id, count(*) AS n FROM items WHERE side = 1 GROUP BY id
), both_ AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM items d JOIN items i ON d.x = i.x AND d.side = 0 AND i.side = 1 GROUP BY ALL
)
SELECT doc_id, item_id, n AS item_shingles, shared, shared / n AS containment FROM both_ JOIN sizes ON item_id = sizes.id WHERE 100 * shared >= 80 * n
"""

# The checksum of a decimal number: each byte, then eight steps of one bit (marked -1).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

ORACLE["op11_trie"] = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT *, {_CRC32} % 9 AS h FROM own
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), rows_ AS (
  SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)
), groups AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM rows_ GROUP BY path
), placed AS (
  SELECT g.*, p.conv_id AS parent_conv_id FROM groups g LEFT JOIN groups p ON g.depth > 0 AND p.depth = g.depth - 1 AND p.path = g.path[1:g.depth - 1]
), counted AS (
  SELECT p.*, (SELECT count(*) FROM placed c WHERE c.parent_conv_id = p.conv_id AND c.depth = p.depth + 1) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].text) ELSE 0 END AS saved FROM placed p
), above AS (
  SELECT conv_id, depth, path[1:unnest(range(0, depth + 1))] AS top, n_children, saved FROM counted
), sums AS (
  SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY top
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM counted JOIN sums ON path = top
"""

ORACLE["op12_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), totals AS (
  SELECT count(*) FILTER (len(t) > 0) AS total, sum(len(t))::BIGINT AS length FROM d
), tf AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), scored AS (
  SELECT doc_id, term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))) AS s FROM tf JOIN df USING (term), totals
), q AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), summed AS (
  SELECT item_id, doc_id, sum(q * s)::BIGINT AS score FROM q JOIN scored USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM summed WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLE["op13_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), usable AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT a AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN counts USING (a) GROUP BY a
"""
