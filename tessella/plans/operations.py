"""Ingest, cache, ledger, rollup and monitoring queries.

Snapshots, ledgers and counters are derived from the data tables by fixed
rules: an event type stands for a crawl state, an event's user for a URL, a
document's id for what became of it.
"""

from __future__ import annotations

from .pairs import Family

FAMILY = Family()
# Ledger states.
TERMINAL = ("ingested", "dry_run_ready", "skipped_short", "skipped_duplicate", "skipped_robots", "skipped_unsupported", "failed_fetch_terminal", "failed_extract")
SUCCESS = ("ingested", "dry_run_ready", "skipped_short", "skipped_duplicate")
KNOWN = (*TERMINAL, "discovered", "fetching", "failed_fetch_retryable", "failed_push", "skipped_depth")


def _list(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_state = "CASE event_id % 12 WHEN 0 THEN 'ingested' WHEN 1 THEN 'skipped_short' WHEN 2 THEN 'skipped_duplicate' WHEN 3 THEN 'skipped_robots' WHEN 4 THEN 'failed_fetch_terminal' WHEN 5 THEN 'failed_extract' WHEN 6 THEN 'discovered' WHEN 7 THEN 'fetching' WHEN 8 THEN 'failed_push' WHEN 9 THEN 'skipped_depth' WHEN 10 THEN 'failed_push_terminal' ELSE 'ingested' END"
LEDGER = f"SELECT user_id % 7 AS run_id, event_id, user_id, {_state} AS state, value, ts, event_type FROM {{events}}"
S = FAMILY.sql
S("ledger_states", f"WITH l AS ({LEDGER}) SELECT run_id, state, count(*) AS n FROM l GROUP BY run_id, state")
S("ledger_coverage", f"""WITH l AS ({LEDGER}) SELECT run_id, count(*) AS n, sum(CASE WHEN state IN {_list(TERMINAL)} THEN 0 ELSE 1 END) AS incomplete, sum(CASE WHEN state IN {_list(SUCCESS)} THEN 1 ELSE 0 END) AS success,
  sum(CASE WHEN state IN {_list(TERMINAL)} AND state NOT IN {_list(SUCCESS)} THEN 1 ELSE 0 END) AS gaps, sum(CASE WHEN state IN {_list(KNOWN)} THEN 0 ELSE 1 END) AS unknown_n, bool_and(state IN {_list(TERMINAL)}) AS complete FROM l GROUP BY run_id""")
S("ledger_last_state", f"WITH l AS ({LEDGER}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS attempts FROM l) SELECT user_id, state, attempts FROM r WHERE k = 1")
S("ledger_families", f"WITH l AS ({LEDGER}) SELECT event_type AS family, count(*) AS n, sum(CASE WHEN state = 'ingested' AND value > 50 THEN 1 ELSE 0 END) AS ok FROM l GROUP BY event_type")
S("discovery_edges", "WITH e AS (SELECT user_id % 100 AS child, user_id % 13 AS parent, event_id % 5 AS depth, event_id FROM {events}) SELECT child, parent, min(depth) AS min_depth, count(*) AS seen, min(event_id) AS first_event FROM e GROUP BY child, parent")
S("frontier_order", "WITH f AS (SELECT page_id, page_id % 4 AS depth, page_id % 17 AS score FROM {pages}) SELECT page_id, row_number() OVER (PARTITION BY depth ORDER BY score DESC, page_id) AS place, depth FROM f")
_old = "SELECT doc_id AS doc, concat('k', CAST(doc_id % 50 AS STRING), '-', CAST(doc_id AS STRING)) AS chunk_key, sha2(text, 256) AS hash FROM {documents} WHERE doc_id % 10 <> 1"
_new = "SELECT doc_id AS doc, concat('k', CAST(doc_id % 50 AS STRING), '-', CAST(doc_id AS STRING)) AS chunk_key, sha2(CASE WHEN doc_id % 10 = 2 THEN concat(text, '!') ELSE text END, 256) AS hash FROM {documents} WHERE doc_id % 10 <> 0"
_duck = lambda text: text.replace("sha2(", "sha256(").replace(", 256)", ")")
S("chunk_diff", f"WITH o AS ({_old}), n AS ({_new}) SELECT coalesce(n.doc, o.doc) AS doc, coalesce(n.chunk_key, o.chunk_key) AS chunk_key, CASE WHEN o.doc IS NULL THEN 'new' WHEN n.doc IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL OUTER JOIN n ON o.doc = n.doc AND o.chunk_key = n.chunk_key", _duck(f"WITH o AS ({_old}), n AS ({_new}) SELECT coalesce(n.doc, o.doc) AS doc, coalesce(n.chunk_key, o.chunk_key) AS chunk_key, CASE WHEN o.doc IS NULL THEN 'new' WHEN n.doc IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL OUTER JOIN n ON o.doc = n.doc AND o.chunk_key = n.chunk_key"))
S("stale_parents", f"WITH o AS ({_old}), n AS ({_new}) SELECT o.doc, o.hash FROM o LEFT ANTI JOIN n ON o.doc = n.doc AND o.hash = n.hash", _duck(f"WITH o AS ({_old}), n AS ({_new}) SELECT o.doc, o.hash FROM o ANTI JOIN n ON o.doc = n.doc AND o.hash = n.hash"))
S("upsert_generations", f"WITH o AS ({_old}), n AS ({_new}) SELECT n.doc, CASE WHEN o.doc IS NULL THEN 1 WHEN o.hash = n.hash THEN 1 ELSE 2 END AS generation, coalesce(o.hash = n.hash, false) AS fast_path FROM n LEFT JOIN o ON o.doc = n.doc", _duck(f"WITH o AS ({_old}), n AS ({_new}) SELECT n.doc, CASE WHEN o.doc IS NULL THEN 1 WHEN o.hash = n.hash THEN 1 ELSE 2 END AS generation, coalesce(o.hash = n.hash, false) AS fast_path FROM n LEFT JOIN o ON o.doc = n.doc"))
S("generation_fence", "WITH c AS (SELECT o_custkey AS doc, o_orderkey % 4 AS generation, o_orderkey FROM {orders}), m AS (SELECT *, max(generation) OVER (PARTITION BY doc) AS latest FROM c) SELECT doc, generation, count(*) AS kept FROM m WHERE generation = latest GROUP BY doc, generation")
S("completion_contract", "SELECT o.o_orderkey, count(l.l_linenumber) AS stored, o.o_orderkey % 7 + 1 AS expected, count(l.l_linenumber) = o.o_orderkey % 7 + 1 AS complete FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
S("failure_verdict", "WITH c AS (SELECT l_orderkey AS doc, count(*) AS chunks, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END) AS embedded FROM {lineitem} GROUP BY l_orderkey) SELECT doc, CASE WHEN chunks = 1 AND failed > 0 THEN 'failed' WHEN failed + embedded >= chunks THEN CASE WHEN embedded = 0 THEN 'failed' ELSE 'indexed' END ELSE 'processing' END AS verdict FROM c")
S("distinct_failed", "SELECT l_suppkey, count(DISTINCT CASE WHEN l_partkey % 9 <> 0 THEN l_partkey END) + sum(CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) AS failed FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey")
S("dead_letters", "WITH f AS (SELECT user_id, count(*) AS failures, max(ts) AS last_at FROM {events} WHERE event_type = 'error' OR event_id % 9 = 0 GROUP BY user_id) SELECT user_id, failures, CASE WHEN failures >= 2 THEN 'abandoned' ELSE 'pending' END AS status FROM f")
S("hydrate_chunks", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_name FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE l.l_quantity > 45")
S("hydrate_fallback", "SELECT b.item_id, coalesce(d.text, e.text) AS text, CASE WHEN d.doc_id IS NULL THEN 'entry' ELSE 'chunk' END AS via FROM {benchmark} b LEFT JOIN {documents} d ON d.doc_id = b.item_id AND d.doc_id % 2 = 0 LEFT JOIN {documents} e ON e.doc_id = b.item_id + 1")
S("orphans", "SELECT e.vec_id FROM {embeddings} e LEFT ANTI JOIN {documents} d ON d.doc_id = e.vec_id * 3", "SELECT e.vec_id FROM embeddings e ANTI JOIN documents d ON d.doc_id = e.vec_id * 3")
S("reconcile_vectors", "WITH v AS (SELECT vec_id, vec_id % 6 AS s FROM {embeddings}), t AS (SELECT doc_id, doc_id % 5 AS status FROM {documents} WHERE doc_id % 2 = 0) SELECT CASE WHEN t.doc_id IS NULL THEN 'untracked' ELSE 'tracked' END AS tracking, s, count(*) AS n FROM v LEFT JOIN t ON t.doc_id = v.vec_id GROUP BY 1, 2")
S("integrity_duplicates", "SELECT o_custkey AS doc, o_orderdate AS chunk_key, count(*) AS n FROM {orders} GROUP BY 1, 2 HAVING count(*) > 1")
S("integrity_collisions", "SELECT p_name AS chunk_key, count(DISTINCT p_brand) AS docs FROM {part} GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
S("store_stats_merge", "WITH a AS (SELECT count(*) AS docs, sum(n_chars) AS bytes FROM {documents}), b AS (SELECT count(*) AS docs, CAST(sum(page_id) AS BIGINT) AS bytes FROM {pages}) SELECT greatest(a.docs, b.docs) AS docs, CAST(a.bytes + b.bytes AS BIGINT) AS bytes FROM a CROSS JOIN b")
S("cache_source_state", """WITH snap AS (SELECT o_orderkey AS entry, o_custkey AS doc, o_orderkey % 3 AS at, concat('h', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE '' END) AS hash FROM {orders}),
 cur AS (SELECT c_custkey AS doc, concat('h', CAST(c_custkey AS STRING)) AS hash, c_custkey % 31 = 0 AS stale, CASE WHEN c_custkey % 37 = 0 THEN 'archived' ELSE 'active' END AS lifecycle FROM {customer} WHERE c_custkey % 41 <> 0)
 SELECT s.entry, CASE WHEN c.doc IS NULL THEN 'SOURCE_MISSING' WHEN c.hash <> s.hash THEN 'SOURCE_CHANGED' WHEN c.stale THEN 'SOURCE_STALE' WHEN c.lifecycle <> 'active' THEN 'SOURCE_INACTIVE' ELSE 'VALID' END AS state FROM snap s LEFT JOIN cur c ON c.doc = s.doc""")
S("cache_all_sources_exist", "WITH e AS (SELECT l_orderkey AS entry, l_partkey AS doc FROM {lineitem}), ok AS (SELECT e.entry, e.doc FROM e LEFT SEMI JOIN (SELECT p_partkey FROM {part} WHERE p_size <= 48) p ON p.p_partkey = e.doc) SELECT e.entry, count(*) AS sources, coalesce(max(k.n), 0) = count(*) AS valid FROM e LEFT JOIN (SELECT entry, count(*) AS n FROM ok GROUP BY entry) k ON k.entry = e.entry GROUP BY e.entry",
  "WITH e AS (SELECT l_orderkey AS entry, l_partkey AS doc FROM lineitem), ok AS (SELECT e.entry, e.doc FROM e SEMI JOIN (SELECT p_partkey FROM part WHERE p_size <= 48) p ON p.p_partkey = e.doc) SELECT e.entry, count(*) AS sources, coalesce(max(k.n), 0) = count(*) AS valid FROM e LEFT JOIN (SELECT entry, count(*) AS n FROM ok GROUP BY entry) k ON k.entry = e.entry GROUP BY e.entry")
S("turn_pairs", "WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM {conversations}) SELECT u.conv_id, u.k, u.turn AS user_turn, a.turn AS assistant_turn, length(u.text) AS q, length(a.text) AS r FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.k = u.k AND u.role = 'user' AND a.role = 'assistant'")
S("history_window", "WITH r AS (SELECT conv_id, turn, role, substring(text, 1, 1000) AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {conversations}) SELECT conv_id, turn, role, length(cut) AS kept FROM r WHERE k <= 6 AND trim(cut) <> ''")
S("latency_percentiles", "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, count(*) AS n FROM {events} GROUP BY event_type")
S("latency_ring", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE k <= 500 GROUP BY user_id")
S("metric_summary", "WITH m AS (SELECT user_id % 10 AS shard, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END) AS misses, sum(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) AS errors, count(*) AS queries FROM {events} GROUP BY 1) SELECT shard, round(hits / CAST(hits + misses AS DOUBLE), 3) AS hit_rate, errors / CAST(queries AS DOUBLE) > 0.1 AS error_alert, hits / CAST(hits + misses AS DOUBLE) < 0.3 AND hits + misses > 10 AS cache_alert FROM m")
S("daily_feedback", "SELECT CAST(CAST(date_trunc('DAY', ts) AS DATE) AS STRING) AS day, count(*) AS n, CAST(round(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) * 100e0 / count(*)) AS BIGINT) AS positive FROM {events} GROUP BY 1")
S("dashboard_rollup", "SELECT source, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS toxic, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS unlabelled FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY source")
S("status_counts", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
S("segment_counts", "SELECT count(*) AS n, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS building, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS machinery FROM {customer}")
S("failure_rates", "SELECT user_id % 20 AS task, sum(CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) > 0.05 AS alert FROM {events} GROUP BY 1")
S("retention", "SELECT event_type, count(*) AS expired FROM {events} WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY event_type")
S("session_purge", "SELECT user_id, count(*) AS marked FROM {events} WHERE event_id % 5 <> 3 GROUP BY user_id")
S("category_rollup", "SELECT lang, grouping(lang) AS total, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM {documents} GROUP BY GROUPING SETS ((lang), ())")
S("kill_switch", "SELECT d.doc_id, coalesce(c.enabled, true) AS enabled FROM {documents} d LEFT JOIN (SELECT item_id, item_id % 2 = 0 AS enabled FROM {benchmark}) c ON c.item_id = d.doc_id")
S("backfill_embedded", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 END, doc_id % 4, 0) AS chunks_embedded FROM {documents}")
S("trace_spans", "SELECT user_id, event_type AS name, count(*) AS spans, round(sum(value), 4) AS total_ms, round(max(value), 4) AS longest_ms FROM {events} GROUP BY user_id, event_type")
S("events_json", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM {events} GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
S("paged_titles", "WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents}) SELECT doc_id FROM t WHERE k <= 50 AND lang = 'en'")
_facts = """WITH f AS (SELECT p_partkey AS id, lower(p_name) AS subject, CASE p_size % 3 WHEN 0 THEN 'fee_amount' ELSE 'other' END AS kind, concat('PKR ', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)) AS raw, CASE WHEN p_partkey % 4 = 0 THEN '2024' WHEN p_partkey % 4 = 1 THEN '2025' END AS session FROM {part}),
 v AS (SELECT *, CASE WHEN kind = 'fee_amount' THEN replace(regexp_extract(raw, '(PKR|Rs)[.]? *([0-9,]+)', 2), ',', '') ELSE trim(raw) END AS val FROM f)"""
# Facts that have all in common but the id are compared once, as a class (of a range of ids, so that its list is bounded), and only the pairs that differ are spelled out.
# Two classes meet once, in their order, so each pair of rows is made once and put in the order of its ids.
# Spark holds what is made of one row of a scan or shuffle, or of one side of a join, until all of it is made: so pieces of classes have at most 512 ids, and their pairs are dealt out before they are spelled out.
# Each class is dealt one of sixteen parts as the first of a pair and stands in all of them as the second, so a frequent subject is many tasks' work.
S(
    "fact_conflicts",
    _facts.replace("concat(", "concat_ws('', ")  # DuckDB's concat passes over nulls
    + """, l AS (SELECT subject, kind, session, val, id DIV 4194304 AS span, collect_list(id) AS ids FROM v GROUP BY subject, kind, session, val, id DIV 4194304),
 c AS (SELECT subject, kind, session, val, span, piece, slice(ids, piece * 512 + 1, 512) AS ids FROM l LATERAL VIEW explode(sequence(0, CAST((size(ids) - 1) DIV 512 AS INT))) AS piece),
 x AS (SELECT *, struct(session, val, span, piece) AS place, pmod(xxhash64(session, val), 16) AS part FROM c), y AS (SELECT *, struct(session, val, span, piece) AS place, explode(sequence(0L, 15L)) AS part FROM c),
 p AS (SELECT /*+ MERGE(y), REPARTITION(ones, others) */ x.ids AS ones, y.ids AS others, CASE WHEN x.session <> y.session THEN 'SESSION_DIFFERENCE' ELSE 'UNRESOLVED_CRITICAL_CONFLICT' END AS conflict FROM x JOIN y ON x.subject = y.subject AND x.kind = y.kind AND x.part = y.part AND x.place < y.place WHERE coalesce(x.session <> y.session, false) OR x.val <> y.val)
 SELECT least(one, other) AS a, greatest(one, other) AS b, conflict FROM p LATERAL VIEW explode(ones) AS one LATERAL VIEW explode(others) AS other WHERE one <> other""",
    _facts
    + """
 SELECT a.id AS a, b.id AS b, CASE WHEN a.session <> b.session THEN 'SESSION_DIFFERENCE' ELSE 'UNRESOLVED_CRITICAL_CONFLICT' END AS conflict FROM v a JOIN v b ON a.subject = b.subject AND a.kind = b.kind AND a.id < b.id WHERE coalesce(a.session <> b.session, false) OR a.val <> b.val""",
)
_pattern = "'([0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9])'"
S("fact_values", f"SELECT doc_id, regexp_extract(text, '(PKR|Rs|Rupees)[.]? *([0-9,]+)', 2) AS currency, regexp_extract(text, '([0-9.]+) *%', 1) AS percent, regexp_extract(text, {_pattern}, 1) AS day FROM {{documents}}")
