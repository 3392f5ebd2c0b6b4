"""Policies over documents whose crawl state is derived from their ids."""

from __future__ import annotations

from tessella.functions import policy

from .pairs import Family

FAMILY = Family()
NOW = 1_785_196_800_000
STATE = f"""SELECT doc_id, text, lang, source,
  CASE doc_id % 7 WHEN 0 THEN 'indexed' WHEN 1 THEN 'active' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'stale' WHEN 5 THEN 'failed' ELSE 'active' END AS status,
  CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS tier,
  doc_id % 11 = 0 AS stale,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {NOW} - (doc_id % 200) * {policy.DAY_MS} END AS crawled,
  CASE doc_id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' ELSE '' END AS lifecycle,
  CASE doc_id % 9 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'clean' END AS security,
  doc_id % 6 AS chunks, (doc_id % 6) - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS embedded
FROM {{documents}}"""
_fresh = policy.freshness("status", "stale", "crawled", "tier", NOW)

FAMILY.sql("freshness_policy", f"WITH s AS ({STATE}) SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in _fresh.items()) + f", {policy.eligible('status')} AS status_eligible FROM s")
FAMILY.sql("freshness_rollup", f"WITH s AS ({STATE}), f AS (SELECT lang, status, {_fresh['state']} AS state FROM s) SELECT lang, count(*) AS n, sum(CASE WHEN state = 'aged' OR status = 'stale' THEN 1 ELSE 0 END) AS stale_n, round(100e0 * sum(CASE WHEN state = 'aged' OR status = 'stale' THEN 1 ELSE 0 END) / count(*), 1) AS stale_pct FROM f GROUP BY lang")
FAMILY.sql("stale_penalty", f"WITH s AS ({STATE}) SELECT doc_id, round((1e0 / (1 + doc_id % 10)) * CASE WHEN {_fresh['penalized']} THEN {policy.STALE_FACTOR}e0 ELSE 1e0 END, 6) AS score FROM s WHERE NOT {policy.excluded('status')}")
FAMILY.sql("candidate_limits", f"SELECT event_id, {policy.candidate_limit('value')} AS candidates FROM {{events}}")
FAMILY.sql("query_risk", f"SELECT conv_id, turn, {policy.query_risk('text')} AS risk FROM {{conversations}}")
_pad = "concat(' ', regexp_replace(lower(text), '[^a-z\\\\s]', ' '), ' ')"
_hits = ", ".join(f"{policy.intent_hits('p', i)} AS h{k}" for k, i in enumerate(policy.INTENTS))
_best = " ".join(f"WHEN h{k} = greatest(h0, h1, h2, h3) THEN '{i}'" for k, i in enumerate(policy.INTENTS))
_intent = f"WITH t AS (SELECT conv_id, turn, {_pad} AS p FROM {{conversations}}), h AS (SELECT conv_id, turn, {_hits} FROM t) SELECT conv_id, turn, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN NULL {_best} END AS intent FROM h"
FAMILY.sql("query_intent", _intent, _intent.replace("'[^a-z\\\\s]', ' ')", "'[^a-z\\s]', ' ', 'g')"))
_d, _r = policy.gate("risk", "temporal", "n", "conflict", "fresh_primary", "current", "aged", "fresh")
FAMILY.sql("evidence_gate", f"""WITH s AS ({STATE}), c AS (
  SELECT doc_id % 97 AS q, {_fresh['state']} AS state, {_fresh['applicability']} AS applies, CASE WHEN doc_id % 3 = 0 THEN 'official_primary' ELSE 'secondary' END AS authority, doc_id % 151 = 0 AS has_conflict FROM s WHERE NOT {policy.excluded('status')}
), n AS (
  SELECT q, CASE WHEN q % 2 = 0 THEN 'high_current' ELSE 'low' END AS risk, CASE WHEN q % 5 = 0 THEN 'historical' ELSE 'current' END AS temporal, count(*) AS n,
    sum(CASE WHEN state = 'fresh' THEN 1 ELSE 0 END) AS fresh, sum(CASE WHEN state = 'fresh' AND authority = 'official_primary' THEN 1 ELSE 0 END) AS fresh_primary,
    sum(CASE WHEN state = 'aged' THEN 1 ELSE 0 END) AS aged, sum(CASE WHEN state = 'unknown' THEN 1 ELSE 0 END) AS unknown_n, bool_or(has_conflict) AS conflict, bool_or(applies IN ('current', 'timeless')) AS current FROM c GROUP BY q
) SELECT q, n, fresh, fresh_primary, aged, unknown_n, {_d} AS decision, {_r} AS reason FROM n""")
FAMILY.sql("abstain_on_stale", f"WITH s AS ({STATE}), f AS (SELECT doc_id % 53 AS q, {_fresh['state']} AS state FROM s) SELECT q, q % 3 = 0 AND NOT bool_or(state = 'fresh') AND bool_and(state <> 'fresh') AS abstain FROM f GROUP BY q")
FAMILY.sql("document_invariant", f"WITH s AS ({STATE}) SELECT doc_id, {policy.document_violation('status', 'lifecycle', 'security', 'chunks', 'embedded')} AS violation FROM s")
FAMILY.sql("ingestion_invariant", f"SELECT o_orderkey, {policy.ingestion_violation('o_orderkey % 5', 'o_orderkey % 5 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END', 'o_orderkey % 5 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END', 'CASE WHEN o_orderkey % 23 = 0 THEN 1024 ELSE 768 END', 'o_orderkey % 3', 'o_orderkey % 3 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END')} AS violation FROM {{orders}}")
FAMILY.sql("cache_invariant", f"SELECT o_orderkey, {policy.cache_violation('o_orderkey * 1000', 'o_orderstatus', "''", 'o_orderpriority', 'o_orderkey % 7 = 0', 5_000_000, 'O', 'e1', '1-URGENT')} AS violation FROM {{orders}}")
FAMILY.sql("high_current_invariant", f"SELECT o_orderkey, {policy.high_current_violation('o_orderkey % 3', 'CASE WHEN o_orderkey % 4 = 0 THEN \'x\' ELSE \'current\' END', 'o_orderkey % 11 = 0', '(o_orderkey % 13 <> 0)')} AS violation FROM {{orders}}")
FAMILY.sql(
    "vector_invariant",
    "SELECT vec_id, size(embedding) = 64 AS sized, forall(embedding, x -> NOT isnan(x)) AS finite, sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) BETWEEN 0.999 AND 1.001 AS unit FROM {embeddings}",
    "SELECT vec_id, len(embedding) = 64 AS sized, len(list_filter(embedding, lambda x: isnan(x))) = 0 AS finite, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) BETWEEN 0.999 AND 1.001 AS unit FROM embeddings",
)
FAMILY.sql("cache_tiers", f"WITH s AS ({STATE}) SELECT doc_id, {policy.cache_tier_hours('tier')} AS hours FROM s")
FAMILY.sql("faq_expiry", f"WITH s AS ({STATE}) SELECT doc_id FROM s WHERE crawled IS NULL OR crawled > {NOW - 30 * policy.DAY_MS}")
FAMILY.sql("governance_sweep", f"WITH s AS ({STATE}) SELECT doc_id, {NOW} - crawled > {policy.ttl_ms("coalesce(tier, 'medium')")} AS stale_now FROM s WHERE crawled IS NOT NULL AND coalesce(status, 'x') IN ('active', 'indexed')")
