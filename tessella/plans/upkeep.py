"""Entries and their documents, cache entries and their sources, facts, and what is stale, expired or complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import upkeep
from tessella.sources.tables import table

from .pairs import Family
from .policies import NOW

FAMILY = Family()
ADD = FAMILY.add


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    entries = docs.select(F.col("doc_id").alias("place"), name(F.col("doc_id") * 7 % 1009).alias("entry"))
    chunks = docs.where("doc_id % 3 <> 0").select(name(F.col("doc_id")).alias("entry"), (F.col("doc_id") % 400).alias("document"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 300).alias("parent"), F.col("text"))
    documents = pages.select(F.col("page_id").alias("document"), F.when(F.col("page_id") % 4 == 0, name(F.col("page_id") * 3)).alias("entry"))
    parents = pages.select(F.col("page_id").alias("parent"), F.col("url").alias("parent_text"))
    return upkeep.hydrated(entries, chunks, documents, parents).select("place", "entry", "document", F.md5("parent_text").alias("digest"), "via")


ADD("entries_hydrated", _entries, """WITH e AS (SELECT doc_id AS place, 'e' || doc_id * 7 % 1009 AS entry FROM documents), c AS (SELECT 'e' || doc_id AS entry, doc_id % 400 AS document, CASE WHEN doc_id % 2 = 0 THEN doc_id % 300 END AS parent, text FROM documents WHERE doc_id % 3 <> 0),
f AS (SELECT c.entry, c.document, CASE WHEN c.parent IS NOT NULL THEN p.url ELSE c.text END AS parent_text FROM c JOIN pages d ON d.page_id = c.document LEFT JOIN pages p ON p.page_id = c.parent), w AS (SELECT 'e' || page_id * 3 AS entry, page_id AS document FROM pages WHERE page_id % 4 = 0)
SELECT place, e.entry, coalesce(f.document, w.document) AS document, md5(f.parent_text) AS digest, CASE WHEN f.document IS NOT NULL THEN 'chunk' WHEN w.document IS NOT NULL THEN 'entry' END AS via FROM e LEFT JOIN f USING (entry) LEFT JOIN w ON w.entry = e.entry""")  # fmt: skip


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cache entries whose lines are their sources."""
    versions = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("document"), F.concat(F.lit("h"), F.when(F.col("l_orderkey") % 9 == 0, "x").otherwise(""), F.col("l_partkey").cast("string")).alias("hash"))))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(versions.alias("v"))
    listed = F.when(F.col("o_orderkey") % 13 != 0, F.transform("v", lambda x: F.struct(x["document"].alias("document"), x["hash"].alias("hash"))))
    entries = table(spark, folder, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("entry"), F.coalesce(F.size("v"), F.lit(0)).alias("sources"), listed.alias("versions"))
    entries = entries.withColumn("sources", F.greatest("sources", F.lit(0)))
    part = table(spark, folder, "part").where("p_partkey % 41 <> 0")
    current = part.select(F.col("p_partkey").alias("document"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("hash"), (F.col("p_partkey") % 31 == 0).alias("stale"), F.when(F.col("p_partkey") % 37 == 0, "archived").when(F.col("p_partkey") % 2 == 0, "active").alias("lifecycle"))
    return upkeep.source_invalidation(entries, current)


ADD("cache_invalidations", _cache, """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 'SOURCE_DOCUMENT_MISSING' WHEN l_orderkey % 9 = 0 THEN 'SOURCE_DOCUMENT_CHANGED' WHEN l_partkey % 31 = 0 THEN 'SOURCE_DOCUMENT_STALE' WHEN l_partkey % 37 = 0 THEN 'SOURCE_DOCUMENT_RETIRED' END AS reason
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 41 <> 0), f AS (SELECT l_orderkey, count(*) AS n, arg_min(reason, {'n': l_linenumber, 'p': l_partkey}) FILTER (reason IS NOT NULL) AS reason FROM l GROUP BY l_orderkey)
SELECT o_orderkey AS entry, CASE WHEN n > 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 'SOURCE_VERSIONS_UNKNOWN' ELSE reason END END AS reason FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")  # fmt: skip


def _conflicts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("fee_amount", "percentage", "other"))), (F.col("p_size") % 3).cast("int"))
    price = F.floor(F.col("p_retailprice") / 100).cast("string")
    raw = F.when(kind == "fee_amount", F.concat(F.lit("Rs. "), price)).when(kind == "percentage", F.concat((F.col("p_size") % 4).cast("string"), F.lit(" %"))).otherwise(F.concat(F.lit(" "), "p_type"))
    session = F.when(F.col("p_partkey") % 4 == 0, "2024").when(F.col("p_partkey") % 4 == 1, "2025").when(F.col("p_partkey") % 4 == 2, "")
    return upkeep.fact_conflicts(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), kind.alias("kind"), raw.alias("raw"), session.alias("session")))


ADD("fact_conflict_classes", _conflicts, """WITH f AS (SELECT p_partkey AS id, lower(p_brand) AS subject, p_size % 3 AS kind, CASE p_partkey % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2025' END AS session,
  CASE p_size % 3 WHEN 0 THEN CAST(floor(p_retailprice / 100) AS BIGINT)::VARCHAR WHEN 1 THEN printf('%.2f', (p_size % 4) / 100) ELSE trim(p_type) END AS value FROM part), c AS (SELECT subject, kind, session, value, min(id) AS id, count(*) AS n FROM f GROUP BY ALL)
SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, CASE WHEN coalesce(a.session <> b.session, false) THEN 'SESSION_DIFFERENCE' ELSE 'UNRESOLVED_CRITICAL_CONFLICT' END AS conflict FROM c a JOIN c b ON a.subject = b.subject AND a.kind = b.kind AND a.id < b.id AND (coalesce(a.session <> b.session, false) OR a.value <> b.value)""")  # fmt: skip

_status = lambda c: F.get(F.array(*map(F.lit, ("active", "indexed", "processing", "failed", "stale", "pending_embed"))), (c % 6).cast("int"))
_status_sql = "(['active', 'indexed', 'processing', 'failed', 'stale', 'pending_embed'])[doc_id % 6 + 1]"
ADD("session_marks", lambda s, f: table(s, f, "documents").select("doc_id", _status(F.col("doc_id")).alias("was"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))).alias("own")).select("doc_id", upkeep.session_status("s3", F.col("own"), F.col("was")).alias("status"), upkeep.purged(upkeep.session_status("s3", F.col("own"), F.col("was")), F.col("doc_id") % 7 == 0).alias("purged")),
    f"""WITH d AS (SELECT doc_id, {_status_sql} AS was, doc_id % 5 <> 0 AND doc_id % 4 = 3 AS same FROM documents), n AS (SELECT *, CASE WHEN was IN ('active', 'pending_embed', 'processing', 'indexed') AND NOT same THEN 'stale' ELSE was END AS status FROM d)
SELECT doc_id, status, status = 'stale' OR (status IN ('indexed', 'active') AND doc_id % 7 = 0) AS purged FROM n""")  # fmt: skip


def _expired(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("failure", "job", "thread", "cache", "other"))), (F.col("event_id") % 5).cast("int"))
    status = F.get(F.array(*map(F.lit, ("resolved", "pending", "abandoned", "completed", "failed"))), (F.floor(F.col("event_id") / 5) % 5).cast("int"))
    at = NOW - (F.col("event_id") % 240) * upkeep.DAY_MS
    gone = upkeep.expired(kind, status, at, at + 90 * upkeep.DAY_MS, NOW)
    return table(spark, folder, "events").groupBy(kind.alias("kind"), status.alias("status")).agg(F.count("*").alias("n"), F.sum(gone.cast("long")).alias("expired"))


ADD("records_expired", _expired, """WITH e AS (SELECT (['failure', 'job', 'thread', 'cache', 'other'])[event_id % 5 + 1] AS kind, (['resolved', 'pending', 'abandoned', 'completed', 'failed'])[event_id // 5 % 5 + 1] AS status, event_id % 240 AS age FROM events)
SELECT kind, status, count(*) AS n, count(*) FILTER (CASE kind WHEN 'failure' THEN status IN ('resolved', 'abandoned') AND age > 7 WHEN 'job' THEN status IN ('completed', 'failed') AND age > 30 WHEN 'thread' THEN age > 180 WHEN 'cache' THEN age >= 90 ELSE false END) AS expired FROM e GROUP BY ALL""")  # fmt: skip
ADD("coverage_verdicts", lambda s, f: table(s, f, "orders").select("o_orderkey", upkeep.coverage_complete(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 3 == 0), F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus") == "F").alias("complete")),
    "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderstatus = 'F' AS complete FROM orders")
