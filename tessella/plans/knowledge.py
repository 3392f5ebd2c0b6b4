"""Store, source, screening and evaluation operators over snapshots derived from the data tables.

The queries call the operators on DataFrames; the DuckDB statements are
written on their own from the rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import calculators, guards
from tessella.operators import evaluation, store
from tessella.sources import corpus
from tessella.sources.checkpoints import shared_folder
from tessella.sources.tables import table

from .pairs import Family

FAMILY = Family()
ADD = FAMILY.add


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.concat(F.lit("doc://"), "doc_id").alias("canonical_url"), "doc_id", "text", "lang", "source", "n_chars")


def _present(spark: SparkSession, folder: str) -> DataFrame:
    """Nine of ten documents at generations 1 to 3."""
    return _documents(spark, folder).where("doc_id % 10 <> 1").select("canonical_url", F.col("source").alias("title"), F.sha2("text", 256).alias("content_hash"), F.lit("fp-1").alias("fingerprint"), F.col("lang").alias("category"), (F.col("doc_id") % 3 + 1).alias("generation"), F.lit("indexed").alias("status"), F.lit(100).cast("long").alias("crawled_at"))


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Four of five documents again, some edited and some with another fingerprint, every seventh twice."""
    rows = _documents(spark, folder).where("doc_id % 5 <> 0").select("canonical_url", F.col("source").alias("title"), F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.when(F.col("doc_id") % 10 == 3, "fp-2").otherwise("fp-1").alias("fingerprint"), F.col("lang").alias("category"), F.lit(200).cast("long").alias("crawled_at"), "doc_id")
    older = rows.where("doc_id % 7 = 0").withColumn("content_hash", F.lit("older")).withColumn("crawled_at", F.lit(150).cast("long"))
    return rows.union(older).drop("doc_id")


ADD("store_upsert_documents", lambda s, f: store.upsert_documents(_present(s, f), _incoming(s, f)).drop("title"), """
SELECT 'doc://' || doc_id AS canonical_url, CASE WHEN NOT came AND had THEN h0 WHEN came AND NOT same THEN h1 ELSE h0 END AS content_hash, CASE WHEN came AND NOT same THEN f1 ELSE 'fp-1' END AS fingerprint, lang AS category,
  (CASE WHEN NOT had THEN 1 WHEN came AND NOT same THEN doc_id % 3 + 2 ELSE doc_id % 3 + 1 END)::BIGINT AS generation, CASE WHEN had THEN 'indexed' ELSE 'active' END AS status, (CASE WHEN came AND NOT same THEN 200 ELSE 100 END)::BIGINT AS crawled_at, CASE WHEN came THEN same END AS fast_path
FROM (SELECT *, had AND came AND h0 = h1 AND f1 = 'fp-1' AS same FROM (
  SELECT doc_id, lang, doc_id % 10 <> 1 AS had, doc_id % 5 <> 0 AS came, sha256(text) AS h0, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h1, CASE WHEN doc_id % 10 = 3 THEN 'fp-2' ELSE 'fp-1' END AS f1 FROM documents))
WHERE had OR came""")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders as chunks of documents, at generation 1 or 2."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("k"), "l_linenumber").alias("chunk_key"), (F.col("l_partkey") % 2 + 1).alias("generation"), F.col("l_quantity").alias("value")).groupBy("document", "chunk_key").agg(F.max("generation").alias("generation"), F.max("value").alias("value"))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    new = table(spark, folder, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("document"), F.explode(F.array(F.lit("k1"), F.lit("k99"))).alias("chunk_key"), F.lit(2).cast("long").alias("generation"), F.lit(-1.0).alias("value"))
    late = table(spark, folder, "orders").where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("document"), F.lit("k1").alias("chunk_key"), F.lit(0).cast("long").alias("generation"), F.lit(-2.0).alias("value"))
    return store.upsert_chunks(_chunks(spark, folder), new.union(late))


_CHUNKS = "SELECT l_orderkey AS document, 'k' || l_linenumber AS chunk_key, max(l_partkey % 2 + 1) AS generation, max(l_quantity) AS value FROM lineitem GROUP BY ALL"
_MERGED = f"""c AS ({_CHUNKS}), came AS (
  SELECT o_orderkey AS document, k AS chunk_key, 2 AS generation, -1.0 AS value FROM orders, (VALUES ('k1'), ('k99')) v(k) WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'k1', 0, -2.0 FROM orders WHERE o_orderkey % 3 = 1
), merged AS (
  SELECT coalesce(c.document, n.document) AS document, coalesce(c.chunk_key, n.chunk_key) AS chunk_key, CASE WHEN n.document IS NULL OR c.generation > n.generation THEN c.generation ELSE n.generation END::BIGINT AS generation, CASE WHEN n.document IS NULL OR c.generation > n.generation THEN c.value ELSE n.value END::DOUBLE AS value
  FROM c FULL JOIN came n ON c.document = n.document AND c.chunk_key = n.chunk_key
)"""
ADD("store_upsert_chunks", _merged, f"WITH {_MERGED} SELECT * FROM merged")


def _committed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return store.commit_generations(_merged(spark, folder), table(spark, folder, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 2 + 1).alias("generation")))


ADD("store_commit_kept", lambda s, f: _committed(s, f)[0], f"WITH {_MERGED} SELECT m.* FROM merged m LEFT JOIN orders ON o_orderkey = document WHERE NOT coalesce(generation < o_orderkey % 2 + 1, false)")
ADD("store_commit_deleted", lambda s, f: _committed(s, f)[1], f"WITH {_MERGED} SELECT document, count(*) FILTER (generation < o_orderkey % 2 + 1) AS deleted FROM merged LEFT JOIN orders ON o_orderkey = document GROUP BY document")
ADD("store_delete_documents", lambda s, f: store.delete_documents(_chunks(s, f), table(s, f, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document"))), f"WITH c AS ({_CHUNKS}) SELECT * FROM c WHERE document NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
ADD("store_get_chunks", lambda s, f: store.get_chunks(table(s, f, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("document"), F.concat(F.lit("k"), F.col("o_orderkey") % 9).alias("chunk_key")), _chunks(s, f)), f"WITH c AS ({_CHUNKS}) SELECT document AS position, c.* FROM c WHERE document % 10 = 0 AND chunk_key = 'k' || document % 9 AND document IN (SELECT o_orderkey FROM orders)")


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chunks = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") + F.col("doc_id") % 2 * 1_000_000).alias("parent_id"), F.concat(F.lit("inline "), "lang").alias("legacy_text"))
    return store.parent_text(chunks, docs.select(F.col("doc_id").alias("parent_id"), "text")).select("doc_id", "parent_text")


ADD("store_parent_text", _parents, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'inline ' || lang WHEN doc_id % 2 = 0 THEN text END AS parent_text FROM documents")
ADD("store_diff_chunks", lambda s, f: store.diff_chunks(*(table(s, f, "documents").where(w).select(F.col("doc_id").alias("document"), F.col("source").alias("chunk_key"), F.expr(h).alias("content_hash")) for w, h in (("doc_id % 10 <> 1", "sha2(text, 256)"), ("doc_id % 10 <> 0", "sha2(CASE WHEN doc_id % 10 = 2 THEN concat(text, '!') ELSE text END, 256)")))),
    "SELECT doc_id AS document, source AS chunk_key, CASE doc_id % 10 WHEN 1 THEN 'new' WHEN 0 THEN 'deleted' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS action FROM documents")
ADD("store_completion", lambda s, f: store.completion(table(s, f, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 7 + 1).alias("expected"), (F.col("o_orderkey") % 8 + 1).alias("counter")), table(s, f, "lineitem").select(F.col("l_orderkey").alias("document"))),
    "SELECT o_orderkey AS document, count(l_orderkey) AS stored, o_orderkey % 8 >= o_orderkey % 7 AND count(l_orderkey) = o_orderkey % 7 + 1 AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("entry"), F.element_at(F.array(*map(F.lit, ("ready", "pending", "replaced", "staged"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("status"), (F.col("vec_id") * 60_000).alias("created_at"))
    return vectors, table(spark, folder, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("entry"))


_VECTORS = "v AS (SELECT vec_id AS entry, ['ready', 'pending', 'replaced', 'staged'][vec_id % 4 + 1] AS status, vec_id * 60000 AS created_at, EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id AND doc_id % 2 = 0) AS tracked FROM embeddings)"
ADD("store_reconcile", lambda s, f: store.reconcile(*_vectors(s, f)), f"WITH {_VECTORS} SELECT CASE WHEN tracked THEN 'TRACKED_' ELSE 'UNTRACKED_' END || CASE status WHEN 'ready' THEN 'READY' WHEN 'pending' THEN 'PENDING' ELSE CASE WHEN tracked THEN 'REPLACED_STALE' ELSE 'REPLACED' END END AS class, count(*) AS n FROM v GROUP BY 1")
ADD("store_collectable", lambda s, f: store.collectable(*_vectors(s, f), now=500 * 60_000), f"WITH {_VECTORS} SELECT entry, status, created_at FROM v WHERE NOT tracked AND 30000000 - created_at > CASE WHEN status = 'staged' THEN 21600000 ELSE 900000 END")


def _integrity(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "orders").select(F.col("o_custkey").alias("document"), F.date_format("o_orderdate", "yyyyMMdd").alias("chunk_key"))
    return store.integrity(chunks, table(spark, folder, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("document")))


ADD("store_integrity", _integrity, """WITH c AS (SELECT o_custkey AS document, strftime(o_orderdate, '%Y%m%d') AS chunk_key FROM orders)
SELECT 'duplicate_keys' AS "check", count(*) AS n FROM (SELECT 1 FROM c GROUP BY document, chunk_key HAVING count(*) > 1) UNION ALL SELECT 'key_collisions', count(*) FROM (SELECT 1 FROM c GROUP BY chunk_key HAVING count(DISTINCT document) > 1) UNION ALL SELECT 'orphan_chunks', count(*) FROM c WHERE document NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)""")
ADD("store_composite", lambda s, f: store.merged_stats(table(s, f, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("bytes")).select((F.col("documents") > 0).alias("ok"), "documents", (F.col("documents") * 2).alias("chunks"), "bytes", (F.col("documents") % 3).alias("duplicates"))),
    "WITH d AS (SELECT count(*) AS n, sum(n_chars) AS b FROM documents GROUP BY lang) SELECT max(n) AS documents, max(n) * 2 AS chunks, sum(b)::BIGINT AS bytes, sum(n % 3)::BIGINT AS duplicates, bool_and(n > 0) AS healthy FROM d")


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.element_at(F.array(*map(F.lit, ("pending_retry", "processing", "abandoned"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("payload"), (F.col("o_orderkey") % 4).alias("attempts"), (F.col("o_orderkey") * 1000).alias("last_at"))
    return store.dead_letter_step(rows, now=5_000_000).select("key", "next")


ADD("dead_letter_step", _letters, "SELECT o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 >= 2 THEN 'abandoned' ELSE 'processing' END WHEN 1 THEN CASE WHEN o_orderkey * 1000 < 3200000 THEN 'pending_retry' ELSE 'processing' END ELSE 'abandoned' END AS next FROM orders")
# States that end a URL's run.
TERMINAL = ("ingested", "dry_run_ready", "skipped_short", "skipped_duplicate", "skipped_robots", "skipped_unsupported", "failed_fetch_terminal", "failed_extract")
_STATES = "['fetching', 'ingested', 'discovered', 'failed_push', 'skipped_short']"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    states = F.array(*map(F.lit, ("fetching", "ingested", "discovered", "failed_push", "skipped_short")))
    return table(spark, folder, "events").select(F.col("user_id").alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 600).alias("http_status"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("title"), F.lit(None).cast("string").alias("content_hash"))


ADD("ledger_fold", lambda s, f: store.fold_events(_ledger(s, f), TERMINAL), f"""WITH e AS (SELECT user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_STATES}[event_id % 5 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN event_id % 600 END AS http_status, CASE WHEN event_id % 4 = 0 THEN event_type END AS title FROM events)
SELECT url, coalesce(arg_max(state, k) FILTER (state IN ('ingested', 'skipped_short')), arg_max(state, k)) AS state, count(*) FILTER (state = 'fetching') AS attempts, arg_max(http_status, k) FILTER (http_status IS NOT NULL) AS http_status, arg_max(title, k) FILTER (title IS NOT NULL) AS title, NULL::VARCHAR AS content_hash FROM e GROUP BY url""")


def _scheduled(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "events").select((F.col("event_id") % 300).alias("url"), (F.col("event_id") % 6).alias("depth"), (F.col("event_id") % 17).alias("score"))
    return store.schedule_links(links, store.fold_events(_ledger(spark, folder), TERMINAL), 3, TERMINAL)


ADD("schedule_links", _scheduled, f"""WITH l AS (SELECT event_id % 300 AS url, min(event_id % 6) AS depth, max(event_id % 17) AS score FROM events GROUP BY 1),
h AS (SELECT user_id AS url, arg_max({_STATES}[event_id % 5 + 1], ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) FILTER (event_id % 5 IN (1, 4)) AS had FROM events GROUP BY 1)
SELECT l.url, depth, CASE WHEN had IS NOT NULL THEN had WHEN depth > 3 THEN 'skipped_depth' ELSE 'discovered' END AS state, row_number() OVER (PARTITION BY depth ORDER BY score DESC, l.url) AS place FROM l LEFT JOIN h ON h.url = l.url""")


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/sources/{label}-{uuid.uuid4().hex}"


def _jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark, "jsonl")
    corpus.append_jsonl(table(spark, folder, "documents").where("doc_id % 2 = 0").select("doc_id", "text", "lang"), path)
    corpus.append_jsonl(table(spark, folder, "documents").where("doc_id % 2 = 1").select("doc_id", "text", "lang"), path)
    rows, _ = corpus.read_jsonl(spark, path, "doc_id long, text string, lang string")
    return rows.select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


ADD("source_jsonl", _jsonl, "SELECT doc_id, sha256(text) AS digest, lang FROM documents")


def _blobs(spark: SparkSession, folder: str) -> DataFrame:
    path, pages = _path(spark, "blobs"), table(spark, folder, "pages")
    for part in (pages.where("page_id % 2 = 0"), pages, pages):
        corpus.add_blobs(part, "html", path)
    return spark.read.parquet(path).select("sha256", F.octet_length("content").cast("long").alias("size"))


ADD("source_blobs", _blobs, "SELECT DISTINCT sha256(html) AS sha256, strlen(html)::BIGINT AS size FROM pages WHERE html IS NOT NULL")


def _report(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark, "report")
    corpus.write_report(table(spark, folder, "pages").select((F.col("page_id") % 4).alias("min_depth"), "url", F.lit("ingested").alias("state")), path)
    read = spark.read.option("header", "true").schema("min_depth long, url string, state string").csv(path)
    return read.groupBy("min_depth", "state").agg(F.count("*").alias("n"), F.min("url").alias("first"))


ADD("source_ledger_report", _report, "SELECT page_id % 4 AS min_depth, 'ingested' AS state, count(*) AS n, min(url) AS first FROM pages GROUP BY 1")


def _sitemap(spark: SparkSession, folder: str) -> DataFrame:
    xml = F.concat(F.lit("<urlset><!-- <loc>x</loc> --><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><sm:loc><![CDATA[https://host.example/page/"), "page_id", F.lit("]]></sm:loc></url></urlset>"))
    found = table(spark, folder, "pages").select("page_id", F.explode(corpus.sitemap_locs(xml)).alias("loc"))
    return found.where(corpus.by_globs(F.col("loc"), (), ("https://host.example/page/*1",)))


ADD("source_sitemap", _sitemap, "SELECT page_id, url AS loc FROM pages WHERE trim(url) <> '' AND NOT regexp_matches(url, '^https://host[.]example/page/[^/]*1$') UNION ALL SELECT page_id, 'https://host.example/page/' || page_id FROM pages WHERE page_id % 10 <> 1")
ADD("source_sitemap_lines", lambda s, f: table(s, f, "pages").select("page_id", F.explode(corpus.sitemap_lines(F.concat(F.lit("# list\r\n "), "url", F.lit(" \nnone\n")))).alias("loc")), "SELECT page_id, trim(url) AS loc FROM pages WHERE regexp_matches(url, '(?i)^https?://')")
ADD("source_bounded", lambda s, f: corpus.bounded(table(s, f, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 5000), "SELECT l_orderkey, l_linenumber FROM lineitem")
ADD("source_cache_misses", lambda s, f: corpus.cache_misses(table(s, f, "documents").select("doc_id", "lang"), table(s, f, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
ADD("source_short_headings", lambda s, f: table(s, f, "documents").select("doc_id", F.array_join(corpus.short_headings(F.array("source", "lang", "text")), " > ").alias("path")), "SELECT doc_id, array_to_string(list_filter([source, lang, text], lambda h: strlen(h) <= 200), ' > ') AS path FROM documents")

_quoted = lambda p: p.replace("'", "''")
ADD("injection_scan", lambda s, f: table(s, f, "documents").select("doc_id", guards.suspicious(F.col("text")).alias("suspicious")), f"SELECT doc_id, regexp_matches(text, '(?i){_quoted(guards.any_of(guards.INJECTION))}') AS suspicious FROM documents")
ADD("security_gateway", lambda s, f: table(s, f, "conversations").select("conv_id", "turn", guards.gateway(F.col("text")).alias("verdict")), f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'EMPTY_INPUT' WHEN length(text) > 2000 THEN 'REQUEST_LENGTH_EXCEEDED'
WHEN regexp_matches(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '(?i){_quoted(guards.any_of(guards.GATEWAY))}') THEN 'PROMPT_INJECTION_DETECTED' ELSE 'OK' END AS verdict FROM conversations""")


def _short(spark: SparkSession, folder: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != ""))
    return table(spark, folder, "documents").select("doc_id", ((words < 50) & ~guards.kept_though_short(F.lit(""), F.col("source"), F.col("text"), words)).alias("too_short"))


ADD("short_documents", _short,
    "WITH w AS (SELECT doc_id, lower(concat(' ', source, ' ', text)) AS t, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n FROM documents) SELECT doc_id, n < 50 AND NOT (n >= 8 AND (" + " OR ".join(f"contains(t, '{t}')" for t in guards.HIGH_VALUE) + ")) AS too_short FROM w")
_has = lambda words, t="t": "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _understood(spark: SparkSession, folder: str) -> DataFrame:
    made = guards.understanding(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in made.items() if n != "facts"], F.array_join(made["facts"], ",").alias("facts"))


ADD("query_understanding", _understood, f"""WITH q AS (SELECT conv_id, turn, text, lower(text) AS t, regexp_extract(lower(text), '\\b(19[0-9][0-9]|20[0-1][0-9]|202[0-4])\\b', 1) AS year FROM conversations), p AS (SELECT *, year <> '' OR {_has(guards.PAST)} AS past, {_has(guards.CURRENT_RISK)} AS risky FROM q)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'urdu' WHEN {_has(guards.ROMAN_URDU)} THEN 'roman_urdu' ELSE 'english' END AS language,
CASE WHEN past THEN 'historical' WHEN contains(t, 'fee') THEN 'fees' WHEN contains(t, 'merit') THEN 'merit' WHEN contains(t, 'entry test') OR contains(t, 'ecat') THEN 'entry_test' WHEN contains(t, 'admission') THEN 'admissions' WHEN contains(t, 'exam') OR contains(t, 'date sheet') THEN 'examinations' ELSE 'general' END AS intent,
CASE WHEN past THEN 'historical' WHEN risky THEN 'current' ELSE 'timeless' END AS temporal_intent, CASE WHEN past THEN 'historical' WHEN risky THEN 'high_current' ELSE 'general' END AS risk, CASE WHEN year <> '' THEN year::INTEGER END AS requested_year,
array_to_string(list_filter([CASE WHEN contains(t, 'fee') THEN 'fee_amount' END, CASE WHEN contains(t, 'deadline') OR contains(t, 'last date') THEN 'deadline' END, CASE WHEN contains(t, 'merit') THEN 'merit_value' END, CASE WHEN contains(t, 'entry test') OR contains(t, 'exam') THEN 'entry_test_date,exam_date' END], lambda x: x IS NOT NULL), ',') AS facts FROM p""")
ADD("confidence_tiers", lambda s, f: table(s, f, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("n"), F.max(F.col("event_id") % 90 / 100).alias("top")).select("user_id", guards.confidence_tier(F.col("n"), F.col("top")).alias("tier")), "SELECT user_id, CASE WHEN count(*) FILTER (event_id % 2 = 0) = 0 THEN 'refuse' WHEN max(event_id % 90) < 40 THEN 'hedge' WHEN max(event_id % 90) < 60 THEN 'cite' ELSE 'normal' END AS tier FROM events GROUP BY user_id")
ADD("person_types", lambda s, f: table(s, f, "pages").select("page_id", guards.person_type(F.col("url"), F.regexp_extract("html", "<title[^>]*>([^<]*)", 1)).alias("person")), f"WITH t AS (SELECT page_id, lower(url || ' ' || regexp_extract(html, '<title[^>]*>([^<]*)', 1)) AS t FROM pages) SELECT page_id, CASE WHEN {_has(guards.FACULTY)} THEN 'faculty' WHEN {_has(guards.STAFF)} THEN 'staff' WHEN {_has(guards.ADMIN)} THEN 'admin' END AS person FROM t")
ADD("question_screen", lambda s, f: table(s, f, "conversations").select("conv_id", "turn", guards.question_screen(F.col("text"), 120).alias("screen")), f"SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'invalid' WHEN length(text) > 120 THEN 'too long' WHEN regexp_matches(text, '(?i){_quoted(guards.any_of(guards.INJECTION))}') THEN 'injection' ELSE 'ok' END AS screen FROM conversations")
ADD("pdf_tiers", lambda s, f: table(s, f, "documents").select("doc_id", guards.pdf_tier(F.col("source"), F.col("text")).alias("tier")), "WITH t AS (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, 'admission|academic|prospectus|fee|schedule') THEN 'high' WHEN regexp_matches(t, 'department|faculty|program|curriculum') THEN 'medium' ELSE 'low' END AS tier FROM t")
ADD("session_filter", lambda s, f: table(s, f, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("session")).where(guards.of_session(F.col("session"), "Brand#11")), "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand END AS session FROM part WHERE p_size % 3 <> 0 OR p_brand = 'Brand#11'")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    kind = F.element_at(F.array(*map(F.lit, ("fee_amount", "deadline", "percentage", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.when(kind == "fee_amount", F.concat(F.lit("Rs. 1,"), F.lpad((F.col("p_size") + 100).cast("string"), 3, "0"))).when(kind == "deadline", F.concat((F.col("p_size") % 28 + 1).cast("string"), F.lit(" July 2026"))).when(kind == "percentage", F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise(F.concat(F.lit(" "), "p_type"))
    return p.select("p_partkey", guards.fact_value(kind, raw).alias("value"))


ADD("fact_values_by_kind", _facts, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1' || (p_size + 100) WHEN 1 THEN '2026-07-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') WHEN 2 THEN printf('%.2f', p_size / 100) ELSE trim(p_type) END AS value FROM part")


def _pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 6 == 1, F.concat(F.lit("a | b | c\n"), F.lit("---|---|---\n1 | 2 | 3"))).when(F.col("doc_id") % 6 == 2, "few words").otherwise(F.col("text"))
    classes = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("picture"))).otherwise(F.array(F.lit("text")))
    return d.select("doc_id", guards.page_route(text, classes, F.col("doc_id") % 5 == 0, F.col("doc_id") % 10 / 10, F.col("doc_id") % 11 == 0, F.when(F.col("doc_id") % 13 == 0, "e")).alias("route"))


ADD("pdf_page_routes", _pdf_pages, """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'fast extractor returned no page chunk' WHEN doc_id % 13 = 0 THEN 'fast page extraction failed'
WHEN doc_id % 6 = 0 THEN 'empty extraction on a visually substantive page' WHEN doc_id % 6 > 2 AND trim(text) = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'empty extraction on a visually substantive page' ELSE 'blank page' END
WHEN doc_id % 5 = 0 AND doc_id % 6 <> 1 THEN 'table detected but Markdown table was not recovered' WHEN doc_id % 10 < 5 AND doc_id % 10 <> 4.5 AND doc_id % 2 = 0 AND doc_id % 10 / 10 < 0.45 THEN 'low-quality extraction with visual/layout content'
WHEN doc_id % 2 = 0 AND CASE WHEN doc_id % 6 = 2 THEN 2 ELSE len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) END < 5 THEN 'sparse extraction from image-heavy page' ELSE 'fast extraction is usable' END AS route FROM documents""")


def _merit(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    m = calculators.merit(k % 400, F.lit(400), k % 550, F.when(k % 3 == 0, 0).otherwise(550), k % 1100, F.lit(1100), k % 2 == 0)
    need = calculators.marks_needed(F.lit(75.0), m["aggregate"], 0.33, F.lit(400), 400)
    return table(spark, folder, "customer").select("c_custkey", F.round(m["aggregate"], 6).alias("merit"), m["engineering"].alias("engineering"), m["computing"].alias("computing"), need.cast("long").alias("test_marks_needed"))


ADD("merit_aggregate", _merit, """WITH m AS (SELECT c_custkey, c_custkey % 400 / 400 * 33 + least(c_custkey % 550 + CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 0 END, 550 + CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 0 END) / 550 * 50 + c_custkey % 1100 / 1100 * 17 AS a FROM customer)
SELECT c_custkey, round(least(100, a), 6) AS merit, c_custkey % 550 >= 330 AND c_custkey % 400 > 0 AS engineering, c_custkey % 550 >= 275 AND c_custkey % 400 > 0 AS computing, greatest(0, ceil((75 - least(100, a)) / 33 * 400))::BIGINT AS test_marks_needed FROM m""")


def _gpa(spark: SparkSession, folder: str) -> DataFrame:
    points, credits = F.col("l_quantity") % 5, (F.col("l_linenumber") % 4 + 1).cast("double")
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(calculators.grade_average(points, credits).alias("g"), F.sum(credits).alias("credits"))
    told = calculators.standing(F.col("g"), F.col("credits"))
    plan = calculators.target(F.lit(3.0), F.lit(130.0), F.col("g"), F.col("credits"))
    return g.select("l_orderkey", F.round("g", 3).alias("gpa"), *[c.alias(n) for n, c in told.items()], F.round(calculators.cumulative(F.col("g"), F.col("credits"), F.lit(3.0), F.lit(30.0)), 3).alias("cgpa"), F.round(plan["required"], 2).alias("required"), plan["status"].alias("status"))


ADD("gpa", _gpa, """WITH g AS (SELECT l_orderkey, sum(l_quantity % 5 * (l_linenumber % 4 + 1)) AS p, sum(l_linenumber % 4 + 1)::DOUBLE AS c FROM lineitem GROUP BY 1), r AS (SELECT *, p / c AS gpa, (390 - p) / (130 - c) AS need FROM g)
SELECT l_orderkey, round(gpa, 3) AS gpa, gpa < 2 AS probation, gpa >= 3.7 AND c >= 12 AS dean_list, round((90 + p) / (30 + c), 3) AS cgpa, round(need, 2) AS required, CASE WHEN need > 4 THEN 'impossible' WHEN need >= 3.5 THEN 'challenging' ELSE 'achievable' END AS status FROM r""")


def _invoice(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    made = calculators.invoice(F.when(k % 3 == 0, "engineering").when(k % 3 == 1, "computing").otherwise("postgraduate"), F.when(k % 2 == 0, "subsidized").otherwise("partial"), F.when(k % 5 < 2, "hostel").otherwise("commute"), F.when(k % 7 == 0, "first").otherwise("later"))
    return table(spark, folder, "customer").select("c_custkey", *[c.cast("long").alias(n) for n, c in made.items()])


ADD("fee_invoice", _invoice, """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 65000 WHEN c_custkey % 6 = 0 THEN 48000 WHEN c_custkey % 6 = 3 THEN 135000 WHEN c_custkey % 6 = 4 THEN 52000 ELSE 145000 END AS tuition, CASE WHEN c_custkey % 5 < 2 THEN 16000 ELSE 14000 END AS living, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 < 2 THEN 50000 ELSE 40000 END ELSE 0 END AS first_dues FROM customer)
SELECT c_custkey, tuition::BIGINT AS tuition, first_dues::BIGINT AS first_dues, (tuition + 17000 + living + first_dues)::BIGINT AS term, (8 * (tuition + 17000 + living) + first_dues)::BIGINT AS four_years FROM p""")


def _acceptance(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = ("workflow_contracts", "trace_spans", "deadlines", "kill_switches", "cache_revalidation", "stampede_protection", "no_dead_models", "dimension_validated")
    row = table(spark, folder, "customer").select(
        "c_custkey", *[(k % (i + 2) != 0).alias(n) for i, n in enumerate(flags)], (k % 11).alias("invalid_documents"), (k % 2).alias("unknown_freshness"), (k % 3).alias("unresolved_conflicts"),
        (k % 5 / 4).alias("injection_pass_rate"), (k % 6 / 5).alias("ssrf_pass_rate"), (k % 100 / 100).alias("recall_at_k"), (k % 4 / 4).alias("unsupported_rate"), (k % 7 / 6).alias("citation_correctness"), (k * 10).alias("p95_ms"), (k * 3).alias("cache_hit_p95_ms"),
    )
    made = calculators.acceptance()
    return row.select("c_custkey", F.size(made["violations"]).alias("violations"), made["accepted"].alias("accepted"), F.round(made["score"], 4).alias("score"))


ADD("acceptance_gate", _acceptance, """WITH v AS (SELECT c_custkey, list_sum(list_transform(range(2, 10), lambda d: (c_custkey % d = 0)::INT)) + (c_custkey % 11 > 0)::INT + (c_custkey % 2 > 0)::INT + (c_custkey % 3 > 0)::INT + (c_custkey % 5 < 4)::INT + (c_custkey % 6 < 5)::INT + (c_custkey % 100 < 95)::INT + (c_custkey % 4 > 0)::INT + (c_custkey % 7 < 6)::INT + (c_custkey > 800)::INT + (c_custkey > 500)::INT AS n FROM customer)
SELECT c_custkey, n::INTEGER AS violations, n = 0 AS accepted, round((16 - n) / 16 * 100, 4) AS score FROM v""")


def _simple(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("got"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 40))).alias("want"), F.sort_array(F.collect_list(F.col("l_returnflag") == "N")).alias("claims"))
    urls = F.transform("got", lambda x: F.when(x % 2 == 0, F.concat(F.lit("https://a.example.com/"), x)).otherwise(F.lit("https://example.com.evil.net/")))
    return lines.select("l_orderkey", F.round(evaluation.recall(F.col("got"), F.col("want")), 6).alias("recall"), F.round(evaluation.reciprocal_rank(F.col("got"), F.col("want")), 6).alias("mrr"), F.round(evaluation.citation_correctness(urls, ("example.com",)), 6).alias("citations"), F.round(evaluation.unsupported_rate(F.col("claims")), 6).alias("unsupported"))


ADD("simple_metrics", _simple, """WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS got, list_distinct(list(l_suppkey % 40) FILTER (l_linenumber > 2)) AS want, avg((l_returnflag <> 'N')::INT) AS u FROM lineitem GROUP BY 1), w AS (SELECT *, coalesce(want, []) AS t FROM l)
SELECT l_orderkey, round(CASE WHEN len(t) = 0 THEN 1 ELSE len(list_intersect(t, got)) / len(t) END, 6) AS recall, round(CASE WHEN len(t) = 0 THEN 1 ELSE coalesce(1 / list_min(list_transform(list_intersect(t, got), lambda x: list_position(got, x))), 0) END, 6) AS mrr, round(len(list_filter(got, lambda x: x % 2 = 0)) / len(got), 6) AS citations, round(u, 6) AS unsupported FROM w""")
ADD("judged_rollup", lambda s, f: evaluation.judged_rollup(table(s, f, "orders").select((F.col("o_orderkey") % 4).alias("relevant"), (F.col("o_orderkey") % 6).alias("retrieved"), (1 / (F.col("o_orderkey") % 5 + 1)).alias("reciprocal_rank"), F.when(F.col("o_orderkey") % 9 == 0, "timeout").alias("error"))),
    "SELECT round(avg((o_orderkey % 4 > 0)::INT) FILTER (o_orderkey % 9 <> 0), 4) AS recall_at_k, round(avg(o_orderkey % 4 / greatest(o_orderkey % 6, 1)) FILTER (o_orderkey % 9 <> 0), 4) AS precision_at_k, round(avg(1 / (o_orderkey % 5 + 1)) FILTER (o_orderkey % 9 <> 0), 4) AS mrr, count(*) AS total_queries, count(*) FILTER (o_orderkey % 9 = 0) AS errors FROM orders")


def _golden(spark: SparkSession, folder: str) -> DataFrame:
    golden = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query"), F.concat(F.lit("/p/"), F.col("o_orderkey") % 10).alias("expected_url"), F.concat(F.lit("Part "), F.col("o_orderkey") % 10).alias("expected_fragment"))
    results = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("https://x/p/"), F.col("l_partkey") % 12).alias("url"), F.concat(F.lit("about part "), F.col("l_partkey") % 12).alias("text"))
    return evaluation.golden_join(golden, results).select("query", "url_rank", "fragment_matched", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"))


ADD("golden_join", _golden, """WITH h AS (SELECT o_orderkey AS query, coalesce(min(l_linenumber) FILTER (starts_with((l_partkey % 12)::VARCHAR, (o_orderkey % 10)::VARCHAR)), 0) AS url_rank, coalesce(bool_or(starts_with((l_partkey % 12)::VARCHAR, (o_orderkey % 10)::VARCHAR)), false) AS fragment_matched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT query, url_rank, fragment_matched, round(CASE WHEN url_rank > 0 THEN 1 / url_rank ELSE 0 END, 6) AS reciprocal_rank, round(CASE WHEN url_rank > 0 THEN 1 / log2(url_rank + 1) ELSE 0 END, 6) AS ndcg FROM h""")
ADD("alias_relevance", lambda s, f: evaluation.alias_relevance(table(s, f, "lineitem").select(F.col("l_orderkey").alias("query"), F.concat(F.lit("u"), F.col("l_partkey") % 50).alias("url"), F.col("l_quantity").alias("grade")), s.range(40).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 13).alias("document"))),
    "SELECT l_orderkey AS query, l_partkey % 50 % 13 AS document, max(l_quantity) AS grade FROM lineitem WHERE l_partkey % 50 < 40 GROUP BY 1, 2")
ADD("baseline_compare", lambda s, f: evaluation.baseline_compare(*(table(s, f, "events").where(w).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value") / 100, 6).alias("value")) for w in ("event_id % 2 = 0", "event_id % 2 = 1 AND event_type <> 'error'"))).select("metric", "value", "base", "delta", "regressed"),
    "WITH a AS (SELECT event_type AS metric, round(avg(value) / 100, 6) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value) / 100, 6) AS base FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1) SELECT metric, value, base, round(value - base, 6) AS delta, coalesce(value - base < -0.02, false) AS regressed FROM a LEFT JOIN b USING (metric)")
ADD("overlap_recall", lambda s, f: evaluation.overlap_recall(table(s, f, "lineitem").select("l_orderkey", "l_partkey"), table(s, f, "lineitem").where("l_suppkey % 4 <> 0").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").select("l_orderkey", F.round("recall", 6).alias("recall")),
    "WITH e AS (SELECT l_orderkey, l_partkey, bool_or(l_suppkey % 4 <> 0) AS hit FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, round(avg(hit::INT), 6) AS recall FROM e GROUP BY 1")
ADD("extraction_rollup", lambda s, f: evaluation.extraction_rollup(table(s, f, "documents").select(F.col("lang").alias("family"), F.col("source").alias("criticality"), (F.col("n_chars") % 7).alias("found"), (F.col("doc_id") % 9).alias("wanted"), (F.col("n_chars") > 500).alias("passed"))),
    "SELECT lang AS family, source AS criticality, count(*) AS n, round(avg(CASE WHEN doc_id % 9 > 0 THEN n_chars % 7 / (doc_id % 9) END), 6) AS macro_recall, round(sum(n_chars % 7) / sum(doc_id % 9), 6) AS micro_recall, round(avg((n_chars > 500)::INT), 6) AS pass_rate FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
ADD("best_chunk_per_document", lambda s, f: store.latest(table(s, f, "lineitem").select("l_orderkey", F.col("l_quantity").alias("score"), (-F.col("l_linenumber")).alias("earlier"), "l_partkey").groupBy("l_orderkey", "score", "earlier").agg(F.max("l_partkey").alias("l_partkey")), ["l_orderkey"], "score", "earlier").select("l_orderkey", "score", (-F.col("earlier")).alias("l_linenumber")),
    "SELECT l_orderkey, l_quantity AS score, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
