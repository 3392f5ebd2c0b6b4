"""Jobs, settings, migrations and what pages say of addresses, over snapshots derived from the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import markup
from tessella.operators import jobs
from tessella.sources.tables import table

from .pairs import Family

FAMILY = Family()
ADD = FAMILY.add
_quoted = lambda p: p.replace("'", "''")


def _named(key: str, *names: str):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.lit(None)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("job"), _named("o_orderkey", "running", "pending", "completed").alias("status"), (F.col("o_orderkey") * 1000).alias("started_at"), nothing.cast("long").alias("completed_at"), nothing.cast("string").alias("error"))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("job"), _named("l_linenumber", "failed", "running", "completed", "cancelled").alias("status"), F.when(F.col("l_linenumber") % 4 == 0, "broken").alias("error"), F.col("l_linenumber").alias("at"))


ADD("jobs_reported", lambda s, f: jobs.report_jobs(_jobs(s, f), _reports(s, f), 9_000_000), """WITH r AS (SELECT l_orderkey AS job, max(l_linenumber) AS k FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1),
j AS (SELECT o_orderkey AS job, ['running', 'pending', 'completed'][o_orderkey % 3 + 1] AS was, ['failed', 'running', 'completed', 'cancelled'][k % 4 + 1] AS told FROM orders LEFT JOIN r ON job = o_orderkey)
SELECT job, coalesce(told, was) AS status, job * 1000 AS started_at, CASE WHEN told <> was AND told <> 'running' THEN 9000000 END AS completed_at, CASE WHEN told = 'failed' THEN 'broken' END AS error FROM j""")
ADD("jobs_failed_silent", lambda s, f: jobs.fail_silent(_jobs(s, f), 12_800_000), """SELECT o_orderkey AS job, CASE WHEN late THEN 'failed' ELSE ['running', 'pending', 'completed'][o_orderkey % 3 + 1] END AS status, o_orderkey * 1000 AS started_at, CASE WHEN late THEN 12800000 END AS completed_at, CASE WHEN late THEN 'no answer after 3 hours' END AS error
FROM (SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey < 2000 AS late FROM orders)""")


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    present = table(spark, folder, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("k"), "p_partkey").alias("key"), F.col("p_brand").alias("value"), F.lit("old").alias("section"), F.lit(1).alias("at"))
    incoming = table(spark, folder, "lineitem").where("l_partkey % 4 <> 0").groupBy("l_partkey", "l_linenumber").agg(F.max("l_returnflag").alias("value")).select(F.concat(F.lit("k"), "l_partkey").alias("key"), "value", F.lit("new").alias("section"), (F.col("l_linenumber") + 1).alias("at"))
    return jobs.upsert_settings(present, incoming)


ADD("settings_upserted", _settings, """WITH i AS (SELECT l_partkey AS k, l_linenumber + 1 AS nth, max(l_returnflag) AS v FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL), n AS (SELECT k, max(nth) AS nth, arg_max(v, nth) AS v FROM i GROUP BY k), p AS (SELECT * FROM part WHERE p_partkey % 3 <> 0)
SELECT 'k' || coalesce(p_partkey, k) AS key, coalesce(v, p_brand) AS value, CASE WHEN p_partkey IS NULL THEN 'new' ELSE 'old' END AS section, coalesce(nth, 1) AS "at" FROM p FULL JOIN n ON k = p_partkey""")
ADD("counters_added", lambda s, f: jobs.count_up(table(s, f, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "none").otherwise(F.col("c_custkey").cast("string")).alias("value")), table(s, f, "orders").select(F.col("o_custkey").alias("key"), F.lit(2).alias("by"))).select("key", F.coalesce(F.col("value").try_cast("double"), F.lit(-1.0)).alias("value")),
    "WITH n AS (SELECT o_custkey AS k, count(*) * 2 AS n FROM orders GROUP BY 1) SELECT coalesce(c_custkey, k) AS key, CASE WHEN n IS NULL AND c_custkey % 3 = 0 THEN -1 ELSE coalesce(n, 0) + CASE WHEN c_custkey % 3 <> 0 THEN c_custkey ELSE 0 END END::DOUBLE AS value FROM customer FULL JOIN n ON k = c_custkey")
ADD("states_reset", lambda s, f: table(s, f, "orders").select("o_orderkey", jobs.reset(F.col("o_orderstatus"), "F", "pending").alias("status")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pending' ELSE o_orderstatus END AS status FROM orders")


def _migrated(spark: SparkSession, folder: str, part: int) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("mode"))
    chunks = lines.select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("chunk"), F.col("l_orderkey").alias("document"), F.when(F.col("l_linenumber") == 3, "p").alias("parent_id"), F.when(F.col("l_linenumber") < 3, F.col("mode")).when(F.col("l_linenumber") == 4, "").alias("parent_text"))
    parents = table(spark, folder, "orders").select(F.concat(F.lit("known"), "o_orderkey").alias("parent_id"), F.col("o_orderkey").alias("document"), F.sha2(F.lit("N"), 256).alias("content_hash"), F.lit("N").alias("text"))
    return jobs.migrate_parents(chunks, parents)[part]


_MADE = "sha256(l_orderkey || '|' || sha256(mode))"
_LINES = "l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS mode FROM lineitem GROUP BY ALL)"
ADD("parents_migrated_chunks", lambda s, f: _migrated(s, f, 0), f"WITH {_LINES} SELECT l_orderkey || '-' || l_linenumber AS chunk, l_orderkey AS document, CASE WHEN l_linenumber = 3 THEN 'p' WHEN l_linenumber < 3 THEN CASE WHEN mode = 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders) THEN 'known' || l_orderkey ELSE {_MADE} END END AS parent_id, CASE WHEN l_linenumber = 4 THEN '' END AS parent_text FROM l")
ADD("parents_migrated", lambda s, f: _migrated(s, f, 1), f"WITH {_LINES} SELECT 'known' || o_orderkey AS parent_id, o_orderkey AS document, sha256('N') AS content_hash, 'N' AS text FROM orders UNION ALL SELECT DISTINCT {_MADE}, l_orderkey, sha256(mode), mode FROM l WHERE l_linenumber < 3 AND NOT (mode = 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders))")


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("id")).agg(F.max("l_quantity").cast("double").alias("score"))
    answers = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query"), F.explode(F.sequence(F.lit(100), F.lit(103))).alias("id")).select("query", "id", (F.col("id") - 80).cast("double").alias("score"), F.when(F.col("id") != 102, (F.col("query") + F.col("id")) % 2 * 1000).alias("expires_at"))
    return jobs.with_answers(hits, answers, 500)


ADD("hits_with_answers", _answered, """WITH a AS (SELECT o_orderkey AS query, id, id - 80 AS score, row_number() OVER (PARTITION BY o_orderkey ORDER BY id DESC) AS k FROM orders, range(100, 104) t(id) WHERE id = 102 OR (o_orderkey + id) % 2 = 1),
b AS (SELECT query, id, score::DOUBLE AS score, 'answer' AS kind FROM a WHERE k <= 2 UNION ALL SELECT l_orderkey, l_linenumber, max(l_quantity), 'hit' FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kind, id) AS place FROM b""")
ADD("html_visible_urls", lambda s, f: table(s, f, "pages").select("page_id", F.array_join(markup.visible_urls(F.concat(F.lit("<p>See https://seen.example/a. <script>https://no.example</script>"), F.coalesce("html", F.lit("")))), " ").alias("urls")),
    f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace('<p>See https://seen.example/a. <script>https://no.example</script>' || coalesce(html, ''), '{_quoted(markup.UNSEEN)}', ' ', 'g'), '{markup.TAG}', ' ', 'g'), '{_quoted(markup.WEB_ADDRESS)}'), lambda u: regexp_replace(u, '{markup.FINAL_MARKS}', '')))), ' ') AS urls FROM pages")
ADD("html_declared_url", lambda s, f: table(s, f, "pages").select("page_id", markup.declared_url(F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<LINK rel='canonical' href='https://own.example/"), "page_id", F.lit("'>"))).otherwise("<base href='https://base.example/'>"), F.coalesce("html", F.lit("")))).alias("url")),
    f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://own.example/' || page_id ELSE coalesce(nullif(regexp_extract(html, '{_quoted(markup.CANONICAL)}', 1), ''), 'https://base.example/') END AS url FROM pages""")
ADD("retry_delays", lambda s, f: table(s, f, "orders").select("o_orderkey", markup.retry_after(F.when(F.col("o_orderkey") % 4 == 0, " 120").when(F.col("o_orderkey") % 4 == 1, "99999").when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon"), 788_918_400).alias("wait"), markup.backoff_ceiling(F.col("o_orderkey") % 9).alias("ceiling")),
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 120 WHEN 1 THEN 3600 WHEN 2 THEN least(3600, greatest(0, epoch(o_orderdate) - 788918400)) END::DOUBLE AS wait, least(60, 2 ** (o_orderkey % 9))::DOUBLE AS ceiling FROM orders")
