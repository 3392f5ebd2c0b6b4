"""Streams with stored tables and state, over files that are made of the data tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.checkpoints import shared_folder
from tessella.sources.tables import table
from tessella.streaming import budget, intake, stateful, sweeps

from .pairs import Family
from .policies import NOW, STATE

FAMILY = Family()
SECRET, HOSTS = "a shared secret", ["example.com"]
MOST = 6000


def folder_of(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}/{uuid.uuid4().hex}"


def arrivals(rows: DataFrame, path: str, order: str, parts: int = 3) -> Iterator[DataFrame]:
    """The stream of the files below ``path``, each time that a further range of ``order`` has been written there."""
    spark = rows.sparkSession
    bounds = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = bounds["lo"] or 0, (bounds["hi"] or 0) + 1
    cuts = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows.where((F.col(order) >= a) & (F.col(order) < b)).write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


def _crawled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(STATE.format(documents="{documents}"), documents=table(spark, folder, "documents")).select("doc_id", "status", "stale", "crawled", "tier")


def _swept(spark: SparkSession, folder: str) -> sweeps.Marks:
    base = folder_of(spark, "sweeps")
    marks = sweeps.Marks(f"{base}/marks").begin(spark)
    for stream in arrivals(_crawled(spark, folder), f"{base}/in", "doc_id"):
        sweeps.run(stream, sweeps.sweep(marks, lambda rows, marked: sweeps.staleness(rows, marked, NOW)), f"{base}/state")
    return marks


_aged = f"NOT stale AND status IN ('active', 'indexed') AND crawled IS NOT NULL AND {NOW} - crawled > CASE tier WHEN 'high' THEN 14 WHEN 'medium' THEN 60 ELSE 180 END * 86400000::BIGINT"
_state = f"WITH s AS ({STATE.format(documents='documents')})"
FAMILY.add("sweep_marks", lambda s, f: _swept(s, f).marked(s).select("key"), f"{_state} SELECT doc_id AS key FROM s WHERE {_aged}")
FAMILY.add(
    "sweep_counters",
    lambda s, f: _swept(s, f).summary(s).drop("batches"),
    f"""{_state} SELECT count(*) AS examined, count(*) FILTER ({_aged}) AS flagged, count(*) FILTER (status IN ('active', 'indexed') AND stale) AS already_stale,
  count(*) FILTER (NOT coalesce(status IN ('active', 'indexed') AND (stale OR ({_aged})), false)) AS skipped FROM s""",
)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", F.col("user_id").cast("string").alias("user_id"), ts.alias("ts"), F.unix_millis(ts).alias("at"), F.greatest(F.ceil("value"), F.lit(1)).cast("long").alias("tokens"), (F.col("event_type") != "error").alias("counted"), (F.col("user_id") % 9 == 0).alias("admin"))


def stream_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Two messages in two hours for users, five for administrators, and 400 tokens for all."""
    base = folder_of(spark, "budget")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.STORE)
    try:
        for stream in arrivals(_requests(spark, folder), f"{base}/in", "at"):
            stateful.run_available(budget.budgeted(stream, 2, 5, 400, budget.SHARDS, 7_200_000), f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.parquet(f"{base}/out")


FAMILY.add("stream_budget", stream_budget)


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as deliveries an hour apart: tasks come again, and some are unsigned, forged, late, without a task or no JSON."""
    page = table(spark, folder, "pages").select("page_id", "url", "html")
    page = page.withColumn("at", NOW + F.col("page_id") * 3_600_000)
    task = F.when(F.col("page_id") % 19 != 4, F.concat(F.lit("task-"), (F.col("page_id") % 60).cast("string")))
    stamp = (F.col("at") - F.when(F.col("page_id") % 29 == 6, intake.SKEW_MS + 1).otherwise(0)).cast("string")
    # One step after another, so that the plan holds the body and its proof once.
    page = page.withColumn("json", F.to_json(F.struct(task.alias("task_id"), F.lit("completed").alias("status"), F.col("url"), F.col("html"))))
    page = page.withColumn("body", F.when(F.col("page_id") % 23 == 5, F.concat(F.lit("{"), "json")).otherwise(F.col("json"))).withColumn("signed_at", stamp)
    proof = intake.hmac_sha256(SECRET, F.encode(F.concat("signed_at", F.lit("."), "body"), "UTF-8"))
    signature = F.when(F.col("page_id") % 17 == 3, F.lit("00ff")).when(F.col("page_id") % 31 != 7, F.concat(F.lit("00, "), F.upper(proof)))
    return page.select(F.col("page_id").alias("delivery"), "at", "signed_at", signature.alias("signature"), F.octet_length("html").cast("long").alias("stated_bytes"), "body")


def _taken(spark: SparkSession, folder: str) -> intake.Intake:
    base = folder_of(spark, "intake")
    tables = intake.Intake(f"{base}/tables").begin(spark)
    work = tables.batch([SECRET], MOST)
    for stream in arrivals(_deliveries(spark, folder), f"{base}/in", "delivery"):
        sweeps.run(stream, work, f"{base}/state")
    return tables


def webhook_intake(spark: SparkSession, folder: str) -> DataFrame:
    """All four tables together."""
    return _taken(spark, folder).read(spark).select("delivery", "verdict", "reason", "task", F.when(F.col("verdict") == "accepted", F.size("results")).cast("long").alias("pages"))


_intake = f"""WITH RECURSIVE d AS (
  SELECT page_id AS delivery, page_id, url, html, 'task-' || page_id % 60 AS task, {NOW} + page_id * 3600000 AS came,
    strlen(json_object('task_id', CASE WHEN page_id % 19 <> 4 THEN 'task-' || page_id % 60 END, 'status', 'completed', 'url', url, 'html', html)::VARCHAR) - CASE WHEN page_id % 19 = 4 THEN 15 ELSE 0 END + CASE WHEN page_id % 23 = 5 THEN 1 ELSE 0 END AS size FROM pages
), r AS (
  SELECT *, CASE WHEN greatest(size, strlen(html)) > {MOST} THEN 'too large' WHEN page_id % 31 = 7 AND page_id % 17 <> 3 THEN 'no signature' WHEN page_id % 29 = 6 THEN 'expired' WHEN page_id % 17 = 3 THEN 'forged' WHEN page_id % 23 = 5 THEN 'no JSON' WHEN page_id % 19 = 4 THEN 'no task' END AS reason FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY came) AS k FROM r WHERE reason IS NULL
), f AS (
  SELECT delivery, task, k, came AS kept, true AS first FROM o WHERE k = 1
  UNION ALL SELECT o.delivery, o.task, o.k, CASE WHEN o.came >= f.kept + 2592000000 THEN o.came ELSE f.kept END, o.came >= f.kept + 2592000000 FROM f JOIN o ON o.task = f.task AND o.k = f.k + 1
)
SELECT r.delivery, CASE WHEN reason = 'too large' THEN 'oversized' WHEN reason IS NOT NULL THEN 'malformed' WHEN first THEN 'accepted' ELSE 'repeated' END AS verdict, reason, CASE WHEN reason IS NULL THEN r.task END AS task, CASE WHEN reason IS NULL AND first THEN 1 END::BIGINT AS pages
FROM r LEFT JOIN f USING (delivery)"""
FAMILY.add("webhook_intake", webhook_intake, _intake)
FAMILY.add(
    "webhook_pages",
    lambda s, f: intake.pages(_taken(s, f).read(s, "accepted"), HOSTS).groupBy("outcome").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n")),
    f"SELECT CASE WHEN regexp_matches(lower(url), '^[a-z]+://([^/?#@]*@)?([^/?#:]+\\.)?example\\.com([/?#:]|$)') AND trim(regexp_replace(html, '\\s+', ' ', 'g')) <> '' THEN 'success' ELSE 'skip' END AS outcome, count(DISTINCT task) AS tasks, count(*) AS n FROM (SELECT i.*, url, html FROM ({_intake}) i JOIN pages ON page_id = delivery) WHERE verdict = 'accepted' GROUP BY 1",
)


def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Users with failing events, counted over three arrivals; of each user the last count."""
    base = folder_of(spark, "dead_letters")
    failing = table(spark, folder, "events").where("event_type = 'error' OR event_id % 9 = 0").select("event_id", F.col("user_id").alias("key"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for stream in arrivals(failing, f"{base}/in", "event_id"):
        counted = stateful.dead_letters(stream.select("key"))
        counted.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("key long, failures long, status string, batch long").parquet(f"{base}/out")
    last = rows.groupBy("key").agg(F.max(F.struct("failures", "status")).alias("l"))
    return last.select("key", "l.failures", "l.status")


FAMILY.add("stream_dead_letters", stream_dead_letters, "SELECT user_id AS key, count(*) AS failures, CASE WHEN count(*) >= 2 THEN 'abandoned' ELSE 'pending' END AS status FROM events WHERE event_type = 'error' OR event_id % 9 = 0 GROUP BY user_id")


def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by type of the windows that the watermark has closed at the end."""
    base = folder_of(spark, "windows")
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    for stream in arrivals(events, f"{base}/in", "at"):
        stateful.run_available(stateful.windowed_counts(stream), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


FAMILY.add(
    "stream_windowed_counts",
    stream_windowed_counts,
    """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w, m WHERE start + INTERVAL 1 HOUR <= mark GROUP BY start, event_type""",
)
