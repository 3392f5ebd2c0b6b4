"""Crawl-stage and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import chunking, html, url_policy
from tessella.operators import crawl
from tessella.sources.checkpoints import shared_folder
from tessella.sources.tables import table
from tessella.streaming import stateful

from .pairs import Family

FAMILY = Family()


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.rate_windows(table(spark, folder, "events"), "user_id", "ts", limit=2, window_s=7200.0)


_rates_sql = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, us AS start, 1 AS used, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN f.start < e.us - 7200000000 THEN e.us ELSE f.start END, CASE WHEN f.start < e.us - 7200000000 THEN 1 WHEN f.used + 1 <= 2 THEN f.used + 1 ELSE f.used END, f.start < e.us - 7200000000 OR f.used + 1 <= 2 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f"""
FAMILY.add("rate_windows", _rates, _rates_sql)
FAMILY.add("near_pages", lambda s, f: crawl.near_pages(table(s, f, "documents")))
_edges = "SELECT page_id AS parent, page_id * 3 % 97 AS child FROM pages"


def _bfs(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "pages").select(F.col("page_id").alias("parent"), (F.col("page_id") * 3 % 97).alias("child"))
    return crawl.breadth_first(edges, spark.createDataFrame([(1,), (100,)], "url long"), 3)


FAMILY.add("frontier_levels", _bfs, f"WITH RECURSIVE e AS ({_edges}), r AS (SELECT url, 0 AS depth FROM (VALUES (1), (100)) v(url) UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.url WHERE r.depth < 3) SELECT CAST(url AS BIGINT) AS url, min(depth) AS depth FROM r GROUP BY url")


def _streamed(spark: SparkSession, folder: str, build, mode: str = "append") -> DataFrame:
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/event[s].parquet")
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    stateful.run_available(build(stream), f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


FAMILY.add("stream_rate_limit", lambda s, f: _streamed(s, f, lambda e: stateful.rate_limited(e, 2, 7200.0)), _rates_sql)
FAMILY.add("stream_idempotent", lambda s, f: _streamed(s, f, lambda e: stateful.idempotent(e)).groupBy("event_type").count().withColumnRenamed("count", "n"), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
FAMILY.add("chunks", lambda s, f: chunking.chunks(table(s, f, "documents").select(F.concat(F.lit("doc://"), "doc_id").alias("url"), "text")))
FAMILY.add("urls_by_policy", lambda s, f: table(s, f, "pages").select("page_id", url_policy.canonical(F.col("url")).alias("url")))
FAMILY.add("pages_as_markdown", lambda s, f: html.extracted(table(s, f, "pages")))
