"""Crawl jobs, settings and migrations as merges of snapshots with changes.

Each function takes whole tables and returns the table after the change.
Changes with a null key have nothing to apply to and add nothing to jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import latest

# States that end a job, and the hours after which a silent one has failed.
ENDED = ("completed", "failed", "cancelled")
SILENT_HOURS = 3
HOUR_MS = 3_600_000


def report_jobs(jobs: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """Jobs (job, status, started_at, completed_at, error) after the last report (job, status, error, at) of each; one that names the present status changes nothing."""
    last = latest(reports, ["job"], "at").select("job", F.col("status").alias("_status"), F.col("error").alias("_error"))
    moved = F.col("_status").isNotNull() & ~F.col("_status").eqNullSafe(F.col("status"))
    return jobs.join(last, "job", "left").select(
        "job", F.when(moved, F.col("_status")).otherwise(F.col("status")).alias("status"), "started_at",
        F.when(moved & F.col("_status").isin(*ENDED), F.lit(now)).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(moved, F.coalesce("_error", "error")).otherwise(F.col("error")).alias("error"),
    )


def fail_silent(jobs: DataFrame, now: int, hours: int = SILENT_HOURS) -> DataFrame:
    """Jobs of which those that run for more than so many hours have failed."""
    late = (F.col("status") == "running") & (now - F.col("started_at") > hours * HOUR_MS)
    error = F.lit(f"no answer after {hours} hours")
    return jobs.withColumns({"status": F.when(late, "failed").otherwise(F.col("status")), "completed_at": F.when(late, F.lit(now)).otherwise(F.col("completed_at")), "error": F.when(late, error).otherwise(F.col("error"))})


def upsert_settings(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """Settings (key, value, section, at) with the last incoming value of each key; a known key keeps its section."""
    new = latest(incoming, ["key"], "at").select("key", F.col("value").alias("_value"), F.col("section").alias("_section"), F.col("at").alias("_at"))
    came = F.col("_at").isNotNull()
    pick = lambda c: F.when(came, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return present.join(new, "key", "full").select("key", pick("value"), F.coalesce("section", "_section").alias("section"), pick("at"))


def count_up(counters: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters (key, value string) with all increments (key, by) added; a value that is no number counts as 0."""
    added = increments.groupBy("key").agg(F.sum("by").alias("_by"))
    joined = counters.join(added, "key", "full")
    total = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.col("_by")
    return joined.select("key", F.when(F.col("_by").isNull(), F.col("value")).otherwise(total.cast("string")).alias("value"))


def reset(status: Column, old: str, new: str) -> Column:
    """A status of which one value goes back to an earlier one."""
    return F.when(status == old, new).otherwise(status)


def migrate_parents(chunks: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk, document, parent_id, parent_text) that refer to parents (parent_id, document, content_hash, text) in place of a text of their own, and all parents.

    Texts equal within a document share one parent, a present one first; ids
    of new ones follow from document and content.
    """
    inline = F.col("parent_id").isNull() & (F.col("parent_text") != "")
    hashed = chunks.withColumn("content_hash", F.when(inline, F.sha2("parent_text", 256)))
    known = parents.groupBy("document", "content_hash").agg(F.min("parent_id").alias("_known"))
    named = hashed.join(known, ["document", "content_hash"], "left")
    made = F.sha2(F.concat_ws("|", F.col("document").cast("string"), "content_hash"), 256)
    own = F.when(F.col("content_hash").isNotNull(), F.coalesce("_known", made))
    new = named.where(F.col("content_hash").isNotNull() & F.col("_known").isNull()).groupBy("document", "content_hash").agg(F.min("parent_text").alias("text"))
    after = named.select("chunk", "document", F.coalesce("parent_id", own).alias("parent_id"), F.when(F.col("content_hash").isNull(), F.col("parent_text")).alias("parent_text"))
    return after, parents.select("parent_id", "document", "content_hash", "text").union(new.select(made, "document", "content_hash", "text"))


def with_answers(hits: DataFrame, answers: DataFrame, now: int, most: int = 2) -> DataFrame:
    """query, id, score, kind and place of hits and the best unexpired prepared answers (query, id, score, expires_at) of each query; of equal scores answers stand first."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    live = answers.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most)
    both = live.select("query", "id", "score", F.lit("answer").alias("kind")).union(hits.select("query", "id", "score", F.lit("hit").alias("kind")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "kind", "id")))
