"""Deliveries of crawl results: one checkpointed pass into four tables.

Each delivery (delivery, at, signed_at, signature, stated_bytes, body) gets a
verdict, checked in this order: too large as stated or as it is; without
signature headers; signed too long before or after it came; signed with no
known secret; no JSON object; without a task; a task that came within the last
thirty days; else accepted.  A batch of the stream is one write into a folder
of its own, parted into the tables ``accepted``, ``oversized``, ``malformed``
(with the reason) and ``repeated``, anew if the batch is run again, and
deliveries that an earlier batch has written are passed over, so that nothing
changes when all of them come again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a body, milliseconds between signature and delivery, days for which a task counts as known.
MOST_BYTES, SKEW_MS, KNOWN_MS = 10_485_760, 5 * 60_000, 30 * 86_400_000
TABLES = ("accepted", "oversized", "malformed", "repeated")
ROW = "delivery long, at long, verdict string, reason string, task string, status string, results array<struct<url: string, media_type: string, content: string, title: string, etag: string, last_modified: string>>"
COLUMNS = [c.split()[0] for c in ROW.split(", ", 6)]
_RESULT = "url STRING, media_type STRING, markdown STRING, html STRING, text STRING, metadata STRUCT<title: STRING>, headers STRUCT<etag: STRING, `last-modified`: STRING>"
_BODY = f"task_id STRING, job_id STRING, status STRING, {_RESULT}, data STRUCT<results: ARRAY<STRUCT<{_RESULT}>>>, results ARRAY<STRUCT<{_RESULT}>>, _corrupt STRING"


def hmac_sha256(secret: str, message: Column) -> Column:
    """The lower-case hexadecimal HMAC of a binary column, by two rounds of SHA-256 over built-in functions."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C)]
    return F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], message), 256))), 256)


def signed(secrets: list[str], signed_at: Column, signature: Column, body: Column) -> Column:
    """Whether one of the comma-separated signatures is that of "signed_at.body" under one of the secrets."""
    message = F.encode(F.concat(signed_at, F.lit("."), body), "UTF-8")
    found = F.transform(F.split(signature, ","), lambda s: F.lower(F.trim(s)))
    return F.arrays_overlap(found, F.array(*[hmac_sha256(s, message) for s in secrets]))


def _first(*values: Column) -> Column:
    """The first value that is neither null nor empty, or null."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _page(r: Column, url: Column) -> Column:
    """A result with its content: Markdown (of an object its fit or raw form), else HTML, else text."""
    markdown = r["markdown"]
    of_object = _first(F.get_json_object(markdown, "$.fit_markdown"), F.get_json_object(markdown, "$.raw_markdown"))
    content = _first(F.when(markdown.startswith("{"), of_object).otherwise(markdown), r["html"], r["text"])
    title = F.coalesce(_first(r["metadata"]["title"]), F.lit("Untitled"))
    return F.struct(
        _first(r["url"], url).alias("url"), r["media_type"].alias("media_type"), F.coalesce(content, F.lit("")).alias("content"), title.alias("title"),
        _first(r["headers"]["etag"]).alias("etag"), _first(r["headers"]["last-modified"]).alias("last_modified"),
    )


def verdicts(deliveries: DataFrame, secrets: list[str], most_bytes: int = MOST_BYTES, skew_ms: int = SKEW_MS) -> DataFrame:
    """delivery, at, verdict (accepted, oversized or malformed), reason, task, status and results of each delivery; repeats aren't looked for."""
    body = F.coalesce("body", F.lit(""))
    large = (F.coalesce("stated_bytes", F.lit(0)) > most_bytes) | (F.octet_length(body) > most_bytes)
    missing = F.coalesce(_first(F.col("signed_at"), F.lit("")), F.lit("")).eqNullSafe("") | F.coalesce(F.col("signature"), F.lit("")).eqNullSafe("")
    stamp = F.regexp_extract(F.col("signed_at"), r"^\s*([+-]?[0-9]{1,18})", 1)
    off = F.abs(F.col("at") - F.when(stamp != "", stamp.cast("long")))
    expired = F.coalesce(off > skew_ms, F.lit(True))
    forged = ~F.coalesce(signed(secrets, F.col("signed_at"), F.col("signature"), body), F.lit(False))
    # A large body isn't parsed.
    parsed = deliveries.withColumn("p", F.when(~large, F.from_json(body, _BODY, {"columnNameOfCorruptRecord": "_corrupt"})))
    p = F.col("p")
    task = _first(p["task_id"], p["job_id"])
    broken = p.isNull() | p["_corrupt"].isNotNull() | (F.trim(body) == "")
    reason = F.when(large, "too large").when(missing, "no signature").when(expired, "expired").when(forged, "forged").when(broken, "no JSON").when(task.isNull(), "no task")
    # A column of its own, so that the plan holds the checks once and not in each column that asks for them.
    parsed = parsed.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNull(), "accepted").when(F.col("reason") == "too large", "oversized").otherwise("malformed")
    alone = F.struct(*[p[c].alias(c) for c in ("url", "media_type", "markdown", "html", "text", "metadata", "headers")])
    results = F.coalesce(p["data"]["results"], p["results"], F.when(_first(p["url"]).isNotNull(), F.array(alone)), F.array())
    pages = F.transform(results, lambda r: _page(r, p["url"]))
    ok = F.col("reason").isNull()
    out = parsed.select("delivery", "at", verdict.alias("verdict"), "reason", F.when(ok, task).alias("task"), F.when(ok, p["status"]).alias("status"), F.when(ok, pages).alias("results"))
    return out


def repeats(rows: DataFrame, known: DataFrame, known_ms: int = KNOWN_MS) -> DataFrame:
    """task, at and delivery of those of ``rows`` (accepted so far) that are the first of their task, or the first after its thirty days.

    known: task and at of tasks accepted before.  Rows are sorted by task and
    time within their partition and read once in that order, so a task keeps
    one time in memory, and the plan is the same however long the rows span.
    """
    last = known.groupBy("task").agg(F.max("at").alias("_at"))
    left = rows.select("task", "at", "delivery").join(last, "task", "left").where(f"_at IS NULL OR at >= _at + {known_ms}").drop("_at")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, until = None, None
        for batch in batches:
            taken = []
            for k, (name, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if until is None or name != task or at >= until:
                    task, until = name, at + known_ms
                    taken.append(k)
            yield batch.take(pa.array(taken, pa.int64()))

    return left.repartition("task").sortWithinPartitions("task", "at", "delivery").mapInArrow(firsts, "task string, at long, delivery long")


@dataclass(frozen=True)
class Intake:
    """The four tables below ``path``."""

    path: str

    def read(self, spark: SparkSession, *names: str, before: int | None = None) -> DataFrame:
        """The rows of some of the tables (none named: of all), of all batches or of those before one."""
        rows = spark.read.schema(ROW + ", batch long").parquet(self.path).select(*COLUMNS, "batch").where("batch >= 0")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.where(F.col("verdict").isin(*names)) if names else rows

    def begin(self, spark: SparkSession) -> Intake:
        """Empty tables, unless they are there already."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=-1")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            spark.createDataFrame([], ROW).drop("verdict").write.mode("overwrite").parquet(f"{self.path}/batch=-1/verdict={TABLES[0]}")
        return self

    def batch(self, secrets: list[str], most_bytes: int = MOST_BYTES, known_ms: int = KNOWN_MS) -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` calls."""

        def work(deliveries: DataFrame, number: int) -> None:
            spark = deliveries.sparkSession
            earlier = self.read(spark, before=number)
            new = deliveries.dropDuplicates(["delivery"]).join(earlier.select("delivery"), "delivery", "left_anti")
            judged = verdicts(new, secrets, most_bytes).persist()
            try:
                fresh = judged.where("verdict = 'accepted'")
                known = earlier.where("verdict = 'accepted'").select("task", "at")
                first = repeats(fresh, known, known_ms).select("delivery", F.lit(True).alias("_first"))
                again = (F.col("verdict") == "accepted") & F.col("_first").isNull()
                rows = judged.join(first, "delivery", "left").withColumn("verdict", F.when(again, "repeated").otherwise(F.col("verdict")))
                # As many files as the rows need, not as many as there are shuffle partitions.
                rows.select(*COLUMNS).hint("rebalance").write.mode("overwrite").partitionBy("verdict").parquet(f"{self.path}/batch={number}")
            finally:
                judged.unpersist()

        return work


def pages(accepted: DataFrame, hosts: list[str]) -> DataFrame:
    """task, url, title, content and outcome (success, or skip: of no host or below one of ``hosts``, or empty) of each result of accepted deliveries; pdf:// addresses have any host."""
    rows = accepted.select("task", F.explode("results").alias("r")).select("task", "r.url", "r.title", "r.content")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    allowed = F.coalesce("url", F.lit("")).startswith("pdf://")
    for h in hosts:
        allowed |= (host == h) | host.endswith(f".{h}")
    empty = F.trim(F.regexp_replace("content", r"\s+", " ")) == ""
    return rows.withColumn("outcome", F.when(allowed & ~empty, "success").otherwise("skip"))
