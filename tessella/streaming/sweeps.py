"""Sweeps over a stream of rows that mark some of them in a stored table, and can be resumed.

A folder holds ``changes`` (a folder for each batch, with the rows that it
has marked) and ``counters`` (a folder for each batch, written last).  A batch
that is run again after a failure sees the marks of earlier batches only and
writes its own folders anew, so it leaves what an undisturbed run leaves.
The cursor is the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import policy

COUNTERS = ("examined", "flagged", "already_stale", "skipped")
_START = -1


@dataclass(frozen=True)
class Marks:
    """The stored table of marks below ``path`` for keys of a Spark type."""

    path: str
    kind: str = "long"

    def begin(self, spark: SparkSession) -> Marks:
        """Empty tables, unless they are there already."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counters/batch={_START}")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            spark.createDataFrame([], f"key {self.kind}").write.mode("overwrite").parquet(f"{self.path}/changes/batch={_START}")
            spark.createDataFrame([(0,) * len(COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS)).write.mode("overwrite").parquet(f"{self.path}/counters/batch={_START}")
        return self

    def marked(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """key and batch of the rows marked by finished batches, or by batches before one."""
        rows = spark.read.schema(f"key {self.kind}, batch long").parquet(f"{self.path}/changes")
        if before is not None:
            return rows.where(F.col("batch") < before)
        return rows.join(self.counters(spark).select("batch"), "batch", "left_semi")

    def counters(self, spark: SparkSession) -> DataFrame:
        """The counters of each finished batch."""
        return spark.read.schema(", ".join(f"{c} long" for c in COUNTERS) + ", batch long").parquet(f"{self.path}/counters")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: the counters of the sweep so far and the batches it has taken."""
        return self.counters(spark).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count(F.when(F.col("batch") > _START, 1)).alias("batches"))


def staleness(rows: DataFrame, marked: DataFrame, now: int, key: str = "doc_id", status: str = "status", stale: str = "stale", crawled: str = "crawled", tier: str = "tier") -> DataFrame:
    """key and outcome (flagged, already_stale or skipped) of every row.

    Only retrievable statuses are looked at; of these, rows with the flag or
    a mark count as stale already, aged ones are flagged, and others are
    skipped.  Rows that share a key are one document: the first that would be
    flagged is, and the others find it flagged.
    """
    state = policy.freshness(status, stale, crawled, tier, now)["state"]
    known = rows.withColumn("_key", F.col(key)).join(marked.select(F.col("key").alias("_key"), F.lit(True).alias("_marked")).distinct(), "_key", "left")
    retrievable = F.coalesce(F.col(status).isin(*policy.RETRIEVABLE), F.lit(False))
    flagged = F.coalesce(F.col(stale), F.lit(False)) | F.coalesce("_marked", F.lit(False))
    outcome = F.when(~retrievable, "skipped").when(flagged, "already_stale").when(F.expr(state) == "aged", "flagged").otherwise("skipped")
    found = known.select(F.col(key).alias("key"), outcome.alias("outcome"))
    again = (F.row_number().over(Window.partitionBy("key", "outcome").orderBy(F.lit(0))) > 1) & (F.col("outcome") == "flagged")
    return found.select("key", F.when(again, "already_stale").otherwise(F.col("outcome")).alias("outcome"))


def sweep(marks: Marks, outcomes: Callable[[DataFrame, DataFrame], DataFrame], dry_run: bool = False) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: marks the rows that ``outcomes`` (rows, marked) flags, and counts all of them.

    A dry run counts and marks nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        found = outcomes(rows, marks.marked(spark, number)).persist()
        try:
            changed = found.where("outcome = 'flagged'").select(F.col("key").cast(marks.kind).alias("key"))
            (changed.limit(0) if dry_run else changed).write.mode("overwrite").parquet(f"{marks.path}/changes/batch={number}")
            counts = [F.count(F.when(F.col("outcome") == c, 1)).alias(c) for c in COUNTERS[1:]]
            found.agg(F.count("*").alias("examined"), *counts).write.mode("overwrite").parquet(f"{marks.path}/counters/batch={number}")
        finally:
            found.unpersist()

    return batch


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take all that a stream has now, in its batches, and stop; a later call goes on behind the last whole batch."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
