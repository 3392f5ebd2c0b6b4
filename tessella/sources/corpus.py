"""JSON Lines, blobs, ledger reports, sitemaps and caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADING_BYTES = 200


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON Lines files, and (line) those lines that don't parse."""
    rows = spark.read.text(path).select(F.col("value").alias("line")).where("trim(line) <> ''")
    parsed = rows.select("line", F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return parsed.where("row._bad IS NULL").select("row.*").drop("_bad"), parsed.where("row._bad IS NOT NULL").select("line")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def add_blobs(rows: DataFrame, content: str, path: str) -> None:
    """Store each distinct content once, by its SHA-256: what ``path`` has is not written again, so that a repeated run adds nothing."""
    spark = rows.sparkSession
    body = F.encode(F.col(content), "UTF-8") if rows.schema[content].dataType.simpleString() == "string" else F.col(content)
    new = rows.where(F.col(content).isNotNull()).select(F.sha2(body, 256).alias("sha256"), body.alias("content")).dropDuplicates(["sha256"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def write_report(ledger: DataFrame, path: str, kind: str = "csv") -> None:
    """A ledger (min_depth, url, ...) in the order of depth and URL as CSV with a header or as JSON Lines; files follow each other in order."""
    ordered = ledger.repartitionByRange("min_depth", "url").sortWithinPartitions("min_depth", "url")
    ordered.write.option("header", "true").format(kind).save(path)


def bounded(rows: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """``rows``; reading one of a key with more than ``most`` rows is an error."""
    over = rows.groupBy(key).count().where(F.col("count") > most).select(key, F.lit(True).alias("_over"))
    joined = rows.join(over, key, "left")
    message = F.concat(F.lit(f"more than {most} rows of "), F.col(key).cast("string"))
    return joined.withColumn("_ok", F.when(F.col("_over"), F.raise_error(message)).otherwise(F.lit(True))).where("_ok").select(*rows.columns)


def sitemap_locs(xml: Column) -> Column:
    """The addresses of a sitemap or sitemap index; comments and CDATA marks are taken off, entities of the five predefined kinds read."""
    plain = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<!\[CDATA\[|\]\]>", "")
    locs = F.regexp_extract_all(plain, F.lit(r"(?s)<(?:[A-Za-z0-9]+:)?loc>\s*(.*?)\s*</"), 1)

    def read(x: Column) -> Column:
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(name), F.lit(sign))
        return x

    return F.filter(F.transform(locs, read), lambda x: x != "")


def sitemap_lines(text: Column) -> Column:
    """The addresses of a text sitemap, one a line."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^https?://"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** is anything, * anything but a slash."""
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(part, re.escape(part)) for part in re.split(r"(\*\*|\*)", glob)) + "$"


def by_globs(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a URL matches an included glob (any if there are none) and no excluded one."""
    hit = lambda globs: F.lit(False) if not globs else url.rlike("|".join(f"({glob_pattern(g)})" for g in globs))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def short_headings(path: Column, most: int = HEADING_BYTES) -> Column:
    """A heading path without entries of more than so many bytes."""
    return F.filter(path, lambda h: F.octet_length(h) <= most)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key the cache doesn't hold."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")
