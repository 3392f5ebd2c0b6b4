"""Rollups and comparisons of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: rows that a task groups.
TASK_ROWS = 500_000


def recall(retrieved: Column, truth: Column) -> Column:
    """The share of ``truth`` among ``retrieved``; 1 when nothing is asked for."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.filter(truth, lambda x: F.array_contains(retrieved, x))) / F.size(truth))


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """1 over the place of the first hit, 0 without one; 1 when nothing is asked for."""
    at = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda p: p.isNotNull()))
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.coalesce(1 / at, F.lit(0.0)))


def citation_correctness(urls: Column, hosts: tuple[str, ...]) -> Column:
    """The share of cited URLs on an approved host or below one; 1 without any."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    own = lambda u: F.exists(F.array(*map(F.lit, hosts)), lambda h: (host(u) == h) | F.endswith(host(u), F.concat(F.lit("."), h)))
    return F.when(F.size(urls) == 0, 1.0).otherwise(F.size(F.filter(urls, own)) / F.size(urls))


def unsupported_rate(supported: Column) -> Column:
    """The share of claims that are not supported (an array of booleans); 0 without claims."""
    return F.when(F.size(supported) == 0, 0.0).otherwise(F.size(F.filter(supported, lambda s: ~F.coalesce(s, F.lit(False)))) / F.size(supported))


def judged_rollup(queries: DataFrame) -> DataFrame:
    """recall_at_k, precision_at_k, mrr, total_queries and errors over queries (relevant, retrieved, reciprocal_rank, error)."""
    done = F.col("error").isNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(done, c)), F.lit(0.0)), 4)
    return queries.agg(
        mean((F.col("relevant") > 0).cast("double")).alias("recall_at_k"), mean(F.col("relevant") / F.greatest("retrieved", F.lit(1))).alias("precision_at_k"), mean(F.col("reciprocal_rank")).alias("mrr"),
        F.count("*").alias("total_queries"), F.count("error").alias("errors"),
    )


def golden_join(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Per golden query (query, expected_url, expected_fragment): url_rank, fragment_matched, reciprocal_rank and ndcg over results (query, rank, url, text).

    Results are joined by their query; the first whose URL holds the expected
    one counts.  With one relevant document nDCG is 1 / log2(rank + 1).
    """
    joined = golden.join(results, "query", "left")
    hit = F.col("rank").isNotNull() & F.contains("url", "expected_url")
    found = joined.groupBy("query", "expected_url", "expected_fragment").agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("url_rank"), F.coalesce(F.bool_or(F.contains(F.lower("text"), F.lower("expected_fragment"))), F.lit(False)).alias("fragment_matched"))
    some = F.col("url_rank") > 0
    return found.select("query", "url_rank", "fragment_matched", F.when(some, 1 / F.col("url_rank")).otherwise(0.0).alias("reciprocal_rank"), F.when(some, 1 / F.log2(F.col("url_rank") + 1)).otherwise(0.0).alias("ndcg"))


def alias_relevance(judgements: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, document and grade of judgements (query, url, grade) resolved by aliases (url, document): the largest grade; two documents of one URL are an error."""
    one = aliases.groupBy("url").agg(F.min("document").alias("document"), F.max("document").alias("_other"))
    checked = one.select("url", F.when(F.col("document") == F.col("_other"), F.col("document")).otherwise(F.raise_error(F.concat(F.lit("URL of several documents: "), "url"))).alias("document"))
    return judgements.join(checked, "url").groupBy("query", "document").agg(F.max("grade").alias("grade"))


def baseline_compare(run: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """metric, value, base, delta and regressed of all metrics of a run."""
    joined = run.join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    delta = F.col("value") - F.col("base")
    return joined.select("metric", "value", "base", F.round(delta, 6).alias("delta"), F.coalesce(delta < -tolerance, F.lit(False)).alias("regressed"))


def overlap_recall(exact: DataFrame, approximate: DataFrame, query: str, key: str) -> DataFrame:
    """Per query the share of the exact keys that the approximate ones hold; a key that comes again counts once, and null keys are held by none.

    Both sides are one table that is grouped by its keys, so nothing is held
    for a join, and dealt to so many tasks that each has about ``TASK_ROWS``.
    """
    asked = exact.select(query, key, F.lit(True).alias("_asked"), F.lit(False).alias("_hit"))
    given = approximate.select(query, key, F.lit(False).alias("_asked"), F.lit(True).alias("_hit")).where(F.col(query).isNotNull() & F.col(key).isNotNull())
    rows = asked.unionByName(given)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // TASK_ROWS)
    keys = rows.repartition(tasks, query, key).groupBy(query, key).agg(F.max("_asked").alias("_asked"), F.max("_hit").alias("_hit")).where("_asked")
    return keys.groupBy(query).agg(F.avg(F.col("_hit").cast("double")).alias("recall"))


def extraction_rollup(fixtures: DataFrame) -> DataFrame:
    """By family, by criticality and over all: n, macro_recall (nulls left out), micro_recall (sums) and pass_rate of fixtures (family, criticality, found, wanted, passed)."""
    share = F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted"))
    return (
        fixtures.withColumn("_share", share)
        .groupingSets([[F.col("family")], [F.col("criticality")], []], "family", "criticality")
        .agg(F.count("*").alias("n"), F.round(F.avg("_share"), 6).alias("macro_recall"), F.round(F.sum("found") / F.sum("wanted"), 6).alias("micro_recall"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))
    )


def required_present(text: Column, phrases: Column) -> Column:
    """Those of the phrases that a text holds, both lower-cased with white space and page state names taken as blanks."""
    blanks = "\u00a0|&nbsp;|__(viewstate|eventvalidation)[a-z]*"
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), blanks, " "), "\u200b", ""), r"\s+", " "))
    return F.filter(phrases, lambda p: F.contains(plain(text), plain(p)))


def forbidden_present(text: Column, phrases: Column) -> Column:
    """Those of the phrases that a text holds, names of page state being kept."""
    plain = lambda t: F.trim(F.regexp_replace(F.lower(t), "(\u00a0|&nbsp;|\\s)+", " "))
    return F.filter(phrases, lambda p: F.contains(plain(text), plain(p)))
