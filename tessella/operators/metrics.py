"""Retrieval metrics and bootstrap intervals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def ranking_metrics(ranked: DataFrame, relevant_total: DataFrame, query: str, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query: precision, recall, hit, reciprocal rank, average precision and nDCG at each cut-off.

    ``ranked`` has query, rank (from 1) and gain (0: not relevant);
    ``relevant_total`` has query and total.  Precision divides by what was
    returned, and gains count as 2 ** gain - 1; the ideal list is made of
    gains of 1.
    """
    sofar = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("gain") > 0).cast("int")
    rows = ranked.withColumn("_hit", hit).withColumn("_seen", F.sum("_hit").over(sofar))
    out = []
    for k in cutoffs:
        inside = F.col("rank") <= k
        one = lambda c, i=inside: F.when(i, c)
        out += [
            (F.sum(one(F.col("_hit"))) / F.greatest(F.lit(1), F.sum(one(F.lit(1))))).alias(f"p{k}"),
            F.sum(one(F.col("_hit"))).alias(f"hits{k}"),
            F.coalesce(F.max(one(F.col("_hit") / F.col("rank"))), F.lit(0.0)).alias(f"rr{k}"),
            F.sum(one(F.col("_hit") * F.col("_seen") / F.col("rank"))).alias(f"sp{k}"),
            F.sum(one((F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1))).alias(f"dcg{k}"),
        ]
    wide = rows.groupBy(query).agg(*out).join(relevant_total, query)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("total").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    columns = [F.col(query)]
    for k in cutoffs:
        some = F.col("total") > 0
        columns += [
            F.col(f"p{k}"), F.when(some, F.col(f"hits{k}") / F.col("total")).otherwise(0.0).alias(f"recall{k}"), (F.col(f"hits{k}") > 0).cast("double").alias(f"hit{k}"),
            F.col(f"rr{k}"), F.when(some, F.col(f"sp{k}") / F.least(F.col("total"), F.lit(k))).otherwise(0.0).alias(f"ap{k}"), F.when(some, F.col(f"dcg{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg{k}"),
        ]
    return wide.select(*columns)


def resampled(rows: DataFrame, group: str, key: str, value: str, resamples: int, seed: int) -> DataFrame:
    """group, mean and means (of each resample, in order): every row has a Poisson weight of mean 1 in each resample.

    A row's weights follow from its key and the seed alone, so they are drawn
    where the row is and don't depend on how rows are dealt; tasks send sums
    for each resample, and no group is held whole.
    """
    kind = rows.schema[group].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby(group, dropna=False):
                sums = np.zeros((2, resamples))
                for k, v in zip(own[key], own[value].astype(float), strict=True):
                    weights = np.random.default_rng([seed, zlib.crc32(str(k).encode())]).poisson(1.0, resamples)
                    sums += [weights, weights * v]
                yield pd.DataFrame({group: [name] * resamples, "r": np.arange(resamples), "w": sums[0], "s": sums[1]})

    parts = rows.where(F.col(value).isNotNull()).select(group, key, value).mapInPandas(add, f"`{group}` {kind}, r int, w double, s double")
    means = parts.groupBy(group, "r").agg((F.sum("s") / F.greatest(F.sum("w"), F.lit(1.0))).alias("m")).groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("means"))
    return means.join(rows.groupBy(group).agg(F.avg(value).alias("mean")), group)


def bootstrap_mean(rows: DataFrame, group: str, key: str, value: str, resamples: int = 5000, seed: int = 7) -> DataFrame:
    """group, mean and the 95 % interval of the mean by resampling; a group is one strategy's values, one for each key."""
    out = resampled(rows, group, key, value, resamples, seed)
    at = lambda share: F.element_at("means", min(resamples - 1, int(share * resamples)) + 1)
    return out.select(group, "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def paired_bootstrap(rows: DataFrame, group: str, key: str, a: str, b: str, resamples: int = 5000, seed: int = 7) -> DataFrame:
    """group, mean difference b - a, its 95 % interval and the share of resamples in which b is better."""
    out = resampled(rows.withColumn("_difference", F.col(b) - F.col(a)), group, key, "_difference", resamples, seed)
    at = lambda share: F.element_at("means", min(resamples - 1, int(share * resamples)) + 1)
    better = F.size(F.filter("means", lambda m: m > 0)) / F.lit(resamples)
    return out.select(group, F.col("mean").alias("difference"), at(0.025).alias("low"), at(0.975).alias("high"), better.alias("improved"))
