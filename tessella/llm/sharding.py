"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

In a uniformly random order of all rows, cut into shards of fixed sizes, the
counts of rows that go from each input partition to each shard follow the
multivariate hypergeometric law.  These counts are drawn first; then each
partition permutes its own rows and deals them out by its row of the matrix,
and each shard permutes what it has got.  No row order is needed beyond one
partition, and sizes are exact whatever the data.

The matrix is never held whole.  It is drawn down a binary tree over the
partitions: a node holds how many rows below it go to each shard and splits
that vector between its halves.  Each node draws with a seed of its own, so
any task finds the row of its partition from the partition sizes alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

ROWS_A_BUCKET = 100_000
_HALF_LOG_2_PI = 0.5 * math.log(2 * math.pi)


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes of ``shards`` shards that differ by one at most."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of each color are among ``n`` drawn without replacement; numpy's own bound on counts is avoided."""
    out, left = np.zeros_like(colors), int(colors.sum())
    for k, c in enumerate(colors.tolist()):
        if not n:
            break
        left -= c
        if not left:
            out[k] = n
            break
        if c:
            out[k] = _one(rng, c, left, n)
            n -= int(out[k])
    return out


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log probability of x successes among n, by Loader's expansion about the mode, which large counts don't make inexact."""
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))

    def rest(k: int) -> float:
        """log k! less its Stirling formula."""
        return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - _HALF_LOG_2_PI if k < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * k * k)) / (k * k)) / (k * k)) / k

    def deviance(k: int, mean: float) -> float:
        """k log(k / mean) + mean - k."""
        u = (k - mean) / mean
        if abs(u) > 0.1:
            return k * math.log(k / mean) + mean - k
        # (1 + u) log(1 + u) - u as its series
        term, total, j = u * u, 0.0, 2
        while abs(term) > 1e-20 * abs(total) and j < 60:
            total += term / (j * (j - 1)) * (1 if j % 2 == 0 else -1)
            term *= u
            j += 1
        return mean * total

    away = n - x
    root = 0.5 * (math.log(n) - math.log(x) - math.log(away)) - _HALF_LOG_2_PI
    return rest(n) - rest(x) - rest(away) - deviance(x, n * p) - deviance(away, n * (1 - p)) + root


def _one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good.

    Beyond numpy's range: the hypergeometric law is that of one of two
    binomials with equal chances, given that both sum to n.  So the count of
    the rarer kind is drawn as a binomial and taken with the probability that
    the other kind makes up the rest, relative to its most likely count; seven
    draws of ten are taken at the worst.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if n in (0, good + bad):
        return good if n else 0
    if good > bad:
        return n - _one(rng, bad, good, n)
    p = n / (good + bad)
    top = _log_binomial(min(bad, int((bad + 1) * p)), bad, p)
    while True:
        took = int(rng.binomial(good, p))
        if 0 <= n - took <= bad and math.log(1 - rng.random()) <= _log_binomial(n - took, bad, p) - top:
            return took


def matrix_row(sums: np.ndarray, shards: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The row of one partition; ``sums``: prefix sums of the partition sizes, from 0."""
    lo, hi, held = 0, len(sums) - 1, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _draw(rng, held, int(sums[mid] - sums[lo]))
        held, lo, hi = (left, lo, mid) if part < mid else (held - left, mid, hi)
    return held


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 7, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` with its shard and its place there.

    Columns: ``key``, size (UTF-8 bytes of the text and 16), text_crc32, law
    ('rows'), shard, slot, grown_shard (null: another shard count deals all
    rows anew), and the columns named in ``carry``.

    Shard sizes differ by one at most.  Rows with equal texts are rows like
    any other and may go to different shards: a uniform shuffle knows no
    groups; text_crc32 names the group of a row.  Null texts count as empty, null keys
    and repeated rows are rows like any other, ties in the random order are
    broken by the row's place in the input, an empty table gives no rows, and columns
    other than those named are left alone.  The driver holds one count for
    each input partition.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = stored(
        docs.select(
            F.col(key),
            (F.octet_length(body).cast("long") + 16).alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_at"),
            *([F.struct(*carry).alias("_carry")] if carry else []),
        ),
        "sharding",
    )
    sizes = {r["_part"]: r["count"] for r in base.groupBy("_part").count().collect()}
    parts = sorted(sizes)
    sums = np.cumsum([0, *(sizes[p] for p in parts)])
    total = int(sums[-1])
    goal = shard_sizes(total, shards)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {p: i for i, p in enumerate(parts)}
        for pdf in batches:
            cuts = [np.cumsum(matrix_row(sums, goal, place[p], seed)).tolist() for p in pdf["_part"]]
            yield pd.DataFrame({"_part": pdf["_part"], "_cuts": cuts})

    matrix = base.select("_part").distinct().mapInPandas(rows_of, "_part int, _cuts array<long>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_at"), "_at")
    dealt = (
        base.withColumn("_rank", F.row_number().over(local) - 1)
        .join(matrix, "_part")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))))
        .drop("_cuts", "_rank")
    )
    # The second permutation: shards are cut into buckets of the random order, so that none is sorted in one task.
    buckets = max(8, total // shards // ROWS_A_BUCKET)
    again = F.xxhash64(F.lit(seed + 1), "_at")
    dealt = stored(dealt.withColumn("_mix", again).withColumn("_bucket", F.pmod(again, F.lit(buckets)).cast("int")), "dealt")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_mix", "_at")
    return (
        dealt.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_bucket"])
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("_start") + F.col("_rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *[F.col("_carry").getField(c).alias(c) for c in carry],
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7, text: str = "text", key: str = "doc_id") -> None:
    """Write the shuffled rows with all their columns, one folder for each shard, in files ordered by slot."""
    fixed = {key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    plain = docs.select(*[F.col(c).alias(f"in_{c}" if c in fixed - {key} else c) for c in docs.columns])
    out = assign_shards(plain, shards, seed, text, key, [c for c in plain.columns if c != key])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
