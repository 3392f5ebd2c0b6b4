"""Near-duplicate pages, breadth-first frontiers and rate windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.simhash64 import hamming, simhash64
from tessella.sources.checkpoints import checkpointed


MOST_RATIO = 1.43


def near_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 6, least_words: int = 120, blocks: int = 8) -> DataFrame:
    """Each document with the least other key within the radius, if any: key, words, duplicate_of.

    Equal fingerprints count as one.  Of ``blocks`` blocks two fingerprints
    within the radius have all but ``radius`` in common at least, so there is
    a table for each choice of so many; more blocks make more tables of
    smaller buckets.  Texts of fewer words, and pairs whose word counts differ
    by more than 0.7 to 1.43, are no duplicates: word counts are put into
    classes of that ratio, a text enters its own and the next one, and two
    texts meet in the larger of their classes only.  Fingerprints are computed
    once and stored.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits of the radius")
    prints = docs.select(F.col(key).alias("id"), simhash64(F.col(text)).alias("s")).select("id", F.col("s.fp").alias("fp"), F.col("s.words").alias("words"))
    prints = checkpointed(prints)
    large = prints.where(F.col("words") >= least_words).groupBy("fp", "words").agg(F.min("id").alias("id"))
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tables = F.array(*[F.xxhash64(F.lit(i), *[block[k] for k in chosen]) for i, chosen in enumerate(combinations(range(blocks), blocks - radius))])
    own = F.floor(F.log(F.col("words")) / math.log(MOST_RATIO)).cast("int")
    classed = large.withColumn("own", own).withColumn("class", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    banded = classed.select("id", "fp", "words", "own", "class", F.explode(tables).alias("bucket"))
    other = banded.select(F.col("id").alias("first"), F.col("fp").alias("_fp"), F.col("words").alias("_words"), F.col("own").alias("_own"), "class", "bucket")
    ratio = F.col("words") / F.col("_words")
    near = (F.col("first") < F.col("id")) & (F.greatest("own", "_own") == F.col("class")) & (hamming(F.col("fp"), F.col("_fp")) <= radius) & ratio.between(0.70, MOST_RATIO)
    pairs = banded.join(other, ["bucket", "class"]).where(near)
    nearest = pairs.groupBy("fp", "words").agg(F.min("first").alias("near"))
    same = large.select("fp", "words", F.col("id").alias("keeper"))
    out = prints.join(same, ["fp", "words"], "left").join(nearest, ["fp", "words"], "left")
    return out.select(F.col("id").alias(key), "words", F.coalesce("near", F.when(F.col("keeper") < F.col("id"), F.col("keeper"))).alias("duplicate_of"))


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """url and the least depth at which links from the seeds lead to it, up to ``depth``; edges: parent, child."""
    found = seeds.select("url", F.lit(0).alias("depth")).distinct()
    front = found
    for level in range(1, depth + 1):
        front = edges.join(front, edges.parent == front.url, "left_semi").select(F.col("child").alias("url")).distinct().join(found, "url", "left_anti").select("url", F.lit(level).alias("depth"))
        front = checkpointed(front)
        found = found.union(front)
    return found


def rate_windows(requests: DataFrame, user: str, time: str, limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """Whether each request is allowed: a user's window starts anew when it is older than ``window_s``, denied ones don't count.

    A user's requests are dealt with in order; the window is a state and no
    tumbling one.  Batches of a user are handed on in time order, so no group
    is held whole.
    """
    kind = requests.schema[user].dataType.simpleString()
    ordered = requests.select(F.col(user).alias("user"), F.col("event_id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).repartition("user").sortWithinPartitions("user", "at", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, used = None, 0, 0
        for pdf in batches:
            allowed = []
            for u, at in zip(pdf["user"], pdf["at"], strict=True):
                if u != current or start < at - window_s * 1e6:
                    current, start, used = u, at, 0
                ok = used + 1 <= limit
                used += ok
                allowed.append(ok)
            yield pdf[["user", "event_id"]].assign(allowed=allowed)

    return ordered.mapInPandas(fold, f"user {kind}, event_id long, allowed boolean").withColumnRenamed("user", user)
