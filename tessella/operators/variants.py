"""Variants of a search compared over the same stored candidates.

Candidates (query, channel, id, rank) are found once.  A variant is a set of
rows (variant, channel, weight, most): it fuses the channels it names by
reciprocal ranks.  All variants are fused, judged and tallied together, so a
further variant costs its rows and no search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.checkpoints import checkpointed

from .dense import top_k
from .lexical import counted, pieces, words

RRF_K, FINAL = 60, 8
SIZE = 64


def word_vectors(rows: DataFrame, key: str, text: str = "text", size: int = SIZE) -> DataFrame:
    """key and embedding: each word adds the logarithm of its count and one to a place, or takes it away, by its MD5.

    Rows without a word are left out.  Words are counted where a text is read,
    in their order, so equal texts have equal vectors.  A place whose words
    take all away again holds a negative zero.
    """
    split = rows.select(key, words(F.col(text)).alias("words")).where(F.size("words") > 0)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, listed = batch.columns
            row, word, n = counted(pc.list_parent_indices(listed).to_numpy(), pc.list_flatten(listed))
            coded = word.dictionary_encode()
            digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
            place, sign = np.array([int(d[:4], 16) % size for d in digests], np.int64), np.array([1.0 if d[4] <= "7" else -1.0 for d in digests])
            at = coded.indices.to_numpy()
            slot = row * size + place[at]
            sums = np.bincount(slot, sign[at] * np.log1p(n), len(keys) * size)
            sums[slot[sums[slot] == 0]] = -0.0
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * size, pa.int32()), pa.array(sums))], names=[key, "embedding"])

    return split.mapInArrow(embed, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def one_text_each(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and text of the rows that have a key; texts of one key are one text."""
    rows = rows.select(key, text).where(F.col(key).isNotNull())
    several = checkpointed(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if several.isEmpty():
        return rows
    joined = rows.join(several, key, "left_semi").groupBy(key).agg(F.concat_ws(" ", F.collect_list(text)).alias(text))
    return rows.join(several, key, "left_anti").unionByName(joined)


def nearest_texts(queries: DataFrame, docs: DataFrame, k: int, query: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """query, key, score and rank of the k documents whose word vectors are most alike to a query's.

    Documents without a place in common with a query are left out. Words may
    take each other away: a text left without a length has the score NaN with
    all that it has a place in common with, and comes before them.
    """
    asked = word_vectors(one_text_each(queries, query, text), query, text).withColumnRenamed(query, key)
    found = top_k(checkpointed(asked), checkpointed(word_vectors(one_text_each(docs, key, text), key, text)), k, key=key, texts=True)  # both are counted before they are searched
    return found.select(F.col("query").alias(query), key, "score", "rank")


def fused(candidates: DataFrame, variants: DataFrame, final: int = FINAL, k: int = RRF_K) -> DataFrame:
    """variant, query, id, score and rank of the best of each variant and query; equal scores by id."""
    own = candidates.join(F.broadcast(variants), "channel").where(F.col("rank") <= F.col("most"))  # variants are a stated few
    score = F.round(F.sum(F.col("weight") / (k - 1 + F.col("rank"))), 12)
    scored = own.groupBy("variant", "query", "id").agg(score.alias("score"))
    place = Window.partitionBy("variant", "query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= final)


def hits(results: DataFrame, relevant: DataFrame, variants: DataFrame) -> DataFrame:
    """variant, query and hit (whether a relevant id is among the results) for every variant and judged query (of relevant: query, id)."""
    met = results.join(relevant.select("query", "id").distinct(), ["query", "id"], "left_semi").select("variant", "query").distinct().withColumn("hit", F.lit(1))
    every = relevant.select("query").distinct().join(F.broadcast(variants.select("variant").distinct()))
    return every.join(met, ["variant", "query"], "left").select("variant", "query", F.coalesce("hit", F.lit(0)).alias("hit"))


def sign_p(wins: Column, losses: Column) -> Column:
    """The exact two-sided p of a paired permutation test of hits: how likely random signs of the pairs that differ lie as far from even."""
    n = wins + losses
    far = F.abs(wins - losses)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("p"))

    def step(s: Column, i: Column) -> Column:
        own = F.when(F.abs(2 * i - n) >= far, F.exp(s["log"])).otherwise(0.0)
        return F.struct((s["log"] + F.log(F.greatest(n - i, F.lit(1)) / (i + 1))).alias("log"), (s["p"] + own).alias("p"))

    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0).cast("long"), n), start, step, lambda s: s["p"]))


def compared(judged: DataFrame, baseline: str) -> DataFrame:
    """variant, n, hits, wins, losses (queries that only it, or only the baseline, hits) and p of each variant."""
    base = judged.where(F.col("variant") == baseline).select("query", F.col("hit").alias("base"))
    both = judged.join(base, "query")
    count = lambda c: F.sum(c.cast("long"))
    out = both.groupBy("variant").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), count(F.col("hit") > F.col("base")).alias("wins"), count(F.col("hit") < F.col("base")).alias("losses"))
    return out.withColumn("p", F.round(sign_p(F.col("wins"), F.col("losses")), 9))


def within_budget(results: DataFrame, sizes: DataFrame, relevant: DataFrame, cuts: list[int], budgets: list[int], header: int = 200) -> DataFrame:
    """variant, most, budget, n and hits: whether a relevant id is among the first ``most`` results that fit the budget of characters.

    Results are taken by rank; one that does not fit is passed over.  sizes: id and size.
    """
    held = results.join(sizes.select("id", "size"), "id").join(relevant.select("query", "id", F.lit(1).alias("good")).distinct(), ["query", "id"], "left")
    listed = held.groupBy("variant", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "size", F.coalesce("good", F.lit(0)).alias("good")))).alias("all"))
    settings = F.array(*[F.struct(F.lit(m).alias("most"), F.lit(b).alias("budget")) for m in cuts for b in budgets])

    def packed(s: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("good"))

        def take(state: Column, x: Column) -> Column:
            after = state["used"] + x["size"] + header
            fits = after <= s["budget"]
            return F.struct(F.when(fits, after).otherwise(state["used"]).alias("used"), F.when(fits, F.greatest(state["good"], x["good"])).otherwise(state["good"]).alias("good"))

        return F.aggregate(F.slice("all", 1, s["most"]), start, take, lambda state: state["good"])

    each = listed.select("variant", "query", F.explode(F.transform(settings, lambda s: F.struct(s["most"].alias("most"), s["budget"].alias("budget"), packed(s).alias("good")))).alias("s"))
    judged = each.join(relevant.select("query").distinct(), "query", "left_semi")
    return judged.groupBy("variant", "s.most", "s.budget").agg(F.count("*").alias("n"), F.sum("s.good").cast("long").alias("hits"))
