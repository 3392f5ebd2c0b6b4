"""The training-data pipeline: quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, folder) and gives a table that the next one
reads; all but the last give the columns of documents.

In all of them null texts count as empty, an empty table gives no rows, and
columns besides doc_id and text, whatever their names, go on as they are.  A
filtering stage names what it drops by doc_id: rows that share one go together
if one of them is dropped, and rows without one are never dropped for what
they say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, minhash, packing, quality
from tessella.llm.queries import WORD_BPE, tokenizer_path
from tessella.llm.storage import new_path, scratch
from tessella.sources.tables import table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``dropped``; rows without one stay."""
    return docs.join(dropped.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the documents that the discriminant rejects, empty ones among them if their score is below the cut-off; rows repeated whole share their score."""
    scores = quality.classify(docs, table(spark, folder, "labels"))
    return _without(docs, scores.where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document of the least doc_id of each group that shares 80 % of its five-word shingles; rows repeated whole stay once; empty texts are alike with nothing."""
    found = minhash.near_duplicates(docs, shingle=5)
    return _without(docs, found.where("NOT kept")).dropDuplicates(["doc_id", "text"])


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold 80 % of the five-word shingles of a benchmark item; null and empty items are held by none."""
    return _without(docs, decontaminate.contained_items(docs, table(spark, folder, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens, rows repeated or without doc_id like any other; an empty text is its end token."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# A trained classifier and a tokenizer are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
