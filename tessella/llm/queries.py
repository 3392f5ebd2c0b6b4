"""The registered queries of this folder: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tables import table

from . import chat, decontaminate, lattice, licenses, minhash, packing, quality, sharding, simhash, token_counts, trie, wand, warc
from .oracles import ORACLE as ORACLE

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; each machine has them at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path(PIECES))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), shards=40)


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversations(table(spark, folder, "conversations"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.edited_and_near(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(WORD_BPE))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=2)


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return wand.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_chat": op5_chat,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_minhash": op10_minhash,
    "op11_trie": op11_trie,
    "op12_search": op12_search,
    "op13_embeddings": op13_embeddings,
}
