"""Searches by the inverted-file index of vectors, and measures of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dense, vector_index
from tessella.sources.checkpoints import shared_folder
from tessella.sources.tables import table

from .pairs import Family
from .retrieval import _COSINE

FAMILY = Family()
SHARE = 0.99


def built(spark: SparkSession, folder: str) -> tuple[vector_index.VectorIndex, DataFrame, DataFrame]:
    """An index of all vectors by label, the vectors, and the queries."""
    vectors = table(spark, folder, "embeddings")
    path = f"{shared_folder(spark)}/vector_index/{uuid.uuid4().hex}"
    return vector_index.build(vectors, path, category="label"), vectors, vectors.where("vec_id % 50 = 0")


def vector_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the probes that are enough for 99 % of a sample's neighbours find of the exact ten best of each query."""
    index, vectors, queries = built(spark, folder)
    probes = vector_index.enough_probes(index, queries, 10, SHARE)
    found = vector_index.search(index, queries, 10, probes)
    exact = dense.top_k(queries, vectors, 10).withColumnRenamed("vec_id", "id")
    return vector_index.recall(found, exact).select("query", F.lit(index.cells).alias("cells"), F.lit(probes).alias("probes"), "hits", "wanted", "recall")


def vector_index_category(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of each query's own label with all cells probed, which is exact, joined back to their rows."""
    index, vectors, queries = built(spark, folder)
    found = vector_index.search(index, queries, 10, index.cells, category="label")
    return vector_index.hydrated(found, vectors.select("vec_id", "label")).select("query", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


FAMILY.add("vector_index_recall", vector_index_recall)
FAMILY.add(
    "vector_index_category",
    vector_index_category,
    f"""WITH pairs AS (SELECT q.vec_id AS query, v.vec_id, v.label, {_COSINE} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND v.label = q.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query, vec_id, label, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)


def vector_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """The cosine of each vector with the next one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


FAMILY.add("vector_cosines", vector_cosines, f"SELECT q.vec_id, round({_COSINE}, 6) AS cosine FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1")
_norm = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
FAMILY.add(
    "vectors_normalized",
    lambda s, f: table(s, f, "embeddings").select("vec_id", F.transform(dense.normalized(F.col("embedding")), lambda v: dense.rounded(v, 6)).alias("unit")),
    f"SELECT vec_id, CASE WHEN {_norm} > 0 THEN list_transform(embedding, lambda x: round(x::DOUBLE / {_norm}, 6)) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS unit FROM embeddings",
)
