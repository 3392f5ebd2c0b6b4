"""An inverted-file index of vectors: cells around centroids, of which a search probes the nearest.

A folder holds the index: ``centroids`` (cell, centroid), ``vectors`` in a
folder for each cell (so that a search reads the cells it probes only), and
``sizes`` (cell and the blocks that its vectors are dealt into, so that a
cell of any size is searched in blocks of bounded size).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dense

CELLS, SAMPLE, ROUNDS = 64, 16_384, 12
PROBED_ROWS = 8192


@dataclass(frozen=True)
class VectorIndex:
    path: str
    cells: int
    block_rows: int = dense.BLOCK_ROWS

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{part}")


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of rows of length one: each round takes the mean direction of the rows nearest to each."""
    draw = np.random.default_rng(seed)
    found = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-300), found)
    return found


def _near_cells(rows: DataFrame, centres: np.ndarray, probes: int, others: list[str]) -> DataFrame:
    """``others``, vector, and for each of the ``probes`` nearest cells a row with cell and place (from 1)."""
    held = rows.sparkSession.sparkContext.broadcast(centres)
    probes = min(probes, len(centres))
    step = max(1, PROBED_ROWS // probes)  # a row becomes as many as it has probes
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                scores = dense.matrix(some.column(0)) @ held.value.T
                order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                took = pa.array(np.repeat(np.arange(some.num_rows), probes))
                found = [pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, probes + 1), some.num_rows), pa.int32())]
                yield pa.RecordBatch.from_arrays([*[c.take(took) for c in some.columns], *found], names=["vector", *others, "cell", "place"])

    return rows.select("vector", *others).mapInArrow(near, f"vector array<double>, {kinds}, cell int, place int")


def _centres(spark: SparkSession, index: VectorIndex) -> np.ndarray:
    rows = index.read(spark, "centroids").orderBy("cell").collect()  # as many as there are cells
    return np.array([r["centroid"] for r in rows])


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", category: str | None = None, cells: int = CELLS, sample: int = SAMPLE, block_rows: int = dense.BLOCK_ROWS) -> VectorIndex:
    """Index all rows of ``vectors`` that have a vector; their vectors must have one length.

    The centroids are fitted on ``sample`` rows, those of the least hashes of
    the key; every row is then put into the cell of its nearest centroid.
    """
    spark = vectors.sparkSession
    rows = dense.usable(vectors, key, vector, "id", category)
    held = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    if not held.num_rows:
        raise ValueError("there is no vector to index")
    centres = centroids(dense.matrix(held.column("vector")), cells)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    placed = _near_cells(rows, centres, 1, ["id", "category"]).drop("place")
    # Blocks are by a hash of fixed range, cut to a cell's number of blocks when it is searched.
    placed.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")).repartition("cell", F.col("slot") % 64).write.partitionBy("cell").parquet(f"{path}/vectors")
    found = VectorIndex(path, len(centres), block_rows)
    sizes = found.read(spark, "vectors").groupBy("cell").agg(F.count("*").alias("n"))
    sizes.select("cell", "n", dense.blocks(F.col("n"), block_rows).alias("parts")).coalesce(1).write.parquet(f"{path}/sizes")
    return found


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", category: str | None = None, query_rows: int = dense.QUERY_ROWS) -> DataFrame:
    """The k best vectors of the ``probes`` cells nearest to each query: query, id, score, rank.

    Vectors of another category than a query that has one are passed over
    before the k best are taken.  All cells probed, the result is exact.
    """
    spark = queries.sparkSession
    asked = dense.usable(queries, key, vector, "query", category)
    asked_parts = dense.blocks(queries.count(), query_rows)
    sizes = index.read(spark, "sizes").select("cell", "parts")  # a row for each cell
    asked = _near_cells(asked, _centres(spark, index), probes, ["query", "category"]).join(F.broadcast(sizes), "cell")
    asked = asked.withColumn("asked", dense.dealt("query", asked_parts)).withColumn("block", dense.every(F.col("parts")))
    own = index.read(spark, "vectors").join(F.broadcast(asked.select("cell").distinct() if probes < index.cells else sizes.select("cell")), "cell", "left_semi")
    own = own.join(F.broadcast(sizes), "cell").withColumn("block", F.col("slot") % F.col("parts")).withColumn("asked", dense.every(asked_parts))
    return dense.best_in_blocks(own, asked, ["cell", "block", "asked"], k)


def enough_probes(index: VectorIndex, queries: DataFrame, k: int, share: float = 0.99, most: int = 256, key: str = "vec_id", vector: str = "embedding", category: str | None = None) -> int:
    """The least number of probes that finds this share of the true neighbours of ``most`` queries, those of the least hashes of the key."""
    spark = queries.sparkSession
    some = queries.orderBy(F.xxhash64(key), key).limit(most)
    exact = search(index, some, k, index.cells, key, vector, category).select("query", "id")
    order = _near_cells(dense.usable(some, key, vector, "query", category), _centres(spark, index), index.cells, ["query"]).select("query", "cell", "place")
    lying = exact.join(index.read(spark, "vectors").select("id", "cell"), "id").join(order, ["query", "cell"])
    counts = {r["place"]: r["count"] for r in lying.groupBy("place").count().collect()}  # as many as there are cells
    total, reached = sum(counts.values()), 0
    for place in sorted(counts):
        reached += counts[place]
        if reached >= share * total:
            return place
    return index.cells


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query, hits (of the exact results that were found), wanted and recall."""
    met = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return met.groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))


def hydrated(found: DataFrame, base: DataFrame, key: str = "vec_id") -> DataFrame:
    """Search results with the columns of their rows of ``base``; results whose row is gone are left out."""
    return found.join(base.withColumnRenamed(key, "id"), "id").withColumnRenamed("id", key)
