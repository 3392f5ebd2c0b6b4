import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import dense, vector_index
from tessella.plans import indexes, registry


def clustered(spark, n=3000, centres=40, size=16, seed=1):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((centres, size)) * 3
    which = draw.integers(0, centres, n)
    which[: n // 3] = 0  # one cell holds a third of the rows
    x = middle[which] + draw.standard_normal((n, size))
    return spark.createDataFrame([(i, v.tolist(), int(w % 5)) for i, (v, w) in enumerate(zip(x, which, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)


def rows_of(df):
    return sorted(map(tuple, df.select("query", "id", "rank").collect()))


@pytest.mark.parametrize("block_rows", [8192, 100])
def test_recall_with_few_probes_and_exact_with_all(spark, tmp_path, block_rows):
    vectors = clustered(spark)
    queries = vectors.where("vec_id % 50 = 0")
    index = vector_index.build(vectors, f"{tmp_path}/{uuid.uuid4().hex}", category="label", cells=40, block_rows=block_rows)
    exact = dense.top_k(queries, vectors, 10, block_rows=block_rows, query_rows=17).withColumnRenamed("vec_id", "id")
    assert index.read(spark, "vectors").count() == 3000
    assert rows_of(vector_index.search(index, queries, 10, 40, query_rows=17)) == rows_of(exact)
    probes = vector_index.enough_probes(index, queries, 10, 0.995)
    found = vector_index.search(index, queries, 10, probes)
    assert probes < 20 and vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.98


def test_exact_results_as_by_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 8))
    x[7] = x[8] = x[9]
    x[20] = 0
    label = np.arange(300) % 3
    table = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))] + [(900, None, 1), (901, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 9)
    for category in (None, "label"):
        want = set()
        for q in range(0, 300, 7):
            order = sorted((i for i in range(300) if i != q and (category is None or label[i] == label[q])), key=lambda i: (-scores[q, i], i))[:5]
            want |= {(q, i, r + 1) for r, i in enumerate(order)}
        got = dense.top_k(table.where("vec_id % 7 = 0 AND vec_id < 300"), table, 5, category=category, block_rows=40, query_rows=9)
        assert {(r["query"], r.vec_id, r["rank"]) for r in got.collect()} == want
    assert dense.top_k(table.where("vec_id < 0"), table, 5).count() == 0 and dense.top_k(table, table.where("vec_id < 0"), 5).count() == 0


def test_recall_of_the_registered_query(spark):
    found = indexes.vector_index_recall(spark, "/root/testdata/sf0.01").agg(F.avg("recall").alias("r"), F.count("*").alias("n"), F.max("probes").alias("p"), F.max("cells").alias("c")).first()
    assert found.r >= 0.98 and found.n == 10 and found.p <= found.c


def test_results_with_their_rows(spark, tmp_path):
    vectors = clustered(spark, 200, 4)
    index = vector_index.build(vectors, f"{tmp_path}/i", cells=4)
    found = vector_index.hydrated(vector_index.search(index, vectors.limit(3), 4, 4), vectors.where("vec_id % 2 = 0"))
    assert {"query", "vec_id", "label", "score", "rank"} <= set(found.columns) and found.where("vec_id % 2 = 1").isEmpty()
    with pytest.raises(ValueError):
        vector_index.build(vectors.where("vec_id < 0"), f"{tmp_path}/none")


def test_unit_vectors_have_the_zeros_halves_and_nulls_of_the_sql(spark, tmp_path):
    duck = duckdb.connect()
    rows = "(1, [1.0, NULL, 2.0]::FLOAT[]), (2, [-1e-9, 1]::FLOAT[]), (3, [-0.0::FLOAT, 1]::FLOAT[]), (4, []::FLOAT[]), (5, NULL), (6, [NULL]::FLOAT[]), (7, [0, 0]::FLOAT[]), (8, [0.6, -0.8]::FLOAT[])"
    duck.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(vec_id, embedding)) TO '{tmp_path}/embeddings.parquet'")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = {r.vec_id: str(r.unit) for r in registry.QUERIES["vectors_normalized"](spark, str(tmp_path)).collect()}
    assert got == {k: str(v) for k, v in duck.execute(registry.ORACLE["vectors_normalized"]).fetchall()} and "-0.0" in got[2]
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.2, 1e300]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(dense.rounded(F.col("v"), 0)).collect()]
    assert list(map(str, found)) == ["1.0", "-1.0", "2.0", "3.0", "-3.0", "0.0", "-0.0", "1e+300"]


def test_rows_go_to_their_probes_in_pieces_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PROBED_ROWS", 64)
    taken = []

    class Rows:  # keeps what is run over batches
        sparkSession, schema = spark, clustered(spark, n=10).schema
        select = lambda self, *names: self
        mapInArrow = lambda self, work, schema: taken.append(work)

    draw = np.random.default_rng(2)
    vector_index._near_cells(Rows(), vector_index.centroids(draw.standard_normal((50, 16)), 30), 30, ["vec_id"])
    batch = pa.RecordBatch.from_pydict({"vector": draw.standard_normal((300, 16)).tolist(), "vec_id": range(300)})
    pieces = list(taken[0]([batch]))
    assert max(b.num_rows for b in pieces) <= 64 and sum(b.num_rows for b in pieces) == 300 * 30
    found = pa.Table.from_batches(pieces).group_by("vec_id").aggregate([("cell", "count_distinct"), ("place", "max")])
    assert set(found.column("cell_count_distinct").to_pylist()) == set(found.column("place_max").to_pylist()) == {30}
    assert dense._TILE * 8 <= 4 << 20  # what a step of a search's scores takes
