from pathlib import Path

import corpus_pipeline
from tessella.llm import packing, quality, storage
from tessella.llm.queries import WORD_BPE, tokenizer_path
from tessella.sources.tables import table

from . import cases
from .test_decontaminate import brute as contained
from .test_minhash import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_as_by_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rejected = {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    keep = {i for i, _, least in components(rows, 5, 80) if i == least}
    rows = [r for r in rows if r[0] in keep]
    hit = {d for d, *_ in contained(rows, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    rows = [r for r in rows if r[0] not in hit]
    want = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(WORD_BPE)).collect()
    got = corpus_pipeline.run(spark, SF)
    assert got.select("doc_id", "piece", "start", "length", "ids_crc32").subtract(spark.createDataFrame(want)).count() == 0
    assert got.count() == len(want) and hit and rejected


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() < docs.count()


def test_stages_stand_awkward_rows(spark):
    docs = cases.table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns), name
        assert out.where("doc_id IS NULL").count() == 1, name  # no stage drops a row without a name
        assert stage(spark, cases.empty(spark), SF).count() == 0, name


def test_tables_between_are_deleted(spark):
    with storage.scratch(spark):
        df = storage.stored(spark.range(3), "between")
        inside = df.inputFiles()[0]
        assert Path(inside.removeprefix("file://")).exists()
    assert not Path(inside.removeprefix("file://")).exists()
    assert storage.stored(spark.range(3), "between").count() == 3
