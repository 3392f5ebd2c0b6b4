import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import quality
from tessella.sources.tables import table

from . import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    scores = quality.classify(table(spark, SF, "documents"), labels)
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    ranks = np.mean([[a > b for a in good] for b in bad])
    assert len(rows) > 50 and ranks > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def plain_scores(rows, labels, shrinkage=0.05):
    """Scores by textbook formulas: densities of two normal laws with shrunk covariances, from all labelled rows outside the fold."""
    x = quality.statistics(pa.array([t for _, t in rows]))
    learn = [k for k, (i, _) in enumerate(rows) if i in labels and zlib.crc32(str(i).encode()) % 5]
    y = np.array([labels[rows[k][0]] for k in learn])
    groups = [x[learn][y == c] for c in (0, 1)]
    scale = np.sqrt(sum(len(g) * g.var(0) for g in groups) / len(learn)).clip(1e-3)
    logs = []
    for g in groups:
        unit = np.cov(g.T, bias=True) / np.outer(scale, scale)
        unit = (1 - shrinkage) * unit + shrinkage * np.trace(unit) / len(scale) * np.eye(len(scale))
        z = (x - g.mean(0)) / scale
        distance = np.einsum("ij,jk,ik->i", z, np.linalg.inv(unit), z)
        logs.append(np.log(len(g) / len(learn)) - 0.5 * np.linalg.slogdet(unit)[1] - 0.5 * distance)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_scores_as_by_textbook_formulas(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([i for i, _ in rows], plain_scores(rows, {r.doc_id: r.quality for r in labels.collect()}), strict=True))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, SF, "documents").limit(300), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_fold_is_by_checksum(spark):
    rows = quality.scored(quality.featured(spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")), quality.fit(quality.featured(cases.empty(spark)), spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.score == 0.5 for r in rows)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (7, 0), (9, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.classify(cases.table(spark), labels).collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.classify(cases.empty(spark), labels).count() == 0
    same = {r.score for r in rows if r.doc_id in (1, 2, 12)}
    assert len(same) == 1
