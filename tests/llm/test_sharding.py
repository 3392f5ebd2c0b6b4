import math
import zlib

import numpy as np

from pyspark.sql import functions as F

from tessella.llm import sharding

from . import cases
from .test_simhash import h64


def test_matrix_rows_sum_to_partitions_and_shards():
    sizes = [7, 0, 300, 45, 1, 1000]
    sums = np.cumsum([0, *sizes])
    goal = sharding.shard_sizes(int(sums[-1]), 12)
    matrix = np.array([sharding.matrix_row(sums, goal, p, 3) for p in range(len(sizes))])
    assert (matrix >= 0).all() and matrix.sum(1).tolist() == sizes and (matrix.sum(0) == goal).all()


def test_counts_follow_the_hypergeometric_mean():
    sums = np.array([0, 400, 1000])
    goal = sharding.shard_sizes(1000, 4)
    drawn = np.mean([sharding.matrix_row(sums, goal, 0, seed) for seed in range(400)], axis=0)
    assert np.abs(drawn - 100).max() < 2


def test_draws_beyond_a_thousand_million_follow_the_hypergeometric_law():
    rng = np.random.default_rng(11)
    for good, bad, n in ((10**9, 10**9, 10**9), (3 * 10**8, 10**9, 4 * 10**8), (5 * 10**10, 2 * 10**9, 3 * 10**10), (40, 10**12, 10**11)):
        drawn = np.array([sharding._one(rng, good, bad, n) for _ in range(3000)], float)
        total = good + bad
        mean, variance = n * good / total, n * (good / total) * (bad / total) * (total - n) / (total - 1)
        assert abs(drawn.mean() - mean) < 4 * (variance / 3000) ** 0.5 and 0.9 < drawn.var() / variance < 1.1
    assert sharding._one(rng, 10**9, 10**9, 0) == 0 and sharding._one(rng, 10**9, 1, 10**9 + 1) == 10**9


def test_large_counts_have_the_binomial_law():
    n, p = 50, 0.3
    whole = [math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(n + 1)]
    assert np.allclose([math.exp(sharding._log_binomial(x, n, p)) for x in range(n + 1)], whole, rtol=1e-7)


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text", "id AS shard", "id AS _rank").repartition(5)
    rows = sharding.assign_shards(docs, 40).collect()
    assert len({r.doc_id for r in rows}) == 1003
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        text = f"text {r.doc_id % 7}".encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    assert sorted(by) == list(range(40)) and {len(s) for s in by.values()} <= {25, 26}
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, np.arange(1003))[0, 1]) < 0.15


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_every_place_as_by_a_plain_version(spark):
    texts = ["", None, "a", "é" * 40, "same", "same"]
    docs = spark.createDataFrame([(k, texts[k % 6]) for k in range(700)], "doc_id long, text string").repartition(5, "doc_id")
    lying = {r.doc_id: (r.p, r.at) for r in docs.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()}
    found = {r.doc_id: r for r in sharding.assign_shards(docs, 40, 7).collect()}
    parts = sorted({p for p, _ in lying.values()})
    own = {p: [d for d, (q, _) in lying.items() if q == p] for p in parts}
    sums, goal, seeded = np.cumsum([0, *(len(own[p]) for p in parts)]), sharding.shard_sizes(700, 40), lambda seed, at: signed(h64(seed.to_bytes(4, "little"), at.to_bytes(8, "little")))
    shards = {}
    for i, p in enumerate(parts):
        cuts = np.cumsum(sharding.matrix_row(sums, goal, i, 7))
        for rank, d in enumerate(sorted(own[p], key=lambda d: (seeded(7, lying[d][1]), lying[d][1]))):
            shards.setdefault(int((cuts <= rank).sum()), []).append(d)
    for shard, held in shards.items():
        order = sorted(held, key=lambda d: (seeded(8, lying[d][1]) % 8, seeded(8, lying[d][1]), lying[d][1]))
        for slot, d in enumerate(order):
            body = (texts[d % 6] or "").encode()
            assert (found[d].shard, found[d].slot, found[d]["size"], found[d].text_crc32) == (shard, slot, len(body) + 16, zlib.crc32(body))
    assert sorted(map(len, shards.values())) == sorted(goal.tolist())


def test_awkward_rows(spark):
    rows = sharding.assign_shards(cases.table(spark), 3).collect()
    assert len(rows) == len(cases.rows()) and sorted(r["size"] for r in rows)[:2] == [16, 16]
    assert sharding.assign_shards(cases.empty(spark), 3).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    sharding.write_shards(cases.table(spark).drop("length"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(cases.rows()) and {"lang", "in_shard", "slot", "shard"} <= set(back.columns)
