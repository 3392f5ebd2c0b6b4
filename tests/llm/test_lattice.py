import math

import numpy as np
import pytest

from tessella.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node string, size int, cells int, a int"


def near(draw, base, cosine):
    """A vector at this cosine to ``base``."""
    side = draw.standard_normal(len(base))
    own = base / np.linalg.norm(base)
    side -= side @ own * own
    return cosine * own + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def brute(rows, least=0.98):
    """n_links and component of every row by comparing all pairs."""
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    vectors = []
    for _, v, label in rows:
        usable = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, np.float32).astype(float) / max(np.abs(np.array(v, np.float32).astype(float)).max(), 1e-300) if usable else None)
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    component = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            component[top(i)] = min(key, component.get(top(i), key))
    return [(key, links[i], component.get(top(i), key)) for i, (key, _, _) in enumerate(rows)]


def found(spark, rows, **options):
    table = spark.createDataFrame([(k, v, g, "node", 1, 2, 3) for k, v, g in rows], SCHEMA).repartition(3)
    return lattice.near_vectors(table, **options).collect()


def same(out, rows):
    order = lambda x: (x[0] is None, x)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=order) == sorted(brute(rows), key=order)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_decoded_points_are_the_nearest():
    draw = np.random.default_rng(1)
    y = draw.standard_normal((200, 8)) * 3
    points = lattice.nearest_points(y)
    apart = ((y - points) ** 2).sum(axis=1)
    doubled = points * 2
    assert (doubled == np.rint(doubled)).all() and (points.sum(axis=1) % 2 == 0).all() and ((doubled % 2).std(axis=1) == 0).all()
    for move in lattice._shortest():
        assert (((y - points - move) ** 2).sum(axis=1) >= apart - 1e-12).all()
    assert len(np.unique(lattice._shortest(), axis=0)) == 240 and ((lattice._shortest() ** 2).sum(axis=1) == 2).all()


@pytest.mark.parametrize("cosine,least", [(0.98, 0.999), (0.985, 0.9995), (0.99, 0.9999)])
def test_recall(cosine, least):
    draw = np.random.default_rng(2)
    x = lattice.unit(draw.standard_normal((8000, 64)))
    y = np.stack([near(draw, a, cosine) for a in x])
    group = np.zeros(len(x), np.int64)
    shared = (lattice.cells(x, group)[:, :, None] == lattice.cells(y, group)[:, None, :]).any(axis=(1, 2))
    assert shared.mean() >= least


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_links_as_by_all_pairs(spark, block_rows):
    draw = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = draw.standard_normal(24)
        for _ in range(int(draw.integers(1, 8)) if g else 90):
            rows.append((len(rows), [float(x) for x in near(draw, base, draw.uniform(0.983, 0.999)) * draw.uniform(0.1, 9)], g % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(0, 60, 2)]
    rows += [(len(rows) + k, rows[k][1], 7) for k in range(0, 20)]
    same(found(spark, rows, block_rows=block_rows), rows)


def test_a_chain_is_one_component(spark):
    rows = [(k, [math.cos(0.15 * k), math.sin(0.15 * k), 0.0], 1) for k in range(12)]
    out = found(spark, rows)
    assert {r.component_id for r in out} == {0} and sorted(r.n_links for r in out) == [1, 1] + [2] * 10
    same(out, rows)


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (3, [2.0, 4.0, 6.0], 1), (4, [-1.0, -2.0, -3.0], 1),
        (5, [1.0, 2.0, 3.0], None), (6, [1.0, 2.0, 3.0], None), (7, None, 1), (8, [], 1), (9, [0.0, 0.0, 0.0], 1), (10, [0.0, -0.0, 0.0], 1),
        (11, [1.0, None, 3.0], 1), (12, [1.0, float("nan"), 3.0], 1), (13, [1.0, float("inf"), 3.0], 1), (14, [1.0, 2.0], 1), (15, [1.0, 2.0], 1),
        (None, [1.0, 2.0, 3.0], 1), (None, [5.0, 0.0, 0.0], 1), (16, [1e30, 2e30, 3e30], 1), (17, [1e-30, 2e-30, 3e-30], 1), (18, [1.0, 2.0, 3.0], 2),
        (19, [1.0] * 20_000, 1), (20, [1.0] * 19_999 + [1.5], 1),
    ]
    out = found(spark, rows)
    assert len(out) == len(rows)
    same(out, rows)
    assert sorted(r.kept for r in out if r.vec_id is None) == [False, True]
    assert found(spark, []) == []
