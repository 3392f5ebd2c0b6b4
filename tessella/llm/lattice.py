"""Near-duplicate vectors by lattice hashing, with every link verified by its cosine.

1. Equal vectors of a label become one node that counts its rows, so copies
   cost nothing from here on.
2. A unit vector is projected at random to ``blocks`` times eight numbers for
   each table, each eight are decoded to the nearest point of the E8 lattice,
   and the points of a table make a cell.  A node also enters the ``probes``
   neighbouring cells (a point moved by one of the lattice's 240 shortest
   vectors) that are nearest to its projection.
3. Nodes that share a cell are compared.  A cell of m nodes is dealt out as
   pairs of blocks of about ``block_rows`` nodes, so no task holds more than
   two blocks and none are left out.  A link counts in the least cell that
   its nodes share, which both sides tell from their lists of cells, so links
   are neither counted twice nor emitted one by one: a block pair gives each
   of its nodes one row, with the rows it has met and one linked node, the
   least that links within the block pair lead to.

At a cosine of 0.98 two nodes share no cell of four tables less than once in
ten thousand times, above it more rarely (measured in the tests).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .linking import components, least_keys
from .storage import stored

BLOCKS, SCALE, TABLES, PROBES, BLOCK_ROWS = 2, 0.75, 4, 7, 1024
_SMALL, _ROWS, _SLICE = 32, 2048, 4096
_U = np.uint64


@lru_cache(maxsize=1)
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of the lattice: two entries of one, or eight halves with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs, strict=True):
        row[i], row[j] = a, b
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.vstack([whole, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points of whole numbers with an even sum: round, and where the sum is odd round the worst entry the other way."""
    point = np.rint(y)
    error = y - point
    row, worst = np.arange(len(y)), np.abs(error).argmax(axis=1)
    step = np.where(error[row, worst] < 0, -1.0, 1.0)
    point[row, worst] += np.where(point.sum(axis=1) % 2 != 0, step, 0)
    return point


def nearest_points(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points to the rows of ``y``: of whole numbers or of halves, whichever is nearer."""
    whole, halves = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - halves) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, halves)


def _cells(y: np.ndarray, probes: int) -> np.ndarray:
    """Values of the own cell and of the nearest neighbouring ones for projections ``y`` (rows, blocks, 8)."""
    n, blocks, _ = y.shape
    points = np.stack([nearest_points(y[:, b]) for b in range(blocks)], axis=1)
    moves = np.vstack([np.zeros(8), _shortest()])
    # How much farther than the nearest point a neighbouring one is, squared.
    farther = np.einsum("nbd,rd->nbr", y - points, moves) * -2 + (moves**2).sum(axis=1)
    near = np.argsort(farther, axis=2, kind="stable")[:, :, : probes + 1]
    farther = np.take_along_axis(farther, near, axis=2)
    choices = np.array([c for c in itertools.product(range(near.shape[2]), repeat=blocks) if np.prod(np.array(c) + 1) <= probes + 1])
    total = sum(farther[:, b][:, choices[:, b]] for b in range(blocks))
    best = np.argsort(total, axis=1, kind="stable")[:, : probes + 1]
    out = np.zeros(best.shape, np.uint64)
    for b in range(blocks):
        move = np.take_along_axis(near[:, b], choices[best, b], axis=1)
        doubled = ((points[:, b][:, None, :] + moves[move]) * 2).astype(np.int64).astype(np.uint64)
        for d in range(8):
            out = hashing.mix64(out * _U(0x9FB21C651E98DF25) + doubled[..., d])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; each is first divided by a power of two, so that no square is too large or too small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells(x: np.ndarray, group: np.ndarray, blocks: int = BLOCKS, scale: float = SCALE, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """All cells of unit rows ``x``, ``tables * (probes + 1)`` for each in ascending order; ``group``: a value for each that keeps groups apart."""
    n, size = x.shape
    draw, width = np.random.default_rng(size), 8 * blocks * tables
    y = np.zeros((n, width))
    for at in range(0, size, _SLICE):
        y += x[:, at : at + _SLICE] @ draw.standard_normal((min(_SLICE, size - at), width))
    y = y.reshape(n, tables, blocks, 8) * scale
    apart = hashing.mix64(group.astype(np.uint64) + _U(size))
    found = [hashing.mix64(_cells(y[:, t], probes) + apart[:, None] * _U(2 * t + 1)) for t in range(tables)]
    return np.sort(np.concatenate(found, axis=1).view(np.int64), axis=1)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column end to end, and the offsets of its rows."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _signed(nodes: DataFrame, blocks: int, scale: float, tables: int, probes: int) -> DataFrame:
    """``nodes`` (node, times, apart, vector) with size, unit vector and cells."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                flat, at = _vectors(batch.column(3))
                sizes, apart = np.diff(at), batch.column(2).to_numpy()
                for size in np.unique(sizes).tolist():
                    took = np.flatnonzero(sizes == size)
                    x = unit(flat[hashing.ranges(at[took], sizes[took])].reshape(len(took), size))
                    codes = cells(x, apart[took], blocks, scale, tables, probes)
                    own = [batch.column(i).take(pa.array(took)) for i in (0, 1)]
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(took) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel())) for a in (x, codes)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(took), size, np.int32)), *lists], names=["node", "times", "size", "vector", "cells"])

    return nodes.select("node", "times", "apart", "vector").mapInArrow(sign, "node long, times long, size int, vector array<double>, cells array<long>")


class _Found:
    """Links between the rows of a chunk: how many rows each has met, and the least row that links lead to."""

    def __init__(self, node: np.ndarray, times: np.ndarray):
        self.node, self.times = node, times
        self.met = np.zeros(len(node), np.int64)
        self.to = node.copy()

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.met, i, self.times[j])
        np.add.at(self.met, j, self.times[i])
        while True:
            least = np.minimum(self.to[i], self.to[j])
            if (least == self.to[i]).all() and (least == self.to[j]).all():
                return
            np.minimum.at(self.to, i, least)
            np.minimum.at(self.to, j, least)

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.met)
        return pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (self.node, self.to, self.met)], names=["a", "b", "met"])


def _before(codes: np.ndarray, bucket: int) -> np.ndarray:
    """Which rows share a cell below ``bucket``, as a matrix."""
    row, col = np.nonzero(codes < bucket)
    values, which, times = np.unique(codes[row, col], return_inverse=True, return_counts=True)
    kept = times[which] > 1
    column = np.cumsum(times > 1) - 1
    has = np.zeros((len(codes), int((times > 1).sum())), np.float32)
    has[row[kept], column[which[kept]]] = 1
    return has @ has.T > 0


def _compare(chunk: pa.Table, least: float) -> pa.RecordBatch:
    """The links of a chunk of whole groups (bucket, lo, hi, own, node, times, vector, cells) whose vectors have one size."""
    bucket, lo, hi, own, node, times = (chunk.column(c).to_numpy() for c in ("bucket", "lo", "hi", "own", "node", "times"))
    x, codes = (_vectors(chunk.column(c).combine_chunks())[0].reshape(len(node), -1) for c in ("vector", "cells"))
    at = _runs(bucket, lo, hi)
    found, sizes = _Found(node, times), np.diff(at)
    small = sizes <= _SMALL
    # Small groups all at once: each row with those behind it.
    rows = hashing.ranges(at[:-1][small], sizes[small])
    behind = np.repeat(at[1:][small], sizes[small]) - rows - 1
    i, j = np.repeat(rows, behind), hashing.ranges(rows + 1, behind)
    apart = (lo[i] == hi[i]) | (own[i] != own[j])
    i, j = i[apart], j[apart]
    for k in range(0, len(i), 1 << 14):
        a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        near = np.einsum("nd,nd->n", x[a], x[b]) >= least
        a, b = a[near], b[near]
        common = codes[a][:, :, None] == codes[b][:, None, :]
        first = ~(common & (codes[a] < bucket[a][:, None])[:, :, None]).any(axis=(1, 2))
        found.add(a[first], b[first])
    for g in np.flatnonzero(~small).tolist():
        a, b = at[g], at[g + 1]
        near = np.triu(x[a:b] @ x[a:b].T >= least, 1) & ~_before(codes[a:b], bucket[a])
        if lo[a] != hi[a]:
            near &= own[a:b][:, None] != own[a:b][None, :]
        i, j = np.nonzero(near)
        found.add(i + a, j + a)
    return found.rows()


def _links(signed: DataFrame, least: float, block_rows: int) -> DataFrame:
    """a, b (a linked node, the least that the block pair's links lead to) and met (the rows linked with a there) of all nodes with links."""
    entered = signed.select("node", F.explode(F.array_distinct("cells")).alias("bucket"))
    shared = entered.groupBy("bucket").agg(F.count("*").alias("_m")).where("_m > 1")
    parts = F.ceil(F.col("_m") / block_rows).cast("int")
    dealt = entered.join(shared, "bucket").withColumn("_parts", parts).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("_parts")).cast("int"))
    dealt = dealt.select("node", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    dealt = dealt.select("node", "bucket", "own", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"))
    rows = dealt.join(signed, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("size", "bucket", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = pa.Table.from_batches([batch])
                held = own if held is None else pa.concat_tables([held, own])
            if held is None or not held.num_rows:
                continue
            size, bucket, lo, hi = (held.column(c).to_numpy() for c in ("size", "bucket", "lo", "hi"))
            # The last group may go on in the next batch.
            end = held.num_rows if batch is None else int(_runs(size, bucket, lo, hi)[-2])
            cuts = [c for c in _runs(size).tolist() if c < end] + [end]
            for a, b in itertools.pairwise(cuts):
                yield _compare(held.slice(a, b - a), least)
            held = held.slice(end)

    return rows.select("size", "bucket", "lo", "hi", "own", "node", "times", "vector", "cells").mapInArrow(compare, "a long, b long, met long")


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: numbers only, all finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.98,
    blocks: int = BLOCKS, scale: float = SCALE, tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """key, n_links (other rows of the same group at a cosine of ``least`` or more), component_id and kept for every row of ``vectors``.

    component_id is the least key reachable by links; kept says whether that
    is the row's own.  Rows without group, and vectors that are null, empty,
    zero or hold null or non-finite numbers are linked with nothing, nor are
    vectors of different sizes.  Equal vectors are linked like others, and
    are told by 128 bits of hashes.  Rows that share a key are vectors of
    their own; a null key is never a least one and kept only if alone.  An
    empty table gives no rows; other columns are left alone.
    """
    own = vectors.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(vector).cast("array<double>").alias("vector"))
    own = own.withColumn("_usable", F.col("grp").isNotNull() & _usable(F.col("vector")))
    name = [F.when(F.col("_usable"), F.xxhash64(F.lit(s), "grp", "vector")).alias(f"h{s}") for s in (0, 1)]
    rows = own.select("key", F.xxhash64("grp").alias("apart"), "vector", *name)
    nodes = rows.where("h0 IS NOT NULL").groupBy("h0", "h1").agg(F.min("key").alias("key"), F.count("*").alias("times"), F.first("apart").alias("apart"), F.first("vector").alias("vector"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    signed = stored(_signed(nodes, blocks, scale, tables, probes), "cells")
    found = stored(_links(signed, least, block_rows), "links")
    met = found.groupBy(F.col("a").alias("node")).agg(F.sum("met").alias("met"))
    labels = components(found.where("a <> b").select("a", "b").distinct())
    named = nodes.select("h0", "h1", "node", "times").join(least_keys(nodes.select("node", "key"), labels), "node").join(met, "node", "left")
    named = named.select("h0", "h1", F.col("least").alias("_component"), (F.col("times") - 1 + F.coalesce("met", F.lit(0))).alias("_links"))
    component = F.coalesce("_component", "key")
    return rows.select("key", "h0", "h1").join(named, ["h0", "h1"], "left").select(
        F.col("key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.col("_component").isNull()).alias("kept"),
    )
