"""Packing of token sequences by exact complements, then best fit.

Only lengths matter to a packing, and there are no more of them than the
capacity.  So documents are tokenised and cut where they lie, a histogram of
piece lengths (at most ``capacity`` counts) goes to the driver, and a plan is
made there for lengths: a pattern of lengths and how many sequences follow
it.  Each plan row covers a run of the pieces of one length, numbered within
that length, and gives their sequences and offsets by arithmetic; tasks look
up their pieces in it.  A step of the plan uses up a length, so the plan is
bounded by the capacity and not by the input.

Complements are looked up in an index of the lengths still available and of
the sums of two of them: a gap is filled by one, two or three lengths that
sum to it exactly, as often as their counts allow.  What has no exact
complement is placed by best fit, longest first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing, word_bpe
from .storage import stored

CAPACITY = 4096


def _le(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each text and its end id: key, piece, start, length, ids_crc32 (, ids)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    last = _le([end_id])
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, cols = [], ([], [], [], [], [])
            for i, coded in enumerate(word_bpe.load(tokenizer).encode(batch.column(1))):
                coded += last
                for k, at in enumerate(range(0, len(coded), step)):
                    part = coded[at : at + step]
                    took.append(i)
                    for col, value in zip(cols, (k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(value)
            arrays = [batch.column(0).take(pa.array(took, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            hashing.let_go()

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


class Complements:
    """The lengths still available, and of which pairs of them sums can be made."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.pair = np.zeros(len(counts), bool)
        have = self.counts > 0
        for a in np.flatnonzero(have).tolist():
            self.pair[a:] |= have[: len(have) - a]

    def times(self, lengths: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.counts[x]) // n for x, n in Counter(lengths).items())

    def one(self, gap: int, beside: list[int]) -> list[int] | None:
        return [gap] if self.counts[gap] and self.times([gap, *beside]) else None

    def two(self, gap: int, beside: list[int]) -> list[int] | None:
        if not self.pair[gap]:
            return None
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in high[(self.counts[high] > 0) & (self.counts[gap - high] > 0)].tolist():
            if self.times([a, gap - a, *beside]):
                return [a, gap - a]
        if not beside:
            self.pair[gap] = False
        return None

    def three(self, gap: int, beside: list[int]) -> list[int] | None:
        first = np.arange(gap - 2, (gap - 1) // 3, -1)
        for a in first[(self.counts[first] > 0) & self.pair[gap - first]].tolist():
            if rest := self.two(gap - a, [a, *beside]):
                return [a, *rest]
            if self.two(gap - a, []) is None:
                continue
        return None

    def filling(self, length: int) -> list[int] | None:
        gap = len(self.counts) - 1 - length
        if gap <= 0:
            return None
        return self.one(gap, [length]) or self.two(gap, [length]) or self.three(gap, [length])


def plan(counts: np.ndarray) -> pd.DataFrame:
    """Where the pieces of each length go; ``counts[n]``: pieces of length n, the last index is the capacity.

    A row says: of the pieces of ``length``, those numbered from ``first`` on
    go one by one to ``bins`` sequences from ``sequence`` on at ``offset``,
    then the next as many to the same sequences behind, ``each`` times over.
    """
    index = Complements(counts)
    capacity = len(counts) - 1
    taken = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def put(pattern: list[tuple[int, int]], bins: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in pattern:
            rows.append((length, int(taken[length]), bins, each, sequence, offset))
            taken[length] += bins * each
            offset += length * each
        sequence += bins

    if counts[capacity]:
        put([(capacity, 1)], int(counts[capacity]))
        index.counts[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while index.counts[length] and (rest := index.filling(length)):
            whole = [length, *rest]
            bins = index.times(whole)
            for x, n in Counter(whole).items():
                index.counts[x] -= n * bins
            put(list(Counter(whole).items()), bins)
    # Best fit of the rest: open[gap] holds groups of equal sequences.
    opened: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity - 1, 0, -1):
        left = int(index.counts[length])
        while left:
            fit = np.flatnonzero(gaps[length:])
            gap = length + int(fit[0]) if len(fit) else capacity
            if len(fit):
                bins, pattern = opened[gap].pop()
                gaps[gap] = bool(opened[gap])
            else:
                bins, pattern = -(-left // (capacity // length)), []
            each = gap // length
            full, over = min(bins, left // each), 0
            left -= full * each
            if full < bins and left:
                over, left = left, 0
            for n, k in ((full, each), (int(over > 0), over), (bins - full - int(over > 0), 0)):
                if n:
                    rest = gap - k * length
                    opened.setdefault(rest, []).append((n, [*pattern, (length, k)] if k else pattern))
                    gaps[rest] = rest > 0
    for groups in opened.values():
        for bins, pattern in groups:
            if pattern:
                put(pattern, bins)
    return pd.DataFrame(rows, columns=["length", "first", "bins", "each", "sequence", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``cut`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset."""
    cut = stored(cut.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    table = plan(counts).sort_values(["length", "first"], kind="stable")
    lengths, firsts, bins, sequences, offsets = (table[c].to_numpy(np.int64) for c in ("length", "first", "bins", "sequence", "offset"))
    spread = int(np.clip(counts.sum() // 500_000, 64, 4096))

    # A number for each piece within its length, by way of shares of the length that no single task holds whole.
    cut = cut.withColumn("_share", F.pmod("_part", F.lit(spread)))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "_share").count().select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_share").orderBy(*order)
    numbered = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_share"])
    keep = [c for c in cut.columns if c not in ("_part", "_share")]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in keep) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = np.searchsorted(lengths, np.arange(capacity + 2), side="left")
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_number"))
            row = np.empty(len(length), np.int64)
            by_length = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by_length])) + 1
            for own in np.split(by_length, cuts):
                if len(own):
                    a, b = lo[length[own[0]]], lo[length[own[0]] + 1]
                    row[own] = a + np.searchsorted(firsts[a:b], number[own], side="right") - 1
            within = number - firsts[row]
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            out += [pa.array(sequences[row] + within % bins[row]), pa.array(offsets[row] + within // bins[row] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "sequence_id", "offset"])

    return numbered.withColumn("_number", F.col("_start") + F.col("_rank")).select(*keep, "_number").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All documents of ``docs`` in sequences of at most ``capacity`` ids.

    A document is its ids and ``end_id``; only one longer than the capacity is
    cut, into pieces of that length and a shorter last one.  Null and empty
    texts are the end id alone.  Repeated rows and rows with a null key are
    packed like others, an empty table gives no rows, other columns are left
    alone.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, text, key), capacity, (key, "piece", "ids_crc32"))
