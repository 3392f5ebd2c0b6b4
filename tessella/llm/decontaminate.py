"""Benchmark decontamination by size-partitioned MinHash containment search.

The question is how much of a test item, a short text, lies in a document,
perhaps a long one: containment of the item's shingle set.  MinHash compares
whole sets, and a long document hides a short item in it.  So both sides are
partitioned by size.  Items of up to half a block of shingles are sought by
each of their shingles, windows of one.  Others fall into classes whose set
sizes lie between ``u / 2`` and ``u``; for each class a document is covered by windows of about
``2 u`` shingles, every one overlapping the next by half, so that a passage
of an item lies whole in a window.  Within a class the containment threshold
t becomes a Jaccard threshold of at least t q / (w + q - t q) for item size q
and window size w, and from it follow how many coordinates make a band.

Windows of a class are unions of blocks, whose signatures are computed once
and joined by coordinate-wise least values, for all classes.

Documents and items that share a band are candidates; each is confirmed or
refuted by exact containment of the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .minhash import _lists, _signed
from .storage import stored

COORDINATES = 64
BLOCK = 16
# Rows of the item index (bands and shingles) up to which it is broadcast; 16 bytes each.
BROADCAST_ROWS = 2_000_000
_STEP = 1 << 21
_POSTINGS = 1 << 21
_FILTER_BITS = 1 << 27
_LOW = np.uint64((1 << 24) - 1)


def window_size(n: int) -> int:
    """Shingles of the windows in which an item of ``n`` shingles is sought: twice the upper end of its class, or single shingles for the least class."""
    if 2 * n <= BLOCK:
        return 1
    u = BLOCK
    while u < n:
        u *= 2
    return 2 * u


def band_rows(least: int, window: int, percent: int, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most coordinates a band may have for a pair at the threshold to be missed at most so often."""
    t = percent / 100
    s = t * least / (window + least - t * least)
    rows = 1
    while (1 - s ** (rows + 1)) ** (coordinates // (rows + 1)) <= miss:
        rows += 1
    return rows


def _windows(hashed: np.ndarray, at: np.ndarray, circulant: hashing.Circulant, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window size (in order, above 1) the rows and signatures of the windows of all rows, from those of their blocks."""
    counts = np.diff(at)
    blocks = -(-counts // BLOCK)
    row = np.repeat(np.arange(len(counts)), blocks)
    level = circulant.runs(hashed, np.append(hashing.ranges(at[:-1], blocks, BLOCK), at[-1]))
    width = 1
    for size in sizes:
        # blocks of half a window, then neighbours joined
        while width * BLOCK < size // 2:
            level, row = _halved(level, row)
            width *= 2
        next_ = np.flatnonzero(row[1:] == row[:-1])
        alone = np.append(True, row[1:] != row[:-1]) & np.append(row[1:] != row[:-1], True)
        yield size, np.concatenate([row[next_], row[alone]]), np.concatenate([np.minimum(level[next_], level[next_ + 1]), level[alone]])


def _halved(level: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every second signature of a row joined with the one behind it."""
    first = np.append(True, row[1:] != row[:-1])
    within = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    even = np.flatnonzero(within % 2 == 0)
    behind = np.minimum(even + 1, len(row) - 1)
    joined = np.where((row[behind] == row[even])[:, None], np.minimum(level[even], level[behind]), level[even])
    return joined, row[even]


def item_index(items: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """item, n, window, bands and shingles of each item that has any shingle."""
    kind = items.schema[key].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = hashing.Circulant(COORDINATES)
        for batch in batches:
            took, sizes, windows, bands, sets = [], [], [], [], []
            for i, hashed in enumerate(hashing.shingle_rows(batch.column(1), shingle)):
                own = np.unique(hashed)
                if not len(own):
                    continue
                window = window_size(len(own))
                took.append(i)
                sizes.append(len(own))
                windows.append(window)
                bands.append(_signed(_salted(own if window == 1 else hashing.band_hashes(circulant.signatures([own]), band_rows(window // 4, window, percent))[0], window)))
                sets.append(_signed(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(took, pa.int64())), pa.array(sizes, pa.int64()), pa.array(windows, pa.int64()), _lists(bands), _lists(sets)],
                names=["item", "n", "window", "bands", "items"],
            )
            hashing.let_go()

    return items.where(F.col(key).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(index, f"item {kind}, n long, window long, bands array<long>, items array<long>")


def _salted(bands: np.ndarray, window: int) -> np.ndarray:
    return hashing.mix64(bands + np.uint64(window))


def _contained(docs: DataFrame, index: DataFrame, shingle: int, percent: int, broadcast: int) -> DataFrame:
    """doc, item and shared (exact count) of all pairs at the threshold."""
    rows, windows = index.agg(F.sum(F.size("bands") + F.size("items")), F.collect_set("window")).first()
    kind, item_kind = docs.schema["doc"].dataType.simpleString(), index.schema["item"].dataType.simpleString()
    if not rows:
        return docs.sparkSession.createDataFrame([], f"doc {kind}, item {item_kind}, shared long, n long")
    by_size = {w: band_rows(w // 4, w, percent) for w in sorted(windows) if w > 1}
    single = 1 in windows
    schema = f"doc {kind}, item {item_kind}, shared long, n long"

    def bands_of(column: pa.Array, circulant: hashing.Circulant) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Slices of a column: first row, shingles, their offsets, and (row, band) arrays."""
        _, begin = hashing.text_bytes(column)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + _STEP, side="right")) - 1)
            hashed, at = hashing.flat_shingles(column.slice(i, j - i), shingle)
            parts = [(np.repeat(np.arange(j - i), np.diff(at)), _salted(hashed, 1))] if single else []
            for size, row, signature in _windows(hashed, at, circulant, list(by_size)) if len(hashed) else ():
                bands = _salted(hashing.band_hashes(signature, by_size[size]), size)
                parts.append((np.repeat(row, bands.shape[1]), bands.ravel()))
            yield i, hashed, at, parts
            i = j

    if rows <= broadcast:
        held = index.select("item", "n", "bands", "items").toArrow().combine_chunks()
        names, sizes = held["item"].combine_chunks(), held["n"].to_numpy().tolist()
        sets = [x.values.to_numpy().view(np.uint64) for x in held["items"]]
        each = [x.values.to_numpy() for x in held["bands"]]
        at = np.repeat(np.arange(len(each)), [len(x) for x in each])
        keys = np.concatenate(each).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        seen = np.zeros(1 << 24, bool)
        seen[keys & _LOW] = True
        seen_bits = np.packbits(seen)
        shared_by = docs.sparkSession.sparkContext.broadcast((keys, at, sets, names, sizes, seen_bits))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, at, sets, names, sizes, seen_bits = shared_by.value
            seen = np.unpackbits(seen_bits).view(bool)
            circulant = hashing.Circulant(COORDINATES)
            for batch in batches:
                took, found, both = [], [], []
                for first, hashed, offsets, parts in bands_of(batch.column(1), circulant):
                    met = np.zeros(0, np.int64)
                    for row, bands in parts:
                        near = np.flatnonzero(seen[bands & _LOW])
                        lo, hi = (np.searchsorted(keys, bands[near], side=s) for s in ("left", "right"))
                        # Step by step, as many bands may each have many items.
                        cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()), _POSTINGS), side="right")
                        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(near)], strict=False):
                            pairs = np.repeat(row[near[a:b]], hi[a:b] - lo[a:b]) * len(names) + at[hashing.ranges(lo[a:b], hi[a:b] - lo[a:b])]
                            met = np.union1d(met, pairs)
                    last, whole = -1, None
                    for pair in met.tolist():
                        row, c = divmod(pair, len(names))
                        if row != last:
                            last, whole = row, np.unique(hashed[offsets[row] : offsets[row + 1]])
                        n = int(np.isin(sets[c], whole, assume_unique=True).sum())
                        if 100 * n >= percent * sizes[c]:
                            took.append(first + row)
                            found.append(c)
                            both.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(took, pa.int64())), names.take(pa.array(found, pa.int64())), pa.array(both, pa.int64()), pa.array([sizes[c] for c in found], pa.int64())],
                    names=["doc", "item", "shared", "n"],
                )
                hashing.let_go()

        return docs.mapInArrow(search, schema)

    # More items than may be broadcast: the same bands meet in a join, and so do the shingles of candidates.
    # What is sent then is a filter of _FILTER_BITS bits whatever the index, so that few bands that no item has are shuffled.
    known = index.select("item", F.explode("bands").alias("band"))
    slot = F.col("band").bitwiseAND(F.lit(_FILTER_BITS - 1))
    words = known.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(band & 63 AS INT))")).alias("bits")).toArrow()
    filter_ = np.zeros(_FILTER_BITS // 64, np.int64)
    filter_[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = hashing.Circulant(COORDINATES)
        for batch in batches:
            for first, _, at, parts in bands_of(batch.column(1), circulant):
                if not parts:
                    continue
                row, bands = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                own = (bands & np.uint64(_FILTER_BITS - 1)).astype(np.int64)
                some = np.flatnonzero(sent.value[own >> 6] >> (own & 63) & 1)
                row, bands = row[some], bands[some]
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(at) - 1))[1:]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), _lists([_signed(np.unique(b)) for b in np.split(bands[order], cuts)])], names=["doc", "bands"])
                hashing.let_go()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([_signed(np.unique(h)) for h in hashing.shingle_rows(batch.column(1), shingle)])], names=["doc", "_whole"])
            hashing.let_go()

    pairs = stored(docs.mapInArrow(explode, f"doc {kind}, bands array<long>").select("doc", F.explode("bands").alias("band")).join(known, "band").select("doc", "item").distinct(), "candidates")
    texts = docs.join(pairs.select("doc").distinct(), "doc", "left_semi").mapInArrow(whole, f"doc {kind}, _whole array<long>")
    both = F.size(F.array_intersect("items", "_whole")).cast("long")
    return pairs.join(index.select("item", "n", "items"), "item").join(texts, "doc").select("doc", "item", both.alias("shared"), "n").where(F.col("shared") * 100 >= F.col("n") * percent)


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """key, item, item_shingles, shared and containment of every document that holds ``percent`` of an item's shingles.

    Shingles are of ``shingle`` words (runs outside ASCII white space, A-Z
    lower-cased); an item of fewer words is one shingle, found in documents
    that are that sequence.  Null or empty texts hold and are nothing;
    rows without a key are left out; repeated rows give one pair; empty
    tables give none; other columns are left alone; keys may have any type
    that can be joined on.  An index of at most ``broadcast`` entries is sent
    to the tasks, a larger one is joined.
    """
    index = stored(item_index(items, item, item_text, shingle, percent), "items")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    found = _contained(rows, index, shingle, percent, broadcast)
    return found.distinct().select(F.col("doc").alias(key), F.col("item").alias(item), F.col("n").alias("item_shingles"), "shared", (F.col("shared") / F.col("n")).alias("containment"))
