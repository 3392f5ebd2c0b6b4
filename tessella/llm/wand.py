"""Ranked search of words with variable blocks of maxima, over shards of documents.

1. Items are taken in blocks of a bounded number of distinct terms.  For each
   block one pass over the texts writes a forward index: of each document the
   block's terms that it holds, how often, and its length.  A term found by
   its hash counts only if its bytes are the item's.
2. Document counts of terms, the number of documents and their lengths are
   summed from that index.
3. A shard is a run of documents of the index with a bounded number of
   postings, made in the task that reads them: its postings are sorted by
   term, scored, and cut into blocks by dynamic programming, so that the sum
   of what block maxima overstate plus a price for each block is least.
4. For an item, the block maxima of its terms add up to an upper bound between
   any two block ends.  Stretches of the highest bounds are scored first; all
   others whose bound is below the tenth score by then are skipped.  What is
   left is scored whole, so the ten best of a shard are exact; the ten best of
   all shards are merged.

No word is shuffled, so a frequent one is nobody's hot key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .storage import stored

# The contract's term: a run of ASCII letters and digits and of all other characters.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
K1_M, WEIGHT, B = 8, 1000, 75
TERMS, DOCS, POSTINGS = 1_000_000, 1 << 14, 1 << 21
LONGEST, PRICE = 48, 2.0
_FIRST = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_INSIDE = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_TO_SPACE = np.array([(c + 32 if 65 <= c <= 90 else c) if inside else 32 for c, inside in enumerate(_INSIDE.tolist())], np.uint8)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased."""
    return [t.encode().translate(_FOLD) for t in TERM.findall(text or "")]


class Vocabulary:
    """Terms by the hashes of their bytes; number k is the k-th of ``words``."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        hashed, begin, end = hashing.word_spans(data, np.array([0, len(data)]), fold=False)
        order = np.argsort(hashed, kind="stable")
        self.data, self.hashed, self.number, self.begin, self.size = data, hashed[order], order, begin[order], (end - begin)[order]
        if len(np.unique(hashed)) < len(words):
            raise ValueError("two terms of a block of items share a hash; use smaller blocks")

    def numbers(self, hashed: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word of ``data``, or -1; bytes are compared."""
        if not len(self.hashed):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        same = np.flatnonzero((self.hashed[at] == hashed) & (self.size[at] == size))
        out = np.full(len(hashed), -1)
        for k in range(0, len(same), 1 << 18):
            hits = same[k : k + (1 << 18)]
            own, sizes = at[hits], size[hits]
            equal = data[hashing.ranges(begin[hits], sizes)] == self.data[hashing.ranges(self.begin[own], sizes)]
            whole = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            out[hits[whole]] = self.number[own[whole]]
        return out


def _held(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of its terms, and (row, term, times) of those in the vocabulary."""
    data, rows = hashing.text_bytes(column)
    data = _TO_SPACE[data]
    hashed, begin, end = hashing.word_spans(data, rows, fold=False)
    lengths = np.diff(np.searchsorted(begin, rows, side="left"))
    number = vocabulary.numbers(hashed, data, begin, end - begin)
    known = np.flatnonzero(number >= 0)
    width = max(1, len(vocabulary.hashed))
    row = np.searchsorted(rows, begin[known], side="right") - 1
    both, times = np.unique(row * width + number[known], return_counts=True)
    return lengths, both // width, both % width, times


def _forward(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """doc, n, terms and times of every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in hashing.slices(batch.column(1)):
                lengths, row, term, times = _held(part, vocabulary)
                ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(a, kind_)) for a, kind_ in ((term, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(lengths, pa.int64()), *lists], names=["doc", "n", "terms", "times"])
                at += len(part)

    return docs.select(F.col(key), F.col(text)).mapInArrow(index, f"doc {kind}, n long, terms array<int>, times array<long>")


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of ``size`` terms: tasks count, and sums of their counts are gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["term", "df"])

    summed = forward.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for row in summed.toLocalIterator():
        out[row["term"]] = row["df"]
    return out


def cut_blocks(values: np.ndarray, starts: np.ndarray, price: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Where blocks of the lists of ``values`` between ``starts`` begin, of at most ``longest`` values.

    Over a list, the sum over blocks of (greatest value * length - sum) plus
    the list's ``price`` for each block is the least that any cutting has.
    All lists are gone through together, a value of each at a time; for each
    of the last ``longest`` places a block that began there is kept open.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin, price = sizes[order], starts[:-1][order], price[order].astype(float)
    n = len(sizes)
    top, total, length = (np.zeros((n, longest)) for _ in range(3))
    cost = np.full((n, longest), np.inf)
    best = np.zeros(n)
    came = np.zeros(len(values), np.int64)  # of each value, where the block that ends with it begins
    live = n
    for i in range(int(sizes.max(initial=0))):
        while live and sizes[live - 1] <= i:
            live -= 1
        slot, v = i % longest, values[begin[:live] + i][:, None].astype(float)
        t, s, k, c = top[:live], total[:live], length[:live], cost[:live]
        t[:, slot], s[:, slot], k[:, slot], c[:, slot] = 0, 0, 0, best[:live]
        np.maximum(t, v, out=t)
        s += v
        k += 1
        whole = c + t * k - s
        least = whole.argmin(axis=1)
        best[:live] = whole[np.arange(live), least] + price[:live]
        came[begin[:live] + i] = begin[:live] + i - (slot - least) % longest
    # From the last value of each list back to its first.
    firsts, at = [], starts[1:][np.diff(starts) > 0] - 1
    floor = starts[:-1][np.diff(starts) > 0]
    while len(at):
        first = came[at]
        firsts.append(first)
        going = first > floor
        at, floor = first[going] - 1, floor[going]
    return np.sort(np.concatenate(firsts)) if firsts else np.zeros(0, np.int64)


class Shard:
    """Scored postings of a run of documents, by term, in blocks with their greatest scores."""

    def __init__(self, row: np.ndarray, term: np.ndarray, score: np.ndarray, size: int, price: float = PRICE):
        order = np.lexsort((row, term))
        self.row, self.score = row[order], score[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))
        some = np.flatnonzero(np.diff(self.starts))
        cuts = np.append(self.starts[:-1][some], len(row))
        mean = np.add.reduceat(self.score, cuts[:-1]) / np.diff(cuts) if len(some) else np.zeros(0)
        self.block = cut_blocks(self.score, cuts, mean * price)
        self.after = np.append(self.block, len(row))[1:]
        self.most = np.maximum.reduceat(self.score, self.block) if len(self.block) else np.zeros(0, np.int64)
        # Blocks of a term are those from blocks[term] to blocks[term + 1].
        self.blocks = np.searchsorted(self.block, self.starts)

    def best(self, wanted: np.ndarray, times: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k highest rows and their scores, equal ones by row, and how many postings were scored.

        wanted, times: the item's terms and how often each is in it; rows: of the shard.
        """
        counts = self.blocks[wanted + 1] - self.blocks[wanted]
        own = hashing.ranges(self.blocks[wanted], counts)
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        weight = np.repeat(times, counts)
        lo, hi, bound = self.row[self.block[own]], self.row[self.after[own] - 1] + 1, self.most[own] * weight
        edges, back = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, back[: len(own)], bound)
        np.add.at(change, back[len(own) :], -bound)
        bounds = np.cumsum(change)[:-1]  # between each edge and the next
        scores, scored = np.zeros(rows, np.int64), 0

        def score(stretches: np.ndarray) -> int:
            """Score all postings of the item within these stretches."""
            wide = np.zeros(rows + 1, np.int64)
            np.add.at(wide, edges[stretches], 1)
            np.add.at(wide, edges[stretches + 1], -1)
            inside = np.cumsum(wide)[:-1] > 0
            touched = np.append(0, np.cumsum(inside))
            some = touched[hi] > touched[lo]
            runs = self.after[own[some]] - self.block[own[some]]
            at = hashing.ranges(self.block[own[some]], runs)
            kept = inside[self.row[at]]
            at = at[kept]
            np.add.at(scores, self.row[at], self.score[at] * np.repeat(weight[some], runs)[kept])
            return len(at)

        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        first = order[:_FIRST]
        scored += score(first)
        tenth = np.partition(scores, -k)[-k] if rows > k else 0
        rest = order[_FIRST:]
        rest = rest[bounds[rest] >= max(tenth, 1)]
        if len(rest):
            scored += score(np.sort(rest))
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        found = found[np.argsort(-scores[found], kind="stable")[:k]]
        return found, scores[found], scored


def _searched(forward: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], df: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """item (a number), doc and score of the k best documents of each shard."""
    kind = forward.schema["doc"].dataType.simpleString()
    weight = np.array([math.floor(WEIGHT * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    numbers = np.array([i for i, _, _ in items], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            # Rows in order of their keys, so that ties are by row.
            table = table.take(pc.sort_indices(table.column("doc"), null_placement="at_end"))
            n = table.column("n").to_numpy()
            lists = table.column("terms").combine_chunks()
            row, term = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
            tf = table.column("times").combine_chunks().flatten().to_numpy()
            m = 100 - B + (B * n * total) // max(length, 1)
            shard = Shard(row, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + K1_M * m[row])), len(df))
            found = [shard.best(wanted, times, k, len(n))[:2] for _, wanted, times in items]
            rows = np.concatenate([f[0] for f in found])
            item = np.repeat(numbers, [len(f[0]) for f in found])
            doc = table.column("doc").combine_chunks().take(pa.array(rows))
            return pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(np.concatenate([f[1] for f in found]))], names=["item", "doc", "score"])

        held, docs, postings = [], 0, 0
        for whole in batches:
            at = 0
            sizes = np.cumsum(pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)) if whole.num_rows else np.zeros(0)
            while at < whole.num_rows:
                before = int(sizes[at - 1]) if at else 0
                end = min(at + DOCS - docs, max(at + 1, int(np.searchsorted(sizes, before + POSTINGS - postings, side="right"))))
                held.append(whole.slice(at, end - at))
                docs, postings = docs + end - at, postings + int(sizes[end - 1]) - before
                at = end
                if docs >= DOCS or postings >= POSTINGS or at < whole.num_rows:
                    yield results(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield results(held)

    return forward.mapInArrow(search, f"item long, doc {kind}, score long")


def _item_blocks(items: DataFrame, most: int) -> Iterator[tuple[list[bytes], list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Distinct terms and items (number, terms, times), as many items at a time as have ``most`` distinct terms, one at least."""
    words: dict[bytes, int] = {}
    block: list[tuple[int, np.ndarray, np.ndarray]] = []
    for row in items.toLocalIterator():
        own: dict[bytes, int] = {}
        for t in terms(row["text"]):
            own[t] = own.get(t, 0) + 1
        if block and len(words) + len(own) > most:
            yield list(words), block
            words, block = {}, []
        numbers = [words.setdefault(t, len(words)) for t in own]
        block.append((row["item"], np.array(numbers, np.int64), np.array(list(own.values()), np.int64)))
    if block:
        yield list(words), block


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_terms: int = TERMS) -> DataFrame:
    """item, rank (from 1), key and score of the k best rows of ``docs`` for each row of ``items``, all if fewer have a score.

    Equal scores are ordered by key, a null key last.  Rows of ``docs`` that
    share a key, or are repeated whole, are documents of their own, and so are
    such items: rows that share an item's name have a ranking each.  Null and
    empty texts have no terms: such documents are in no ranking and not
    counted, such items have none.  Without documents or items there are no
    rows; other columns are left alone.  Items go through the driver in blocks
    of ``block_terms`` distinct terms, and the texts are read once for each.
    """
    numbered = stored(items.select(F.col(item).alias("name"), F.col(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    kind = docs.schema[key].dataType.simpleString()
    found = None
    for words, block in _item_blocks(numbered, block_terms):
        forward = stored(_forward(docs, key, text, Vocabulary(words)), "forward")
        total, length = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = _searched(forward, block, _frequencies(forward, len(words)), total, length, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        own = stored(own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
        found = own if found is None else found.union(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item long, doc {kind}, score long, rank int")
    return found.join(numbered.select("item", "name"), "item").select(F.col("name").alias(item), "rank", F.col("doc").alias(key), "score")
