"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts gives each row the size of its shingle set, a
   128-bit key of the set, and band values of a circulant MinHash signature.
2. Rows with equal sets become one node, numbered; it is by set and not by
   key, so rows that share a key but not a text are nodes of their own.
3. In each bucket (a band value that several nodes share) every node is
   paired with one leader, so a bucket of m nodes costs m pairs.  Pairs are
   confirmed on full sets, confirmed ones are links, and links are joined to
   components.
4. Buckets that still hold several components are gone over with other
   leaders, and at the end every pair of nodes of different components there
   is tested within the join, so that it gives links and not pairs, and no
   link that a bucket shows is lost.  Pairs within a component are left out:
   they can't change it.  The test first bounds the overlap by bit maps.

With 32 bands of 4 coordinates a pair at similarity 0.8 meets in no bucket
once in 2e7; above, more rarely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .linking import BLOCK, least_keys, linked, met
from .storage import stored

BANDS, ROWS = 32, 4


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _set_key(own: np.ndarray) -> bytes | None:
    """A 128-bit name of a set of hashes in order; none of an empty one."""
    return hashlib.blake2b(own, digest_size=16).digest() if len(own) else None


def signed_sets(docs: DataFrame, key: str, text: str, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each row's key, n (distinct shingles), set_key (null without any) and band values."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = hashing.Circulant(bands * rows)
        for batch in batches:
            sizes, keys, index, sets = [], [], {}, []
            for hashed in hashing.shingle_rows(batch.column(1), shingle):
                own = np.unique(hashed)
                sizes.append(len(own))
                name = _set_key(own)
                keys.append(name)
                if name is not None and name not in index:
                    index[name] = len(sets)
                    sets.append(own)
            values = [_signed(v) for v in hashing.band_hashes(circulant.signatures(sets), rows)] if sets else []
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists([none if k is None else values[index[k]] for k in keys])],
                names=["key", "n", "set_key", "bands"],
            )
            hashing.let_go()

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(sign, f"key {kind}, n long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, the distinct shingle hashes and a map of 1024 bits of them, for the rows of ``docs`` (node, set_key, text) whose text has that set."""
    maps = [f"b{k}" for k in range(16)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, took, parts, bits = 0, [], [], []
            names, rows = batch.column(1).to_pylist(), hashing.shingle_rows(batch.column(2), shingle)
            for i, hashed in enumerate(rows):
                own = np.unique(hashed)
                if _set_key(own) == names[i]:
                    took.append(i)
                    parts.append(_signed(own))
                    map_ = np.zeros(1024, bool)
                    map_[(own & np.uint64(1023)).astype(np.int64)] = True
                    bits.append(np.packbits(map_).view(np.int64))
                    held += len(own)
                if took and (held > 1_000_000 or i == batch.num_rows - 1):
                    columns = np.stack(bits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), _lists(parts), *(pa.array(columns[:, k]) for k in range(16))], names=["node", "items", *maps])
                    held, took, parts, bits = 0, [], [], []

    return docs.select("node", "set_key", "text").mapInArrow(of, "node long, items array<long>, " + ", ".join(f"{m} long" for m in maps))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _shortened(sets: DataFrame) -> DataFrame:
    """Sets by the upper halves of their hashes; spare: how many of these are equal to others of the set."""
    short = F.transform("items", lambda x: F.shiftright(x, 32).cast("int"))
    return sets.select("node", F.array_distinct(short).alias("items"), (F.size("items") - F.size(F.array_distinct(short))).alias("spare"), *[f"b{k}" for k in range(16)])


def _reached(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether shortened sets can be links: first by bits that only one map has, each of which an own item set, then by the overlap."""
    only = lambda x, y: reduce(lambda s, t: s + t, [F.bit_count(x(f"b{k}").bitwiseAND(F.bitwise_not(y(f"b{k}")))) for k in range(16)])
    need = (a("n") + b("n")) * percent
    maps = F.least(a("n") - only(a, b), b("n") - only(b, a)) * (100 + percent) >= need
    return maps & ((F.size(F.array_intersect(a("items"), b("items"))) + F.greatest(a("spare"), b("spare"))) * (100 + percent) >= need)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * |A and B| >= percent * |A or B|."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("_a") + F.size("_b") - both) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, rounds: int = 2, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id and kept for every row of ``docs``.

    Words are runs outside ASCII white space with A-Z lower-cased, a set has
    the distinct shingles of ``shingle`` words; with fewer words the whole
    sequence is the one shingle.  Null and empty texts have empty sets and
    are linked with nothing.  component_id is the least key reachable by
    links; kept says whether that is the row's own.  Rows that share a key
    and differ in text are documents of their own, with one name; a null key
    never is a least one and never kept unless alone.  An empty table gives
    no rows; other columns are left alone.
    """
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    signed = stored(signed_sets(docs, "doc", "text", shingle, bands, rows), "signed")
    classes = stored(signed.where("n > 0").groupBy("set_key").agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id()), "classes")
    own = classes.where("key IS NOT NULL")
    # One row of each set, or equal ones, stands for it.
    nodes = signed.select("key", "set_key", "n", "bands").join(own, ["set_key", "key"]).select("node", "n", "bands")
    shared = stored(met(nodes.select("node", "n", F.explode("bands").alias("bucket"))), "buckets")
    involved = own.join(shared.select("node").distinct(), "node").select(F.col("key").alias("doc"), "node", "set_key")
    sets = stored(shingle_sets(docs.join(involved, "doc"), shingle).dropDuplicates(["node"]), "sets")

    labels = linked(shared, lambda pairs: confirmed(pairs, sets, percent), lambda n, m: _alike(n, m, percent), _shortened(sets), lambda a, b: _reached(a, b, percent), rounds, block)
    named = classes.select("set_key", "node").join(least_keys(classes.select("node", "key"), labels), "node").select("set_key", F.col("least").alias("_component"))
    component = F.coalesce("_component", "key")
    return signed.join(named, "set_key", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.col("_component").isNull()).alias("kept")
    )
