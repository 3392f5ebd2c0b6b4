"""The trie of conversations' turns, by rolling fingerprints of their prefixes.

1. A turn's name is a hash of role and text.  One aggregation over the names
   compares the least with the greatest text of each; names that several
   texts share are split by their texts, so from then on equal names are
   equal turns.
2. Turns are dealt out by ranges of (conversation, turn), and each range is
   scanned in order by numpy: a polynomial over the names so far, modulo two
   primes.  A conversation that goes on in further ranges is put together
   from one row for each range, as such polynomials are.
3. Rebuilt conversations take the first turns of another one, so their
   prefixes have fingerprints that follow from those of the two originals by
   arithmetic; only names and fingerprints are copied, never texts.
4. Prefixes of a depth with one fingerprint are a candidate group.  The group
   is verified turn by turn: every member's last turn, and its parent group,
   must be those of the representative.  Groups where they are not are split
   by them until all groups pass.
5. Sums over subtrees double their reach in each round, so a trie as deep as
   a million turns takes twenty rounds.

No step holds a conversation or a group of conversations in one task: groups
are combined before they are shuffled, and the members that end at a node are
hashed from a stream of joined pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

FAMILY, HEADS = 5, 9
PRIMES, BASES = (2147483647, 2147483629), (1403580417, 1828906513)
BITS = 62
_PIECE = 1 << 18
_EMPTY = hashlib.sha256().hexdigest()


def _exact_names(turns: DataFrame) -> DataFrame:
    """``turns`` with equal names for equal turns only: what shares a name is told apart by its texts."""
    body = F.struct("role", "text")
    shared = turns.groupBy("name").agg(F.min(body).alias("_least"), F.max(body).alias("_last")).where("_least <> _last").select("name")
    shared = stored(shared, "shared-names")
    if shared.isEmpty():
        return turns
    texts = turns.join(shared, "name", "left_semi").select("name", "role", "text").distinct()
    split = stored(texts.withColumn("_own", F.monotonically_increasing_id() + (1 << BITS)), "split-names")
    return turns.join(split, ["name", "role", "text"], "left").withColumn("name", F.coalesce("_own", "name")).drop("_own")


def _powers(base: int, steps: np.ndarray, prime: int) -> np.ndarray:
    """base ** steps modulo the prime, by the bits of the steps."""
    out = np.ones(len(steps), np.int64)
    for bit in range(int(steps.max(initial=0)).bit_length()):
        out = np.where(steps >> bit & 1, out * pow(base, 1 << bit, prime) % prime, out)
    return out


def rolled(names: np.ndarray, first: np.ndarray, before: list[int]) -> list[np.ndarray]:
    """For each prime ``f = f * base + name`` along runs of rows; ``first``: where each row's run starts, ``before``: values that the run at 0 goes on from."""
    out, steps = [], np.arange(1, len(names) + 1)
    for prime, base, start in zip(PRIMES, BASES, before, strict=True):
        up, down = _powers(base, steps, prime), _powers(pow(base, -1, prime), steps, prime)
        sums = np.append(0, np.cumsum(names % prime * down % prime))
        start_too = np.where(first == 0, start, 0)
        out.append(((sums[1:] - sums[first] + start_too) % prime * up) % prime)
    return out


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, part, place, name, size and the polynomials f0, f1 of every row of ``turns``, each within its conversation's part."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    dealt = turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, placed, values = None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, names = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if conv[0] != last:
                placed, values = 0, [0, 0]
            index = np.arange(len(conv))
            first = np.maximum.accumulate(np.where(np.append(True, conv[1:] != conv[:-1]), index, 0))
            found = rolled(names, first, values)
            place = index - first + 1 + np.where(first == 0, placed, 0)
            last, placed, values = conv[-1], int(place[-1]), [int(f[-1]) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(place), *batch.columns[2:], *map(pa.array, found)], names=["conv", "part", "place", "name", "size", "f0", "f1"])

    return dealt.select("conv", "part", "name", "size").mapInArrow(scan, "conv long, part int, place long, name long, size long, f0 long, f1 long")


def _carried(dealt: DataFrame) -> DataFrame:
    """conv, part, n and g0, g1: what conversations that began in an earlier part bring to a later one."""
    ends = dealt.groupBy("conv", "part").agg(F.max(F.struct("place", "f0", "f1")).alias("end"))
    runs = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("runs")).where(F.size("runs") > 1)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n, values = 0, [0, 0]
                for run in row["runs"]:
                    if n:
                        rows.append((row["conv"], run["part"], n, *values))
                    own, n = run["end"], n + run["end"]["place"]
                    values = [(v * pow(b, own["place"], p) + own[f"f{k}"]) % p for k, (v, b, p) in enumerate(zip(values, BASES, PRIMES, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), *[pa.int64()] * 3))], names=["conv", "part", "n", "g0", "g1"])

    return runs.mapInArrow(carry, "conv long, part int, n long, g0 long, g1 long")


def _shifted(rows: DataFrame, others: list[str], kinds: list[str]) -> DataFrame:
    """f0, f1 of ``rows`` with what g0, g1 become over ``steps`` more names added; ``others`` go on."""

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, *both = (batch.column(k).to_numpy() for k in range(5))
            found = [pa.array((f + _powers(b, steps, p) * g) % p) for f, g, b, p in zip(both[:2], both[2:], BASES, PRIMES, strict=True)]
            yield pa.RecordBatch.from_arrays([*found, *batch.columns[5:]], names=["f0", "f1", *others])

    return rows.select("steps", "f0", "f1", "g0", "g1", *others).mapInArrow(shift, "f0 long, f1 long, " + ", ".join(kinds))


def _keyed(rows: DataFrame, bits: int) -> DataFrame:
    """conv, depth, name, size, ends with key, the fingerprint of a prefix, and above, that of the prefix without its last turn."""

    def key(f: list[np.ndarray]) -> pa.Array:
        return pa.array((f[0] << 31 | f[1]) & ((1 << bits) - 1))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, *f = (batch.column(k).to_numpy() for k in range(3))
            above = [(v - names) % p * pow(b, -1, p) % p for v, b, p in zip(f, BASES, PRIMES, strict=True)]
            yield pa.RecordBatch.from_arrays([key(f), key(above), batch.column(0), *batch.columns[3:]], names=["key", "above", "name", "conv", "depth", "size", "ends"])

    return rows.select("name", "f0", "f1", "conv", "depth", "size", "ends").mapInArrow(keys, "key long, above long, name long, conv long, depth long, size long, ends boolean")


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and their groups by (depth, key), where all of a group have one last turn and one parent group; mixed groups are split by these."""
    turn = 0
    while True:
        spread = [f(c).alias(f"{c}_{n}") for c in ("name", "above") for n, f in (("lo", F.min), ("hi", F.max))]
        groups = stored(rows.groupBy("depth", "key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *spread), "groups")
        mixed = groups.where("name_lo <> name_hi OR above_lo <> above_hi").select("depth", "key")
        if mixed.isEmpty():
            return rows, groups.select("depth", "key", F.col("above_lo").alias("above"), "conv_id", "n_convs", "size")
        turn += 1
        own = F.xxhash64("key", "name", "above", F.lit(turn))
        moved = stored(rows.join(mixed, ["depth", "key"], "left_semi").select("conv", "depth", own.alias("_key")), "split")
        upper = moved.select("conv", (F.col("depth") + 1).alias("depth"), F.col("_key").alias("_above"))
        rows = rows.join(moved, ["conv", "depth"], "left").join(upper, ["conv", "depth"], "left")
        rows = stored(rows.withColumn("key", F.coalesce("_key", "key")).withColumn("above", F.coalesce("_above", "above")).drop("_key", "_above"), "rows")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """id with the sums of leaves and saved over each subtree of ``nodes`` (id, up, leaves, saved)."""
    state = nodes
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        farther = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        after = state.join(below, "id", "left").join(farther, "up", "left")
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        state = stored(after.select("id", F.col("_up").alias("up"), add("leaves"), add("saved")), "sums")
    return state


def _ends_hashed(ends: DataFrame) -> DataFrame:
    """depth, key and the SHA-256 of the comma-joined conversations, ascending, of ``ends`` (depth, key, conv)."""
    order = ["depth", "key", "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, key, conv = (batch.column(k).to_numpy() for k in range(3))
            size = max(1, _PIECE // 20)
            new = np.append(True, (depth[1:] != depth[:-1]) | (key[1:] != key[:-1])) if len(depth) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            cuts = [c for a, b in zip(starts, np.append(starts[1:], len(depth)), strict=True) for c in range(a, b, size)]
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(depth)], strict=True)]
            took = pa.array(cuts, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(took) for c in batch.columns], pa.array(texts, pa.string())], names=[*order, "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for depth, key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (depth, key) != at:
                    if state is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, key), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_py().encode())
            yield rows_of(done)
        if state is not None:
            yield rows_of([(*at, state.hexdigest())])

    def rows_of(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["depth", "key", "ends_sha256"])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, key long, conv long, piece string")
    dealt = pieces.repartition("depth", "key").sortWithinPartitions(*order)
    return dealt.select("depth", "key", "piece").mapInArrow(digest, "depth long, key long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    family: int = FAMILY, heads: int = HEADS, name_bits: int = BITS, key_bits: int = BITS,
) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation
    c - c % family and its own turns after its first h, with h the unsigned
    crc32 of its decimal number modulo ``heads`` (1: as it is).  Turns are
    ordered by ``turn`` (null first), ties by role and the MD5 of the text;
    null roles and texts are empty; repeated rows are turns of their own;
    rows without key belong to no conversation; keys are 64-bit integers.
    An empty table gives no rows; other columns are left alone.

    conv_id: the least member; depth; parent_conv_id: that of the parent;
    n_convs: members; n_children; n_leaves: childless nodes of the subtree,
    itself included; saved_tokens: over the subtree, (n_convs - 1) times the
    bytes of the last text; ends_sha256: of the members whose last turn this is.

    name_bits and key_bits shorten hashes of turns and fingerprints, which
    changes only how often groups have to be split.
    """
    body, speaker = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    turns = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), speaker.alias("role"), body.alias("text"))
    turns = turns.withColumn("name", F.xxhash64("role", F.octet_length("role"), "text").bitwiseAND(F.lit((1 << name_bits) - 1)))
    turns = _exact_names(turns.withColumn("mark", F.unhex(F.md5("text"))).withColumn("size", F.octet_length("text").cast("long")))
    dealt = stored(_prefixes(turns.select("conv", "turn", "role", "mark", "name", "size")), "prefixes")
    carried = dealt.join(stored(_carried(dealt), "carried"), ["conv", "part"], "left")
    carried = carried.select("conv", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), "name", "size", F.col("place").alias("steps"), "f0", "f1", *[F.coalesce(g, F.lit(0)).alias(g) for g in ("g0", "g1")])
    whole = stored(_shifted(carried, ["conv", "place", "name", "size"], ["conv long", "place long", "name long", "size long"]), "whole")

    # Of each conversation its first turns, and how it is put together.
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % heads
    first = F.when(F.col("place") < heads, F.struct("place", "name", "size", "f0", "f1"))
    own = stored(whole.groupBy("conv").agg(F.max("place").alias("n"), F.sort_array(F.collect_list(first)).alias("head")), "heads")
    base = own.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("head").alias("taken"))
    built = own.withColumn("base", F.col("conv") - F.col("conv") % family).join(base, "base", "left").withColumn("h", h.cast("int"))
    built = built.withColumn("taken", F.slice(F.coalesce("taken", F.array().cast(own.schema["head"].dataType)), 1, F.greatest("h", F.lit(1)))).withColumn("e", F.when(F.col("h") > 0, F.size("taken")).otherwise(0))
    at = lambda column, place, f: F.coalesce(F.get(column, place - 1).getField(f), F.lit(0))
    change = [F.pmod(F.when(F.col("e") > 0, at(F.col("taken"), F.col("e"), f)).otherwise(0) - F.when(F.col("h") > 0, at(F.col("head"), F.col("h"), f)).otherwise(0), F.lit(p)).alias(g) for f, g, p in zip(("f0", "f1"), ("g0", "g1"), PRIMES, strict=True)]
    depth = F.col("e") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    built = stored(built.select("conv", "h", "e", *change, depth.alias("deepest"), F.when(F.col("e") > 0, F.col("taken")).alias("taken")), "built")

    copied = built.select("conv", "deepest", F.explode("taken").alias("t")).select("conv", F.col("t.place").alias("depth"), "deepest", "t.name", "t.size", "t.f0", "t.f1")
    rest = whole.join(built.drop("taken"), "conv").where("place > h").withColumn("steps", F.col("place") - F.col("h")).withColumn("depth", F.col("e") + F.col("steps"))
    rest = _shifted(rest, ["conv", "depth", "deepest", "name", "size"], ["conv long", "depth long", "deepest long", "name long", "size long"]).select(*copied.columns)
    rows = stored(_keyed(copied.union(rest).withColumn("ends", F.col("depth") == F.col("deepest")), key_bits), "rows")

    rows, groups = _verified(rows)
    root = built.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nought = F.lit(0).cast("long")
    root = root.select(nought.alias("depth"), nought.alias("key"), F.lit(None).cast("long").alias("above"), "conv_id", "n_convs", nought.alias("size"))
    nodes = stored(groups.union(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    placed = stored(nodes.join(parents, ["depth", "above"], "left"), "placed")
    children = placed.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    placed = stored(placed.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", nought)), "placed")
    leaves, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    sums = _subtree_sums(placed.select("id", "up", leaves.alias("leaves"), saved.alias("saved")))
    turnless = built.where("deepest = 0").select(nought.alias("depth"), nought.alias("key"), "conv")
    hashed = _ends_hashed(rows.where("ends").select("depth", "key", "conv").union(turnless))
    out = placed.join(sums.select("id", "leaves", F.col("saved").alias("saved_tokens")), "id").join(hashed, ["depth", "key"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )
