"""SimHash fingerprints of whole texts, and classes of near fingerprints, in built-in functions only.

Terms are pairs of neighbouring words; the number of times that a term
occurs is its weight; texts of all lengths have the same kind of terms, so
near copies have them in common whatever their lengths.  A term's hash votes
for or against each of 128 bits, and a bit is set when most votes are for it.
Votes are counted two to a 64-bit sum, 32 bits each, so a text may have
billions of terms, and counts of a text are combined before they are shuffled.

Fingerprints of 8 blocks within a Hamming radius r < 8 agree in at least 8 - r
blocks.  For each choice of so many blocks there is a table of the
fingerprints permuted so that these come first; those that share them meet in
a bucket and are compared, so nothing within the radius is missed.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import BLOCK, least_keys, linked, met
from .storage import stored, whole

BITS, BLOCKS, RADIUS = 128, 8, 6
_SPACE = r"[\x20\x09-\x0D]+"
_PAIR = 0x0000000100000001


def words(text: Column) -> Column:
    """Words of a lower-cased text; none of an empty one."""
    return F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")


def term_hashes(parts: Column) -> Column:
    """64-bit hashes of the terms: neighbouring words, or the word of a single one."""
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.element_at(parts, i), F.element_at(parts, i + 1)))).otherwise(F.transform(parts, lambda w: F.xxhash64(w)))


def _votes(h: Column, salt: int) -> list[Column]:
    own = h if salt == 0 else F.when(h.isNotNull(), F.xxhash64(h, F.lit(salt)))
    return [F.sum(F.shiftrightunsigned(own, k).bitwiseAND(F.lit(_PAIR))).alias(f"v{salt}_{k}") for k in range(32)]


def _bits(salt: int) -> Column:
    """The 64 majority bits of one half as a long."""
    set_ = []
    for k in range(32):
        v = F.coalesce(F.col(f"v{salt}_{k}"), F.lit(0))
        for part, at in ((v.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(v, 32), k + 32)):
            set_.append(F.shiftleft((part * 2 > F.col("terms")).cast("long"), at))
    return reduce(lambda a, b: a.bitwiseOR(b), set_)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """f0 and f1, the halves of the fingerprint, for each distinct ``keys`` of ``rows``."""
    parts = rows.select(*keys, words(F.col(text)).alias("_words"))
    hashed = parts.select(*keys, F.explode_outer(term_hashes(F.col("_words"))).alias("_h"))
    counted = hashed.groupBy(*keys).agg(F.count("_h").alias("terms"), *_votes(F.col("_h"), 0), *_votes(F.col("_h"), 1))
    return counted.select(*keys, _bits(0).alias("f0"), _bits(1).alias("f1"))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    return 1 - bits_apart(a0, a1, b0, b1) / F.lit(float(BITS))


def shown(f0: Column, f1: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(f0), 16, "0")), F.lower(F.lpad(F.hex(f1), 16, "0")))


def neighbours(ids: DataFrame) -> DataFrame:
    """Each row (doc, id, h, n_chars, times) with id and h of the next one by descending doc; the last is followed by the first.

    Rows are dealt out by ranges of doc, numbered within a range, and ranges
    are joined at their ends, so no task holds more than a range.
    """
    dealt = stored(ids.repartitionByRange(F.col("doc").desc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(F.col("doc").desc_nulls_last(), F.col("h"))
    numbered = dealt.withColumn("_next", F.lead(F.struct("id", "h")).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    ends = Window.orderBy("_range")
    starts = numbered.where("_first").select("_range", F.struct("id", "h").alias("_start"))
    after = starts.select("_range", F.coalesce(F.lead("_start").over(ends), F.first("_start").over(ends)).alias("_after"))
    to = F.coalesce("_next", "_after")
    return numbered.join(after, "_range").select("doc", "id", "h", "n_chars", "times", to.getField("id").alias("next_id"), to.getField("h").alias("next_h"))


def block_tables(f0: Column, f1: Column, radius: int) -> Column:
    """A value for each choice of the blocks that fingerprints within the radius have in common."""
    width = BITS // BLOCKS
    blocks = [F.shiftrightunsigned(f, k * width).bitwiseAND(F.lit((1 << width) - 1)) for f in (f0, f1) for k in range(BLOCKS // 2)]
    return F.array(*[F.xxhash64(F.lit(i), *[blocks[k] for k in chosen]) for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius))])


def bits_apart(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def near_classes(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """f0, f1 and near_class (the least doc that steps of ``radius`` bits at most lead to) of all distinct fingerprints of ``prints`` (doc, f0, f1)."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be from 0 to {BLOCKS - 1} bits")
    nodes = prints.where("doc is not null").groupBy("f0", "f1").agg(F.min("doc").alias("key")).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "prints")
    shared = stored(met(nodes.select("node", F.lit(0).alias("n"), F.explode(block_tables(F.col("f0"), F.col("f1"), radius)).alias("bucket"))), "buckets")

    def confirm(pairs: DataFrame) -> DataFrame:
        left, right = (whole(nodes).select(F.col("node").alias(k), F.col("f0").alias(f"{k}0"), F.col("f1").alias(f"{k}1")) for k in ("a", "b"))
        near = bits_apart(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) <= radius
        return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")

    within = lambda a, b: bits_apart(a("f0"), a("f1"), b("f0"), b("f1")) <= radius
    labels = linked(shared, confirm, lambda n, m: F.lit(True), nodes.drop("key"), within, block=block)
    return nodes.join(whole(least_keys(nodes.select("node", "key"), labels)), "node").select("f0", "f1", F.col("least").alias("near_class"))


def edited_and_near(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how they compare.

    The edited text has the last third of its code points replaced by as many
    of the first ones of the next row by descending key (after the last, the
    first), or by all that there are.  near_class is the least key among the
    fingerprints that steps of at most ``radius`` bits lead to.

    Null texts count as empty, and an empty text has the fingerprint of no
    set bit.  A row repeated with key and text is one place in the order and
    comes out as often as it went in; rows that share a key only are ordered
    by their text's hash; null keys come last and have a class only through
    others.  An empty table gives no rows; other columns are left alone.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # A row's name, never null so that joins need no more than its hash partitioning.
    named = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), body.alias("text")).withColumn("h", F.xxhash64("text"))
    texts = named.groupBy("id", "h").agg(F.first("text").alias("text"))
    ids = named.select("doc", "id", "h", F.char_length("text").cast("long").alias("n_chars"))
    ids = ids.groupBy(*ids.columns).agg(F.count("*").cast("int").alias("times"))
    order = stored(neighbours(ids), "neighbours")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    heads = texts.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("_text")).join(whole(order), ["next_id", "next_h"])
    heads = heads.select("doc", "id", "h", "n_chars", "times", "next_id", "next_h", F.substring("_text", F.lit(1), third).alias("head"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), "head")
    both = texts.join(whole(heads), ["id", "h"]).withColumn("edited", edited)
    keys = ["doc", "id", "h", "n_chars", "times", "next_id", "next_h", "sha"]
    sides = both.withColumn("sha", F.unhex(F.sha2("edited", 256))).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("_s"))
    prints = stored(fingerprints(sides.select(*keys, "_s.side", "_s.text"), [*keys, "side"], "text"), "fingerprints")
    plain = prints.where("side = 0")
    changed = prints.where("side = 1").select("id", "h", F.col("f0").alias("e0"), F.col("f1").alias("e1"))
    following = plain.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    out = plain.join(whole(changed), ["id", "h"]).join(whole(following), ["next_id", "next_h"])
    out = out.join(whole(near_classes(plain.select("doc", "f0", "f1"), radius)), ["f0", "f1"], "left")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times")))
    f, e, n = (tuple(F.col(f"{c}{i}") for i in (0, 1)) for c in "fen")
    return out.select(
        F.col("doc").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown(*f).alias("fingerprint"), shown(*e).alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"), likeness(*f, *n).alias("near_next"), "near_class",
    )
