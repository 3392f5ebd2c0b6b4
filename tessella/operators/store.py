"""A knowledge store as tables: documents by URL, chunks by (document, chunk_key), generations.

Each function takes the present tables and what comes in and returns the new
table, so a caller writes it where the next run reads it.  Merges are equi-joins
or groupings on the key and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: Grace of vectors without a tracked chunk, and of staged ones.
GRACE_MS, STAGED_GRACE_MS = 15 * MINUTE_MS, 360 * MINUTE_MS
DOCUMENT = ("canonical_url", "title", "content_hash", "fingerprint", "category", "generation", "status", "crawled_at")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: that with the largest values in ``order``; rows equal in these are told apart by all their columns."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_best").getField(c).alias(c) for c in (*order, *rest)]).select(*rows.columns)


def upsert_documents(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """The documents after ``incoming`` (canonical_url, title, content_hash, fingerprint, category, crawled_at), and fast_path.

    Equal content and fingerprint leave a row as it is, crawl time included
    (fast_path); another one raises its generation; a new URL starts active at
    generation 1.  fast_path is null for rows that nothing came in for.
    """
    new = latest(incoming, ["canonical_url"], "crawled_at").select(F.col("canonical_url"), *[F.col(c).alias(f"_{c}") for c in ("title", "content_hash", "fingerprint", "category", "crawled_at")], F.lit(True).alias("_in"))
    both = present.join(new, "canonical_url", "full_outer")
    known, came = F.col("generation").isNotNull(), F.coalesce("_in", F.lit(False))
    same = known & came & F.col("content_hash").eqNullSafe(F.col("_content_hash")) & F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))
    take = came & ~same
    pick = lambda c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    generation = F.when(~known, F.lit(1)).when(take, F.col("generation") + 1).otherwise(F.col("generation")).cast("long")
    return both.select("canonical_url", pick("title"), pick("content_hash"), pick("fingerprint"), pick("category"), generation.alias("generation"), F.when(~known, F.lit("active")).otherwise(F.col("status")).alias("status"), pick("crawled_at"), F.when(came, same).alias("fast_path"))


def upsert_chunks(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks (document, chunk_key, generation, ...) with incoming ones in the place of those of their key, unless these have a later generation."""
    return latest(present.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))), ["document", "chunk_key"], "generation", "_new").drop("_new")


def commit_generations(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of each document's generation (of documents: document, generation), and (document, deleted): how many older ones go.

    Chunks of a later generation, whose document isn't there yet, stay.
    """
    joined = chunks.join(documents.select("document", F.col("generation").alias("_committed")), "document", "left")
    old = F.coalesce(F.col("generation") < F.col("_committed"), F.lit(False))
    deleted = joined.groupBy("document").agg(F.sum(old.cast("long")).alias("deleted"))
    return joined.where(~old).drop("_committed"), deleted


def delete_documents(rows: DataFrame, gone: DataFrame, key: str = "document") -> DataFrame:
    """``rows`` without those of the documents in ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def get_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that ``refs`` (position, document, chunk_key) name, ones that don't exist left out; positions give the order."""
    return refs.join(chunks, ["document", "chunk_key"])


def parent_text(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks with parent_text: that of their parent if they have a parent_id, else what they hold inline (legacy_text)."""
    joined = chunks.join(parents.select("parent_id", F.col("text").alias("_parent")), "parent_id", "left")
    return joined.withColumn("parent_text", F.when(F.col("parent_id").isNotNull(), F.col("_parent")).otherwise(F.col("legacy_text"))).drop("_parent")


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """document, chunk_key and action (new, changed, unchanged, deleted) of all chunks of two snapshots (document, chunk_key, content_hash)."""
    both = old.select("document", "chunk_key", F.col("content_hash").alias("_old"), F.lit(True).alias("_was")).join(new.select("document", "chunk_key", F.col("content_hash").alias("_new"), F.lit(True).alias("_is")), ["document", "chunk_key"], "full_outer")
    action = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select("document", "chunk_key", action.alias("action"))


def completion(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document, stored and complete: the counter has reached what is expected and as many rows are stored."""
    stored = chunks.groupBy("document").agg(F.count("*").alias("stored"))
    joined = documents.join(stored, "document", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return joined.select("document", "stored", ((F.col("counter") >= F.col("expected")) & (F.col("stored") == F.col("expected"))).alias("complete"))


def vector_class(tracked: Column, status: Column) -> Column:
    """Class of a vector entry by whether a chunk tracks it and by its status."""
    own = F.when(status == "ready", "READY").when(status == "pending", "PENDING")
    return F.when(tracked, F.concat(F.lit("TRACKED_"), F.coalesce(own, F.lit("REPLACED_STALE")))).otherwise(F.concat(F.lit("UNTRACKED_"), F.coalesce(own, F.lit("REPLACED"))))


def reconcile(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """class and n of the entries of ``vectors`` (entry, status) against the entries that ``chunks`` name."""
    known = chunks.where("entry IS NOT NULL").select("entry", F.lit(True).alias("_tracked")).distinct()
    joined = vectors.join(known, "entry", "left")
    return joined.groupBy(vector_class(F.coalesce("_tracked", F.lit(False)), F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def collectable(vectors: DataFrame, chunks: DataFrame, now: int) -> DataFrame:
    """Entries (entry, status, created_at) that no chunk names and that are older than their grace."""
    grace = F.when(F.col("status") == "staged", STAGED_GRACE_MS).otherwise(GRACE_MS)
    return vectors.join(chunks.select("entry").distinct(), "entry", "left_anti").where(F.lit(now) - F.col("created_at") > grace)


def integrity(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """check and n: keys that a document has twice, keys of several documents, chunks of no document."""
    twice = chunks.groupBy("document", "chunk_key").count().where("count > 1")
    shared = chunks.groupBy("chunk_key").agg(F.countDistinct("document").alias("n")).where("n > 1")
    lost = chunks.join(documents.select("document").distinct(), "document", "left_anti")
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, x in (("duplicate_keys", twice), ("key_collisions", shared), ("orphan_chunks", lost))]
    return parts[0].union(parts[1]).union(parts[2])


def merged_stats(sides: DataFrame) -> DataFrame:
    """Over the sides of a composite store (ok, documents, chunks, bytes, duplicates): counts that both hold are the larger, bytes and faults add up, all must be ok."""
    return sides.agg(F.max("documents").alias("documents"), F.max("chunks").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum("duplicates").alias("duplicates"), F.bool_and("ok").alias("healthy"))


def dead_letter_step(rows: DataFrame, now: int, most: int = 2, stuck_ms: int = 30 * MINUTE_MS) -> DataFrame:
    """Dead letters (key, status, payload, attempts, last_at) after one sweep, with ``next``.

    Processing ones older than ``stuck_ms`` go back to pending_retry; of
    pending ones those without payload or with ``most`` attempts are abandoned
    and the others are processed.
    """
    stuck = (F.col("status") == "processing") & (F.coalesce("last_at", F.lit(0)) < now - stuck_ms)
    bad = F.col("payload").isNull() | (F.trim("payload") == "") | (F.col("attempts") >= most)
    return rows.withColumn("next", F.when(stuck, "pending_retry").when(F.col("status") == "pending_retry", F.when(bad, "abandoned").otherwise("processing")).otherwise(F.col("status")))


def fold_events(events: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """url, state, attempts, http_status, title and content_hash from ledger events (url, at, seq, state, http_status, title, content_hash).

    A value that an event lacks doesn't overwrite an earlier one; a final
    state is not replaced by one that is none; attempts count the fetches.
    """
    place = F.struct("at", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    final = F.max_by("state", F.when(F.col("state").isin(*terminal), place))
    return events.groupBy("url").agg(F.coalesce(final, F.max_by("state", place)).alias("state"), F.sum((F.col("state") == "fetching").cast("long")).alias("attempts"), last("http_status"), last("title"), last("content_hash"))


def schedule_links(links: DataFrame, ledger: DataFrame, depth: int, terminal: tuple[str, ...]) -> DataFrame:
    """url, depth, state and place of distinct links (url, depth, score): by score, too deep ones are skipped_depth, ones with a final state keep it."""
    each = links.groupBy("url").agg(F.min("depth").alias("depth"), F.max("score").alias("score"))
    joined = each.join(ledger.select("url", F.col("state").alias("_had")), "url", "left")
    state = F.when(F.col("_had").isin(*terminal), F.col("_had")).when(F.col("depth") > depth, "skipped_depth").otherwise("discovered")
    out = joined.withColumn("state", state)
    order = Window.partitionBy("depth").orderBy(F.desc("score"), "url")
    return out.withColumn("place", F.row_number().over(order)).select("url", "depth", "state", "place")
