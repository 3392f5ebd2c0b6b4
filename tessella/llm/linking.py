"""Components of documents that share buckets, without all pairs of a bucket.

A bucket of m nodes is gone over with one leader at a time, m pairs each.
What a round has joined to one component is left out of the next; a last
round takes every pair of nodes of different components that a bucket still
holds.  So components are those of all links that buckets show.

Of two nodes of different components one at least is not of a given one, so
the last round joins the nodes outside the leader's component with all of
their bucket; a bucket that is nearly one component costs little.  Both sides
of a large bucket are dealt out by blocks of about ``BLOCK`` nodes, and a
block of one side meets every block of the other under a key of their own, so
no key has more than two blocks, whatever the settings of adaptive plans.

Exploded rows are joined by ``whole``: Spark takes them for as large as what
they are made of and would send them to the driver and every task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored, whole

BLOCK = 2048


def met(banded: DataFrame) -> DataFrame:
    """Of rows (node, n, bucket) those whose bucket holds several nodes, with the least of them as lead."""
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).where("lead <> _last")
    return banded.join(whole(shared.select("bucket", "lead")), "bucket")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links lead to) for all nodes of ``links`` (a, b).

    Each node takes the least label among its neighbours and then the label
    of that label, until none changes; chains shrink by half each time.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("node"), F.least("a", "_least").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("_least"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("_old"), F.least("component", "_least").alias("_new"))
        above = labels.select(F.col("node").alias("_new"), F.col("component").alias("_above"))
        after = stored(moved.join(above, "_new").select("node", "_old", F.least("_new", "_above").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("_old <> component").isEmpty():
            return labels


def least_keys(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node and the least key of its component for all ``nodes`` (node, key), those without a label having their own."""
    placed = nodes.join(labels, "node")
    least = placed.groupBy("component").agg(F.min("key").alias("_least"))
    found = placed.select("node", "component").join(least, "component").select("node", "_least")
    return nodes.join(found, "node", "left").select("node", F.coalesce("_least", "key").alias("least"))


def _dealt(rows: DataFrame, own: str, over: str) -> DataFrame:
    """``rows`` with their block of ``own`` (a count of blocks) as ``_in`` and once for each of ``over`` blocks of the other side as ``_to``."""
    place = F.pmod(F.xxhash64("node", "bucket"), F.col(own)).cast("int")
    return rows.withColumn("_in", place).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col(over) - 1))).drop(own, over)


def linked(
    shared: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    alike: Callable[[Column, Column], Column],
    detail: DataFrame,
    close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    rounds: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """node, component for the nodes of ``shared`` (node, n, bucket, lead) that have links.

    confirm: keeps those of the pairs (a, b) that are links; alike: whether
    nodes with these n can be linked at all; detail: node and what ``close``
    needs of it to tell links, within the join of the last round, so that
    this join has no rows but links (and what ``confirm`` then refutes);
    block: the nodes of a bucket that go under one key there.
    """
    sizes = shared.select(F.col("node").alias("lead"), F.col("n").alias("_n")).distinct()
    first = shared.where("node <> lead").select("lead", "node", "n").distinct().join(sizes, "lead").where(alike(F.col("n"), F.col("_n")))
    tried = stored(first.select(F.col("lead").alias("a"), F.col("node").alias("b")), "pairs")
    links = stored(confirm(tried), "links")
    labels = components(links)
    for turn in range(1, rounds + 1):
        held = shared.drop("lead").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        leader = F.max(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "component"))
        mixed = held.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), leader.alias("_lead")).where("_lo <> _hi")
        if turn < rounds:
            pairs = held.join(mixed, "bucket").where(F.col("component") != F.col("_lead.component")).where(alike(F.col("n"), F.col("_lead.n")))
            pairs = pairs.select(F.least("node", "_lead.node").alias("a"), F.greatest("node", "_lead.node").alias("b"))
        else:
            # Of two nodes of different components one at least is not of the leader's.
            outside = F.sum((F.col("component") != F.col("_lead.component")).cast("long"))
            placed = held.join(mixed.select("bucket", "_lead"), "bucket")
            blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
            led = placed.groupBy("bucket").agg(F.first("_lead.component").alias("_led"), blocks(F.count("*")).alias("_all"), blocks(outside).alias("_some"))
            right = held.join(led, "bucket").withColumn("_major", F.col("component") == F.col("_led")).drop("_led")
            left = _dealt(right.where("NOT _major"), "_some", "_all").withColumnsRenamed({"_in": "_x", "_to": "_y"}).join(whole(detail), "node")
            right = _dealt(right, "_all", "_some").withColumnsRenamed({"_in": "_y", "_to": "_x"}).join(whole(detail), "node")
            key = ["bucket", "_x", "_y"]
            right = right.select(*key, *[F.col(c).alias(f"_{c}") for c in right.columns if c not in key])
            apart = (F.col("__major") | (F.col("node") < F.col("_node"))) & (F.col("component") != F.col("_component")) & alike(F.col("n"), F.col("_n"))
            pairs = left.join(whole(right), key).where(apart & close(F.col, lambda c: F.col(f"_{c}")))
            pairs = pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(confirm(pairs), "links")
        tried = tried.union(pairs)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    return labels
