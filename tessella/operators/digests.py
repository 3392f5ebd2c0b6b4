"""Fingerprints of tables that do not depend on the order of rows, and manifests compared by them.

A row has a SHA-256 of its values; two slices of sixty bits of it are summed
modulo a prime each, with the number of rows beside them.  Sums of parts add
up to that of the whole, so nothing is sorted and nothing gathered, and any
partitioning gives the same digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMES = (1152921504606846883, 1152921504606846869)


def row_text(columns: list[str]) -> Column:
    """The values of a row as one text that tells null from empty and where each ends."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.octet_length(value(c)).cast("string"), F.lit(":"), value(c))) for c in columns])


def row_digest(columns: list[str]) -> Column:
    return F.sha2(row_text(columns), 256)


def table_digest(rows: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """n, a, b and digest of all rows, or of those of each value of ``by``.

    The columns are taken by name, so their order in the table is nothing
    either; a row twice counts twice.  Values must have one text form (no
    maps, and numbers of one type).
    """
    columns = sorted(columns or [c for c in rows.columns if c not in by])
    slices = [F.conv(F.substring("_d", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in (0, 1)]
    hashed = rows.select(*by, row_digest(columns).alias("_d"))
    sums = [F.coalesce(F.sum(s).cast("decimal(38,0)") % p, F.lit(0)).cast("long").alias(name) for s, p, name in zip(slices, PRIMES, "ab", strict=True)]
    out = hashed.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "n", "a", "b"), 256))


def manifest(rows: DataFrame, key: str, fields: dict[str, Column | str]) -> DataFrame:
    """key and each field; values that stand for contents are given as SHA-256 of them, by the caller."""
    return rows.select(F.col(key).cast("string").alias("id"), *[(F.col(v) if isinstance(v, str) else v).cast("string").alias(name) for name, v in fields.items()])


def universe(current: DataFrame, baseline: DataFrame | None) -> str:
    """Whether two manifests are unchanged or changed, by their digests; unknown without a baseline.  Two rows are collected."""
    if baseline is None:
        return "unknown"
    return "unchanged" if table_digest(current).first()["digest"] == table_digest(baseline).first()["digest"] else "changed"


def changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """id, change (added, removed or changed), field, baseline and current: a row for each entry that came or went, and for each field that differs."""
    fields = [c for c in current.columns if c != "id"]
    old = baseline.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_old"))
    both = current.withColumn("_new", F.lit(True)).join(old, "id", "full_outer")
    nothing = F.lit(None).cast("string")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    entry = F.struct(nothing.alias("field"), nothing.alias("baseline"), nothing.alias("current"))
    differing = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("baseline"), F.col(c).alias("current"))) for c in fields]))
    found = both.select("id", change.alias("change"), F.when(change == "changed", differing).otherwise(F.array(entry)).alias("d"))
    return found.select("id", "change", F.explode("d").alias("d")).select("id", "change", "d.field", "d.baseline", "d.current")
