"""Names, metadata and quality of documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .candidates import bound
from .furniture_forms import MARKER, RULE, WORD
from .urls import origin

# Lines that are dropped when they repeat the one before have so many characters at most.
SHORT_LINE = 120


def sanitized(text: Column, most: int) -> Column:
    """Metadata without control characters, its white space as single blanks, cut to ``most`` characters (compatibility forms stay)."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, most)


def document_id(source: Column, explicit: Column) -> Column:
    """The explicit name as letters, digits, dots, underscores and hyphens, 96 at most; without one 24 digits of the source's SHA-256.  Null if nothing of a name is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(sanitized(explicit, 160)), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(F.coalesce(explicit, F.lit("")) != "", F.when(name != "", F.substring(name, 1, 96))).otherwise(F.substring(F.sha2(source, 256), 1, 24))


def comparison_url(url: Column) -> Column:
    """A key for equal addresses: scheme and host in lower case, the usual port and the fragment left out, the query as it is; empty for what is no web address."""
    value = F.trim(url)
    path = F.regexp_extract(value, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(value, r"^[^?#]*(\?[^#]*)", 1)
    found = F.concat(origin(value), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when(F.contains(value, F.lit("\\")) | (F.char_length(value) > 65_536), "").otherwise(F.coalesce(found, F.lit("")))


def normalized_markdown(text: Column) -> Column:
    """Markdown without characters of no width, blanks at line ends, repeated short lines and runs of blank lines."""
    plain = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")), "[​‌‍﻿]", "")
    lines = F.transform(F.split(plain, "\r\n|\n|\r"), lambda line, i: F.struct(i.alias("at"), F.regexp_replace(line, r"\s+$", "").alias("line")))

    def kept(all_: Column) -> Column:
        said = F.filter(all_, lambda x: x["line"] != "")
        once = bound(said, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.trim(F.get(s, i - 1)["line"]) != F.trim(x["line"])) | (F.char_length(F.trim(x["line"])) > SHORT_LINE)))
        return F.array_sort(F.concat(once, F.filter(all_, lambda x: x["line"] == "")))

    joined = F.array_join(F.transform(bound(lines, kept), lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def text_quality(text: Column, least_words: int = 50) -> Column:
    """garbage, score, reasons, words, alphabetic, distinct, lines, table_share, letter_share and odd_share of a cleaned PDF text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(F.regexp_replace(x, r"\s", " ")) != "") & ~x.rlike(MARKER) & ~x.rlike(RULE))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    start = F.struct(words.alias("w"), lines.alias("l"), F.regexp_replace(text, r"\s", "").alias("c"))

    def counted(s: Column) -> Column:
        alphabetic = F.filter(s["w"], lambda w: w.rlike(r"\p{L}"))
        tables = F.size(F.filter(s["l"], lambda x: F.size(F.split(x, r"\|")) > 2))
        share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        n = F.char_length(s["c"])
        return F.struct(
            F.size(s["w"]).alias("words"), F.size(alphabetic).alias("alphabetic"), F.size(F.array_distinct(F.transform(alphabetic, F.lower))).alias("distinct"), F.size(s["l"]).alias("lines"),
            share(tables, F.size(s["l"])).alias("table_share"), share(F.char_length(F.regexp_replace(s["c"], r"[^\p{L}\p{N}]", "")), n).alias("letter_share"), share(F.char_length(F.regexp_replace(s["c"], r"[^�\p{Co}\p{Cc}]", "")), n).alias("odd_share"), n.alias("n"),
        )

    def judged(c: Column) -> Column:
        signs = [
            ("too_few_words", c["words"] < least_words, F.lit(0.60)),
            ("too_few_alphabetic_words", c["alphabetic"] < max(5, least_words // 5), F.lit(0.45)),
            ("mostly_numeric_or_symbolic_table", (c["table_share"] > 0.50) & (c["alphabetic"] < F.greatest(F.floor(c["words"] / 3), F.lit(8))), F.lit(0.55)),
            ("symbol_heavy_output", (c["letter_share"] < 0.22) & (c["alphabetic"] < max(least_words, 20)), F.lit(0.40)),
            ("many_invalid_or_unmapped_glyphs", c["odd_share"] > 0.02, F.least(F.lit(0.60), c["odd_share"] * 10)),
            ("extremely_repetitive_text", (c["alphabetic"] >= 30) & (c["distinct"] / c["alphabetic"] < 0.06), F.lit(0.35)),
        ]
        empty = c["n"] == 0
        penalty = sum((F.when(sign, by).otherwise(0.0) for _, sign, by in signs), F.lit(0.0))
        score = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)))
        reasons = F.when(empty, F.array(F.lit("empty_after_cleaning"))).otherwise(F.array_compact(F.array(*[F.when(sign, name) for name, sign, _ in signs])))
        sparse = (c["words"] < least_words) & (c["alphabetic"] < max(10, least_words // 2))
        return F.struct((empty | sparse | (score < 0.45)).alias("garbage"), score.alias("score"), reasons.alias("reasons"), *[c[name].alias(name) for name in ("words", "alphabetic", "distinct", "lines", "table_share", "letter_share", "odd_share")])

    return bound(start, lambda s: bound(counted(s), judged))
