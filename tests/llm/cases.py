"""Small tables with the awkward rows that every operator must stand."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n int, key string, h int, component int, shard string, _part int, length int"
LONG = "lorem ipsum dolor " * 20_000


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (3, "the QUICK brown fox jumps over the lazy dog and runs away from the big bad bear"),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "word"),
        (8, "Word"),
        (9, LONG),
        (10, "naïve café ünïcode 日本語 text with ½ and emoji 🎉 here"),
        (None, "a row without an identifier but with words in it"),
        (12, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (12, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"),
        (13, "x" * 700_000),
    ]
    return [(i, t, "en", None, None, "node", 1, "key", 2, 3, "s", 4, 5) for i, t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return re.findall(rb"[^\x20\x09-\x0d]+", low)


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
