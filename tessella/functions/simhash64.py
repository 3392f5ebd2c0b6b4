"""The 64-bit SimHash that the crawl stage uses: three-word shingles hashed by BLAKE2b."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

_WORD = re.compile(r"[^\W_]{2,}")
#: Occurrences of one shingle that count.
MOST_VOTES = 4


def fingerprint(text: str | None) -> tuple[int, int]:
    """The signed fingerprint and the number of words (of two characters or more) of a whole text; of fewer than three words each is a shingle."""
    words = np.array(_WORD.findall((text or "").lower()), object)
    if not len(words):
        return 0, 0
    shingles, counts = np.unique(words if len(words) < 3 else words[:-2] + " " + words[1:-1] + " " + words[2:], return_counts=True)
    hashed = b"".join(hashlib.blake2b(s.encode(), digest_size=8).digest() for s in shingles)
    signs = 2 * np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64).astype(np.int64) - 1
    for_ = np.minimum(counts, MOST_VOTES) @ signs > 0
    return int.from_bytes(np.packbits(for_).tobytes(), "big", signed=True), len(words)


@F.pandas_udf(StructType().add("fp", LongType()).add("words", IntegerType()))
def simhash64(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([fingerprint(t) for t in part], columns=["fp", "words"])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
