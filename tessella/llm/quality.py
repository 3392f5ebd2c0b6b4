"""Document quality by a regularised quadratic discriminant.

Each text gives a vector of statistics (sizes, character classes, repetition,
line shape), transformed so that counts (log) and shares (arcsine of the
root) are nearer to normal.  Each class has a mean and a covariance shrunk
towards a multiple of the identity in standardised units.  The score is the
logistic of the difference of the two log densities and priors, from
Mahalanobis distances by Cholesky factors that are computed once and sent to
the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .storage import stored

FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.3
NAMES = (
    "log_chars", "log_words", "word_length", "word_spread", "upper", "digit", "symbol", "stop", "other_stop", "beyond_ascii", "space", "same_byte",
    "repeated_words", "same_word", "repeated_lines", "line_words", "odd_end", "no_letter", "one_byte", "shouted",
)
_STEP = 1 << 21
# Byte classes: 0 lower-case letters, 1 upper, 2 digits, 3 white space, 4 . , sentence marks, 5 other usual marks, 6 symbols, 7 beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,"]] = 4
_CLASS[[ord(c) for c in "!?;:'\"()-"]] = 5
_CLASS[128:] = 7


def _share(part: np.ndarray, whole: np.ndarray, more: float = 0) -> np.ndarray:
    """A share, drawn towards none by ``more`` units so that a single case in a short text says little."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole + more, 1), 0, 1)))


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` that start at ``rows`` (one more than the runs)."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[rows[1:]] - total[rows[:-1]]


def _repeats(hashed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each run, how many values are not the first of their kind."""
    return np.array([b - a - len(np.unique(hashed[a:b])) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], np.int64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; null and empty texts give those of no words."""
    whole, rows = hashing.text_bytes(texts)
    out, i = [], 0
    while i < len(rows) - 1:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + _STEP, side="right")) - 1)
        out.append(_statistics(whole[rows[i] : rows[j]], rows[i : j + 1] - rows[i]))
        i = j
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _statistics(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(rows) - 1
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(rows))
    by = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8)
    size = np.diff(rows)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] != 3)
    hashed, starts, ends = hashing.word_spans(data, rows)
    at = np.searchsorted(starts, rows, side="left")
    words = np.diff(at)
    long = ends - starts
    length, square = _sums(long, at), _sums(long * long, at)
    mean = length / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(words, 1) - mean**2, 0))
    again = np.zeros(len(hashed), bool)
    again[1:] = hashed[1:] == hashed[:-1]
    inner = at[:-1][at[:-1] < len(hashed)]
    again[inner] = False
    last, letters = kind[ends - 1], np.append(0, np.cumsum((kind < 2) | (kind == 7)))
    capitals = np.append(0, np.cumsum(kind == 1))
    lettered = letters[ends] - letters[starts]
    shouted = (capitals[ends] - capitals[starts] >= 2) & (2 * (capitals[ends] - capitals[starts]) >= lettered)
    # Lines: values of their words added up, so that equal lines have equal sums.
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([rows, breaks]))
    edges = edges[edges <= len(data)]
    word_edge = np.searchsorted(starts, edges, side="left")
    sums = np.append(np.uint64(0), np.cumsum(hashed, dtype=np.uint64))
    line_hash, line_words = sums[word_edge[1:]] - sums[word_edge[:-1]], np.diff(word_edge)
    used = line_words > 0
    line_hash, line_words, line_start = line_hash[used], line_words[used], edges[:-1][used]
    line_at = np.searchsorted(line_start, rows, side="left")
    lines = np.diff(line_at)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread),
        _share(by[:, 1], by[:, 0] + by[:, 1] + by[:, 7], 40), _share(by[:, 2], size, 40), _share(by[:, 6], size, 40), _share(by[:, 4], size, 40), _share(by[:, 5], size, 40), _share(by[:, 7], size), _share(by[:, 3], size),
        _share(_sums(same, rows), size, 40), _share(_repeats(hashed, at), words, 8), _share(_sums(again, at), words, 8), _share(_repeats(line_hash, line_at), lines, 3),
        np.log1p(words / np.maximum(lines, 1)), _share(_sums((last == 6) | (last == 5), at), words, 8), _share(_sums(lettered == 0, at), words, 8), _share(_sums(long == 1, at), words, 8), _share(_sums(shouted, at), words, 8),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and x (transformed statistics) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            ends = pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[key, "x"])
            hashing.let_go()

    return docs.select(F.col(key), F.col(text)).mapInArrow(of, f"`{key}` {kind}, x array<double>")


def held_out(key: Column) -> Column:
    """Whether a key is in the fold that is never learned from; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Discriminant:
    """Two classes, each with its mean, the inverse of the Cholesky factor of its covariance, and log weight."""

    mean: np.ndarray
    whitening: np.ndarray
    weight: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for c in (0, 1):
            z = self.whitening[c] @ (x - self.mean[c]).T
            logs.append(self.weight[c] - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", shrinkage: float = 0.05) -> Discriminant:
    """Learn from all labelled rows outside the held-out fold; only sums over them go to the driver.

    Several labels of one key count as their largest.  With no rows of one
    class the score is the share of class 1 (0.5 without any rows).
    """
    d = len(NAMES)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    rows = features.where(~held_out(F.col(key))).join(known, key).select("_y", "x")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            for c in (0, 1):
                own = pdf.loc[pdf["_y"] == c, "x"]
                if len(own):
                    x = np.stack(own.to_list())
                    total[c] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"c": [0, 1], "v": list(total)})

    sums = np.zeros((2, 1 + d + d * d))
    parts = rows.mapInPandas(add, "c int, v array<double>").select("c", F.posexplode("v").alias("p", "v")).groupBy("c", "p").agg(F.sum("v").alias("v"))
    for r in parts.collect():
        sums[r["c"], r["p"]] = r["v"]
    n = sums[:, 0]
    if not n.all():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = sums[:, 1 : d + 1] / n[:, None]
    spread = sums[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum((n[:, None] * np.diagonal(spread, axis1=1, axis2=2)).sum(0) / n.sum(), 1e-6))
    factor = np.empty_like(spread)
    for c in (0, 1):
        unit = spread[c] / np.outer(scale, scale)
        unit = (1 - shrinkage) * unit + shrinkage * max(np.trace(unit) / d, 1e-3) * np.eye(d)
        factor[c] = np.linalg.cholesky(unit) * scale[:, None]
    weight = np.log(n / n.sum()) - np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1)
    return Discriminant(mean, np.linalg.inv(factor), weight)


def scored(features: DataFrame, model: Discriminant, key: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """key, held_out, score and predicted for each row of ``features``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[key, "score"])

    kind = features.schema[key].dataType.simpleString()
    out = features.select(F.col(key), "x").mapInArrow(of, f"`{key}` {kind}, score double")
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF, shrinkage: float = 0.05) -> DataFrame:
    """Score every row of ``docs``: key, held_out, score (0 to 1), predicted.

    Only the text is an input of a score.  Null texts count as empty, rows
    with a null key and repeated rows are scored like others, an empty table
    gives no rows and other columns are left alone.
    """
    features = stored(featured(docs, key, text), "quality")
    return scored(features, fit(features, labels, label, key, shrinkage), key, cutoff)
