"""Token counts under a unigram model of a piece vocabulary, shared along a trie.

A pre-token is a run outside ASCII white space with the word mark before it.
Its tokens are those of the best-scoring split into pieces.  The best score
of a prefix does not depend on what follows, so the distinct pre-tokens of a
batch are walked as a trie, depth first (in sorted order, each starting where
it leaves the one before): scores are computed once for each prefix, and the
number of tokens is kept at each terminal, as are those of pre-tokens that
earlier batches had.

The vocabulary files here hold merge ranks and no probabilities, so a piece
of rank r has the Zipf probability 1 / ((r + 1) H).  A character without a
piece costs its UTF-8 bytes, each as a piece of the last rank.  Between
splits of equal score the one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

MARK = "▁"
_KNOWN = 500_000


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each ordinary piece of a sentencepiece file, and that of a single byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}, -math.log(len(pieces) + 1) - total


class Unigram:
    def __init__(self, path: str):
        self.scores, self.byte = unigram_scores(path)
        by_end: dict[str, set[int]] = {}
        for piece in self.scores:
            by_end.setdefault(piece[-1], set()).add(len(piece))
        # The lengths that pieces with a given last character have.
        self.lengths = {c: sorted(n) for c, n in by_end.items()}
        self._forget()

    def _forget(self) -> None:
        self.words, self.tokens = hashing.Words(), np.zeros(0, np.int64)

    def terminals(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word (its mark included)."""
        out: dict[str, int] = {}
        best, count, before = [0.0], [0], ""
        scores, lengths = self.scores, self.lengths
        for word in sorted(words):
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                c = word[i - 1]
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, fewest = best[i - 1] + size * self.byte, count[i - 1] + size
                for n in lengths.get(c, ()):
                    if n > i:
                        break
                    own = scores.get(word[i - n : i])
                    if own is not None:
                        value, k = best[i - n] + own, count[i - n] + 1
                        if value > top or (value == top and k < fewest):
                            top, fewest = value, k
                best.append(top)
                count.append(fewest)
            out[word] = count[-1]
            before = word
        return out

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each row."""
        words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in hashing.slices(column):
            if len(self.tokens) > _KNOWN:
                self._forget()
            number, rows = self.words.numbers(part)
            new = [MARK + w.decode() for w in self.words.new]
            found = self.terminals(new)
            self.tokens = np.append(self.tokens, np.fromiter((found[w] for w in new), np.int64, len(new)))
            sums = np.append(0, np.cumsum(self.tokens[number]))
            words.append(np.diff(rows))
            tokens.append(np.diff(sums[rows]))
        return np.concatenate(words), np.concatenate(tokens)


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    return Unigram(path)


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pre_tokens and tokens of every whole text.

    Null and empty texts and texts of white space have none of either.
    Repeated rows and rows with a null key are counted like others, an empty
    table gives no rows and other columns are left alone.
    """
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for batch in batches:
            words, tokens = model.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=[key, "pre_tokens", "tokens"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(of, f"`{key}` {kind}, pre_tokens long, tokens long")
