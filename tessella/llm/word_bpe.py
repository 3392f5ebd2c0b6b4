"""Ids of a word-end BPE vocabulary file for batches of texts.

The file's split pattern never joins characters across white space, and its
normaliser changes none across it, so a text's ids are those of its words end
to end; likewise marks after a letter are split off it.  (Only after a-z and
A-Z: other letters may become a letter and a mark when lower-cased.)  The
library is asked once for each distinct word without these, many at a time;
words are told apart by their bytes.  What is a-z only is one pre-token that
normalising leaves as it is, so it goes to the library's model directly.  Words
that might hold a special literal go to the library as they are.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import hashing

# Words, and parts of words, whose ids a task keeps.
_KNOWN, _PARTS = 500_000, 300_000
_JOINED, _SLICE = 4_000, 1 << 20
_MARKS = ".,;:!?"
_SPECIAL = "<|"


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self._forget()

    def _forget(self) -> None:
        self.words = hashing.Words()
        self.parts: dict[str, bytes] = {}
        # The ids of all words by their numbers, end to end.
        self.flat, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of ``words``, from those of their parts."""
        parts = []
        for word in words:
            core, marks = word, ""
            if _SPECIAL not in word:
                low = word.lower() if word.isascii() else word
                core = low.rstrip(_MARKS)
                if core and "a" <= core[-1].lower() <= "z" and core[-1].isascii():
                    marks = low[len(core) :]
                else:
                    core = low
            parts.append((core, marks))
        known = self.parts
        new = list({x for both in parts for x in both if x and x not in known})
        tokenize, plain = self.model.tokenize, []
        for x in new:
            if x.isascii() and x.isalpha():
                known[x] = array("I", [t.id for t in tokenize(x)]).tobytes()
            elif _SPECIAL not in x:
                plain.append(x)
        for k in range(0, len(plain), _JOINED):
            self._ask(plain[k : k + _JOINED])
        for x in new:
            if _SPECIAL in x:
                known[x] = np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return [known[core] + known[marks] if marks else known[core] for core, marks in parts]

    def _ask(self, words: list[str]) -> None:
        """Ids of words in one text; each id belongs to the word in which its characters begin."""
        coded = self.library.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        at = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
        ends = np.append(0, np.cumsum(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(words)))) * 4
        ids, cuts = np.array(coded.ids, "<u4").tobytes(), ends.tolist()
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self.parts[word] = ids[a:b]

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none of a null or empty one."""
        for part in hashing.slices(column, _SLICE):
            if len(self.counts) > _KNOWN:
                self._forget()
            if len(self.parts) > _PARTS:
                self.parts = {}
            number, rows = self.words.numbers(part)
            own = self._learn([w.decode() for w in self.words.new])
            self.counts = np.append(self.counts, np.fromiter(map(len, own), np.int64, len(own)) // 4)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(own), "<u4"))
            starts, counts = (np.cumsum(self.counts) - self.counts)[number], self.counts[number]
            ids = self.flat[hashing.ranges(starts, counts)].tobytes()
            cuts = (np.append(0, np.cumsum(counts)) * 4)[rows].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield ids[a:b]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
