"""Blocks of Markdown that say something which others do not, found within the row of a text.

A text is read once in an Arrow task, with its words in sets, so the time
follows its length.  A block that is the same text as an earlier one has its
key and isn't looked at again.  Letters and digits are those of Python's
Unicode tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of a block's words that must be known for it to be known, for structure and for prose; blocks at most; words that prose must have.
STRUCTURE_KNOWN, PROSE_KNOWN, MOST, LEAST_WORDS = 0.98, 0.90, 80, 4
# What separates blocks and words.
_BLANKS = " \t\n\x0b\f\r"
_BETWEEN = re.compile(rf"\n[{_BLANKS}]*\n")
_WIDE = re.compile(rf"[\t\n\x0b\f\r][{_BLANKS}]*| [{_BLANKS}]+")
_LINK, _MARK = re.compile(r"\[([^\]]*)\]\([^)]*\)"), re.compile(r"[`*_>#|~]")
_WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")
_STRUCTURE = re.compile(r"#|[-*+>] ")


def blocks(text: str | None) -> list[str]:
    """The blocks between blank lines."""
    return [b for b in (part.strip(_BLANKS) for part in _BETWEEN.split(text or "")) if b]


def key(block: str) -> str:
    """A block without link targets and marks, its white space as single spaces, in lower case."""
    return _WIDE.sub(" ", _MARK.sub(" ", _LINK.sub(r"\1", block) if "](" in block else block)).strip(" ").lower()


def words(key_: str) -> set[str]:
    """The distinct words of a block's key; what stands between spaces is taken apart only where it has more than letters and digits."""
    found = set(key_.split(" "))
    mixed = [w for w in found if not w.isalnum()]
    found.difference_update(mixed)
    found.update(_WORD.findall(" ".join(mixed)))
    return found


def structural(block: str) -> bool:
    """Whether a block is a heading, a list, a quote or a table."""
    return bool(_STRUCTURE.match(block)) or ("|" in block and sum(line.lstrip(" ").startswith("|") for line in block.split("\n")) >= 2)


def _supplemental(full: str | None, supplement: str | None, most: int) -> list[str]:
    same = set(blocks(full))
    keys = {key(b) for b in same}
    cover = set().union(*map(words, keys))
    out: list[str] = []
    for block in blocks(supplement):
        if len(out) >= most:
            break
        if block in same:
            continue
        same.add(block)
        name = key(block)
        if name in keys:
            continue
        said, own = words(name), structural(block)
        if said and len(said & cover) / len(said) < (STRUCTURE_KNOWN if own else PROSE_KNOWN) and (len(said) >= LEAST_WORDS or own):
            keys.add(name)
            out.append(block)
    return out


def _without_repeats(text: str | None) -> list[str]:
    same, keys, cover, out = set(), set(), set(), []
    for block in blocks(text):
        if block in same:
            continue
        if name := key(block):
            same.add(block)
            if name in keys:
                continue
            keys.add(name)
        said = words(name)
        if len(said) >= 2 and said <= cover and not structural(block):
            continue
        cover |= said
        out.append(block)
    return out


def _by_row(find: Callable[..., list[str]], *texts: Column) -> Column:
    """``find`` of the texts of each row."""

    @F.arrow_udf("array<string>")
    def found(*columns: pa.Array) -> pa.Array:
        return pa.array((find(*(t.as_py() for t in row)) for row in zip(*columns, strict=True)), pa.list_(pa.string()))

    return found(*texts)


def supplemental(full: Column, supplement: Column, most: int = MOST) -> Column:
    """The blocks of ``supplement`` that ``full`` does not cover, in order.

    A block is covered if its key is among the full text's, or if the full
    text has nearly all of its distinct words: 98 % for structure, 90 % for
    prose.  Prose of fewer than four words is left out, and so are blocks
    whose key came before.
    """
    return _by_row(lambda a, b: _supplemental(a, b, most), full, supplement)


def without_repeats(text: Column) -> Column:
    """The blocks of a text in order, without those whose key came before and prose of two words or more all of which came before.

    What is left out adds no word, so the words before a block are those of
    the blocks that were kept.
    """
    return _by_row(_without_repeats, text)
