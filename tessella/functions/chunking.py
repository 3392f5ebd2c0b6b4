"""Structure-aware chunks of Markdown: parents of about 3000 characters, children of about 800, stable keys.

Lengths are code points.  A document is folded block by block in one task;
documents are independent of each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

VERSION = "1"
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP, GUARD = 3000, 300, 800, 100, 7200
# Abbreviations whose full stop ends no sentence, and names of menu and of sharing links.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "Ave", "Dept", "Univ", "Fig", "vs", "etc", "approx", "dept", "est", "govt", "inc", "ltd", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MENU = ("Home", "Admissions?", "Academics?", "Departments?", "Faculties", r"Contact\s*Us", "Downloads?", "Gallery", "Sitemap", "Examinations?", "Registrar", "Careers?", r"About\s*Us", "Research", "News", "Events", r"Notice\s*Board", "Administration", r"Vice\s*Chancellor")
SHARING = ("Facebook", "Twitter", "LinkedIn", "Instagram", "Youtube", "Pinterest", r"Google\+", "RSS", "Mail")
# What normalising takes away, in this order, each with what comes in its place.
RULES = (
    (r"\r\n", "\n"),
    (r"[ \t]+\n", "\n"),
    (rf"(?im)^[ \t]*[\*•-]?\s*\[?({'|'.join(MENU)})\]?\(.*?\)[ \t]*\n?", ""),
    (rf"(?im)^[ \t]*[\*•-]?\s*\[?({'|'.join(SHARING)})\]?\(.*?\)[ \t]*\n?", ""),
    (r"(?m)^[ \t]*\[[^\]]*\]\(#[^)]*\)[ \t]*\n?", ""),
    (r"(?m)^[ \t]*\|[ \t]*\|[ \t]*\n?", ""),
    (r"\n{3,}", "\n\n"),
)
# Of each rule, what a text must hold for it to find anything.
_NEEDED = (("\r\n",), (" \n", "\t\n"), ("(",), ("(",), ("](#",), ("|",), ("\n\n\n",))
# Fixed value: chunks that a task hands on together.
_ROWS = 2000
_MASK = "\0"
_ABBREVIATED = re.compile(rf"\b({'|'.join(ABBREVIATIONS)})\.")
_STOPPED = tuple(f"{a}." for a in ABBREVIATIONS)
_MARKS = re.compile(r"[.!?]+")
_GUARDED = re.compile(r"[^.!?\n]+[.!?\n]*")
_HEADING = re.compile(r"(#{1,6})\s")
Path = tuple[str, ...]


def normalized(text: Column) -> Column:
    """A text without menu and sharing lines, links within the page, empty table rows and superfluous blanks."""
    for pattern, instead in RULES:
        text = F.regexp_replace(text, pattern, instead)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: str) -> str:
    for (pattern, instead), needed in zip(RULES, _NEEDED, strict=True):
        if any(n in text for n in needed):
            text = re.sub(pattern, instead, text)
    return text.strip()


def overlap_tail(text: str, size: int) -> str:
    """The end of a text from the first blank within its last ``size`` characters; a short text whole."""
    start = max(0, len(text) - size)
    blank = text.find(" ", start) if start else -1
    return text[max(start, blank + 1) :]


def sentences(text: str) -> list[str]:
    """Sentences with their marks; the full stop of an abbreviation ends none, and marks before the first word belong to no sentence that follows."""
    masked = _ABBREVIATED.sub(rf"\1{_MASK}", text) if any(a in text for a in _STOPPED) else text
    out, start, done = [], 0, 0
    for marks in _MARKS.finditer(masked):
        if marks.start() > start:
            done = marks.end()
            out.append(masked[start:done])
        start = marks.end()
    if masked[done:].strip():
        out.append(masked[done:])
    return ([s.replace(_MASK, ".") for s in out] if _MASK in masked else out) or [text]


def filled(words: list[str], size: int) -> Iterator[str]:
    """Words joined by blanks to lines of at most ``size`` characters with a blank; a longer word alone."""
    start, length = 0, 0
    for k, word in enumerate(words):
        if length + len(word) + 1 > size:
            if length:
                yield " ".join(words[start:k])
            start, length = k, len(word)
        else:
            length += len(word) + (1 if length else 0)
    if length:
        yield " ".join(words[start:])


def last_rows(rows: list[str], size: int) -> list[str]:
    """As many rows from the end as ``size`` characters hold, one at least."""
    used = 0
    for k in range(len(rows) - 1, -1, -1):
        if used and used + len(rows[k]) > size:
            return rows[k + 1 :]
        used += len(rows[k]) + 1
    return rows


def table_parts(block: str, size: int, overlap: int) -> Iterator[str]:
    """A table in parts, each under its two heading rows and begun with the last rows of the part before."""
    rows = block.split("\n")
    head, body = ("\n".join(rows[:2]) + "\n", rows[2:]) if len(rows) > 2 else ("", rows)
    held = ""
    for row in body:
        if len(held) + len(row) + 1 > size:
            if held:
                yield head + held
            again = last_rows([r.strip() for r in held.split("\n") if r.strip()], overlap)
            held = "".join(f"{r}\n" for r in [*again, row])
        else:
            held += row + "\n"
    if held:
        yield head + held


def prose_parts(block: str, size: int, overlap: int, carried: str) -> Iterator[str]:
    """A long block by sentences, after what is carried on; the next part begins with the overlap of the one before."""
    held = f"{carried}\n\n" if carried else ""
    for sentence in sentences(block):
        for part in filled(sentence.split(" "), size) if len(sentence) > size else (sentence,):
            if len(held) + len(part) > size:
                if held:
                    yield held
                held = f"{overlap_tail(held.strip(), overlap)} {part}"
            else:
                held += (" " if held else "") + part
    if held:
        yield held


def usable(text: str) -> bool:
    """Whether a chunk has five words of two characters or more."""
    first = text.split(None, 12)[:12]
    return sum(len(w) > 1 for w in first) >= 5 or (len(first) == 12 and sum(len(w) > 1 for w in text.split()) >= 5)


def split(markdown: str, size: int, overlap: int, path: Path = ()) -> Iterator[tuple[Path, str]]:
    """Heading path and text of each usable chunk in order."""
    for where, text in _split(markdown, size, overlap, path):
        if usable(text):
            yield where, text.strip()


def _split(markdown: str, size: int, overlap: int, path: Path) -> Iterator[tuple[Path, str]]:
    held = ""
    for block in re.split(r"\n{2,}", markdown):
        own = block.strip()
        if heading := _HEADING.match(own):
            if held:
                yield path, held
                held = ""
            above, title = path[: len(heading[1]) - 1], re.sub(r"^#+\s*", "", own)
            path = above if above[-1:] == (title,) else (*above, title)
        if len(block) <= size:
            if held and len(held) + len(block) > size:
                yield path, held
                held = overlap_tail(held.strip(), overlap)
            held = f"{held}\n\n{block}" if held else block
            continue
        if held:
            yield path, held
            held = overlap_tail(held.strip(), overlap)
        if own.startswith("|"):
            for part in table_parts(block, size, overlap):
                yield path, part
            held = ""
        else:
            prefix = " > ".join(path) + "\n\n" if path else ""
            last = ""
            for last in prose_parts(block, size, overlap, held):
                yield path, prefix + last
            held = overlap_tail(last.strip(), overlap)
    if held:
        yield path, held


def guarded(text: str, size: int = GUARD) -> Iterator[str]:
    """A text in parts that no model's limit cuts, by sentences and, where these are too long, by words."""
    if len(text) <= size:
        yield text
        return
    held = ""
    for sentence in _GUARDED.findall(text):
        parts = [sentence] if len(sentence) <= size else list(filled(sentence.split(" "), size))
        for part in parts:
            glue = " " if len(parts) > 1 and held else ""
            if held and len(held) + len(part) > size:
                yield held.strip()
                held = part
            else:
                held += glue + part
    if held.strip():
        yield held.strip()


def context_prefix(title: str | None, url: str) -> str:
    """Title and, but for PDFs, URL path: what stands before each child."""
    out = f"Document Title: {title}\n" if title is not None else ""
    path = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", url)
    if out and not urls.is_pdf(url) and path and path[1] not in ("", "/"):
        out += f"URL Path: {path[1]}\n"
    return out


def chunk_key(url: str, headings: Path, ordinal: int) -> str:
    return hashlib.sha256(f"{VERSION}|{url}|{'>'.join(headings)}|{ordinal}".encode()).hexdigest()


def of_document(url: str, text: str | None, title: str | None = None) -> Iterator[tuple]:
    """parent, ordinal, headings, chunk_key, content_hash and text of each child chunk."""
    ordinals: dict[Path, int] = {}
    prefix = context_prefix(title, url)
    for parent, (above, whole) in enumerate(split(normalize(text or ""), PARENT, PARENT_OVERLAP)):
        for headings, child in split(whole, CHILD, CHILD_OVERLAP, above):
            for part in guarded(prefix + child):
                ordinal = ordinals.get(headings, 0)
                ordinals[headings] = ordinal + 1
                yield parent, ordinal, ">".join(headings), chunk_key(url, headings, ordinal), hashlib.sha256(part.encode()).hexdigest(), part


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, for work that costs far more than reading; where there are as many partitions already, as they lie."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def chunks(docs: DataFrame) -> DataFrame:
    """Child chunks of ``docs`` (url, text and perhaps title); a document is chunked in one task, in time that follows its length."""
    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    docs = spread(docs)

    kind = pa.schema([("url", pa.string()), ("parent", pa.int32()), ("ordinal", pa.int32()), *[(c, pa.string()) for c in ("headings", "chunk_key", "content_hash", "text")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for u, t, name in zip(*batch.columns, strict=True):
                url = u.as_py()
                for chunk in of_document(url, t.as_py(), name.as_py()):
                    rows.append((url, *chunk))
                    if len(rows) == _ROWS:
                        yield _batch(rows, kind)
                        rows = []
        if rows:
            yield _batch(rows, kind)

    return docs.select("url", "text", title.alias("title")).mapInArrow(cut, "url string, parent int, ordinal int, headings string, chunk_key string, content_hash string, text string")


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def section_label(path: Column) -> Column:
    """"Section: a > b" of a heading path, empty without one."""
    return F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "))).otherwise("")


def chunk_header(title: Column, url: Column, path: Column, crawled_at: Column, tier: Column, state: Column, applicability: Column) -> Column:
    """The lines above a chunk in a context; freshness is never inferred, what is missing is unknown (crawled_at in milliseconds)."""
    section = F.when(F.size(path) > 0, F.concat(section_label(path), F.lit("\n"))).otherwise("")
    day = F.coalesce(F.date_format(F.timestamp_millis(crawled_at), "yyyy-MM-dd"), F.lit("unavailable"))
    told = [F.coalesce(c, F.lit("unknown")) for c in (tier, state, applicability)]
    return F.concat(section, F.lit("Source: ["), title, F.lit("]("), url, F.lit(")\nRetrieved: "), day, F.lit("\nFreshness tier: "), told[0], F.lit("\nFreshness state: "), told[1], F.lit("\nApplicability: "), told[2])
