"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing: each task appends its records, every one a gzip member of its own,
to files in a shared folder, starts a new file at ``ROLL`` bytes, and gives a
file its final name only when it is whole.  Names hold the task attempt, and
only those that the finished tasks report in the manifest, a table, are read,
so a task that is run again leaves nothing in the result.

Reading: files are dealt out by name and read through a window of a few MB,
so an archive may be of any size; memory follows the largest record.  A member must inflate with the right checksum, begin with a WARC
version line, have whole headers and a block of the stated length, and match
its block digest.  After a failed check the reader searches for the next
gzip magic or version line at which a record passes, goes on from there, and
reports the bytes between as quarantined.  Plain (not gzipped) records are
read likewise.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, stored

VERSION = b"WARC/1.1"
ROLL = 16 << 20
MIN_REVISIT = 1000
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
# The longest thing that _START finds; bytes read and inflated at a time; bytes kept of a file; the longest headers.
_MARK, _STEP, _WINDOW, _HEADERS = 10, 1 << 16, 1 << 22, 1 << 19
_ROWS, _FILES = 4096, 16  # of a batch of results, of a task
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, begin long, end long"
LOG = RECORD + ", reason string"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _clean(value: object) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(value)).encode()


def record(page_id: object, url: object, payload: bytes, refers_to: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without it."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        body += payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % _clean("" if page_id is None else page_id),
        b"WARC-Date: " + date.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: " + _base32(hashlib.sha1(payload).digest()).encode(),
        b"WARC-Block-Digest: " + _base32(hashlib.sha1(body).digest()).encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _clean(url))
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % _clean(refers_to)]
    lines.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


@dataclass
class Record:
    begin: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    begin: int
    end: int
    reason: str


class Window:
    """Bytes at any place of a file (or of bytes), read in steps and kept while they are near."""

    def __init__(self, file: object):
        self.file = file
        self.size = len(file) if isinstance(file, bytes) else file.size()
        self.at, self.held = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``, fewer at the end."""
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            if n > _WINDOW:
                return self._read(at, n)
            self.at, self.held = at, self._read(at, min(_WINDOW, self.size - at))
        return self.held[at - self.at : at - self.at + n]

    def _read(self, at: int, n: int) -> bytes:
        return self.file[at : at + n] if isinstance(self.file, bytes) else self.file.read_at(n, at)

    def next_start(self, at: int) -> int:
        """Where a gzip member or a version line may begin, from ``at`` on; the end if nowhere."""
        while at < self.size:
            part = self.bytes(at, _STEP + _MARK)
            found = _START.search(part)
            if found and found.start() < _STEP:
                return at + found.start()
            at += _STEP
        return self.size


class _Plain:
    """The bytes of a file from a place on."""

    def __init__(self, window: Window, at: int):
        self.window, self.at = window, at

    def bytes(self, at: int, n: int) -> bytes:
        return self.window.bytes(self.at + at, n)


class _Inflated:
    """The bytes of the gzip member at a place, inflated as far as they are asked for."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.out = window, at, bytearray()
        self.unpack = zlib.decompressobj(31)

    def bytes(self, at: int, n: int) -> bytes:
        while len(self.out) < at + n and not self.unpack.eof:
            waiting = self.unpack.unconsumed_tail
            if not waiting:
                waiting = self.window.bytes(self.at, _STEP)
                self.at += len(waiting)
            try:
                more = self.unpack.decompress(waiting, _STEP)
            except zlib.error as e:
                raise ValueError(f"bad member: {e}") from None
            if not waiting and not more:
                raise ValueError("member not ended")
            self.out += more
        return bytes(self.out[at : at + n])

    def end(self, used: int) -> int:
        """Where the member ends, of which a record takes ``used`` bytes."""
        at = used
        while more := self.bytes(at, _STEP):
            if more.strip():
                raise ValueError("more in the member than its record")
            at += len(more)
        return self.at - len(self.unpack.unused_data)


def _parse(source: _Plain | _Inflated) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and size of the plain record at the start of ``source``; ValueError says what is wrong.

    The block is read only if it ends where its headers say.
    """
    raw = b""
    while (stop := raw.find(b"\r\n\r\n")) < 0:
        more = source.bytes(len(raw), _HEADERS // 8)
        raw += more
        if not _VERSION.match(raw):
            raise ValueError("no version line")
        if not more or len(raw) > _HEADERS:
            raise ValueError("headers not ended")
    headers = {}
    for line in raw[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin, length = stop + 4, int(headers["content-length"])
    if source.bytes(begin + length, 4) != b"\r\n\r\n":
        raise ValueError("block not ended where stated")
    block = source.bytes(begin, length)
    stated = headers.get("warc-block-digest")
    if stated and stated.startswith("sha1:") and stated != _base32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    return headers, block, begin + length + 4


def salvage(file: object) -> Iterator[Record | Gap]:
    """The records of an archive that pass their checks, and the byte gaps between them, in order.

    file: bytes, or a file with ``size()`` and ``read_at(n, at)``.
    """
    window, at, bad, why = Window(file), 0, None, ""
    while at < window.size:
        try:
            if window.bytes(at, len(_MAGIC)) == _MAGIC:
                member_ = _Inflated(window, at)
                headers, block, used = _parse(member_)
                end = member_.end(used)
            else:
                headers, block, used = _parse(_Plain(window, at))
                end = at + used
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = window.next_start(at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield Record(at, end, headers, block)
        at = end
    if bad is not None:
        yield Gap(bad, window.size, why)


def _slim(pages: DataFrame, key: str, html: str, *others: Column) -> DataFrame:
    """_key, _digest and _bytes of each page's payload, and other columns."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(key).cast("long").alias("_key"), F.sha1(body).alias("_digest"), F.octet_length(body).alias("_bytes"), *others)


def revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """_key, _digest, _bytes and refers_to of the pages that repeat the payload of a page with a larger key."""
    slim = _slim(pages, key, html).where(F.col("_bytes") >= least)
    groups = slim.groupBy("_digest", "_bytes").agg(F.max("_key").alias("refers_to"), F.min("_key").alias("_first")).where("_first < refers_to")
    return slim.join(groups, ["_digest", "_bytes"]).where("_key < refers_to").select("_key", "_digest", "_bytes", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT, roll: int = ROLL) -> DataFrame:
    """Write every page to archives below ``path`` and return the manifest: name of each whole file.

    Of pages with equal payloads of at least ``least`` bytes that with the
    largest key is a response and the others revisit it; smaller payloads and
    pages with a null key are responses, and so is every page with another
    payload, whatever others there are of its key.  A task without pages
    writes no file.  The path must be one that pyarrow can write.
    """
    keyed = _slim(pages, key, html, F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))
    rows = keyed.join(revisits(pages, key, html, least), ["_key", "_digest", "_bytes"], "left")
    rows = rows.select("_key", "_url", "_html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        stem = f"{task.partitionId():06d}-{task.taskAttemptId():09d}"
        names, held, size = [], [], 0

        def finish() -> None:
            nonlocal held, size
            name = f"{stem}-{len(names):04d}.warc.gz"
            with store.open_output_stream(f"{root}/_{name}", compression=None) as file:
                for part in held:
                    file.write(part)
            store.move(f"{root}/_{name}", f"{root}/{name}")
            names.append(name)
            held, size = [], 0

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                k, u, h, r = (x.as_py() for x in row)
                held.append(member(record(k, u, (h or "").encode(), r)))
                size += len(held[-1])
                if size >= roll:
                    finish()
        if held:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return stored(rows.mapInArrow(write, "name string"), "manifest")


def _names(spark: SparkSession, path: str) -> DataFrame:
    """The names of the archives below ``path``; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.warc.gz").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"))


def salvaged(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """A row for each record and for each quarantined byte gap of the archives below ``path``, told apart by ``reason``, which records have not.

    names: a table of the names of the files to read (all if None).  The path must be one that pyarrow can read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    found = salvage(file)
                    while rows := [_row(name, x) for x in itertools.islice(found, _ROWS)]:
                        yield _frame(rows)

    names = _names(spark, path) if names is None else names
    parts = max(spark.sparkContext.defaultParallelism, names.count() // _FILES)
    return names.select("name").repartition(parts, "name").mapInArrow(read, LOG)


def read_archives(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """A row for each record of the archives below ``path``."""
    return records_of(salvaged(spark, path, names))


def read_gaps(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """The quarantined byte gaps of the archives below ``path``."""
    return gaps_of(salvaged(spark, path, names))


def records_of(log: DataFrame) -> DataFrame:
    return log.where("reason IS NULL").drop("reason")


def gaps_of(log: DataFrame) -> DataFrame:
    return log.where("reason IS NOT NULL").select("file", "begin", "end", "reason")


def _id(value: str | None) -> int | None:
    inner = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(inner[1]) if inner else None


def _row(name: str, found: Record | Gap) -> tuple:
    if isinstance(found, Gap):
        return (None, None, None, None, None, name, found.begin, found.end, found.reason)
    h, revisit = found.headers, found.headers.get("warc-type") == "revisit"
    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32decode(stated).hex() if revisit else hashlib.sha1(found.payload).hexdigest()
    size = int(h["x-payload-length"]) if revisit else len(found.payload)
    return (_id(h.get("warc-record-id")), size, digest, h.get("warc-type"), _id(h.get("warc-refers-to")), name, found.begin, found.end, None)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in LOG.split(", ")), strict=True)
    arrays = [pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string()) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: a row for each page.

    The archives are read once, into a table of records and quarantined gaps
    in the shared folder, of which the records are returned.  Null html is an
    empty payload; null urls leave out the target; repeated rows are records
    of their own; other columns are left alone; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    names = write_archives(pages, path, key, url, html)
    return records_of(stored(salvaged(spark, path, names), "warc-log"))
