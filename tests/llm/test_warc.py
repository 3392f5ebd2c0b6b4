import hashlib
import os
import random
import tracemalloc

import duckdb

from tessella.llm import warc
from tessella.llm.storage import new_path

BODIES = ["<p>" + "a" * 1500, "small", "", None, "<p>é" + "b" * 3000]


def first_name(names):
    return min(r["name"] for r in names.collect())


def salvaged(data):
    found = list(warc.salvage(data))
    return [x for x in found if isinstance(x, warc.Record)], [(x.begin, x.end) for x in found if isinstance(x, warc.Gap)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, _key int")


def test_records_come_back_with_revisits(spark):
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nX: 1", BODIES[i % 5], "f", 1) for i in range(20)] + [(None, "u", BODIES[0], "f", 1)]
    found = warc.round_trip(pages(spark, rows).repartition(3)).collect()
    assert len(found) == 21
    for r in found:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        body = (BODIES[r.page_id % 5] or "").encode()
        last = max(i for i in range(20) if i % 5 == r.page_id % 5)
        revisit = len(body) >= 1000 and r.page_id < last
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last) if revisit else ("response", None))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_tasks_without_pages(spark):
    rows = [(1, "u", BODIES[0], "f", 1), (2, "u", BODIES[0], "f", 1), (3, "u", None, "f", 1)]
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows).repartition(50)).collect()}
    assert found == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}


def test_rows_that_share_a_key_keep_their_payloads(spark):
    big = (1 << 60) + 1
    rows = [(1, "u", BODIES[0], "f", 1), (1, "u", BODIES[4], "f", 1), (2, "u", BODIES[0], "f", 1), (big, "u", BODIES[4], "f", 1), (None, "u", "x", "f", 1)]
    found = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect())
    a, b, x = (hashlib.sha1(t.encode()).hexdigest() for t in (BODIES[0], BODIES[4], "x"))
    assert found == sorted([(1, a, "revisit", 2), (1, b, "revisit", big), (2, a, "response", None), (big, b, "response", None), (0, x, "response", None)], key=lambda r: r[:3])


def test_gaps_are_logged_with_the_records(spark):
    path = new_path(spark, "warc-log-test")
    names = warc.write_archives(pages(spark, [(i, "u", f"page {i}", "f", 1) for i in range(9)]).coalesce(1), path)
    with open(f"{path.removeprefix('file://')}/{first_name(names)}", "r+b") as f:
        f.write(b"?" * 20)
    log = warc.salvaged(spark, path, names)
    assert warc.records_of(log).count() == 8 and [(r.begin, r.reason) for r in warc.gaps_of(log).collect()] == [(0, "no version line")]


def test_damage_costs_only_the_records_that_it_hits():
    random.seed(1)
    raws = [warc.record(i, f"http://x/{i}", bytes(random.randrange(32, 127) for _ in range(2000))) for i in range(30)]
    for packed in (True, False):
        parts = [warc.member(r) if packed else r for r in raws]
        at = [sum(map(len, parts[:i])) for i in range(31)]
        whole = bytearray(b"".join(parts))
        assert len(salvaged(bytes(whole))[0]) == 30
        hit = {4, 11, 29}
        for i in hit:
            whole[at[i] + 700] ^= 0xFF
        records, gaps = salvaged(bytes(whole))
        assert {int(r.headers["warc-record-id"][10:-1]) for r in records} == set(range(30)) - hit
        assert gaps == [(at[i], at[i + 1]) for i in sorted(hit)]
        # junk between records, and a file cut short
        junk = b"\x1f\x8b\x08junk" + os.urandom(50)
        records, gaps = salvaged(b"".join([*parts[:3], junk, *parts[3:6]]) + parts[6][:100])
        assert len(records) == 6 and gaps[0] == (at[3], at[3] + len(junk)) and len(gaps) == 2


def test_only_finished_files_are_read(spark):
    path = new_path(spark, "warc-test")
    names = warc.write_archives(pages(spark, [(i, "u", "x" * 50_000 + str(i), "f", 1) for i in range(40)]), path, roll=2000)
    assert names.count() > 1
    local = path.removeprefix("file://")
    with open(f"{local}/999999-000000000-0000.warc.gz", "wb") as f:
        f.write(warc.member(warc.record(77, "u", b"stray")))
    assert warc.read_archives(spark, path, names).count() == 40
    with open(f"{local}/{first_name(names)}", "r+b") as f:
        f.write(b"\0" * 30)
    assert warc.read_archives(spark, path, names).count() < 40 and warc.read_gaps(spark, path, names).count() == 1


class Long:
    """A file of many times the same member that is never in memory, with zeros from ``a`` to ``b``."""

    def __init__(self, part, times, a, b):
        self.part, self.n, self.a, self.b, self.most = part, len(part) * times, a, b, 0

    def size(self):
        return self.n

    def read_at(self, n, at):
        self.most = max(self.most, n)
        k = at % len(self.part)
        out = bytearray((self.part * (n // len(self.part) + 2))[k : k + min(n, self.n - at)])
        lo, hi = max(self.a, at) - at, min(self.b, at + len(out)) - at
        if lo < hi:
            out[lo:hi] = bytes(hi - lo)
        return bytes(out)


def test_archives_of_any_size_are_read_in_little_memory():
    raw = warc.record(1, "u", random.Random(2).randbytes(1_500_000))
    for part in (warc.member(raw, 1), raw):
        file = Long(part, 200, 100 * len(part) - 7, 103 * len(part) + 7)
        tracemalloc.start()
        records, gaps = 0, []
        for x in warc.salvage(file):
            records += isinstance(x, warc.Record)
            gaps += [(x.begin, x.end)] if isinstance(x, warc.Gap) else []
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert records == 200 - 5 and gaps == [(99 * len(part), 104 * len(part))]
        assert peak < 40e6 and file.most <= 4 << 20 < file.size() / 70


def test_lengths_that_are_not_true():
    good = warc.record(1, "u", b"payload")
    for stated in (b"9" * 15, b"1", b"0", b"-5", b""):
        wrong = good.replace(b"Content-Length: %d\r\n\r\nHTTP" % len(good[good.index(b"HTTP") : -4]), b"Content-Length: " + stated + b"\r\n\r\nHTTP")
        assert wrong != good
        for packed in (warc.member, bytes):
            records, gaps = salvaged(packed(wrong) + packed(good))
            assert len(records) == 1 and gaps == [(0, len(packed(wrong)))]


def test_a_payload_of_many_megabytes(spark):
    body = "<p>é" * 4_000_000
    found = warc.round_trip(pages(spark, [(1, "u", body, "f", 1), (2, "u", body, "f", 1), (3, "u", "x", "f", 1)])).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found) == [(1, 20_000_000, "revisit", 2), (2, 20_000_000, "response", None), (3, 1, "response", None)]


def test_digest_agrees_with_duckdb():
    assert duckdb.sql("SELECT sha1('é')").fetchall()[0][0] == hashlib.sha1("é".encode()).hexdigest()
