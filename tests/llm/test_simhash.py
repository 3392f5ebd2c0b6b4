import hashlib
import random
import re

import pytest
import xxhash

from tessella.llm import linking, simhash

from . import cases

MASK = (1 << 64) - 1


def h64(*values):
    """Spark's xxhash64 of strings, longs and ints."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text.lower()) if w]
    terms = [h64(a, b) for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else [h64(w) for w in words]
    halves = []
    for salt in (0, 1):
        own = [t if salt == 0 else h64(t.to_bytes(8, "little"), (1).to_bytes(4, "little")) for t in terms]
        halves.append(sum(1 << k for k in range(64) if 2 * sum(t >> k & 1 for t in own) > len(own)))
    return "".join(f"{h:016x}" for h in halves)


def like(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        f, e, n = brute(text), brute(edited), brute(following)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, like(f, e), like(f, n))
    return out


def test_fingerprints_as_by_counting(spark):
    rows = [(i * 7 % 23, f"some text {i} about {i % 5} things, and more of it é " * (i % 9) + "end 🎉" * (i % 3)) for i in range(23)]
    found = simhash.edited_and_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found}
    assert got == expected(rows)


def test_near_copies_around_256_characters(spark):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=draw.randint(3, 7))) for _ in range(80)) for _ in range(20)]
    rows = [(i, n, text[:n]) for i, text in enumerate(texts) for n in (253, 255, 257)]
    found = simhash.fingerprints(spark.createDataFrame(rows, "i int, n int, text string"), ["i", "n"], "text").collect()
    by = {(r.i, r.n): f"{r.f0 & MASK:016x}{r.f1 & MASK:016x}" for r in found}
    for a, b in ((253, 255), (255, 257)):
        assert sum(like(by[i, a], by[i, b]) for i in range(20)) / 20 > 0.9


def test_awkward_rows(spark):
    found = simhash.edited_and_near(cases.table(spark)).collect()
    assert len(found) == len(cases.rows()) and sum(r.doc_id == 12 for r in found) == 2
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint == by[12].fingerprint and by[1].near_class == by[12].near_class == 1
    assert by[4].fingerprint == "0" * 32 and by[4].n_chars == 0 and by[4].near_edited == 1.0
    assert simhash.edited_and_near(cases.empty(spark)).count() == 0


def classes(prints, radius):
    """The least doc reachable by steps of at most so many bits, by comparing all pairs."""
    up = {i: i for i, *_ in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a, b in prints:
        for j, c, d in prints[:i]:
            if (a ^ c).bit_count() + (b ^ d).bit_count() <= radius:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, *_ in prints}


@pytest.mark.parametrize("radius", [0, 3, 6, 7])
def test_classes_as_by_all_pairs(spark, radius):
    draw = random.Random(radius)
    prints = []
    for _ in range(8):
        whole = draw.getrandbits(128)
        for flips in (0, 1, 3, 6, 7, 8, 12, radius, radius, radius + 1):
            own = whole
            for bit in draw.sample(range(128), flips):
                own ^= 1 << bit
            prints.append((len(prints), own & MASK, own >> 64))
            whole = own if draw.random() < 0.3 else whole
    signed = [(i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))) for i, a, b in prints]
    found = {(r.f0, r.f1): r.near_class for r in simhash.near_classes(spark.createDataFrame(signed, "doc long, f0 long, f1 long"), radius).collect()}
    want = classes(prints, radius)
    least = {}
    for i, a, b in signed:
        least.setdefault((a, b), want[i])
    assert found == least


def test_a_bucket_of_thousands_without_links(spark):
    """All share their first six blocks and so a bucket; the last two differ by more than the radius, but for three pairs."""
    draw = random.Random(9)
    code = [sum(1 << (3 * k) for k in range(10) if x >> k & 1) * 7 for x in range(1024)]
    prints = [(k, 5, code[k] | draw.getrandbits(1) << 31) for k in range(1024)]
    prints += [(2000 + k, 5, prints[k][2] ^ 1 << 31) for k in (3, 70, 900)]
    signed = [(i, a, b << 32) for i, a, b in prints]
    signed = [(i, a, b - (1 << 64) if b >> 63 else b) for i, a, b in signed]
    found = {(r.f0, r.f1): r.near_class for r in simhash.near_classes(spark.createDataFrame(signed, "doc long, f0 long, f1 long"), 2, block=100).collect()}
    want = classes([(i, a & MASK, b & MASK) for i, a, b in signed], 2)
    assert found == {(a, b): want[i] for i, a, b in signed} and len(set(found.values())) == 1024


def test_rows_that_share_a_key_keep_their_own_class(spark):
    rows = [(5, 1, 1), (5, 1 << 40, (1 << 60) - 1), (3, 1 << 40, (1 << 60) - 2)]
    found = {(r.f0, r.f1): r.near_class for r in simhash.near_classes(spark.createDataFrame(rows, "doc long, f0 long, f1 long")).collect()}
    assert found == {(1, 1): 5, (1 << 40, (1 << 60) - 1): 3, (1 << 40, (1 << 60) - 2): 3}


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, monkeypatch):
    """Not on Spark's default threshold either, by which exploded and compressed rows look small until they fill the driver."""
    plans = {}

    def kept(df, label, write=simhash.stored):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    for module in (simhash, linking):
        monkeypatch.setattr(module, "stored", kept)
    rows = [(i, f"some text {i} about {i % 5} things") for i in range(60)]
    out = simhash.edited_and_near(spark.createDataFrame(rows, "doc_id long, text string"))
    for label in ("fingerprints", "buckets", "links"):
        assert all("BroadcastExchange" not in plan and "SortMergeJoin" in plan for plan in plans[label]), label
    # Blocks of nodes and what is known of a node, of which there may be as many as documents.
    last = plans["pairs"][-1]
    assert last.count("SortMergeJoin") == 3 and not re.search(r"BroadcastHashJoin \[[^\]]*_x#", last)
    # Results, edited fingerprints, those of the next rows and classes; then nodes and their classes.
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 4
