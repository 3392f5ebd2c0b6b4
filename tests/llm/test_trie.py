import hashlib
import random
import zlib

import numpy as np
import pytest

from tessella.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, name string, depth int, conv int, key int"


def brute(rows, family=5, heads=9):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            body = text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, role or "", hashlib.md5(body.encode()).digest()), role or "", body))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own_ in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own_) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(*r, 1, "name", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    out = trie.conversation_trie(table, **options).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out), key=str)


def made(seed, convs=120):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-60, 200), convs):
        opening = random.choice([[], [("user", "hello")], [("user", "hello"), ("assistant", "hi there ü")]])
        turns = opening + [(random.choice(["user", "assistant", None]), random.choice(["a", "b", None, "", "long " * 50])) for _ in range(random.randint(0, 14))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("heads", [9, 1])
def test_nodes_as_by_plain_sequences(spark, heads):
    rows = made(4)
    assert found(spark, rows, heads=heads) == brute(rows, heads=heads)


@pytest.mark.parametrize("bits", [{"key_bits": 4}, {"name_bits": 2}, {"key_bits": 3, "name_bits": 1}])
def test_collisions_are_split(spark, bits):
    rows = made(5, 40)
    assert found(spark, rows, **bits) == brute(rows)


def test_a_conversation_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(5, k, "user", f"turn {k % 7}") for k in range(900)] + [(c, k, "user", f"turn {k % 7}") for c in (6, 7, 10) for k in range(40)]
        assert trie._carried(trie._prefixes(_turns(spark, rows))).count() > 0
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _turns(spark, rows):
    return spark.createDataFrame([(c, k, r, t, hash(t) % 1000, len(t)) for c, k, r, t in rows], "conv long, turn long, role string, mark string, name long, size long")


def test_rolling_values_go_on_from_block_to_block():
    draw = np.random.default_rng(1)
    names = draw.integers(0, 1 << 62, 500)
    whole = trie.rolled(names, np.zeros(500, np.int64), [0, 0])
    half = trie.rolled(names[:200], np.zeros(200, np.int64), [0, 0])
    rest = trie.rolled(names[200:], np.zeros(300, np.int64), [int(f[-1]) for f in half])
    plain = [0, 0]
    for x in names.tolist():
        plain = [(f * b + x) % p for f, b, p in zip(plain, trie.BASES, trie.PRIMES, strict=True)]
    for k in range(2):
        assert whole[k][-1] == rest[k][-1] == plain[k] and (whole[k][:200] == half[k]).all()


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (0, None, None, None), (0, 0, "user", ""), (0, 1, "user", "x" * 2_000_000), (0, 1, "user", "y"), (0, 1, "user", "y"),
        (1, 0, "user", ""), (2, 5, "user", "early"), (2, None, "user", "first of all"), (13, 0, "a", "bc"), (14, 0, "ab", "c"), (-3, 1, "user", "below"), (-7, 1, "user", "below"), (10**17, 0, "user", "far"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    alone = [(1, 0, "user", "only")]
    assert found(spark, alone) == brute(alone)
