import random
import re

import numpy as np
import pyarrow as pa

from tessella.llm import hashing

from . import cases


def test_words_of_all_rows_as_by_regular_expression():
    texts = [r[1] for r in cases.rows()]
    hashed, at = hashing.word_hashes(pa.array(texts))
    expected = [cases.words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in expected]
    seen = {}
    for word, value in zip((w for row in expected for w in row), hashed.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_rows_do_not_run_into_each_other():
    apart, _ = hashing.word_hashes(pa.array(["ab", "cd"]))
    joined, _ = hashing.word_hashes(pa.array(["abcd"]))
    assert len(apart) == 2 and joined[0] not in apart


def test_circulant_signatures_estimate_jaccard():
    random.seed(3)
    base = np.array([random.getrandbits(64) for _ in range(4000)], np.uint64)
    for share in (0.2, 0.5, 0.8):
        both = int(3000 * share)
        a, b = base[:both], base[:both]
        rest = (3000 - both) // 2
        a, b = np.concatenate([a, base[both : both + rest]]), np.concatenate([b, base[both + rest : both + 2 * rest]])
        s = hashing.Circulant(512).signatures([a, b])
        assert abs((s[0] == s[1]).mean() - share) < 0.08


def test_signature_of_a_set_does_not_depend_on_blocks():
    values = np.arange(1, 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = hashing.Circulant(16)
    assert (c.signatures([values], block=1000) == c.signatures([values], block=1 << 20)).all()


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_words_of_regular_structure_have_hashes_of_their_own():
    for n in (64, 1024, 4096):
        hashed, _ = hashing.word_hashes(pa.array([thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), thue_morse(n, "a", "c")]))
        assert len(set(hashed.tolist())) == 3


def test_numbers_of_words():
    texts = [r[1] for r in cases.rows()] + ["eight888 eight889 sixteen_bytes_16 sixteen_bytes_17 " + "y" * 256 + " " + "y" * 257, "a\x00 a a\x00\x00", "é è e"]
    for bits in (64, 3):
        known, names = hashing.Words(bits), []
        for column in (pa.array(texts), pa.array(["before", *texts, "behind"]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None], pa.string())):
            number, rows = known.numbers(column)
            names += [w.decode() for w in known.new]
            assert len(set(names)) == len(names) == known.known
            plain = [[w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w] for t in column.to_pylist()]
            assert [[names[k] for k in number[a:b]] for a, b in zip(rows[:-1], rows[1:], strict=True)] == plain
    random.seed(7)
    many = hashing.Words()
    column = pa.array([" ".join(f"{random.randrange(9000):x}" * random.randint(1, 4) for _ in range(20_000)) for _ in range(3)])
    number, _ = many.numbers(column)
    assert [many.new[k].decode() for k in number] == [w for t in column.to_pylist() for w in t.split()]
