import random

import pytest

from tessella.llm import minhash

from . import cases
from .test_hashing import thue_morse


def brute(rows, size, percent):
    """Components by comparing all pairs of sets."""
    sets = [cases.shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(sets[i]), least.get(top(i), key)) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_as_by_all_pairs(spark, size):
    random.seed(size)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    for _ in range(12):
        base = [random.choice(vocabulary) for _ in range(random.randint(20, 120))]
        for _ in range(random.randint(1, 9)):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 14))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((key, " ".join(own)))
            key += 1
    random.shuffle(rows)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, size, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_chain_is_one_component(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(24)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.component_id for r in found} == {0}


def test_words_of_regular_structure_are_not_linked(spark):
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), (3, thue_morse(4096, "a", "b")), (4, thue_morse(4096, "b", "a"))]
    assert all(r.kept for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect())


def test_rows_that_share_a_key_are_documents_of_their_own(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(9, " ".join(base)), (9, "something else altogether and no copy"), (4, " ".join(base[1:])), (9, " ".join(base[:-1])), (9, " ".join(base[:-1]))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == [(4, 58, 4, True), (9, 5, 9, True), (9, 58, 4, False), (9, 58, 4, False), (9, 59, 4, False)]


@pytest.mark.parametrize("block", [2048, 5])
def test_documents_of_one_template(spark, block):
    random.seed(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    template, rows = [f"t{k}" for k in range(40)], []
    for _ in range(40):
        own = template + [random.choice(vocabulary) for _ in range(40)]
        rows += [(len(rows) + k, " ".join(own[: len(own) - k])) for k in range(random.randint(1, 3))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, bands=64, rows=1, block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, 2, 80))


def test_awkward_rows(spark):
    found = minhash.near_duplicates(cases.table(spark), shingle=2).collect()
    assert len(found) == len(cases.rows())
    by = {r.doc_id: r for r in found}
    assert [by[i].component_id for i in (1, 2, 3, 12, 7, 8)] == [1, 1, 1, 1, 7, 7]
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (4, 5, 6))
    assert by[7].n_shingles == 1 and by[None].kept
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
