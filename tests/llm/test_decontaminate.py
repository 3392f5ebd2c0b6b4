import random

import pytest

from tessella.llm import decontaminate

from . import cases


def brute(docs, items):
    out = set()
    for d, text in docs:
        have = cases.shingles(text, 5)
        for i, item in items:
            want = cases.shingles(item, 5)
            both = len(want & have)
            if d is not None and i is not None and want and 100 * both >= 80 * len(want):
                out.add((d, i, len(want), both))
    return sorted(out)


def tables(spark, docs, items):
    return spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, doc int"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_pairs_as_by_all_comparisons(spark, broadcast):
    random.seed(5)
    word = lambda: f"w{random.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(random.choice([3, 5, 8, 20, 45, 90])))) for i in range(30)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(random.choice([10, 200, 3000]))]
        for _ in range(random.randint(0, 3)):
            own = random.choice(items)[1].split()
            for _ in range(random.choice([0, 0, 1])):
                own[random.randrange(len(own))] = word()
            at = random.randrange(len(body))
            body[at:at] = own
        docs.append((d, " ".join(body)))
    docs += [(100 + i, text.upper()) for i, text in items[:6]] + [(None, items[0][1]), (200, None), (201, "")]
    items += [(None, "a b c d e f"), (90, None), (91, " "), (92, items[1][1])]
    a, b = tables(spark, docs, items)
    found = decontaminate.contained_items(a.repartition(3), b, broadcast=broadcast).collect()
    assert sorted((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in found) == brute(docs, items)
    assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in found)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem")], "item_id long, text string")
    found = decontaminate.contained_items(cases.table(spark), items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(9, 1)]
    assert decontaminate.contained_items(cases.empty(spark), items).count() == 0
    assert decontaminate.contained_items(cases.table(spark), items.limit(0)).count() == 0
