import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import wand

from . import cases


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    counted = [(key, Counter(words(t))) for key, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    total, length = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for name, text in items:
        scores = []
        for (key, c), n in zip(counted, lengths, strict=True):
            m = 25 + 75 * n * total // max(length, 1)
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(name, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **options):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, item int, rank int, n int").repartition(parts)
    i = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, item int, name int, doc int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in wand.rank(d, i, **options).collect()), key=str)


def made(seed, n=400):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(random.choices(vocabulary, weights, k=random.randint(0, 80)))) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(0, 60, 3)]
    items = [(k, " ".join(random.choices(vocabulary, weights, k=random.randint(1, 30)))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_terms": 40}, {"k": 3}])
def test_ranks_as_by_plain_scores(spark, options):
    docs, items = made(1)
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_shards_of_few_documents(spark, monkeypatch):
    docs, items = made(2)
    monkeypatch.setattr(wand, "DOCS", 37)
    assert found(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(wand, "POSTINGS", 90)
    assert found(spark, docs, items) == brute(docs, items)


def plain_cost(values, price, longest):
    best = [0.0]
    for i in range(1, len(values) + 1):
        best.append(min(best[j] + max(values[j:i]) * (i - j) - sum(values[j:i]) + price for j in range(max(0, i - longest), i)))
    return best[-1]


def test_blocks_cost_least():
    draw = np.random.default_rng(3)
    lists = [draw.integers(1, 100, n) for n in (1, 2, 5, 40, 97, 200)]
    starts, values = np.cumsum([0, *map(len, lists)]), np.concatenate(lists)
    price = np.array([3.0, 50, 0.5, 120, 20, 75])
    firsts = wand.cut_blocks(values, starts, price, 16)
    for own, a, b, p in zip(lists, starts[:-1], starts[1:], price, strict=True):
        cuts = [*firsts[(firsts >= a) & (firsts < b)] - a, len(own)]
        assert cuts[0] == 0 and max(np.diff(cuts)) <= 16
        cost = sum(own[i:j].max() * (j - i) - own[i:j].sum() + p for i, j in zip(cuts[:-1], cuts[1:], strict=True))
        assert cost == pytest.approx(plain_cost(own.tolist(), p, 16))


def test_blocks_are_skipped():
    draw = np.random.default_rng(4)
    rows, size = 16_000, 12
    row, term, score = [], [], []
    for t in range(size):
        own = np.flatnonzero(draw.random(rows) < 0.3)
        row.append(own)
        term.append(np.full(len(own), t))
        score.append((draw.pareto(2.0, len(own)) * 1000).astype(np.int64) + 1)
    shard = wand.Shard(*map(np.concatenate, (row, term, score)), size)
    wanted, times = np.array([1, 4, 7]), np.array([1, 2, 1])
    whole = np.zeros(rows, np.int64)
    for t, q in zip(wanted, times, strict=True):
        whole[row[t]] += score[t] * q
    found_, scores, scored = shard.best(wanted, times, 10, rows)
    order = np.lexsort((np.arange(rows), -whole))[:10]
    assert found_.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert scored < 0.5 * sum(len(row[t]) for t in wanted)


def test_terms_are_runs_of_bytes():
    text = "Don't STOP_now 3x4 naïve ÀÉ 日本語,ok a\x7fb\x00c z{y}x tab\tend\xa0joined"
    assert [t.decode() for t in wand.terms(text)] == words(text)


def test_awkward_rows(spark):
    docs = [(r[0], r[1]) for r in cases.rows()] + [(20, "!!! ... ---"), (21, "fox")]
    items = [(1, "the quick FOX"), (1, "word"), (2, None), (3, ""), (4, "?!"), (None, "lorem lorem dolor"), (5, cases.LONG + " naïve 日本語"), (6, "nowhere"), (7, "x" * 700_000)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "...")], items) == []
    assert found(spark, docs, [(1, None), (2, "?")]) == []
