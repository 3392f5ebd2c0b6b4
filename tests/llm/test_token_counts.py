import random

import pyarrow as pa

from tessella.llm import queries, token_counts

from . import cases
from .test_hashing import thue_morse

PATH = queries.tokenizer_path(queries.PIECES)


def brute(model, word):
    """Every split is tried: best score first, then fewest tokens."""
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + size * model.byte, -(best[i - 1][1] + size))]
        options += [(best[j][0] + model.scores[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in model.scores]
        top = max(options)
        best[i] = (top[0], -top[1])
    return best[-1][1]


def test_counts_as_word_by_word():
    random.seed(2)
    model = token_counts.Unigram(PATH)
    words = ["the", "The", "thethe", "café", "日本語🎉", "x" * 40, "internationalisation", thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")] + ["".join(random.choice("aethinsor") for _ in range(random.randint(1, 14))) for _ in range(400)]
    assert model.terminals([token_counts.MARK + w for w in set(words)]) == {token_counts.MARK + w: brute(model, token_counts.MARK + w) for w in set(words)}
    for _ in range(2):  # the second time from what is known
        counts = model.count(pa.array([" ".join(words), None, "", " \n", "the"]))
        assert counts[0].tolist() == [len(words), 0, 0, 0, 1]
        assert counts[1].tolist() == [sum(brute(model, token_counts.MARK + w) for w in words), 0, 0, 0, 1]


def test_awkward_rows(spark):
    rows = token_counts.token_counts(cases.table(spark), PATH).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(cases.rows()) and [by[i].tokens for i in (4, 5, 6)] == [0, 0, 0]
    assert by[1].tokens == by[2].tokens and by[9].pre_tokens == 60_000
    assert token_counts.token_counts(cases.empty(spark), PATH).count() == 0
