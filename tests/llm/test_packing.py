import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, queries, word_bpe
from tessella.sources.tables import table

from . import cases

PATH = queries.tokenizer_path(queries.WORD_BPE)


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once_without_overlap(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=51)
    table = packing.plan(counts)
    placed = {}
    for r in table.itertuples():
        for k in range(r.bins * r.each):
            placed.setdefault(r.sequence + k % r.bins, []).append((r.offset + k // r.bins * r.length, r.length))
    assert sorted(x[1] for own in placed.values() for x in own) == sorted(lengths)
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50
    assert len(placed) <= 1.25 * -(-sum(lengths) // 50) + 1


def test_corpora_are_packed_near_the_least_number_of_sequences():
    draw = np.random.default_rng(4)
    known = []  # 20,000 full sequences cut at random: so many are the least
    for parts in draw.integers(1, 7, 20_000).tolist():
        known += np.diff([0, *np.sort(draw.choice(np.arange(1, 4096), parts - 1, replace=False)), 4096]).tolist()
    even = draw.integers(1, 4097, 40_000)
    skewed = np.clip(draw.lognormal(6, 1.2, 60_000).astype(int), 1, 4096)
    for lengths, share in ((np.array(known), 1.01), (skewed, 1.01), (even, 1.02)):
        table = packing.plan(np.bincount(lengths, minlength=4097))
        least = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
        assert int((table.sequence + table.bins).max()) <= share * least


def test_exact_complements_leave_no_waste():
    counts = np.zeros(101, int)
    counts[[60, 40, 70, 20, 10, 55, 25, 15, 5]] = [5, 5, 3, 3, 3, 2, 2, 2, 2]
    table = packing.plan(counts)
    assert int((table.sequence + table.bins).max()) == 10


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_ones(library):
    texts = ["", "   ", "don't 'S we'LL it''s 'sun x'restore 12 ½ ²", "<|endoftext|> x", "İstanbul Σας ß ÀÉ", "a\x1cb c\x85d e\xa0f", "!!!***$$$ |", "z" * 300, "日本 x", "“quoted” – dash… €5"]
    texts += ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|endoftext", "e\u0301 e \u0301", "one\x0btwo\x0cthree\u2003four", " lead", None]
    coded = list(word_bpe.WordBpe(PATH).encode(pa.array(texts * 2)))
    assert coded == [np.array(library(t or ""), "<u4").tobytes() for t in texts * 2]
    assert np.frombuffer(coded[10], "<u4").tolist() == [320, 49407, 321]


def test_ids_of_letters_marks_and_punctuation_of_all_scripts(library):
    assert list(word_bpe.WordBpe(PATH).encode(pa.array(["ÜNİVERSİTESİ.", "İ.", "İ,x İ;"]))) == [np.array(library(t), "<u4").tobytes() for t in ("ÜNİVERSİTESİ.", "İ.", "İ,x İ;")]
    draw = random.Random(11)
    kinds = {}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LMNPSZ":
            kinds.setdefault(kind, []).append(chr(c))
    near = [chr(c) for c in range(0x250)] + list("İıŞşÇçßẞΣςσΑΙǅǆﬁ") + list(".,;:!?'’") * 8 + [" "] * 30

    def word():
        pick = lambda: draw.choice(near) if draw.random() < 0.8 else draw.choice(kinds[draw.choice("LLLMMNPSZ")])
        return "".join(pick() for _ in range(draw.randint(1, 6))) + draw.choice(["", "", ".", ",", "!?", "...", ":;"])

    texts = [" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(100_000)]
    coded = list(word_bpe.WordBpe(PATH).encode(pa.array(texts)))
    wrong = [t for t, c in zip(texts, coded, strict=True) if c != np.array(library(t), "<u4").tobytes()]
    assert not wrong, (len(wrong), wrong[:5])


def test_ids_of_all_documents_are_the_library_ones(spark, library):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    coded = list(word_bpe.WordBpe(PATH).encode(pa.array(texts)))
    assert coded == [np.array(library(t or ""), "<u4").tobytes() for t in texts]


def test_documents_are_packed_whole(spark, library):
    docs = cases.table(spark)
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece) for r in rows if r.piece == 0) == sorted((-1 if i is None else i, 0) for i, *_ in cases.rows())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for i, text, *_ in cases.rows():
        if i == 12:
            continue
        ids = np.array([*library(text or ""), 1], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0
