"""Bin slack packing: identifiers of the unchanged tokenizer, whole documents, few sequences."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelens.llm import binslack
from tests.llm.conftest import edge_rows

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(binslack.VOCABULARY))
ODD = [
    "It's we'LL 'tis ''s 12½ ²x", "İSTANBUL ΣΑΣ ß ﬁ é é ﷺ", "a b c\x85d\x1fe\x0bf", "<|endoftext|>a<|startoftext|>b <|EndOfText|>",
    "日本語 ไทย 한글 한", "\x00\x01�\U0001f600‍", "×÷ÀÿªºµÆŒ", "x" * 5000, "", " \n\t ",
]


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, binslack.END]


def ids(text):
    return np.frombuffer(binslack.identifiers().of(text), dtype="<u4").tolist()


def test_identifiers_equal_those_of_the_tokenizer():
    for text in ODD + [r[1] for r in edge_rows() if r[1] is None or len(r[1]) < 10_000]:
        assert ids(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbst'lé ÉÀ\n\t12<|>’“·"))))
def test_identifiers_of_any_text(text):
    assert ids(text) == plain(text)


def test_a_text_of_more_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(binslack, "REMEMBERED", 40)
    known = binslack.Identifiers(binslack.VOCABULARY)
    r = random.Random(3)
    text = " ".join(f"w{r.randint(0, 200)}x" for _ in range(1000))
    assert np.frombuffer(known.of(text), dtype="<u4").tolist() == plain(text)
    assert len(known.known) <= 40


def check(rows, texts):
    by_sequence, left = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        left[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= binslack.WINDOW
    total = 0
    for doc_id, text in texts:
        mine = np.array(ids(text), dtype="<u4")
        total += len(mine)
        for piece, start in enumerate(range(0, len(mine), binslack.WINDOW)):
            cut = mine[start:start + binslack.WINDOW]
            left[doc_id].remove((piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert not any(left.values())
    return len(by_sequence), total


def test_edge_rows(edge, nothing):
    sequences, total = check(binslack.best_fit(edge).collect(), [r[:2] for r in edge_rows()])
    assert sequences == -(-total // binslack.WINDOW)
    assert binslack.best_fit(nothing).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sequences, total = check(binslack.best_fit(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sequences <= -(-total // binslack.WINDOW) + 1


@pytest.mark.parametrize("seed", range(6))
def test_fullest_equals_all_combinations(seed):
    r = random.Random(seed)
    lengths = [r.randint(3, 60) for _ in range(10)]
    counts, room = np.bincount(lengths, minlength=200), r.randint(60, 180)
    got = binslack.fullest(counts, room)
    assert not (np.bincount(got, minlength=200) > counts).any()
    assert sum(got) == max(sum(c) for k in range(11) for c in itertools.combinations(lengths, k) if sum(c) <= room)


@pytest.mark.parametrize("lengths", ["uniform", "short", "awkward", "long"])
def test_plan_uses_every_piece(lengths):
    rng = np.random.default_rng(1)
    drawn = {"uniform": rng.integers(1, 2049, 20_000), "short": rng.geometric(0.01, 50_000), "awkward": np.full(1000, 1025), "long": rng.integers(700, 2000, 20_000)}[lengths]
    h = np.bincount(drawn, minlength=2049)[:2049]
    used, bins = np.zeros_like(h), 0
    for parts, times in binslack.plan(h):
        assert sum(parts) <= 2048 and times > 0
        bins += times
        np.add.at(used, list(parts), times)
    assert (used == h).all()
    assert bins <= {"uniform": 1.01, "short": 1.001, "awkward": 2, "long": 1.2}[lengths] * (h @ np.arange(2049)) / 2048 + 1


def test_a_repeated_kind_of_bin_is_what_bins_one_by_one_give():
    rng = np.random.default_rng(4)
    h = np.bincount(rng.integers(300, 1500, 400), minlength=2049)
    left, singly = h.copy(), 0
    while left.any():
        longest = int(np.nonzero(left)[0][-1])
        left[longest] -= 1
        np.subtract.at(left, binslack.fullest(left, 2048 - longest), 1)
        singly += 1
    assert sum(times for _, times in binslack.plan(h)) == singly
