"""Texts that name an added token of the tokenizer."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import packing
from tests.llm.conftest import edge_rows

ODD = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> a  b\n\n\tc d'll 12345 é中\U0001f600", "<|endoftext", "x <|endoftext|>" * 50]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_identifiers_equal_those_of_an_unchanged_tokenizer(plain):
    texts = ODD + [text for _, text, *_ in edge_rows() if text is not None and len(text) < 10_000]
    for text in texts:
        assert packing.document_ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END]


def test_packed_pieces_hold_added_tokens(spark, plain):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r for r in packing.packed(docs).collect()}
    for i, text in enumerate(ODD):
        ids = packing.document_ids(text)
        assert [*ids[:-1]] == plain.encode(text, add_special_tokens=False).ids
        assert (got[i].doc_tokens, got[i].length, got[i].ids_crc32) == (len(ids), len(ids), zlib.crc32(ids.tobytes()))
