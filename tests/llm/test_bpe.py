"""The encoder against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kerbside.llm.bpe import bpe, decode_documents, encode_documents, round_trip_digests

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LETTERS = st.text(st.sampled_from("abcdeinthsorIİΣσςéÉ́ \n\t'st012,.#$-\x1c\x85 日本ß½²"), max_size=60)


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(LETTERS, st.text(max_size=40)), special=st.sampled_from(["", "<|endoftext|>", "<|startoftext|>"]))
def test_as_the_library(path, text, special):
    library, ours = Tokenizer.from_file(path), bpe(path)
    text = text + special + text[:3]
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_pieces(path):
    library, ours = Tokenizer.from_file(path), bpe(path)
    for text in ("a" * 5000, "thethat" * 900, "$" * 3000, "é" * 2000, "x " * 30000):
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


ROWS = [(1, "The cat's 2 hats, né?"), (2, None), (3, ""), (1, "The cat's 2 hats, né?"), (None, "x"), (4, "word " * 20000)]


def test_digests_and_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in ROWS], "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted(map(tuple, round_trip_digests(docs, WORD).collect()), key=repr)
    library, want = Tokenizer.from_file(WORD), []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert round_trip_digests(docs.limit(0), WORD).count() == 0


def test_documents_there_and_back(spark):
    docs = spark.createDataFrame([(1, "Plain words, and  spaces\n"), (2, None)], "doc_id bigint, text string")
    back = decode_documents(encode_documents(docs, BYTE), BYTE).collect()
    assert sorted(map(tuple, back)) == [(1, "Plain words, and  spaces\n"), (2, "")]
