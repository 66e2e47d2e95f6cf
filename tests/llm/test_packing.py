"""Both packings lose nothing, and are as full as they should be."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kerbside.llm.packing import pack, sequences
from kerbside.llm.token_matrix import CapacityTree, best_fit, matrix_digests, packed_matrix, write_matrix
from kerbside.llm.tokens import encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abthe'sTé \n\t ,.12$½<|>"), max_size=50), st.sampled_from(["", "<|endoftext|>"]))
def test_ids_as_the_library(text, special):
    for path in (BYTE, WORD):
        want = Tokenizer.from_file(path).encode(text + special, add_special_tokens=False).ids
        assert encoder(path)[0](text + special).tolist() == want


def documents():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "onion", "Zürich", "42"]) for _ in range(rng.choice([0, 1, 5, 30, 400])))) for i in range(60)]
    return rows + [(60, None), (61, "x" * 9000), (5, "again"), (5, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1) for r in documents()], "doc_id bigint, text string, part int, rest int").repartition(5)


def with_end(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def test_concatenate_and_cut(spark, docs):
    pieces = pack(docs, BYTE, window=64, with_ids=True)
    rows = pieces.collect()
    total = sum(len(with_end(t)) for _, t in documents())
    assert sum(r.length for r in rows) == total
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(-(-total // 64)))
    for k, some in by_sequence.items():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or k == max(by_sequence)
    texts = {i: t for i, t in documents()}
    for i in range(60):
        if i == 5:
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = with_end(texts[i])
        assert [r.doc_tokens for r in own] == [len(ids)] * len(own)
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.doc_id == 5 and r.start == 0 for r in rows) == 3
    whole = sequences(spark.createDataFrame(rows, pieces.schema), BYTE, window=64).collect()
    assert all(len(r.ids) == 64 for r in whole) and len(whole) == len(by_sequence)


def test_nothing_to_pack(docs):
    assert pack(docs.limit(0), BYTE).count() == 0
    assert packed_matrix(docs.limit(0), BYTE).count() == 0


def naive(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=120))
def test_best_fit_as_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    ranges, bins = best_fit(counts, 32)
    used = {}
    for n, (ranks, first, offset) in ranges.items():
        for k in range(counts[n]):
            at = int(np.searchsorted(ranks, k, "right")) - 1
            used.setdefault(int(first[at]) + k - int(ranks[at]), []).append((int(offset[at]), n))
    assert sorted(used) == list(range(bins))
    for parts in used.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 32
    assert sorted(32 - sum(n for _, n in p) for p in used.values()) == naive(lengths, 32)


def test_capacity_tree():
    tree = CapacityTree(10)
    for c in (3, 7):
        tree.set(c, True)
    assert [tree.least(b) for b in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, None, None]


def test_matrix(spark, docs, tmp_path):
    matrix = packed_matrix(docs, BYTE, window=64, pad_id=9)
    write_matrix(matrix, str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    found = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens:] == 9).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((s, ids[a:b].tolist()))
    for i, t in documents():
        if i != 5:
            assert [x for _, part in sorted(found[i]) for x in part] == with_end(t)
    assert [p for _, p in found[5]].count(with_end("again")) == 2
    assert matrix_digests(spark.createDataFrame(rows, matrix.schema)).count() == len(rows)
