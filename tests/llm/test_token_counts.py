"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbside.llm import token_counts as T

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None, "", " ", "\n", "  \n\t x", "it's we'll they'VE ''s 's", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c<|endoftext",
    "x" * 3000, "=" * 500 + " " * 700 + "  end", "naïve ÉCOLE straße ½²", "汉字かな交じり文 한국어", "🎉🎉 \U0001f9ff done",
    "՘࢏꟎\U0003fc2c", "\x00\x1c\x85", "á̧ b", "don't " * 200, "the the the",
]


def texts(seed=3, n=400):
    draw = random.Random(seed)
    pool = ["the", " ", "  ", "\n", "'s", "'", "!", "Zürich", "1", "²", "汉", "x1y", "<|endoftext|>", "\t", "é", "…", "\U0001f600", "՘", "Ω"]
    return ODD + ["".join(draw.choices(pool, k=draw.randint(1, 40))) for _ in range(n)]


def expected(docs, path):
    library = Tokenizer.from_file(path)
    encoded = library.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    return sorted((-1 if i is None else i, len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(docs, encoded, strict=True))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_as_the_library(spark, monkeypatch, path):
    monkeypatch.setattr(T, "CHUNK_ROWS", 50)
    monkeypatch.setattr(T, "FREQUENT", 20)
    monkeypatch.setattr(T, "BLOCK", 100)
    docs = list(enumerate(texts())) + [(None, "no id"), (0, "again"), (0, "again")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, token string, row int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df, path).collect())
    assert got == expected(docs, path)


def test_each_pre_token_is_merged_once(spark):
    docs = spark.createDataFrame([(k, "some words and some more words") for k in range(500)], "doc_id bigint, text string")
    tokens = spark.read.parquet(T.write_frequencies(docs, BYTE)).filter("token is not null").select("token")
    pieces = T.piece_counts(tokens, BYTE).collect()
    assert sorted(r.token for r in pieces) == [" and", " more", " some", " words", "some"]


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), BYTE).count() == 0


def test_code_points_that_are_cut_alike():
    cut = Tokenizer.from_file(BYTE).pre_tokenizer.pre_tokenize_str
    agreed = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and T.AGREED.fullmatch(chr(c))]
    assert len(agreed) > 40_000 and max(agreed) > 0xD000
    assert [c for c in agreed if not T.cuts_alike(cut, c)] == []


def test_narrow_pattern():
    cut, narrow = T.Cutter(BYTE)._cut, T.Cutter(BYTE)._cut_narrow
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(chr(draw.randrange(256)) if draw.random() < 0.5 else draw.choice(" '\nsvetal19") for _ in range(30))
        assert cut.findall(text) == narrow.findall(text)
