"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from kerbside.llm import variants as V

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    return forms_of(words)


def forms_of(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def near_variants(draw, alphabet, count, longest):
    words = {}
    while len(words) < count:
        word = "".join(draw.choices(alphabet, k=draw.randint(6, longest)))
        words[word] = draw.randint(5, 2000)
        for _ in range(draw.randint(0, 4)):
            k, c = draw.randrange(len(word) + 1), draw.choice(alphabet)
            word = draw.choice([word[:k] + c + word[k:], word[:k] + word[k + 1:], word[:k] + c + word[k + 1:]])
            if len(word) >= 6:
                words[word] = draw.randint(5, 2000)
    return words


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("alphabet", "longest", "long_list", "frequent"), [
    ("ab", 9, 4096, 4096), ("ab", 9, 20, 64), ("abcdefé", 12, 4096, 4096), ("abcdefé", 12, 10, 500), ("thanerionÿ", 80, 30, 2000)])
def test_against_all_words(spark, monkeypatch, alphabet, longest, long_list, frequent):
    monkeypatch.setattr(V, "LONG_LIST", long_list)
    monkeypatch.setattr(V, "FREQUENT_GRAMS", frequent)
    words = near_variants(random.Random(len(alphabet) + longest), alphabet, 600, longest)
    rows = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n bigint")
    assert found(V.group_variants(rows)) == forms_of(words)


def test_whole_texts(spark):
    draw = random.Random(5)
    words = [*near_variants(draw, "abcdeÉéß", 80, 9)] + ["Reading", "READING", "readin", "a", "x×y÷zzz"]
    docs = [(k, " ".join(draw.choices(words, k=300)) + ".") for k in range(60)]
    docs += [docs[3], (None, " ".join(words)), (61, None), (62, ""), (63, "z" * 5000 + " " + "y" * 70)] + [(64, "y" * 71 + " " + "y" * 70)] * 6
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, word string")
    got = found(V.group_variants(V.count_words(df)))
    assert got == expected(docs) and len(got) > 50


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert V.group_variants(V.count_words(empty)).count() == 0
    few = spark.createDataFrame([(1, "only one here")], "doc_id bigint, text string")
    assert V.group_variants(V.count_words(few)).count() == 0
