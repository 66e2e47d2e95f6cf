"""Counts against brute force, and the rules line by line."""

import re
from collections import Counter

import pytest

from conftest import SF
from kerbside.llm.common import WordHashes
from kerbside.llm.quality import Line, evaluate, judge


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in evaluate(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("text", ["", None, " \t\n", "a b c\x1cd\v\fe", "one two three four five six seven eight " * 3, "w " * 5000, "é\n\né\n é"])
def test_counts_of_odd_texts(text):
    v = judge(text, WordHashes())
    assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == brute(text)


@pytest.mark.parametrize("line, rule", [
    ("An ordinary sentence of some words.", None), ("A heading without a stop", None),
    ("wo*** rd### an$$$ ot%%%", "punctuation"), ("BUY!! NOW!! IT!! IS!! CHEAP!!", "punctuation"),
    ("Home | News | Sports | Contact", "navigation"), ("He said that 2 > 1, and 3 > 2.", None),
    ("Released under the MIT License.", "boilerplate"), ("All Rights Reserved", "boilerplate"),
])
def test_lines(line, rule):
    assert Line(line, len(line.split()), len(line.replace(" ", ""))).failure() == rule


def test_verdicts(spark):
    clean = ("This line holds a sentence of quite ordinary words.\nAnother one follows it and says nothing new.\n"
             "Then there is a third, as plain as both.\n")
    menu = "Home | News | Sports | Weather | Contact | Imprint | Help | Search\n"
    rows = [(1, clean), (2, clean + menu), (3, "A short one stays out of it.\n" + menu * 1 + menu.replace("Home", "Start") + menu.replace("Home", "Top")),
            (4, "too short"), (5, None), (1, clean)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, kept boolean")
    got = evaluate(docs, with_text=True).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (1, True), (2, True), (3, False), (4, False), (5, False)]
    assert next(r.cleaned for r in got if r.doc_id == 2) == clean
    assert evaluate(docs.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = evaluate(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    kept = got.groupBy("quality").agg({"*": "count"}).collect()
    assert kept
    assert got.filter("quality = 1 and not kept").count() == 0
    assert got.filter("quality = 0 and kept").count() <= 0.1 * got.filter("quality = 0").count() + 1
