"""Components against brute force over all pairs."""

import random

import pytest

from kerbside.llm import ngram_join as J


def brute(rows):
    root = {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n bigint, digest string").repartition(3)
    return sorted(map(tuple, J.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, groups, members, edits, length):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, groups, members, edits, length", [(1, 12, 12, 4, 60), (2, 2, 90, 6, 120), (3, 40, 3, 1, 9), (4, 30, 4, 2, 5)])
def test_near_copies(spark, seed, groups, members, edits, length):
    rows = near_copies(seed, groups, members, edits, length)
    assert result(spark, rows) == brute(rows)


def test_blocks_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    monkeypatch.setattr(J, "FREQUENT", 50)
    monkeypatch.setattr(J, "CHUNK", 500)
    common = " ".join(f"common{k}" for k in range(30))
    rows = [(i, t + " " + common) for i, t in near_copies(5, 15, 8, 3, 50)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(40000))
    rows = [(9, "Only three words"), (8, "only THREE words"), (7, None), (6, ""), (5, " \n"), (4, long), (4, long + " x"), (3, "É a b c"),
            (2, "é a b c"), (None, "a b c d e"), (None, "a b c d e"), (1, "a b c d"), (1, "a b c d"), (11, "a b c d e"), (12, "one")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_keep_one(spark):
    rows = near_copies(6, 10, 6, 2, 50) + [(500, None), (501, ""), (0, "the same row twice over"), (0, "the same row twice over")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n string")
    components = brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    wordless = {500, 501}
    # Two components have the least id 0: that of document 0, and the text that repeats its id.
    assert len([r for r in got if r.doc_id not in wordless]) == len({c for i, n, c in components if n}) + 1
    assert wordless <= {r.doc_id for r in got}
    assert J.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_unlike_texts_without_own_ids(spark):
    rows = [(None, "the first text has no id"), (None, "another one has none either"), (None, "another one has none either"),
            (7, "these are words of a text"), (7, "its id is used for this too")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(set(rows), key=repr)


def test_keep_one_by_other_values(spark):
    text = [f"w{k}" for k in range(104)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:93] + [f"other{k}" for k in range(11)]))], "doc_id bigint, text string")
    assert (J.keep_one(docs).count(), J.keep_one(docs, 5, 80).count()) == (2, 1)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (103, 102)]
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in J.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 104)}}
