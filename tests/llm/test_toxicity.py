"""Held-out accuracy and odd rows."""

import random

from kerbside.llm import toxicity as T


def frames(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(bad * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["grub", "knave", "oafishly", "oafish"]))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(bad)))
    odd = [(5001, None, ""), (5002, "", ""), (None, "knave", ""), (5003, "knave " * 30000, ""), (0, docs[0][1], "")]
    return (spark.createDataFrame(docs + odd, "doc_id bigint, text string, score string"),
            spark.createDataFrame(labels + [(None, 1), (5001, None), (0, 0), (5002, 0)], "doc_id bigint, toxic int"))


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = frames(spark, 2000)
    rows = T.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 2000]
    assert len(held) > 300
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5001].score == by_id[5002].score < 0.5
    assert by_id[5003].predicted == 1 and not by_id[None].held_out
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_repeatable(spark):
    docs, labels = frames(spark, 200)
    a, b = (sorted(map(tuple, T.classify(d, labels).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b))


def test_nothing_to_learn(spark):
    docs, labels = frames(spark, 20)
    assert {r.predicted for r in T.classify(docs, labels.limit(0)).collect()} == {0}
    assert T.classify(docs.limit(0), labels).count() == 0


def test_stage_keeps_columns(spark):
    docs, labels = frames(spark)
    kept = T.keep_civil(docs, T.train(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 4 != 0 for i in range(600) if i in ids) >= 445 and sum(i in ids for i in range(0, 600, 4)) <= 5
