"""Top k against brute force."""

import math
import random

import pytest

from kerbside.llm import topk


def brute(rows, k=10):
    v = {}
    rows = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows
            if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, q)), j) for m, (j, e) in enumerate(rows) if m != n and len(e) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def result(spark, rows):
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<float>, score int").repartition(3)
    return sorted(map(tuple, topk.top_k(frame).collect()))


@pytest.mark.parametrize("dim, n", [(24, 450), (3, 300), (1, 120)])
def test_random_vectors(spark, monkeypatch, dim, n):
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(dim)
    centre = [rng.gauss(0, 1) for _ in range(dim)]
    rows = [(i, [round(c * (i % 3) + rng.choice([0.0, 0.25, -0.5, 1.125]), 3) for c in centre]) for i in range(n)]
    rows = [(i, [float(x) for x in __import__("numpy").array(e, "float32")]) for i, e in rows]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (100, [3.0]), (None, [1.0, 1.0]), (2, [1.0, 2.0]), (-100, [-1.0, 0.5]), (0, [1.0, 2.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0])]) == []


def test_repeated_ids_ask_for_themselves(spark, monkeypatch):
    """Rows that share an id, some of them equal: each is a candidate of the others."""
    monkeypatch.setattr(topk, "VECTORS", 4)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(100, [float(i % 5), 1.0]) for i in range(9)] + [(7, [2.0, 2.0]), (200, [1.0, 1.0]), (200, [1.0, 1.0])]
    assert result(spark, rows) == brute(rows)


def test_beyond_64_bits_is_refused(spark):
    for rows in ([(0, [4e9]), (1, [4e9])], [(0, [1.0]), (1, [1e17])]):
        with pytest.raises(Exception, match="beyond 64 bits"):
            result(spark, rows)
    near = [(0, [2.0 ** 20]), (1, [2.0 ** 22]), (2, [-2.0 ** 20])]
    assert result(spark, near) == brute(near)
