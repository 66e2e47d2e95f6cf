"""Held-out accuracy, the filter itself and odd rows."""

import numpy as np

from conftest import SF
from kerbside.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_filter_finds_all_and_little_else():
    rng = np.random.default_rng(1)
    sets = {f"l{k:03d}": rng.integers(0, 1 << 63, 300, dtype=np.uint64) for k in range(70)}
    f = L.LanguageFilter.build(sets)
    assert f.masks.shape[1] == 2

    def found(hashes, k):
        slots = f._slots(hashes, len(f.masks))
        mask = np.bitwise_and.reduce([f.masks[s, k // 64] for s in slots])
        return (mask >> np.uint64(k % 64) & np.uint64(1)).mean()

    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    for k, name in enumerate(f.languages):
        assert found(sets[name], k) == 1.0
        assert abs(found(other, k) - f.chance[k]) < 0.01


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")


ROWS = [(k, ("der die und das ist nicht " if k % 2 else "the and that with this from ") * 4, "de" if k % 2 else "en") for k in range(80)]
ODD = [(900, None, "en"), (901, "", "de"), (902, "12 34 !!", None), (903, "und das", None), (None, "with this", "en"), (904, "The And " * 50000, None)]


def test_odd_rows(spark):
    got = {r.doc_id: r for r in L.identify(frame(spark, ROWS + ODD)).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == "de" and got[None].lang_pred == "en" and got[904].lang_pred == "en"
    assert not got[None].held_out
    assert all(got[k].lang_pred == ("de" if k % 2 else "en") for k in range(80))
    assert L.identify(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in L.identify(frame(spark, [(1, "words", None)])).collect()] == ["und"]


def test_stage_keeps_columns(spark):
    docs = frame(spark, ROWS + ODD)
    kept = L.keep_known(docs, L.train(docs), 0.15)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(80), 903, 904, None}
