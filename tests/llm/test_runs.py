"""Periodic runs against trying all periods at all places."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import runs, shared

RNG = random.Random(5)


def periodic() -> list[int]:
    k = RNG.randint(1, 3)
    made = [RNG.randrange(k) for _ in range(RNG.randint(0, 30))]
    if RNG.random() < 0.6:
        made += made[: RNG.randint(1, 6)] * RNG.randint(1, 8) + [RNG.randrange(k) for _ in range(RNG.randint(0, 5))]
    if RNG.random() < 0.3:
        made += made[len(made) // 3 :]  # runs inside a block that copies an earlier one
    return made * RNG.randint(1, 4) if RNG.random() < 0.3 else made


@pytest.mark.parametrize(("least", "shortest"), [(4, 6), (2, 2), (3, 3)])
def test_all_runs_of_random_texts(least, shortest):
    for _ in range(400):
        texts = [periodic() for _ in range(RNG.randint(1, 4))]
        found = dict(runs.runs_of(np.array([c for t in texts for c in t], np.int64), np.array([len(t) for t in texts]), least, shortest))
        assert [found.get(i, []) for i in range(len(texts))] == [runs.brute_force(t, least, shortest) for t in texts]


def test_words_are_those_of_the_contract():
    texts = ["", None, " \t a\x0bb\x0cc\r\n", "one", "é é  x\x85y\x1fz", "\x00 a"]
    words, counts = shared.split_words(pa.array(texts, pa.string()))
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in (t or "").encode().split()]


TEXTS = [None, "", " \n ", "one", "a " * 5, "a " * 6, "A a " * 40, "é ü " * 9 + "é", "x y z " * 4 + "end " + "x y z " * 4 + "end", "tick " * 3000 + "tock " + "tick " * 3000]


def test_query_matches_rows_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PART", 200)
    rows = [(i, " ".join(f"w{c}" for c in periodic()) + RNG.choice(["", " ", "\n"])) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "p q " * 8), rows[3], rows[3]]
    spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((runs.row_by_hand(*r) for r in rows), key=repr)
    assert any(runs.planted(i, 50) is not None and g[1] for i, g in zip([g[0] for g in got], got, strict=True))


def test_collapsed_texts(spark):
    rows = [(1, "so it goes it goes it goes it goes it goes on"), (2, "nothing repeats here"), (3, None)]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (12, [(1, 10, 2)], "so it goes on"), 2: (3, [], "nothing repeats here"), 3: (0, [], "")}


def test_empty_table(spark):
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
