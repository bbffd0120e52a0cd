"""Faults found by review, each held by a test: evidence of all mentions, automata kept by the worker."""

import os
import random

import pytest

from pyspark.sql import functions as F

from quern.llm import decontaminate, pii, secrets, shared

RNG = random.Random(31)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long")


def disclosing(spark, rows):
    docs = frame(spark, rows)
    found = pii.disclosing(docs, pii.base(docs))
    return {} if found is None else {r["term"]: pytest.approx(r["strength"]) for r in found.collect()}


def test_one_more_mention_takes_no_evidence_away(spark):
    rows = [(i, f"codename Bluefinch met agent@corp.example for tea {'abcdefghijkl'[i]}x") for i in range(12)]
    more = [(i, f"aa {'stuvwxyzabcd'[i]}q agent@corp.example bb. " + "filler and filler. " * 12 + t) for i, t in rows]
    plain = [(100 + i, "the common words over and of the plain kind") for i in range(60)]
    for texts in (rows, more):
        assert "bluefinch" in disclosing(spark, texts + plain)
        spans = pii.scan(frame(spark, texts + plain)).where("doc_id < 12").collect()
        assert all(any(t[s["start"] : s["end"]] == "Bluefinch" for s in r["terms"] or []) for r in spans for t in [dict(texts)[r["doc_id"]]])


def test_mentions_of_one_document_count(spark):
    """An entity of a single long document whose telling word stands beside it in several surroundings."""
    text = " ".join(f"{w}ish Silverlake {w}er 10.20.30.40 and {w}ing" + " filler" * 30 for w in ("red", "green", "blue", "dark"))
    rows = [(1, text)] + [(100 + i, "and some filler here") for i in range(40)]
    assert "silverlake" in disclosing(spark, rows)
    assert "silverlake" not in disclosing(spark, [(1, text.replace("Silverlake", "Silverlake", 1).replace("green", "red").replace("blue", "red").replace("dark", "red")), *rows[1:]])


def test_strengths_by_hand(spark):
    words = [f"{a}{b}" for a in "ka ti so mer lun".split() for b in "na ri tok es".split()]
    entities = ["a@b.example", "10.1.2.3", "+44 20 7946 0991", "c@d.example"]
    telling = dict(zip(entities, ("bluefinch", "rotor", "harbour", "quartz"), strict=True))
    rows = []
    for i in range(150):
        parts = []
        for _ in range(RNG.randint(0, 4)):
            e = RNG.choice(entities)
            parts += [RNG.choice(words) for _ in range(RNG.randint(0, 25))] + ([telling[e]] if RNG.random() < 0.8 else []) + [e]
        rows.append((i if i % 50 else None, " ".join([*parts, *(RNG.choice(words) for _ in range(10))])))
    want = pii.brute_force_terms(rows)
    assert len(want) > 3 and disclosing(spark, rows) == want


def test_terms_are_broadcast_by_bytes(spark, monkeypatch):
    rows = [(i, f"codename Bluefinch met agent@corp.example for tea {'abcdefghijkl'[i]}x") for i in range(12)] + [(100 + i, "the common words") for i in range(60)]
    want = sorted(map(repr, pii.scan(frame(spark, rows)).collect()))
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, pii.scan(frame(spark, rows)).collect())) == want


def test_one_automaton_a_worker(spark):
    items = [("a", [b"one", b"two"]), ("b", [b"x"] * 20)]
    get, sent = decontaminate.matcher_for(spark, items)
    again, _ = decontaminate.matcher_for(spark, list(items))

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "one": [id(get())], "two": [id(again())]})

    got = spark.range(0, 48, 1, 12).mapInArrow(kept, "pid long, one long, two long").collect()
    assert len(got) == 12 and len({tuple(r) for r in got}) == len({r["pid"] for r in got}) <= 4
    assert all(r["one"] == r["two"] for r in got)
    sent.destroy()


def test_dictionary_has_no_bound_and_joins_give_the_same(spark, monkeypatch):
    rows = [(i, f"the Datenschutz of mechanisms {i}. key: hvqkzmxwpl and pin: Datenschutz{i % 3}") for i in range(9)]
    rows += [(20, "password is mechanismsdatenschutz"), (21, "token: kqzwvbxj9kqzw"), (22, None), (23, ""), (24, "no hint here")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    asked = {r["word"] for r in secrets.asked_words(docs).collect()}
    assert {"datenschutz", "mechanisms"} <= asked and "hvqkzmxwpl" not in asked and "the" not in asked
    spans = lambda: sorted((r["doc_id"], r["spans"]) for r in secrets.scan(docs).collect())
    kept = lambda: sorted(map(repr, secrets.redact(docs).collect()))
    want, left = spans(), kept()
    assert any("guess" in s for _, s in want) and dict(want)[20] == ""
    monkeypatch.setattr(secrets, "BROADCAST_BYTES", 0)
    assert spans() == want and kept() == left


def test_pipeline_passes_other_columns_through(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "g", "x", "y", "z")], "doc_id long, text string, _id string, _mark string, _doc string")
    gone = spark.createDataFrame([(2,)], "doc_id long").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", shared.mark().alias("mark"))
    assert [tuple(r) for r in corpus_pipeline.without(docs, gone).collect()] == [(1, "a b c d e f", "x", "y", "z")]
    with pytest.raises(ValueError, match="own"):
        corpus_pipeline.named(docs.withColumn("_quern_id", F.lit(1)))
