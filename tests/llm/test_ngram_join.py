"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import near_dedup, ngram_join

RNG = random.Random(23)
WORDS = [f"{a}{b}" for a in "ka ti so mer lun dra vo pel".split() for b in "na ri tok es ul am".split()]
EDGES = [(100000, None), (100001, ""), (100002, " \n\t "), (100003, "one"), (100004, "One"), (100005, "é" * 300), (100006, "x " * 5000), (100007, "one two"), (100008, "two one"), (100009, "a b c")]


def frame(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n long, key string")


def edited(words: list[str], most: int) -> str:
    own = list(words)
    for _ in range(RNG.randint(0, most)):
        own[RNG.randrange(len(own))] = RNG.choice(WORDS)
    return " ".join(own)


def found(spark, rows, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(frame(spark, rows), **how).collect()}


def by_hand(rows, size=3, percent=90):
    return {d: x[:2] for d, x in near_dedup.brute_force(rows, size, percent).items()}


@pytest.mark.parametrize(("short", "block", "longest"), [(16, 1000, 4), (1, 7, 2)])
def test_matches_all_pairs(spark, monkeypatch, short, block, longest):
    for name, value in (("SHORT", short), ("BLOCK", block), ("LONGEST", longest)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = []
    for _ in range(25):
        words = [RNG.choice(WORDS) for _ in range(RNG.choice((20, 60, 150)))]
        rows += [(len(rows) + k, edited(words, 5)) for k in range(RNG.randint(1, 8))]
    words = [RNG.choice(WORDS) for _ in range(200)]
    rows += [(len(rows) + k, edited(words, 9)) for k in range(40)]
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(5)] + EDGES
    want = by_hand(rows)
    assert found(spark, rows) == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_chain_and_lists_that_no_pivot_settles(spark, monkeypatch):
    """Neighbours of a chain are linked, ends are not; all share a passage, whose pivot is linked with few."""
    monkeypatch.setattr(ngram_join, "SHORT", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    words, rows = [RNG.choice(WORDS) for _ in range(120)], []
    for i in range(40):
        words[(11 * i) % 120] = f"new{i}"
        rows.append((40 - i, " ".join(words)))
    assert found(spark, rows) == by_hand(rows)
    monkeypatch.setattr(ngram_join, "screened", lambda percent: lambda batches: (b.select([0, 1]).slice(0, 0) for b in batches))  # pivots confirm nothing
    assert found(spark, rows) == by_hand(rows)


def test_templates(spark):
    """Texts of one template share most tokens, yet are not linked; one copy of one of them is."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"common words around slot {s} v{rng.randrange(3)}s{s} end" for s in range(40))) for i in range(300)]
    rows.append((300, rows[150][1].replace("s39 end", "x39 end")))
    got = found(spark, rows)
    assert got == by_hand(rows) and got[300][1] == 150


@pytest.mark.parametrize(("size", "percent"), [(1, 50), (5, 100)])
def test_other_shingles_and_similarities(spark, size, percent):
    words = [RNG.choice(WORDS) for _ in range(30)]
    rows = [(i, edited(words, 8)) for i in range(60)] + EDGES
    assert found(spark, rows, size=size, percent=percent) == by_hand(rows, size, percent)


def test_rows_without_or_with_one_id(spark):
    text = " ".join(WORDS)
    rows = [(None, text), (7, text), (7, text), (3, text + " more"), (9, "other text here"), (9, text), (5, "other text here")]
    got = sorted(map(tuple, ngram_join.joined(frame(spark, rows)).collect()), key=repr)
    n = len(WORDS) - 2
    # the two rows of id 9 each follow their text; the row without an id has no links
    assert got == sorted([(3, n + 1, 3), (5, 1, 5), (7, n, 3), (7, n, 3), (9, n, 3), (9, 1, 5), (None, n, None)], key=repr)


def test_empty_table(spark):
    assert ngram_join.joined(frame(spark, [])).count() == 0


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        whole = np.unique(rng.integers(0, 2**63, 400, np.uint64))
        sa, sb = (np.sort(rng.choice(whole, rng.integers(1, len(whole)), replace=False)) for _ in range(2))
        fa, fb = (np.bincount((x % np.uint64(ngram_join.BINS)).astype(int), minlength=ngram_join.BINS).astype(np.uint16) for x in (sa, sb))
        percent = int(rng.integers(1, 100))
        if ngram_join.similar(sa, sb, percent):
            assert ngram_join.bounded(np.array(len(sa)), np.array(len(sb)), fa, fb, percent)


def test_tables_of_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAN", 2)
    rows = [(i, " ".join(RNG.choice(WORDS) for _ in range(50))) for i in range(60)]
    scan = ngram_join.scanned(frame(spark, rows).repartition(5), 3).cache()
    got = ngram_join.table_of(scan.where("piece IS NOT NULL"), 5)
    sets = ngram_join.shingle_sets(pa.array([t for _, t in rows]), 3)
    assert (got == np.bincount(ngram_join.cell(np.concatenate(sets)), minlength=ngram_join.CELLS)).all()
