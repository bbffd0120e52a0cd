"""The Merkle manifest against a tree built in one piece."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

ROWS = [(i, f"text {i} é" * (i % 4), "en", "a", i) for i in range(97)]
ROWS += [(i, f"texte {i}", "fr", "b", 7) for i in range(200, 209)] + [(300, None, None, None, None), (301, "", "", "", 0), (302, "x" * 100_000, "éa", "c", 1)]
ROWS += [(None, "no id", "en", "a", 3), (None, None, None, None, None), (5, "another text of id 5", "en", "a", 1), *[(400, "copy", "de", "z", 4)] * 30]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, n string, root string"


def frame(spark, rows):
    """With further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def by_hand(row) -> str:
    i, text, lang, source, chars = row
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, chars, text)).encode()).hexdigest()


def leaves(spark, rows):
    return frame(spark, rows).select("doc_id", "lang", merkle.digest(*map(F.col, merkle.FIELDS)).alias("leaf"))


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1)])
def test_equals_a_tree_in_one_piece(spark, fanout, levels):
    found = merkle.manifest(leaves(spark, ROWS), "lang", "doc_id", fanout, levels)
    got = found.select("lang", "doc_id", "leaf", "subroot", merkle.siblings().alias("path"), "root", merkle.folded(F.col("leaf")).alias("folded")).collect()
    root, proofs = merkle.brute_force([(r[2], r[0], by_hand(r)) for r in ROWS], fanout)
    want = [(r[2], r[0], by_hand(r), *proofs[k]) for k, r in enumerate(ROWS)]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert {r["root"] for r in got} == {r["folded"] for r in got} == {root}


def test_changed_rows_are_found(spark):
    found = merkle.manifest(leaves(spark, ROWS), "lang", "doc_id", 2, 3)
    other = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("leaf"))
    got = found.select("doc_id", (merkle.folded(other) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] == (r["doc_id"] is None or r["doc_id"] % 5 > 0) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "one", "en", "a", 3)], [(1, "one", None, "a", 3)] * 2])
def test_small_tables(spark, rows):
    found = merkle.manifest(leaves(spark, rows), "lang", "doc_id").collect()
    root, _ = merkle.brute_force([(r[2], r[0], by_hand(r)) for r in rows])
    assert len(found) == len(rows) and all(r["root"] == root for r in found)


def test_query_on_copies_and_nulls(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS) and {r["root"] for r in got} == {merkle.brute_force([(r[2], r[0], by_hand(r)) for r in ROWS])[0]}
    import zlib

    hit = {r[0] for r in ROWS if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r["doc_id"] for r in got if not r["verified"]} == hit and hit
