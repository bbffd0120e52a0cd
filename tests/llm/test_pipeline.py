"""The pipeline stage by stage: columns stay, decisions take effect, each stage against brute force on what the one before kept."""

import corpus_pipeline
from quern.llm import decontaminate, near_dedup, pieces, secrets, shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs, _ = shared.stored(stage(spark, docs, SF), name)
        kept[name] = (before, {r["doc_id"]: r for r in docs.collect()})
        assert name == "encode" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in shared.table(spark, SF, "labels").collect()}
    before, after = kept["quality"]
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.98 * len(good) and len(after) < len(before)
    before, after = kept["near_dedup"]
    assert set(after) == {d for d, (_, _, stays) in near_dedup.brute_force(list(before.items()), size=corpus_pipeline.SHINGLE).items() if stays}
    before, after = kept["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in shared.table(spark, SF, "benchmark").collect()]
    assert set(after) == {d for d, t in before.items() if not decontaminate.brute_force(t, items)[4]}
    before, after = kept["secrets"]
    assert set(after) == set(before)
    words = secrets.dictionary(spark.createDataFrame([(t,) for t in before.values()], "text string"))
    for d, r in after.items():
        raw = before[d].encode().lower()
        spans = secrets.base_spans(before[d], raw) + secrets.guessed_spans(before[d], raw, words)
        assert r["text"] == secrets.redact_text(before[d], spans) and r["n_chars"] == len(r["text"])
        assert not secrets.base_spans(r["text"], r["text"].encode().lower())
    before, after = kept["encode"]
    assert set(after) == set(before) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after.values())
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(docs).collect()}
    assert back == before


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and got.count() > 0


def test_nulls_and_empty_tables(spark, tmp_path):
    schema = shared.table(spark, SF, "documents").schema
    for name in ("labels", "benchmark"):
        shared.table(spark, SF, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of " * 30, "en", None, 330), (4, "the and of " * 30, "en", "s", 330)], schema)
    for rows in (odd, odd.limit(0)):
        rows.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        corpus_pipeline.run(spark, f"file://{tmp_path}").collect()


def test_rows_that_share_an_id(spark):
    """Decisions are on rows: equal rows are one, another text under the same id or under none stays or goes on its own."""
    schema = shared.table(spark, SF, "documents").schema
    one, other = " ".join(f"word{i}" for i in range(40)), " ".join(f"thing{i}" for i in range(40))
    rows = [(1, one, "en", "s", 1), (1, one, "en", "s", 1), (2, one, "en", "s", 1), (3, other, "en", "s", 1), (None, "a b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    assert got == [(0, "a b"), (1, one), (3, other)]
    gone = spark.createDataFrame([(1, one), (None, "a b")], "doc_id long, text string").select("doc_id", shared.mark().alias("mark"))
    docs = spark.createDataFrame([*rows, (1, other, "en", "s", 1), (None, "c", "en", "s", 1)], schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.without(docs, gone).collect())
    assert got == [(0, "c"), (1, other), (2, one), (3, other)]
