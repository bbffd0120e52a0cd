"""The quality model is learnt from every trusted document that isn't kept for the thresholds."""

from quern.llm import quality


def test_trains_on_all_trusted_documents(spark, monkeypatch):
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts: seen.append(texts.count()) or train(texts))
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('Some words ', id % 7) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = quality.classify(docs, labels)
    kept = docs.where("pmod(xxhash64(doc_id, 'calibration'), 3) = 0").count()
    assert seen == [9000 - kept] and seen[0] > 5000 and got.where("rejected").count() == 0


def test_counts_do_not_depend_on_how_many_are_held(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two  three"), (2, None), (3, "two three two three")], "doc_id long, text string")
    want = {r["g"]: r["n"] for r in quality.grams(docs.selectExpr("0 AS key", "text")).groupBy("g").agg({"n": "sum"}).toDF("g", "n").collect()}
    monkeypatch.setattr(quality, "HELD", 2)
    assert {r["g"]: r["n"] for r in quality.counted(docs).collect()} == want
