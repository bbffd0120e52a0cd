"""The training-data pipeline over documents: each stage works on all that the one before it kept.

quality        documents that the classifier rejects go (empty texts too)
near_dedup     one document of each group of near copies stays, the one of the smallest id; of rows with one id and one text, one
decontaminate  documents that the benchmark contaminates go
secrets        secret spans are masked in the text, and n_chars follows; no document goes
encode         the pieces of each text

All stages but the last return the columns of documents. Decisions are on rows, named by id and text, so that rows that share an id,
or have none, each follow their own. Null and empty texts go in the first stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, near_dedup, pieces, quality, secrets, shared

#: Up to so many rows that a stage removes are broadcast to the scan of texts (16 bytes each); more are joined by sorting.
BROADCAST_ROWS = 1_000_000
#: Words of a shingle.
SHINGLE = 5


#: Columns by which a stage knows a row; documents' own columns of any other name pass through. A table that has these two is refused.
ID, MARK = "_quern_id", "_quern_mark"


def named(docs: DataFrame) -> DataFrame:
    if taken := {ID, MARK} & set(docs.columns):
        raise ValueError(f"documents has columns of the pipeline's own: {sorted(taken)}")
    return docs.withColumns({ID: F.col("doc_id").cast("long"), MARK: shared.mark()})


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs but those in gone (doc_id, mark: the hash of the text); a null id is an id like others here."""
    gone, _ = shared.stored(gone.select(F.col("doc_id").cast("long").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct(), "gone")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return named(docs).join(gone, F.col(ID).eqNullSafe(F.col("_gone_id")) & F.col(MARK).eqNullSafe(F.col("_gone_mark")), "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, shared.table(spark, sf_dir, "labels"))
    return without(docs, judged.where("rejected"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = shared.stored(near_dedup.near_duplicates(docs, size=SHINGLE), "judged")
    kept = without(docs, found.where("NOT kept"))
    twice, _ = shared.stored(found.where("kept AND n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("_twice_id"), F.col("mark").alias("_twice_mark")), "twice")
    if twice.isEmpty():
        return kept
    same = F.col(ID).eqNullSafe(F.col("_twice_id")) & F.col(MARK).eqNullSafe(F.col("_twice_mark"))
    once = named(kept).join(twice, same, "left_semi").dropDuplicates([ID, MARK])
    return named(kept).join(twice, same, "left_anti").unionByName(once).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets_stage), ("encode", encode_stage)]
#: Trained and sampled steps have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = shared.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
