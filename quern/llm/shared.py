"""Helpers that the operators of this subpackage share: the shared folder, intermediate tables, Arrow maps, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import prepare

#: Rows and bytes handed to a Python worker at once, far below Spark's 10,000 rows: documents are long, and what is in flight
#: lies outside the JVM's heap on both sides.
BATCH_ROWS = 400
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one only where it is unset (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this driver has had written, for clean().
WRITTEN: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    WRITTEN.append(f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex[:12]}")
    return WRITTEN[-1]


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables and models written so far. To be called once results are stored: frames not yet computed read them."""
    while WRITTEN:
        remove(spark, WRITTEN.pop())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession) -> None:
    """Bounds what Arrow sends to a Python worker at once, so that long texts don't fill its memory. Shuffle files go when the query they
    served ends (a later reader of the same plan would have its stages run again), so that they don't add up from one stored table to the next."""
    prepare(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives what a task has held back to the system, as the worker lives on and the next task may need the memory elsewhere."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc: it keeps the memory for itself


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to its columns; schema is Spark's DDL."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows(batch)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, out)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts after one another, and how many each has; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.any(empty := pc.equal(pc.binary_length(words), 0)).as_py():  # before the first word and after the last
        gone = np.zeros(len(words) + 1, np.int64)
        np.cumsum(empty.to_numpy(zero_copy_only=False), out=gone[1:])
        ends = np.cumsum(counts)
        counts = counts - (gone[ends] - gone[ends - counts])
        words = words.filter(pc.invert(empty))
    return words, counts


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mark(text: str = "text") -> Column:
    """A hash of a text: with its doc_id it names a row, so that rows that share an id are told apart."""
    return F.xxhash64(F.col(text).cast("string"))
