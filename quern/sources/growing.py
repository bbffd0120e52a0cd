"""Growing text files as a source, batch and streaming: `spark.read.format("growing_lines")`, `spark.readStream.format("growing_lines")`.

Rows are (path, at, line): the lines added to the files below a folder, each with the byte at which it begins. An offset is one number a file, the
end of its last whole line, which Spark commits in the query's checkpoint: a half-written line waits for its end, only added bytes are
read, and a file that is shorter than its offset was cut and starts again. (One that was cut and has since grown past its offset can't be told from one that
grew.) Added bytes are dealt out in parts of about `part` bytes; a part reads the lines that begin in it, so a large file isn't one task.

Files are reached through pyarrow's file systems by URI (file, hdfs, s3, gs). Lines end in \\n or \\r\\n; bytes that are no UTF-8 are replaced, in whole lines only.
Options: path (the folder or a file), suffix (of file names), part, and for batch reading since and until (offsets as JSON).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.session import prepare

SCHEMA = "path string, at bigint, line string"
ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string())])
PART = 64 << 20
READ = 1 << 20
ROWS = 5000


def listed(folder: str, suffix: str = "") -> dict[str, int]:
    """Size of each file."""
    system, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}


def opened(folder: str, path: str):
    system, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")
    return system.open_input_file(path)


def whole(folder: str, path: str, size: int) -> int:
    """The end of the last whole line within size bytes, looked for from the end."""
    with opened(folder, path) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - READ)
            f.seek(start)
            if (k := f.read(stop - start).rfind(b"\n")) >= 0:
                return start + k + 1
            stop = start
    return 0


@dataclass
class Part(InputPartition):
    folder: str
    path: str
    start: int
    low: int
    high: int
    stop: int


def planned(folder: str, since: dict[str, int], until: dict[str, int], part: int) -> list[Part]:
    """The parts of what was added; a file that is now shorter begins at 0."""
    out = []
    for path, stop in sorted(until.items()):
        start = since.get(path, 0)
        start = start if start <= stop else 0
        out += [Part(folder, path, start, low, min(low + part, stop), stop) for low in range(start, stop, part)]
    return out


def lines_of(p: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the part, the last of them read to its end."""
    with opened(p.folder, p.path) as f:
        at = p.low
        if p.low > p.start:  # the line that reaches into the part belongs to the one before
            at = p.low - 1
            f.seek(at)
            while True:
                block = f.read(min(READ, p.stop - at))
                k = block.find(b"\n")
                if k >= 0 or not block:
                    at += k + 1
                    break
                at += len(block)
            if not block:
                return
        f.seek(at)
        held, place = b"", at
        while place < p.high and (block := f.read(min(READ, p.stop - at))):
            at += len(block)
            parts = (held + block).split(b"\n")
            held = parts.pop()
            for line in parts:
                if place >= p.high:
                    return
                yield place, line
                place += len(line) + 1


def batches_of(p: Part) -> Iterator[pa.RecordBatch]:
    places: list[int] = []
    texts: list[str] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=ARROW)

    held = 0
    for place, line in lines_of(p):
        places.append(place)
        texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
        held += len(line)
        if len(places) == ROWS or held > 4 * READ:
            yield made()
            places, texts, held = [], [], 0
    if places:
        yield made()


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("part", PART))
        self.since, self.until = json.loads(options.get("since", "{}")), json.loads(options["until"]) if "until" in options else None

    def partitions(self) -> list[Part]:
        until = self.until if self.until is not None else ends(self.folder, self.suffix)
        return planned(self.folder, self.since, until, self.part) or [Part(self.folder, "", 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches_of(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("part", PART))
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Files whose size hasn't changed since the last look aren't opened."""
        for path, size in listed(self.folder, self.suffix).items():
            if self.seen.get(path, (-1, 0))[0] != size:
                self.seen[path] = size, whole(self.folder, path, size)
        return {path: end for path, (_, end) in sorted(self.seen.items())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return planned(self.folder, start, end, self.part)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition)


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def ends(folder: str, suffix: str = "") -> dict[str, int]:
    """The offsets of now."""
    return {path: whole(folder, path, size) for path, size in listed(folder, suffix).items()}


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(GrowingLines)
