"""Growing files: whole lines only, added bytes only, cut files again, parts of any size, restarts of the stream."""

import random

import pytest

from quern.sources import growing, readers
from quern.streaming import streams

RNG = random.Random(8)


def taken(spark, folder, tmp_path):
    """What the stream's query adds now."""
    out = f"{tmp_path}/out"
    before = set()
    if (tmp_path / "out").exists():
        before = {tuple(r) for r in spark.read.schema(growing.SCHEMA).parquet(out).collect()}
    after = streams.run_once(streams.growing(spark, str(folder)), out, f"{tmp_path}/checkpoint").collect()
    assert len(after) == len({tuple(r) for r in after})
    return sorted((r["path"].rsplit("/", 1)[1], r["at"], r["line"]) for r in after if tuple(r) not in before)


def test_stream_of_growing_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    a, b = folder / "a.log", folder / "deep" / "b.log"
    a.write_bytes(b"one\ntw")
    b.write_bytes("ä".encode()[:1])
    assert taken(spark, folder, tmp_path) == [("a.log", 0, "one")]
    with a.open("ab") as f:
        f.write(b"o\r\nthree")
    with b.open("ab") as f:
        f.write("ä".encode()[1:] + b"\n\n")
    assert taken(spark, folder, tmp_path) == [("a.log", 4, "two"), ("b.log", 0, "ä"), ("b.log", 3, "")]
    assert taken(spark, folder, tmp_path) == []
    with a.open("ab") as f:
        f.write(b"\n")
    (folder / "c.log").write_bytes(b"new\n")
    b.write_bytes(b"x\n")  # cut, and written anew
    assert taken(spark, folder, tmp_path) == [("a.log", 9, "three"), ("b.log", 0, "x"), ("c.log", 0, "new")]


def test_lines_added_bit_by_bit(spark, tmp_path):
    """However the bytes come, each line is read once, as it is in the end."""
    folder = tmp_path / "in"
    folder.mkdir()
    whole = "".join("".join(RNG.choice("aé😀 ") for _ in range(RNG.randint(0, 9))) + "\n" for _ in range(60)).encode()
    at, found, offsets = 0, [], None
    while at < len(whole):
        n = RNG.randint(1, 120)
        with (folder / "x.log").open("ab") as f:
            f.write(whole[at : at + n])
        at += n
        rows, offsets = readers.new_lines(spark, str(folder), offsets)
        found += sorted((r["at"], r["line"]) for r in rows.collect())
    lines = whole.decode().split("\n")[:-1]
    assert [t for _, t in found] == lines and [p for p, _ in found] == [len("\n".join(lines[:i] + [""]).encode()) for i in range(len(lines))]


@pytest.mark.parametrize("part", [1, 3, 7, 64, 10**6])
def test_parts_share_no_line_and_lose_none(tmp_path, monkeypatch, part):
    monkeypatch.setattr(growing, "READ", 5)
    whole = b"".join(bytes(RNG.choice(b"ab") for _ in range(RNG.choice((0, 1, 2, 30)))) + b"\n" for _ in range(80)) + b"torn"
    (tmp_path / "x").write_bytes(whole)
    until = growing.ends(str(tmp_path))
    assert list(until.values()) == [len(whole) - 4]
    for start in (0, whole.index(b"\n") + 1):
        found = [x for p in growing.planned(str(tmp_path), {k: start for k in until}, until, part) for x in growing.lines_of(p)]
        assert b"".join(t + b"\n" for _, t in found) == whole[start:-4] and all(whole[p : p + len(t)] == t for p, t in found)


def test_only_added_bytes_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"a" * 1000 + b"\n" + b"b\n")
    asked = []

    class Seen:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *e):
            self.f.close()

        def seek(self, n):
            asked.append(n)
            self.f.seek(n)

        def read(self, n):
            return self.f.read(n)

    plain = growing.opened
    monkeypatch.setattr(growing, "opened", lambda folder, path: Seen(plain(folder, path)))
    parts = growing.planned(str(tmp_path), {str(tmp_path / "x"): 1001}, {str(tmp_path / "x"): 1003}, 100)
    assert [x for p in parts for x in growing.lines_of(p)] == [(1001, b"b")] and asked == [1001]


def test_no_folder_and_no_file(spark, tmp_path):
    lines, at = readers.new_lines(spark, str(tmp_path / "none"))
    assert lines.count() == 0 and at == {}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.log").write_bytes(b"")
    lines, at = readers.new_lines(spark, str(tmp_path / "empty"))
    assert lines.count() == 0 and list(at.values()) == [0]
