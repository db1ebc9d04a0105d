"""The one-pass CSV reader: every line once, whatever the split, the encoding, the header and the line ends."""

from __future__ import annotations

import random

import pytest

from flowspark.sources import raw_csv as R


class Recorder:
    """A file that notes which bytes were read."""

    def __init__(self, data: bytes) -> None:
        self.data, self.reads = data, [0] * len(data)

    def read_at(self, n: int, at: int) -> bytes:
        for i in range(at, min(at + n, len(self.data))):
            self.reads[i] += 1
        return self.data[at : at + n]


@pytest.mark.parametrize("ending", [b"\n", b"\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_every_line_belongs_to_one_range(ending, last, monkeypatch):
    monkeypatch.setattr(R, "TAIL_BYTES", 5)
    rng = random.Random(1)
    lines = [bytes(rng.choice(b"abc,") for _ in range(rng.choice([0, 1, 2, 9, 40]))) for _ in range(60)]
    data = ending.join(lines) + (ending if last else b"")
    for split in (1, 2, 3, 7, 16, 50, 333, 10_000):
        for limit in (1, 4, 64):
            got = [p for start in range(0, len(data), split) for p in R.pieces(Recorder(data), start, min(start + split, len(data)), len(data), limit)]
            assert b"".join(got) == data, (split, limit)
            assert all(p.endswith(b"\n") for p in got[:-1])


def test_bytes_are_read_once():
    data = b"".join(b"%d,some text\n" % i for i in range(40_000))
    file, split = Recorder(data), 1 << 17
    rows = b"".join(p for start in range(0, len(data), split) for p in R.pieces(file, start, min(start + split, len(data)), len(data), 1 << 14))
    assert rows == data
    assert sum(file.reads) <= len(data) + (R.TAIL_BYTES + 1) * (len(data) // split + 1)  # the line at each end of a range


def test_kinds():
    assert [R.kind_of(x) for x in (b"a", "é".encode(), b"\xe9", b"")] == [R.ASCII, R.UTF8, R.OTHER, R.ASCII]


def test_encodings_headers_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name, n\r\ncafé,1\r\n\"a,\"\"b\"\"\",x\r\n\r\nshort\r\nlong,2,3\r\n".encode())
    (tmp_path / "b.csv").write_bytes("n,Extra,Name\n4,e,na\xefve\n5,,Ã©\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"Name,n\n")
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.csv").write_text("Name\n" + "\n".join(f"é{i}" for i in range(500)), encoding="utf-8")
    for split in (7, 64, 1 << 20):
        df = R.read_raw(spark, f"{tmp_path}/*.csv", lambda c: "double" if c == "n" else "string", split_bytes=split)
        assert df.columns == ["Name", "n", "Extra"]
        got = sorted(((r.Name, r.n, r.Extra) for r in df.collect()), key=str)
        want = [("café", 1.0, None), ('a,"b"', None, None), ("short", None, None), ("long", 2.0, None), ("naïve", 4.0, "e"), ("Ã©", 5.0, None)]
        assert got == sorted([*want, *((f"é{i}", None, None) for i in range(500))], key=str), split


def test_files_without_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,1\n\"\",2\n")
    assert sorted(map(tuple, R.read_raw(spark, f"{tmp_path}/1.csv", header=False).collect())) == [("", "2"), ("a", "1")]
    named = R.read_raw(spark, f"{tmp_path}/1.csv", header=False, names=lambda n: ["x", "y"])
    assert named.columns == ["x", "y"] and named.count() == 2
