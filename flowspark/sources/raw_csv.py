"""Raw CSV files in one pass: a Python data source with byte-range partitions.

Each partition reads its byte range of one file once, to the end of the line that it cuts, and yields Arrow
batches of plain strings under the names of its file's header.  What only the whole file tells, its encoding, is settled
after the read without touching the files again: bytes are taken as Latin-1, which loses nothing, every piece is marked
as ASCII, UTF-8 or neither, the typed rows are stored as Parquet, and a file without any "neither" has the texts of its
UTF-8 pieces decoded when they are read from there.

A line break ends a record.  Rows with too few fields are filled up with nulls, extra fields are dropped, empty fields are null.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowspark.session import written

FORMAT = "raw_flow_csv"
SPLIT_BYTES = 64 << 20
PIECE_BYTES = 4 << 20
HEADER_BYTES = 1 << 16
TAIL_BYTES = 1 << 12  # how far beyond its range a partition looks at a time for the end of its last line
ASCII, UTF8, OTHER = 0, 1, 2
FILE, KIND = "_file", "_kind"
BOM = b"\xef\xbb\xbf"


def open_file(uri: str) -> pa.NativeFile:
    """Any file system that Arrow reads, by the URI that Spark lists."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    system, path = FileSystem.from_uri(uri)
    return system.open_input_file(path)


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files of a glob, by name; a folder stands for its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(path) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(s.getPath().toUri().toString(), s.getLen()) for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found)


def numbered(names: list[str]) -> list[str]:
    """Header names trimmed and made unique: a name met again gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        key = name.strip()
        count = seen.get(key, 0)
        seen[key] = count + 1
        out.append(f"{key}.{count}" if count else key)
    return out


def first_line(uri: str) -> bytes:
    line, at = b"", 0
    with open_file(uri) as file:
        while b"\n" not in line:
            more = file.read_at(HEADER_BYTES, at)
            if not more:
                break
            line, at = line + more, at + len(more)
    return line.split(b"\n", 1)[0].removeprefix(BOM).rstrip(b"\r")


def fields(line: bytes) -> list[str]:
    """The fields of a header line, which holds no other encoding's letters in practice: UTF-8 if it is, else Latin-1."""
    try:
        decoded = line.decode()
    except UnicodeDecodeError:
        decoded = line.decode("latin-1")
    return next(csv.reader([decoded]), [])


def pieces(file: pa.NativeFile, start: int, end: int, size: int, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Whole lines that begin in [start, end), in pieces of about ``limit`` bytes; each byte is read once."""
    at, rest = start, b""
    inside = start == 0  # the line cut by ``start`` belongs to the range before, unless a line begins there
    if start:
        at -= 1
    while at < size:
        block = file.read_at(min(limit, end - at) if at < end else TAIL_BYTES, at)
        if not block:
            break
        if not inside:
            cut = block.find(b"\n")
            if cut < 0:
                at += len(block)
                if at >= end:
                    return
                continue
            if at + cut + 1 >= end:
                return
            block, at, inside = block[cut + 1 :], at + cut + 1, True
        at += len(block)
        rest += block
        if at >= end:  # the last line of the range ends at the first break at or after its last byte
            last = len(rest) - (at - end) - 1
            stop = rest.find(b"\n", max(last, 0))
            if stop >= 0 or at >= size:
                if kept := rest[: stop + 1] if stop >= 0 else rest:
                    yield kept
                return
            continue
        cut = rest.rfind(b"\n")
        if cut >= 0:
            yield rest[: cut + 1]
            rest = rest[cut + 1 :]
    if rest:
        yield rest


def kind_of(piece: bytes) -> int:
    if piece.isascii():
        return ASCII
    try:
        piece.decode()
    except UnicodeDecodeError:
        return OTHER
    return UTF8


def parsed(piece: bytes, names: list[str]) -> Iterator[pa.Table]:
    """The rows of a piece as string columns."""
    from pyarrow import csv as arrow_csv

    odd: list[str] = []

    def keep(row) -> str:
        odd.append(row.text)
        return "skip"

    try:
        yield arrow_csv.read_csv(
            pa.BufferReader(piece), arrow_csv.ReadOptions(column_names=names, encoding="latin-1", block_size=max(len(piece), 1)),
            arrow_csv.ParseOptions(invalid_row_handler=keep),
            arrow_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False))
    except pa.ArrowInvalid:  # nothing but blank lines
        if piece.strip(b"\r\n"):
            raise
    if odd:
        rows = [(r + [""] * len(names))[: len(names)] for r in csv.reader(io.StringIO("\n".join(odd))) if r]
        yield pa.table([pa.array([r[i] or None for r in rows], pa.string()) for i in range(len(names))], names)


class Range(InputPartition):
    def __init__(self, number: int, uri: str, size: int, start: int, end: int, names: list[str], header: bool) -> None:
        self.number, self.uri, self.size, self.start, self.end, self.names, self.header = number, uri, size, start, end, names, header


class RawCsvReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.columns = schema.names[2:]
        self.files = json.loads(options["files"])
        self.names = json.loads(options["names"])
        self.header = options["header"] == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        return [
            Range(number, uri, size, start, min(start + self.split, size), self.names[kind], self.header)
            for number, (uri, size, kind) in enumerate(self.files) for start in range(0, size, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        order = [FILE, KIND, *self.columns]
        with open_file(part.uri) as file:
            leading = part.start == 0
            for piece in pieces(file, part.start, part.end, part.size):
                if leading:
                    piece = piece.removeprefix(BOM)
                    if self.header:
                        piece = piece.split(b"\n", 1)[1] if b"\n" in piece else b""
                    leading = False
                if not piece:
                    continue
                kind = kind_of(piece)
                for rows in parsed(piece, part.names):
                    have = {name: rows.column(i) for i, name in enumerate(part.names)}
                    have[FILE], have[KIND] = pa.array([part.number] * rows.num_rows, pa.int32()), pa.array([kind] * rows.num_rows, pa.int32())
                    absent = pa.nulls(rows.num_rows, pa.string())
                    yield from pa.table([have.get(c, absent) for c in order], order).to_batches(max_chunksize=10_000)


class RawCsv(DataSource):
    """Options: files as [[URI, bytes, header number]], names as lists by header number, header, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> RawCsvReader:
        return RawCsvReader(schema, self.options)


def _first_lines(spark: SparkSession, files: list[tuple[str, int]]) -> list[bytes]:
    """The first line of each file, read in parallel tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("i"), pa.array([first_line(u) for u in batch.column("uri").to_pylist()], pa.binary())], ["i", "line"])

    rows = spark.createDataFrame([(i, uri) for i, (uri, _) in enumerate(files)], "i int, uri string").repartition(min(len(files), 64))
    return [bytes(r.line) for r in rows.mapInArrow(task, "i int, line binary").orderBy("i").collect()]


def read_raw(spark: SparkSession, pattern: str, typed: Callable[[str], str] | None = None, header: bool = True,
             names: Callable[[int], list[str]] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All files of ``pattern`` unioned by name, stored as Parquet in the shared folder.

    ``typed`` gives the type of a column by its name (string if left out; what does not parse is null).  Without ``header``, ``names`` gives
    the names for a number of fields.
    """
    files = listed(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no CSV file matches {pattern}")
    heads: list[list[str]] = []
    numbers = []
    for line in _first_lines(spark, files):
        found = fields(line)
        own = numbered(found) if header else (names(len(found)) if names else [f"_c{i}" for i in range(len(found))])
        if own not in heads:
            heads.append(own)
        numbers.append(heads.index(own))
    columns = list(dict.fromkeys(c for head in heads for c in head))
    spark.dataSource.register(RawCsv)
    schema = T.StructType([T.StructField(FILE, T.IntegerType()), T.StructField(KIND, T.IntegerType()), *[T.StructField(c, T.StringType()) for c in columns]])
    listing = [(uri, size, kind) for (uri, size), kind in zip(files, numbers, strict=True)]
    rows = (
        spark.read.format(FORMAT).schema(schema).option("files", json.dumps(listing)).option("names", json.dumps(heads))
        .option("header", str(header).lower()).option("splitBytes", str(split_bytes)).load())
    kinds = {c: typed(c) if typed else "string" for c in columns}

    def own(c: str) -> Column:
        return F.col("`" + c.replace("`", "``") + "`")

    stored = written(rows.select(FILE, KIND, *[own(c) if kinds[c] == "string" else own(c).try_cast(kinds[c]).alias(c) for c in columns]))
    other = [r[FILE] for r in stored.where(F.col(KIND) == OTHER).select(FILE).distinct().collect()]  # file numbers
    decoded = (F.col(KIND) == UTF8) & ~F.col(FILE).isin(other) if other else F.col(KIND) == UTF8
    return stored.select(*[
        own(c) if kinds[c] != "string" else F.when(decoded, F.decode(F.encode(own(c), "ISO-8859-1"), "UTF-8")).otherwise(own(c)).alias(c)
        for c in columns])
