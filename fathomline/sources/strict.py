"""Strict JSON lines as a data source: spark.read.format("strict_jsonl").schema(...).load(path).

Files are read in ranges of bytes; a line belongs to the range that it starts in, so a large file is many tasks and nothing is read twice. Only fields of the
schema are taken out of a line. Two more columns may be in the schema: `_file`, and `_offset`, the place of the line in its file, which orders lines without
counting them. A line that strict JSON refuses, or a value of another type than its column's, fails the read with file:line; the number is counted then, not before.

Options: splitBytes (bytes of a range, 128 MB). Paths may be a file, a folder, or several by commas, in any store that Arrow opens (local, HDFS, S3, GCS); names that begin with
a dot or an underscore are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES, PIECE_BYTES, BATCH_ROWS = 128 << 20, 1 << 20, 2000


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def opened(path: str):
    """The store of a path, and the path as it knows it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(paths: str) -> list[tuple[str, int]]:
    """Files with their sizes, in the order of their names."""
    from pyarrow import fs

    out = []
    for path in paths.split(","):
        store, at = opened(path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        out += [(prefix + f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted(out)


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that start in a range of bytes: (place, line), without line ends. One piece and one line are held at a time."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        # A line starts where the byte before is a line end: the range looks at that byte, too.
        place = max(0, start - 1)
        f.seek(place)
        rest = b""
        skip = start > 0
        while True:
            piece = f.read(PIECE_BYTES)
            if not piece:
                if rest and not skip:
                    yield place, rest
                return
            parts = piece.split(b"\n")
            parts[0] = rest + parts[0]
            for line in parts[:-1]:
                if not skip:
                    yield place, line
                skip = False
                place += len(line) + 1
                if place >= end:
                    return
            rest = parts[-1]


def line_number(path: str, place: int) -> int:
    store, at = opened(path)
    n = 1
    with store.open_input_file(at) as f:
        while place > 0 and (piece := f.read(min(PIECE_BYTES, place))):
            n += piece.count(b"\n")
            place -= len(piece)
    return n


class StrictReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split_bytes: int):
        self.schema, self.path, self.split_bytes = schema, path, split_bytes

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(path, at, min(size, at + self.split_bytes)) for path, size in listed(self.path) for at in range(0, size, self.split_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from fathomline.sources.jsonl import strict_object

        kinds = to_arrow_schema(self.schema)

        def fail(place: int, why: str):
            raise ValueError(f"{partition.path}:{line_number(partition.path, place)}: {why}")

        def batch(rows: list[tuple[int, dict]]):
            columns = []
            for field in kinds:
                values = [{"_file": partition.path, "_offset": place}[field.name] if field.name in ("_file", "_offset") else row.get(field.name) for place, row in rows]
                try:
                    columns.append(pa.array(values, field.type))
                except (pa.ArrowException, TypeError, ValueError, OverflowError):
                    for (place, _), value in zip(rows, values, strict=True):
                        try:
                            pa.array([value], field.type)
                        except (pa.ArrowException, TypeError, ValueError, OverflowError):
                            fail(place, f"{field.name} is no {field.type}")
                    raise
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        rows: list[tuple[int, dict]] = []
        for place, line in lines_of(partition.path, partition.start, partition.end) if partition.path else ():
            if line.strip():
                try:
                    rows.append((place, strict_object(line.decode())))
                except RecursionError:
                    fail(place, "nested too deeply")
                except ValueError as e:
                    fail(place, str(e))
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class StrictJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strict_jsonl"

    def schema(self) -> StructType:
        raise ValueError("strict_jsonl needs a schema")

    def reader(self, schema: StructType) -> StrictReader:
        return StrictReader(schema, self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictJsonl)
