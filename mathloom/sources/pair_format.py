"""Pair files as a format of Spark's: `spark.dataSource.register(Pairs)`, then `spark.read.format("pairs")`, `readStream` and `write`.

A file of problem and answer lines is read in ranges of bytes; a line belongs to the range that it begins in, so ranges need no look at one
another. Rows carry their file and the byte that they begin at, which order them as in the files. Paths are those of pyarrow's file
systems (a local path or a URI).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "problem string, answer string, file string, start long"
_ARROW = pa.schema([("problem", pa.string()), ("answer", pa.string()), ("file", pa.string()), ("start", pa.int64())])
#: Bytes of a range, of a read within it, and lines of a batch.
RANGE_BYTES, READ_BYTES, BATCH_LINES = 64 << 20, 1 << 20, 8192
#: Short ranges are lengthened, up to RANGE_BYTES, until there are about so many: each is a task.
MOST_RANGES = 512


def _system(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"file:/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in the order of their names; hidden ones are left out."""
    system, where = _system(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Bytes start to end - 1 of a file."""

    file: str
    start: int
    end: int


def _ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    size = max(size, min(RANGE_BYTES, -(-sum(n for _, n in files) // MOST_RANGES)))
    return [Range(name, a, min(a + size, n)) for name, n in files for a in range(0, n, size)]


def _lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range."""
    # from the byte before: a line begins behind a line break
    at = max(start - 1, 0)
    stream.seek(at)
    held, skip = b"", start > 0
    while at < end:
        more = stream.read(min(READ_BYTES, max(end - at - len(held), 4096)))
        held += more
        *whole, rest = held.split(b"\n")
        if not more and rest:
            whole, rest = [*whole, rest], b""
        for line in whole:
            if not skip and at < end:
                yield at, line
            skip, at = False, at + len(line) + 1
            if at >= end:
                return
        held = rest
        if not more:
            return


def _rows(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _system(path)
    rows = []
    with system.open_input_file(part.file) as stream:
        for at, line in _lines(stream, part.start, part.end):
            text = line.decode("utf-8", "replace").strip()
            if "#" in text:
                problem, _, answer = text.partition("#")
                rows.append((problem.strip(), answer.strip(), part.file, at))
            if len(rows) == BATCH_LINES:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class PairReader(DataSourceReader):
    """Ranges of all files. Conditions aren't pushed down: a table's plans share what one of them has pushed, so that a second one would lose
    rows; to read some files, give them as the path."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


class PairStreamReader(DataSourceStreamReader):
    """New files of a folder. A writer's names must rise: the offset is the last name that has been read."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([x for x in _files(self.path) if start["after"] < x[0] <= end["after"]], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the staging folder."""

    name: str
    rows: int


class PairWriter(DataSourceWriter):
    """Tasks write to a hidden folder; on commit their files are moved, so readers meet all of a job's rows or, before, none of a file.
    Names rise with the time of the job and the number of the partition."""

    def __init__(self, path: str, overwrite: bool):
        from .sinks import append_number

        self.path, self.overwrite, self.job = path, overwrite, f"{append_number():020d}"
        self.staging = f".staging-{self.job}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, where = _system(self.path)
        context, rows = TaskContext.get(), 0
        name = f"part-{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}.txt"
        system.create_dir(f"{where}/{self.staging}")
        with system.open_output_stream(f"{where}/{self.staging}/{name}") as out:
            for row in iterator:
                line = f"{row['problem']} # {row['answer']}"
                if "\n" in line or "#" in row["problem"]:
                    raise ValueError("a line break, or # in a problem, can't be written as a pair")
                out.write(line.encode() + b"\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _system(self.path)
        old = [name for name, _ in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{where}/{self.staging}/{m.name}", f"{where}/{m.name}")
        for name in old:
            system.delete_file(name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, where = _system(self.path)
        if system.get_file_info(f"{where}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{where}/{self.staging}")


class Pairs(DataSource):
    """Options: path, and range_bytes for reads, the least bytes of a range of many (MOST_RANGES)."""

    @classmethod
    def name(cls) -> str:
        return "pairs"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the format pairs needs a path")
        return unquote(self.options["path"]) if "%" in self.options["path"] else self.options["path"]

    def _size(self) -> int:
        return int(self.options.get("range_bytes", RANGE_BYTES))

    def reader(self, schema: StructType) -> PairReader:
        return PairReader(self._path(), self._size())

    def streamReader(self, schema: StructType) -> PairStreamReader:
        return PairStreamReader(self._path(), self._size())

    def writer(self, schema: StructType, overwrite: bool) -> PairWriter:
        if not {"problem", "answer"} <= set(schema.names):
            raise ValueError("problem and answer are needed")
        return PairWriter(self._path(), overwrite)
