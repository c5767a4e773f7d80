"""ARFF files as a data source: ``spark.dataSource.register(ArffSource)``, then ``format("arff")``.

A table is a folder of part files, each with the whole header, so every part is an ARFF file by itself.
Numbers are ``NUMERIC`` and read as doubles; texts are ``STRING``, quoted; nominal attributes read as
texts; a missing value is ``?``. Parts are read in ranges of bytes; a row is one line.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+)", re.IGNORECASE)
VALUE = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]*)(?:,|$)")
#: The escapes inside quotes.
ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
PLAIN = {"n": "\n", "r": "\r", "t": "\t"}
BLOCK = 64 << 20


def quoted(text: str) -> str:
    return "'" + re.sub(r"[\\'\n\r\t]", lambda m: ESCAPES[m[0]], text) + "'"


def unquoted(text: str) -> str:
    text = text.strip()
    if text[:1] not in ("'", '"') or len(text) < 2:
        return text
    return re.sub(r"\\(.)", lambda m: PLAIN.get(m[1], m[1]), text[1:-1])


def values(line: str) -> list[str | None]:
    """The values of a data line; None where it has a bare question mark."""
    found, at = [], 0
    while True:
        match = VALUE.match(line, at)
        if match is None:
            raise ValueError(f"no ARFF values at {at}: {line[:80]!r}")
        found.append(None if match[1].strip() == "?" else unquoted(match[1]))
        if match.end() == len(line) and not line[match.start() :].endswith(","):
            return found
        if match.end() == len(line):
            return [*found, ""]
        at = match.end()


def header_schema(lines: Iterator[str]) -> T.StructType:
    schema = T.StructType()
    for line in lines:
        match = ATTRIBUTE.match(line.strip())
        if match:
            number = match[2].strip().lower() in ("numeric", "real", "integer")
            schema.add(unquoted(match[1]), T.DoubleType() if number else T.StringType())
        elif line.strip().lower() == "@data":
            return schema
    raise ValueError("an ARFF header without @DATA")


def part_files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file itself, or the ARFF files in the folder by name."""
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return system, [info]
    inside = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return system, sorted((f for f in inside if f.type == fs.FileType.File and f.path.endswith(".arff")), key=lambda f: f.path)


def lines_from(system: fs.FileSystem, path: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """The lines that begin in a range of bytes."""
    with io.BufferedReader(system.open_input_file(path), 1 << 20) as file:
        at = max(start - 1, 0)
        file.seek(at)
        if start:
            at += len(file.readline())
        while end is None or at < end:
            line = file.readline()
            if not line:
                return
            at += len(line)
            yield line.decode().rstrip("\r\n")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ArffReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, block: int) -> None:
        self.path, self.schema, self.block = path, schema, block

    def partitions(self) -> list[Range]:
        _, files = part_files(self.path)
        return [Range(f.path, at, min(at + self.block, f.size)) for f in files for at in range(0, f.size, self.block)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        numeric = [isinstance(f.dataType, T.DoubleType) for f in self.schema]
        for line in lines_from(system, partition.path, partition.start, partition.end):
            # Header lines, which any range may meet, begin with a sign that no written value has.
            if not line.strip() or line[0] in "@%":
                continue
            row = values(line)
            if len(row) != len(numeric):
                raise ValueError(f"{len(row)} values for {len(numeric)} attributes: {line[:80]!r}")
            yield tuple(float(v) if n and v is not None else v for v, n in zip(row, numeric))


@dataclass
class Written(WriterCommitMessage):
    path: str


class ArffWriter(DataSourceArrowWriter):
    """Parts are written aside; the commit moves those of the tasks that counted into the folder."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.aside = f"_writing-{uuid.uuid4().hex}"
        kinds = [("NUMERIC" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "STRING") for f in schema]
        attributes = [f"@ATTRIBUTE {quoted(f.name)} {kind}\n" for f, kind in zip(schema, kinds)]
        self.header = "".join(["@RELATION 'table'\n\n", *attributes, "\n@DATA\n"])
        self.numeric = [kind == "NUMERIC" for kind in kinds]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{inner}/{self.aside}")
        name = f"{inner}/{self.aside}/part-{uuid.uuid4().hex}.arff"
        with system.open_output_stream(name) as out:
            out.write(self.header.encode())
            for batch in iterator:
                columns = [
                    ["?" if v is None else repr(float(v)) if n else quoted(str(v)) for v in column.to_pylist()]
                    for column, n in zip(batch.columns, self.numeric)
                ]
                out.write("".join(",".join(row) + "\n" for row in zip(*columns)).encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = fs.FileSystem.from_uri(self.path)
        before = part_files(self.path)[1] if self.overwrite else []
        for message in messages:
            if message is not None:
                system.move(message.path, f"{inner}/{message.path.rsplit('/', 1)[1]}")
        for old in before:
            system.delete_file(old.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{inner}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.aside}")


class ArffSource(DataSource):
    """Options: ``path``, and ``block``, the bytes of one read task."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> T.StructType:
        system, files = part_files(self.options["path"])
        if not files:
            raise ValueError(f"no ARFF files in {self.options['path']}")
        return header_schema(lines_from(system, files[0].path))

    def reader(self, schema: T.StructType) -> ArffReader:
        return ArffReader(self.options["path"], schema, int(self.options.get("block", BLOCK)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArffWriter:
        return ArffWriter(self.options["path"], schema, overwrite)
