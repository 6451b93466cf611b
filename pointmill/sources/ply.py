"""PLY files as a Spark data source: ``spark.read.format("ply")`` and ``points.write.format("ply")``.

Binary files are read in ranges of rows, a task each, so a file of any size is read in parallel; an ascii file is streamed by one task. Only headers are read when
the job is planned, and they say how many vertices each file has, so ids run on from file to file in the order of paths. Writing puts binary files of at most
``file_rows`` vertices, of which a task holds one at a time; they get their names when the job commits, so attempts that failed or ran twice leave nothing behind.

Paths are those of ``pyarrow.fs`` (a local path or a URI), a file, a folder, or one with wildcards in its last part.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CLOUD = "id long, x double, y double, z double"
#: The names of the format's number types.
KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
HEADER_LIMIT = 1 << 20
BATCH = 1 << 17


@dataclass(frozen=True)
class Header:
    """``order``: of bytes, empty for ascii; ``begin``: where the vertices begin; ``fields``: names and types of a vertex."""

    order: str
    begin: int
    count: int
    fields: tuple[tuple[str, str], ...]

    @property
    def row(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + t) for n, t in self.fields])


def parse_header(start: bytes) -> Header:
    """The header at the start of a file. Elements may follow the vertices but not come before them; the vertices have no lists."""
    end = start.find(b"end_header")
    if not start.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    begin = start.index(b"\n", end) + 1
    order, count, fields, element, before = None, 0, [], None, 0
    for line in start[:end].decode("ascii").splitlines():
        match line.split():
            case ["format", kind, *_]:
                if kind not in ORDERS:
                    raise ValueError(f"unsupported format: {kind}")
                order = ORDERS[kind]
            case ["element", "vertex", n]:
                if before:
                    raise ValueError("elements before the vertices are not supported")
                element, count = "vertex", int(n)
            case ["element", element, n]:
                before += int(n) if not fields else 0
            case ["property", "list", *_] if element == "vertex":
                raise ValueError("vertices with lists are not supported")
            case ["property", kind, name] if element == "vertex":
                fields.append((name, KINDS[kind]))
    if order is None or not {"x", "y", "z"} <= {n for n, _ in fields}:
        raise ValueError("the header lacks a format or the coordinates of vertices")
    return Header(order, begin, count, tuple(fields))


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def files_of(path: str) -> list[str]:
    """The PLY files that a path names, in order."""
    fs, at = file_system(path)
    parent, _, last = at.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(parent)) if f.is_file and fnmatch.fnmatchcase(f.base_name, last)]
    elif (info := fs.get_file_info(at)).type == pyarrow.fs.FileType.Directory:
        found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._" and f.extension.lower() == "ply"]
    elif info.is_file:
        found = [at]
    else:
        found = []
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


@dataclass
class Range(InputPartition):
    """Vertices ``first`` to ``first + rows`` of a file; ``id`` is that of the first."""

    file: str
    header: Header
    first: int
    rows: int
    id: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Range]:
        fs, _ = file_system(self.path)
        out, at = [], 0
        for file in files_of(self.path):
            with fs.open_input_file(file) as f:
                header = parse_header(f.read(HEADER_LIMIT))
            step = max(1, self.part_bytes // header.row.itemsize) if header.order else max(1, header.count)
            out += [Range(file, header, first, min(step, header.count - first), at + first) for first in range(0, header.count, step)]
            at += header.count
        return out or [Range("", Header("", 0, 0, ()), 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        fs, _ = file_system(self.path)
        parts = (_binary if partition.header.order else _ascii)(fs, partition)
        at = partition.id
        for cols in parts:
            n = len(cols[0])
            # Coordinates are single precision, whatever the file's type is.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(c.astype("f4").astype("f8")) for c in cols)], names=["id", "x", "y", "z"])
            at += n


def _binary(fs: pyarrow.fs.FileSystem, part: Range) -> Iterator[list[np.ndarray]]:
    row = part.header.row
    with fs.open_input_file(part.file) as f:
        f.seek(part.header.begin + part.first * row.itemsize)
        for done in range(0, part.rows, BATCH):
            want = min(BATCH, part.rows - done)
            rows = f.read(want * row.itemsize)
            if len(rows) < want * row.itemsize:
                raise ValueError(f"{part.file} ends before its last vertex")
            rows = np.frombuffer(rows, dtype=row)
            yield [rows[a] for a in "xyz"]


def _ascii(fs: pyarrow.fs.FileSystem, part: Range) -> Iterator[list[np.ndarray]]:
    """Numbers in the order of the file, wherever its lines break."""
    width, left, rest = len(part.header.fields), part.rows, b""
    places = [[n for n, _ in part.header.fields].index(a) for a in "xyz"]
    with fs.open_input_stream(part.file) as f:
        f.read(part.header.begin)
        while left:
            some = f.read(BATCH * 16)
            text = rest + some
            # A number may be cut at the end of what was read.
            cut = len(text) if not some else max(text.rfind(b"\n"), text.rfind(b" ")) + 1
            numbers = text[:cut].split()
            whole = min(left, len(numbers) // width)
            if not some and whole < left:
                raise ValueError(f"{part.file} ends before its last vertex")
            rest = b" ".join(numbers[whole * width :]) + (b" " if numbers[whole * width :] else b"") + text[cut:]
            if whole:
                rows = np.array(numbers[: whole * width], dtype="f8").reshape(whole, width)
                yield [rows[:, p] for p in places]
            left -= whole


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_rows: int, overwrite: bool):
        self.path, self.file_rows, self.overwrite, self.job = path, file_rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        task, files, held, n = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            nonlocal held, n
            name = f"part-{task:05d}-{len(files):05d}-{self.job[:8]}.ply"
            files.append((f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{name}"))
            with fs.open_output_stream(files[-1][0]) as f:
                f.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n".encode())
                for rows in held:
                    f.write(rows.tobytes())
            held, n = [], 0

        for batch in iterator:
            rows = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"]).astype("<f4")
            while len(rows):
                take = rows[: self.file_rows - n]
                held.append(take)
                n, rows = n + len(take), rows[len(take) :]
                if n == self.file_rows:
                    flush()
        if n:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
                if f.is_file and f.extension == "ply":
                    fs.delete_file(f.path)
        for message in messages:
            for hidden, name in message.files if message else ():
                fs.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for message in messages:
            for hidden, _ in message.files if message else ():
                fs.delete_file(hidden)


class PlySource(DataSource):
    """Options: ``path``; ``part_bytes`` of a task that reads; ``file_rows`` of a file written."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("part_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], int(self.options.get("file_rows", 1 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``ply`` known to a session; again does no harm."""
    spark.dataSource.register(PlySource)
