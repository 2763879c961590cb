"""Array files (.npy, .npz) as a Spark source and sink, read by ranges of rows.

``spark.read.format("arrays").load(path)`` after ``register(spark)``: path is a file, or a folder of such files in the order of their names.  The
arrays of an .npz file are columns of one table and must have equally many rows; an .npy file has the one column ``array``.  Headers
are read once, on the driver; a task reads its own bytes of every column and nothing else.  ``part_bytes`` sets the bytes of a task,
``columns`` (comma-separated) the arrays to read.  Arrays of one dimension become scalars, of more dimensions nested arrays; numbers keep
their width (16-bit floats become floats, unsigned 64-bit numbers don't exist in Spark and are an error), texts of fixed width become strings.

Members of an .npz file that are compressed can't be read from the middle: one task reads such a file.  ``row`` counts the rows of all
files from 0.

``df.write.format("arrays").mode("append").save(path)`` writes each task's rows as .npz files of at most ``file_rows`` rows, all columns but
``row`` (nulls and lists of unequal lengths are errors).  A list of the files is written when all tasks are done, and where there is one,
only files on it are read: what lost or repeated tasks left behind isn't.
"""

from __future__ import annotations

import ast
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type

PART_BYTES = 16_000_000
FILE_ROWS = 100_000
LIST = "_files.json"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Member:
    """One array of a file: where its numbers begin (None: compressed), and their type and shape."""

    name: str
    start: int | None
    dtype: np.dtype
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _header(raw: io.RawIOBase, name: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, length of the header) of the array that begins here."""
    magic = raw.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError(f"{name} is not an array file")
    size = struct.unpack("<H", raw.read(2))[0] if magic[6] == 1 else struct.unpack("<I", raw.read(4))[0]
    about = ast.literal_eval(raw.read(size).decode("latin1" if magic[6] < 3 else "utf-8"))
    dtype = np.dtype(about["descr"])
    if about["fortran_order"] and len(about["shape"]) > 1:
        raise ValueError(f"{name} is stored by columns")
    if dtype.hasobject or not about["shape"]:
        raise ValueError(f"{name} has no rows of plain values")
    return dtype, tuple(about["shape"]), size + (10 if magic[6] == 1 else 12)


def members(path: str) -> list[Member]:
    """The arrays of a file, from its headers alone."""
    where, name = _open(path)
    with where.open_input_file(name) as file:
        if not name.endswith(".npz"):
            dtype, shape, start = _header(file, path)
            return [Member("array", start, dtype, shape)]
        out = []
        with zipfile.ZipFile(file) as held:
            for info in held.infolist():
                with held.open(info) as inner:
                    dtype, shape, size = _header(inner, f"{path}:{info.filename}")
                start = None
                if info.compress_type == zipfile.ZIP_STORED:  # the local header's own lengths say where the content begins
                    file.seek(info.header_offset + 26)
                    start = info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4))) + size
                out.append(Member(info.filename.removesuffix(".npy"), start, dtype, shape))
        return out


def _arrow(values: np.ndarray) -> pa.Array:
    """An array as an Arrow column: scalars, or lists of lists."""
    if values.ndim > 1:
        inner = _arrow(values.reshape(len(values) * values.shape[1], *values.shape[2:]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32()), inner)
    if values.dtype.kind == "f" and values.dtype.itemsize == 2:
        values = values.astype(np.float32)
    if values.dtype.kind == "u":
        if values.dtype.itemsize == 8:
            raise ValueError("unsigned 64-bit numbers have no type in Spark")
        values = values.astype(f"i{2 * values.dtype.itemsize}")
    if values.dtype.kind == "S":
        values = np.char.decode(values, "utf-8")
    return pa.array(values.tolist(), pa.string()) if values.dtype.kind == "U" else pa.array(values.astype(values.dtype.newbyteorder("=")))


@dataclass
class Rows(InputPartition):
    """Rows [first, end) of one file, which are numbered from ``number`` on."""

    path: str
    first: int
    end: int
    number: int
    members: list


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _files(self) -> list[str]:
        path = self.options["path"]
        where, name = _open(path)
        if where.get_file_info(name).type != fs.FileType.Directory:
            return [path]
        found = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(name)) if f.base_name.endswith((".npy", ".npz")))
        if where.get_file_info(f"{name}/{LIST}").is_file:
            with where.open_input_stream(f"{name}/{LIST}") as listed:
                found = json.loads(listed.read())
        return [f"{path.rstrip('/')}/{f}" for f in found]

    def _wanted(self, path: str) -> list[Member]:
        held = members(path)
        if "columns" in self.options:
            by_name = {m.name: m for m in held}
            held = [by_name[c.strip()] for c in self.options["columns"].split(",")]
        if len({m.shape[0] for m in held}) > 1:
            raise ValueError(f"the arrays of {path} have unequal numbers of rows: {({m.name: m.shape[0] for m in held})}")
        return held

    def schema(self) -> T.StructType:
        files = self._files()
        if not files:
            raise ValueError(f"no array files in {self.options['path']}")
        columns = [(m.name, from_arrow_type(_arrow(np.zeros((0, *m.shape[1:]), m.dtype)).type)) for m in self._wanted(files[0])]
        return T.StructType([T.StructField("row", T.LongType()), *(T.StructField(n, k) for n, k in columns)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("file_rows", FILE_ROWS)), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, source: ArrayFiles, schema: T.StructType):
        self.source, self.names = source, [f.name for f in schema]

    def partitions(self) -> list[Rows]:
        out, number = [], 0
        most = int(self.source.options.get("part_bytes", PART_BYTES))
        for path in self.source._files():
            held = self.source._wanted(path)
            n = held[0].shape[0] if held else 0
            step = max(1, most // max(1, sum(m.row_bytes for m in held)))
            if any(m.start is None for m in held):
                step = max(n, 1)
            out += [Rows(path, at, min(at + step, n), number + at, held) for at in range(0, n, step)]
            number += n
        return out or [Rows("", 0, 0, 0, [])]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, name = _open(part.path)
        columns = {"row": pa.array(np.arange(part.number, part.number + part.end - part.first))}
        with where.open_input_file(name) as file:
            for m in part.members:
                size = (part.end - part.first) * m.row_bytes
                if m.start is None:
                    with zipfile.ZipFile(file) as held:
                        raw = held.read(f"{m.name}.npy")
                    raw = raw[len(raw) - m.shape[0] * m.row_bytes :]
                else:
                    file.seek(m.start + part.first * m.row_bytes)
                    raw = file.read(size)
                if len(raw) < size:
                    raise ValueError(f"{part.path} ends before its array {m.name}")
                columns[m.name] = _arrow(np.frombuffer(raw, m.dtype, count=size // m.dtype.itemsize).reshape(part.end - part.first, *m.shape[1:]))
        yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    files: list


def _numpy(column: pa.Array, name: str) -> np.ndarray:
    """A column as an array; lists must be of one length."""
    if column.null_count:
        raise ValueError(f"{name} has nulls")
    if pa.types.is_list(column.type):
        inner = column.flatten()
        lengths = np.unique(np.asarray(pa.compute.list_value_length(column)))
        if len(lengths) > 1:
            raise ValueError(f"{name} has lists of unequal lengths")
        flat = _numpy(inner, name)
        return flat.reshape(len(column), int(lengths[0]) if len(lengths) else 0, *flat.shape[1:])
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_rows: int, overwrite: bool):
        self.path, self.file_rows, self.overwrite = path.rstrip("/"), file_rows, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        part, files, held, rows = TaskContext.get().partitionId(), [], [], 0
        where, name = _open(self.path)
        where.create_dir(name)

        def flush() -> None:
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            file = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.npz"
            packed = io.BytesIO()
            np.savez(packed, **{c: _numpy(table.column(c).chunk(0), c) for c in table.column_names if c != "row"})
            with where.open_output_stream(f"{name}/{file}") as out:
                out.write(packed.getbuffer())
            files.append(file)
            held, rows = [], 0

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, self.file_rows - rows))
                at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
                if rows == self.file_rows:
                    flush()
        if rows:
            flush()
        return _Written(part, files)

    def commit(self, messages: list) -> None:
        where, name = _open(self.path)
        where.create_dir(name)
        old = []
        if not self.overwrite and where.get_file_info(f"{name}/{LIST}").is_file:
            with where.open_input_stream(f"{name}/{LIST}") as listed:
                old = json.loads(listed.read())
        new = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        with where.open_output_stream(f"{name}/{LIST}") as out:
            out.write(json.dumps(old + new).encode())

    def abort(self, messages: list) -> None:
        where, name = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{name}/{f}")
