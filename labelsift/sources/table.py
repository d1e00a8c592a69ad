"""A Python data source, ``vectorfile``, that writes and reads vector files of several kinds.

fvecs, ivecs and bvecs: rows of a 32-bit dimension and the components. u8bin: rows and dimension as 32-bit numbers, then a
byte matrix. npy: a two-dimensional float array in C order. spmat: a compressed sparse row matrix (rows, columns and entries
as 64-bit numbers, then indptr, indices, data), one array of column numbers a row. pkl: a pickled list of such lists, read by
an unpickler that knows plain containers only.

Records have a fixed length (spmat: a known one), so files are read by ranges of rows, ``range_bytes`` at a time; only pkl
files are read whole. A write task stages files of at most ``FILE_ROWS`` rows under ``_staged`` of the target folder and the
driver moves them into place on commit, so a repeated task or a lost executor leaves no half-written part. The path is a
file or a folder that Arrow's file systems read.
"""

from __future__ import annotations

import io
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import KINDS, encode_vectors

#: Types of the components: of the file, and of the rows.
TYPES = {**KINDS, "u8bin": ("u1", "int"), "npy": ("<f4", "float"), "spmat": ("<i4", "int"), "pkl": ("<f8", "double")}
FILE_ROWS = 65_536
_ARROW = {"float": pa.float32(), "int": pa.int32(), "double": pa.float64()}


def _fs(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Plain(pickle.Unpickler):
    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is no plain container")


@dataclass
class Written(WriterCommitMessage):
    names: list


@dataclass
class Part(InputPartition):
    """``rows`` rows from row ``first`` on, at byte ``at``, of records of ``record`` bytes with ``head`` bytes before the components."""

    path: str
    first: int = 0
    rows: int = 0
    at: int = 0
    record: int = 0
    head: int = 0


class VectorFile(DataSource):
    """Options: path, kind, and range_bytes. Rows are (file, vec_id, embedding), numbered from 0 in each file."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return f"file string, vec_id long, embedding array<{TYPES[self.options.get('kind', 'fvecs')][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind", "fvecs"), int(self.options.get("range_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("kind", "fvecs"), [f.name for f in schema].index("embedding"), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int):
        self.path, self.kind, self.range_bytes = path, kind, range_bytes

    def _layout(self, f, size: int) -> tuple[int, int, int, int]:
        """(rows, byte of the first record, bytes of a record, bytes of a record before its components)"""
        item = np.dtype(TYPES[self.kind][0]).itemsize
        if self.kind == "pkl" or not size:
            return (1 if size else 0), 0, size, 0
        if self.kind == "u8bin":
            n, d = (int(x) for x in np.frombuffer(f.read(8), "<u4"))
            at, record, head = 8, d, 0
        elif self.kind == "spmat":
            n = int(np.frombuffer(f.read(24), "<i8")[0])
            return n, 24, 8, 0  # records are places in indptr
        elif self.kind == "npy":
            start = io.BytesIO(f.read(min(size, 1 << 16)))
            version = np.lib.format.read_magic(start)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(start) if version == (1, 0) else np.lib.format.read_array_header_2_0(start)
            if fortran or len(shape) != 2 or dtype != np.dtype("<f4"):
                raise ValueError("only two-dimensional 32-bit float arrays in C order are read")
            (n, d), at, head = shape, start.tell(), 0
            record = d * item
        else:
            d = int(np.frombuffer(f.read(4), "<i4")[0])
            at, head, record = 0, 4, 4 + d * item
            n = size // record if d >= 0 else -1
        if n < 0 or at + n * record != size:
            raise ValueError("the file's length doesn't fit its dimension")
        return n, at, record, head

    def partitions(self):
        system, at = _fs(self.path)
        info = system.get_file_info(at)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "_."]
        out = []
        for info in sorted(files, key=lambda f: f.path):
            with system.open_input_file(info.path) as f:
                n, start, record, head = self._layout(f, info.size)
            step = max(1, self.range_bytes // max(1, record))
            out += [Part(info.path, k, min(step, n - k), start + k * record, record, head) for k in range(0, n, step)]
        return out or [Part("")]

    def read(self, p):
        if not p.path:
            return
        system, _ = _fs(self.path)
        dtype, sql = TYPES[self.kind]
        with system.open_input_file(p.path) as f:
            if self.kind == "pkl":
                rows = _Plain(io.BytesIO(f.read())).load()
                for k in range(0, len(rows), 4096):
                    yield self._batch(p, k, pa.array(rows[k : k + 4096], pa.list_(_ARROW[sql])))
                return
            if self.kind == "spmat":
                n = int(np.frombuffer(f.read(24), "<i8")[0])
                f.seek(p.at)
                ends = np.frombuffer(f.read(8 * (p.rows + 1)), "<i8")
                f.seek(24 + 8 * (n + 1) + 4 * int(ends[0]))
                columns = np.frombuffer(f.read(4 * int(ends[-1] - ends[0])), "<i4")
                yield self._batch(p, 0, pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(columns)))
                return
            f.seek(p.at)
            for k in range(0, p.rows, 4096):
                rows = min(4096, p.rows - k)
                raw = np.frombuffer(f.read(rows * p.record), "u1").reshape(rows, p.record)
                if p.head and (raw[:, :4].view("<i4") != (p.record - 4) // np.dtype(dtype).itemsize).any():
                    raise ValueError("rows differ in their dimension")
                x = np.ascontiguousarray(raw[:, p.head :]).view(dtype)
                ends = np.arange(rows + 1, dtype=np.int32) * x.shape[1]
                yield self._batch(p, k, pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()).cast(_ARROW[sql])))

    def _batch(self, p, k: int, values: pa.Array) -> pa.RecordBatch:
        ids = np.arange(p.first + k, p.first + k + len(values))
        return pa.RecordBatch.from_arrays([pa.array([p.path] * len(values), pa.string()), pa.array(ids), values], ["file", "vec_id", "embedding"])


def _encoded(rows: list, kind: str) -> bytes:
    if kind in KINDS:
        return encode_vectors(rows, kind)
    if kind == "pkl":
        return pickle.dumps([list(r) for r in rows], 4)
    if kind == "spmat":
        ends = np.cumsum([0, *map(len, rows)]).astype("<i8")
        columns = np.array([x for r in rows for x in sorted(r)], "<i4")
        head = np.array([len(rows), int(columns.max()) + 1 if len(columns) else 0, len(columns)], "<i8")
        return head.tobytes() + ends.tobytes() + columns.tobytes() + np.ones(len(columns), "<f4").tobytes()
    x = np.array(rows, TYPES[kind][0])
    if kind == "u8bin":
        return np.array(x.shape, "<u4").tobytes() + x.tobytes()
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, column: int, overwrite: bool):
        self.path, self.kind, self.column, self.overwrite = path, kind, column, overwrite

    def write(self, iterator):
        system, at = _fs(self.path)
        names, rows = [], []
        system.create_dir(f"{at}/_staged", recursive=True)

        def flush():
            names.append(f"part-{uuid.uuid4().hex}.{self.kind}")
            with system.open_output_stream(f"{at}/_staged/{names[-1]}") as out:
                out.write(_encoded(rows, self.kind))
            rows.clear()

        for r in iterator:
            if r[self.column] is None:
                raise ValueError("a null vector has no place in a vector file")
            rows.append(r[self.column])
            if len(rows) == FILE_ROWS:
                flush()
        if rows:
            flush()
        return Written(names)

    def commit(self, messages):
        system, at = _fs(self.path)
        kept = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.is_file:
                    system.delete_file(f.path)
        for name in kept:
            system.move(f"{at}/_staged/{name}", f"{at}/{name}")
        system.delete_dir(f"{at}/_staged")

    def abort(self, messages):
        system, at = _fs(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{at}/_staged/{name}")


def register(spark) -> None:
    spark.dataSource.register(VectorFile)
