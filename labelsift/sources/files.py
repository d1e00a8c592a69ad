"""Vector files: rows of (dimension, components) in fvecs, ivecs and bvecs, headed u8bin matrices, sparse access matrices.

A file is read through Spark's binaryFile source, so any path that Spark reads will do; rows are numbered from 0 in each
file. Memory is that of a file at a time, for paths that only Spark reads; the ``vectorfile`` source (``table``) reads large
files by ranges of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "int")}


def _rows(content: bytes, dtype: str) -> np.ndarray:
    if not content:
        return np.empty((0, 0), dtype)
    d = int(np.frombuffer(content, "<i4", 1)[0])
    row = np.dtype([("d", "<i4"), ("x", dtype, (d,))])
    if d < 0 or len(content) % row.itemsize:
        raise ValueError("the file's length doesn't fit its dimension")
    got = np.frombuffer(content, row)
    if (got["d"] != d).any():
        raise ValueError("rows differ in their dimension")
    return got["x"]


def read_vectors(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(file, vec_id, embedding)"""
    dtype, sql = KINDS[kind]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _rows(content, dtype)
                for k in range(0, len(x), 4096):
                    part = x[k : k + 4096]
                    arr = [r.tolist() for r in part]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(k, k + len(part)), pa.int64()), pa.array(arr, pa.list_(pa.float32() if sql == "float" else pa.int32()))], ["file", "vec_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, vec_id long, embedding array<{sql}>")


def read_u8bin(spark: SparkSession, path: str, dtype: str = "u1") -> DataFrame:
    """Two unsigned 32-bit numbers, rows and dimension, then the matrix."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, d = (int(v) for v in np.frombuffer(content, "<u4", 2))
                x = np.frombuffer(content, dtype, n * d, 8).reshape(n, d)
                for k in range(0, n, 4096):
                    part = x[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(k, k + len(part)), pa.int64()), pa.array([r.tolist() for r in part], pa.list_(pa.float32()))], ["file", "vec_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, vec_id long, embedding array<float>")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, label, weight) of a compressed sparse row matrix: rows, columns, entries as 64-bit, then indptr, indices, data."""

    def run(batches):
        for b in batches:
            for content in b.column(1).to_pylist():
                rows, _, n = (int(v) for v in np.frombuffer(content, "<i8", 3))
                ptr = np.frombuffer(content, "<i8", rows + 1, 24)
                at = 24 + 8 * (rows + 1)
                cols, data = np.frombuffer(content, "<i4", n, at), np.frombuffer(content, "<f4", n, at + 4 * n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows), np.diff(ptr))), pa.array(cols), pa.array(data)], ["vec_id", "label", "weight"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "vec_id long, label int, weight float")


def encode_vectors(rows: list[list[float]], kind: str = "fvecs") -> bytes:
    """The bytes of a file of such rows."""
    x = np.array(rows, KINDS[kind][0])
    out = np.empty(len(x), np.dtype([("d", "<i4"), ("x", x.dtype, (x.shape[1] if len(x) else 0,))]))
    out["d"], out["x"] = x.shape[1] if len(x) else 0, x
    return out.tobytes()


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """An index is its tables; the folder must be new."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
