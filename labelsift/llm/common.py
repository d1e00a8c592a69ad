"""Session plumbing that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Arrow batches are cut by bytes as well as rows, so very long texts don't pile up in a Python worker.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="labelsift-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The shuffle files of the write go when it has ended; the table goes by ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and that nothing reads any more."""
    for t in tables:
        files, folder = _folder(t.sparkSession, t._written)
        files.delete(folder, True)


def folded(text: Column) -> Column:
    """Text with null as empty and A-Z, and nothing else, in lower case."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(large: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on ``key`` with a side that holds each key once: rows of a hot key in ``large`` are dealt out by ``by``."""
    salt = unused(large, "_salt")
    left = large.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return left.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt], how).drop(salt)


def smallest(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """At most ``n`` rows, those of the smallest hashes of ``key``, one of each hash. Only hashes are sorted, so no task holds rows."""
    h = unused(rows, "_h")
    hashed = rows.withColumn(h, F.xxhash64(*key))
    chosen = hashed.select(h).orderBy(h).limit(n).distinct()
    return hashed.join(F.broadcast(chosen), h, "left_semi").dropDuplicates([h]).orderBy(h).drop(h)
