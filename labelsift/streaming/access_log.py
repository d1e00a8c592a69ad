"""Grants and revocations as an append-only log(vec_id, label, op, ts, seq), read in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_access(log: DataFrame) -> DataFrame:
    """(vec_id, label) granted now: the latest (ts, seq) of each pair decides. One aggregation, combined map-side."""
    last = log.groupBy("vec_id", "label").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))
    return last.where("op = 'grant'").select("vec_id", "label")


def compact(log: DataFrame) -> DataFrame:
    """The log cut to its latest entry of each pair."""
    return log.groupBy("vec_id", "label").agg(F.max(F.struct("ts", "seq", "op")).alias("m")).select("vec_id", "label", "m.op", "m.ts", "m.seq")


def last_slices(table: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the n newest slices, by number."""
    newest = table.agg(F.max(column)).first()[0]
    return table.where(F.col(column) > F.lit((newest if newest is not None else 0) - n))


def follow(log: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"):
    """A streaming query that keeps the latest state of each pair, as batches of changes under ``path``.

    Entries later than ``delay`` behind the newest are dropped by the watermark; repeated entries are dropped by their key.
    """

    def write(batch: DataFrame, number: int) -> None:
        compact(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same batch again replaces itself

    once = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["vec_id", "label", "seq"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def followed(spark, path: str) -> DataFrame:
    """The access table that ``follow`` has written so far."""
    return current_access(spark.read.parquet(path).select("vec_id", "label", "op", "ts", "seq"))
