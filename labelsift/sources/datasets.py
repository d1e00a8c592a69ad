"""Datasets by name: what a loader returns is vectors(vec_id, embedding) and access(vec_id, label)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import draw, random_access
from .table import register

Loader = Callable[..., tuple[DataFrame, DataFrame]]
_LOADERS: dict[str, Loader] = {}


def dataset(pattern: str):
    """Registers a loader under a pattern of names; groups of the pattern go to it as keyword arguments."""

    def put(f: Loader) -> Loader:
        _LOADERS[pattern] = f
        return f

    return put


def load(spark: SparkSession, name: str, **options) -> tuple[DataFrame, DataFrame]:
    """The dataset of that name; an unknown name is an error that lists the known patterns."""
    for pattern, f in _LOADERS.items():
        if m := re.fullmatch(pattern, name):
            return f(spark, **m.groupdict(), **options)
    raise KeyError(f"{name!r} is none of {sorted(_LOADERS)}")


def synthetic(spark: SparkSession, rows: int, d: int, seed: int = 42, first: int = 0) -> DataFrame:
    """vectors(vec_id, embedding): ``rows`` vectors on a curved surface of few parameters, so that neighbours are meaningful.

    Component j is the sine of a sum of four uniform parameters of the row with weights that depend on j alone.
    """
    ids = spark.range(first, first + rows).withColumnRenamed("id", "vec_id")
    z = ids.select("vec_id", F.array(*(draw("vec_id", F.lit(k), seed=seed) for k in range(4))).alias("z"))
    weight = lambda k, j: F.lit(float((k + 1) * (j % 7 + 1) % 5 + 1))
    parts = [F.sin(sum((F.col("z")[k] * weight(k, j) for k in range(4)), F.lit(0.0))) for j in range(d)]
    return z.select("vec_id", F.array(*parts).alias("embedding"))


def files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    register(spark)
    return spark.read.format("vectorfile").option("kind", kind).load(path)


@dataset(r"randperm-v(?P<vectors>\d+)-t(?P<labels>\d+)-d(?P<density>0?\.\d+)")
def _random(spark: SparkSession, vectors: str, labels: str, density: str, d: int = 16, seed: int = 42):
    v = synthetic(spark, int(vectors), d, seed)
    return v, random_access(v, int(labels), float(density), seed=seed)


@dataset(r"u8bin-tags")
def _tagged(spark: SparkSession, vectors: str, tags: str):
    """One byte matrix, scaled to [-0.5, 0.5], and one sparse matrix of tags, row by row."""
    v = files(spark, vectors, "u8bin").select("vec_id", F.transform("embedding", lambda x: x / F.lit(255.0) - F.lit(0.5)).alias("embedding"))
    return v, files(spark, tags, "spmat").select("vec_id", F.explode("embedding").alias("label"))


def standard(spark: SparkSession, folder: str, base: str = "base.fvecs", queries: str = "query.fvecs", truth: str = "groundtruth.ivecs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The usual layout of public nearest-neighbour sets: vectors(vec_id, embedding), queries(query_id, embedding) and
    truth(query_id, rank, vec_id)."""
    read = lambda name: files(spark, f"{folder}/{name}", name.rsplit(".", 1)[1])
    v, q, t = read(base).drop("file"), read(queries), read(truth)
    return v, q.select(F.col("vec_id").alias("query_id"), "embedding"), t.select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("rank", "vec_id")).withColumn("rank", F.col("rank") + 1)


@dataset(r"standard")
def _standard(spark: SparkSession, folder: str, **names: str):
    v, _, _ = standard(spark, folder, **names)
    return v, v.select("vec_id", F.lit(0).alias("label")).limit(0)
