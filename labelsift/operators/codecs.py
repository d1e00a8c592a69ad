"""Vector codecs and transforms: scalar and product quantisers, row-wise codes, hashing, means, principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, hamming, l2sq, pack_signs


def sq_limits(vectors: DataFrame) -> DataFrame:
    """(dim, lo, hi)"""
    each = vectors.select(F.posexplode(doubles("embedding")).alias("dim", "x"))
    return each.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def _row_of(table: DataFrame, *columns: str) -> DataFrame:
    """One row of arrays ordered by dim: as long as a vector, so it is broadcast."""
    z = F.array_sort(F.collect_list(F.struct("dim", *columns)))
    part = lambda c: F.transform("_z", lambda x: x[c]).alias(f"_{c}")
    return table.agg(z.alias("_z")).select(*map(part, columns))


def sq_encode(vectors: DataFrame, limits: DataFrame, levels: int = 255) -> DataFrame:
    """vec_id, code: each component as a level between its dimension's limits; a constant dimension is 0."""
    met = vectors.crossJoin(F.broadcast(_row_of(limits, "lo", "hi")))
    span = F.zip_with("_hi", "_lo", lambda h, lo: F.nullif(h - lo, F.lit(0.0)))
    above = F.zip_with(doubles("embedding"), "_lo", lambda x, lo: x - lo)
    code = F.zip_with(above, span, lambda x, s: F.coalesce(F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(x / s * levels))), F.lit(0)).cast("long"))
    return met.select("vec_id", code.alias("code"))


def sq_decode(codes: DataFrame, limits: DataFrame, levels: int = 255) -> DataFrame:
    met = codes.crossJoin(F.broadcast(_row_of(limits, "lo", "hi")))
    step = F.zip_with("_hi", "_lo", lambda h, lo: (h - lo) / levels)
    return met.select("vec_id", F.zip_with(F.zip_with("code", step, lambda c, s: (c + 0.5) * s), "_lo", lambda x, lo: x + lo).alias("embedding"))


def _limits(column: int, limits: list) -> Column:
    return F.array(*(F.lit(float(x[column])) for x in limits))


def sq_codes(vectors: DataFrame, limits: list, levels: int = 255) -> DataFrame:
    """``vectors`` with code, under limits (lo, hi) of each dimension that are known already."""
    above = F.zip_with(doubles("embedding"), _limits(0, limits), lambda x, lo: x - lo)
    span = F.array(*(F.lit(float(hi - lo)) if hi > lo else F.lit(None).cast("double") for lo, hi in limits))
    return vectors.withColumn("code", F.zip_with(above, span, lambda x, s: F.coalesce(F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(x / s * levels))), F.lit(0)).cast("long")))


def sq_values(codes: DataFrame, limits: list, levels: int = 255) -> DataFrame:
    """``codes`` with embedding: the middle of each code's interval."""
    step = F.array(*(F.lit(float(hi - lo) / levels) for lo, hi in limits))
    return codes.withColumn("embedding", F.zip_with(F.zip_with("code", step, lambda c, s: (c + 0.5) * s), _limits(0, limits), lambda x, lo: x + lo))


def rowwise(vectors: DataFrame, levels: int = 255) -> DataFrame:
    """vec_id, lo, scale, code with the limits of each row."""
    v = vectors.withColumns({"lo": F.array_min(doubles("embedding")), "_hi": F.array_max(doubles("embedding"))})
    scale = F.nullif(F.col("_hi") - F.col("lo"), F.lit(0.0))
    return v.select("vec_id", "lo", (F.coalesce(scale, F.lit(0.0)) / levels).alias("scale"), F.transform(doubles("embedding"), lambda x: F.coalesce(F.round((x - F.col("lo")) / scale * levels), F.lit(0)).cast("long")).alias("code"))


def pq_encode(vectors: DataFrame, centroids: DataFrame, parts: int) -> DataFrame:
    """(vec_id, m, c): nearest centroid c in each of ``parts`` equal slices. centroids(c, centroid) are few and broadcast."""
    width = F.floor(F.size("embedding") / parts).cast("int")
    cut = lambda v: F.slice(v, F.col("m") * width + 1, width)
    met = vectors.crossJoin(F.broadcast(centroids)).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = met.groupBy("vec_id", "m").agg(F.min(F.struct(l2sq(cut(F.col("embedding")), cut(F.col("centroid"))).alias("d"), "c")).alias("x"))
    return near.select("vec_id", "m", F.col("x.c").alias("c"))


def hash_pairs(vectors: DataFrame, bits: int, flips: int, limit: int) -> DataFrame:
    """Pairs (i, j) whose first ``bits`` signs differ in at most ``flips`` (0 or 1), verified on all signs. Equi-joins on hashes."""
    w = vectors.select("vec_id", pack_signs("embedding").alias("w")).withColumn("h", F.get("w", F.lit(0)).bitwiseAND(F.lit((1 << bits) - 1)))
    masks = [0] + ([1 << k for k in range(bits)] if flips else [])
    probe = w.select(F.col("vec_id").alias("i"), F.col("w").alias("x"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("h").bitwiseXOR(m.cast("long")))).alias("h"))
    return probe.join(w, "h").where((F.col("i") < F.col("vec_id")) & (hamming("x", "w") <= limit)).select("i", F.col("vec_id").alias("j"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.posexplode(doubles("embedding")).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def _added(batch):
    import pyarrow as pa

    total = lambda c: np.sum([np.array(x) for x in batch.column(c).to_pylist()], 0).tolist()
    return pa.table({"n": pa.array([sum(batch.column("n").to_pylist())], pa.int64()), "s": pa.array([total("s")], pa.list_(pa.float64())), "ss": pa.array([total("ss")], pa.list_(pa.float64()))})


def pca(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (rows) of the covariance; only d x d sums reach the driver."""

    def moments(batches):
        import pyarrow as pa

        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "ss"])

    each = vectors.select(F.col("embedding").cast("array<float>")).mapInArrow(moments, "n long, s array<double>, ss array<double>")
    each = each.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = each.select("_g", "n", "s", "ss").groupBy("_g").applyInArrow(_added, "n long, s array<double>, ss array<double>").collect()  # at most 64 rows
    n = sum(p.n for p in parts)
    s = np.sum([p.s for p in parts], 0)
    d = len(s)
    cov = (np.sum([p.ss for p in parts], 0).reshape(d, d) - np.outer(s, s) / n) / max(1, n - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    axes = axes.T[order]
    sign = np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])  # the largest component of each axis is positive
    return values[order], axes * sign[:, None]
