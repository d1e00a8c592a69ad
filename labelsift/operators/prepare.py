"""Dataset preparation: sub-matrices, deterministic splits, categories, label subsets, random access, id assignment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import to_column
from .storage import cut


def draw(*columns: str | Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns as text, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def top_n_m(access: DataFrame, n: int, m: int) -> DataFrame:
    """Pairs of the n vectors with most labels and the m most frequent labels, both counted on all pairs."""
    rows = access.groupBy("vec_id").count().orderBy(F.desc("count"), "vec_id").limit(n).select("vec_id")
    cols = access.groupBy("label").count().orderBy(F.desc("count"), "label").limit(m).select("label")
    return access.join(rows, "vec_id", "left_semi").join(cols, "label", "left_semi").select("vec_id", "label")


def split(vectors: DataFrame, test_share: float = 0.2, seed: int = 42, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Train and test: the first int(n (1 - t)) rows in hash order, found by the hash at the cut, not by ranking all rows."""
    n = vectors.count()
    keep = int(n * (1 - test_share))
    h = F.struct(F.xxhash64(id_col, F.lit(seed)).alias("h"), F.col(id_col).alias("id"))
    if keep in (0, n):
        return vectors.limit(keep), vectors.where(F.lit(keep == 0))
    cut = vectors.select(h.alias("h")).orderBy(F.desc("h") if keep * 2 > n else F.asc("h")).limit(n - keep if keep * 2 > n else keep + 1).agg((F.min if keep * 2 > n else F.max)("h").alias("cut")).first().cut
    low = (F.xxhash64(id_col, F.lit(seed)) < cut.h) | ((F.xxhash64(id_col, F.lit(seed)) == cut.h) & (F.col(id_col) < cut.id))
    return vectors.where(low), vectors.where(~low)


def top_categories(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.select(F.explode(F.split(column, " ")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(n)


def filter_categories(rows: DataFrame, column: str, kept: list[str], n: int, id_col: str) -> DataFrame:
    """The first n rows with at least one kept category, and only their kept ones."""
    own = F.array_intersect(F.split(column, " "), F.array(*map(F.lit, kept)))
    return rows.withColumn(column, own).where(F.size(column) > 0).orderBy(id_col).limit(n)


def label_encode(rows: DataFrame, column: str) -> DataFrame:
    """Dense codes of the sorted distinct values: places in each sorted partition after the sizes of the partitions before."""
    spark = rows.sparkSession
    values = cut(rows.select(column).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in values.groupBy(part.alias("p")).count().collect())  # a row for each partition
    before = F.lit(0).cast("long")
    for p, _ in sizes:
        before = F.when(part == p, F.lit(sum(n for q, n in sizes if q < p)).cast("long")).otherwise(before)
    return values.select(column, (before + place).alias("code"))


def share_degree(access: DataFrame, degree: float, users: int, seed: int = 42) -> DataFrame:
    """Each label becomes round(degree / mean labels) random users; duplicates stay."""
    mean = access.agg(F.count(F.lit(1)) / F.count_distinct("vec_id")).first()[0] or 1.0
    copies = max(1, round(degree / mean))
    each = access.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return each.select("vec_id", F.floor(draw("label", "_k", seed=seed) * users).cast("int").alias("label"))


def random_access(vectors: DataFrame, labels: int, density: float, seed: int = 42) -> DataFrame:
    """Each (vector, label) with the given probability."""
    each = vectors.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(labels - 1))).alias("label"))
    return each.where(draw("vec_id", "label", seed=seed) < density)


def selectivity_labels(vectors: DataFrame, levels: int, per_level: int, seed: int = 42) -> DataFrame:
    """Labels at ``levels`` evenly spaced selectivities from 0.01 to 1, ``per_level`` of each."""
    step = 0.99 / max(1, levels - 1)
    each = vectors.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(levels * per_level - 1))).alias("label"))
    return each.where(draw("vec_id", "label", seed=seed) < 0.01 + F.floor(F.col("label") / per_level) * step)


def resample(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement, numbered 0 .. n-1."""
    spark = vectors.sparkSession
    ranked = append_ids(vectors, "vec_id", "_i", spark.range(0).withColumnRenamed("id", "_i"))
    size = vectors.count()
    picks = spark.range(n).select(F.col("id").alias("new_id"), F.floor(draw("id", seed=seed) * size).alias("_i"))
    return picks.join(ranked, "_i").drop("_i")


def random_test_labels(access: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """As many random distinct labels for each vector as it has; labels(label) is the vocabulary, numbered and broadcast.

    The j-th label of a vector is at place (start + j * step) mod n of the vocabulary, with a start drawn by its id and a
    step that has no factor in common with n, so a vector's labels differ as long as it has at most n.
    """
    numbered = labels.distinct().withColumn("_i", F.row_number().over(Window.orderBy("label")) - 1)  # one row a label
    n = max(1, labels.distinct().count())
    steps = [s for s in range(1, n + 1) if math.gcd(s, n) == 1]
    counts = access.groupBy("vec_id").agg(F.count_distinct("label").alias("_c"))
    step = F.get(F.array(*map(F.lit, steps)), F.floor(draw("vec_id", seed=seed + 1) * len(steps)).cast("int"))
    start = F.floor(draw("vec_id", seed=seed) * n)
    places = counts.select("vec_id", F.explode(F.sequence(F.lit(0), F.least("_c", F.lit(n)).cast("int") - 1)).alias("_j"))
    return places.select("vec_id", F.pmod(start + F.col("_j") * step, F.lit(n)).cast("int").alias("_i")).join(F.broadcast(numbered), "_i").select("vec_id", "label")


def label_sample(access: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n labels, those of the smallest hashes."""
    return access.select("label").distinct().orderBy(draw("label", seed=seed), "label").limit(n)


def label_split(access: DataFrame, labels: list[int], remap: bool = True) -> DataFrame:
    """Pairs of a label subset, with dense labels if asked."""
    kept = sorted(set(labels))
    own = access.where(F.col("label").isin(kept))
    if not remap:
        return own
    codes = F.create_map(*(x for i, n in enumerate(kept) for x in (F.lit(n), F.lit(i))))
    return own.select("vec_id", F.element_at(codes, F.col("label")).alias("label"))


def selectivity_split(access: DataFrame, vectors: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of labels whose selectivity lies in [low, high]."""
    n = vectors.count()
    labels = access.groupBy("label").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") / F.lit(n)).between(low, high)).select("label")
    return access.join(labels, "label", "left_semi").select("vec_id", "label")


def predicates_to_labels(wide: DataFrame, formulas: dict[int, str], universe: str = "labelled") -> DataFrame:
    """Each formula as a label of its own, in one scan."""
    hits = F.array_compact(F.array(*(F.when(to_column(f, "labels", universe), F.lit(i)) for i, f in sorted(formulas.items()))))
    return wide.select("vec_id", F.explode(hits).alias("label"))


def merge_tables(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """Union after a check of the schemas, the second's ids shifted."""
    if a.schema != b.schema:
        raise ValueError("the tables differ in their columns")
    return a.unionByName(b.withColumn("vec_id", F.col("vec_id") + F.lit(shift)))


def append_ids(rows: DataFrame, order: str, id_col: str, existing: DataFrame) -> DataFrame:
    """New rows numbered on from the largest existing id, by ranges of ``order`` so that no task holds all rows."""
    first = existing.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    own = cut(ranged.withColumn("_n", F.row_number().over(w)))  # ranges are sampled: they must not be drawn twice
    sizes = {r._p: r.n for r in own.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.element_at(F.create_map(*(x for p, n in before.items() for x in (F.lit(p), F.lit(n)))), F.col("_p")) if before else F.lit(0)
    return own.select((F.col("_n") + start + F.lit(first)).cast("long").alias(id_col), *rows.columns)
