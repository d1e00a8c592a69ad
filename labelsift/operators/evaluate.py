"""Evaluation of search results: recall, precision, intersections, latency, selectivity groups, fronts, cost fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per group: recall_ref = hits / returned (1 if both are empty, 0 if only the result is), recall = hits / truth."""
    r = results.where("vec_id >= 0").select(*by, "vec_id", F.lit(1).alias("_r")).distinct()
    t = truth.where("vec_id >= 0").select(*by, "vec_id", F.lit(1).alias("_t")).distinct()
    n = r.join(t, [*by, "vec_id"], "full").groupBy(*by).agg(F.count("_r").alias("returned"), F.count("_t").alias("expected"), F.count_if(F.col("_r").isNotNull() & F.col("_t").isNotNull()).alias("hits"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hits") / F.col(d)).otherwise(F.when(F.col("expected") == 0, 1.0).otherwise(0.0))
    return n.select(*by, "returned", "expected", "hits", ratio("returned").alias("recall_ref"), ratio("expected").alias("recall"))


def recall_at(results: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """One row: share of queries whose first true neighbour is among the first r; intersection of the first r with the true r."""
    first = truth.where("rank = 1").select("query_id", F.col("vec_id").alias("_first"))
    one = results.where(F.col("rank") <= r).join(first, "query_id").groupBy("query_id").agg(F.max((F.col("vec_id") == F.col("_first")).cast("int")).alias("hit"))
    both = results.where(F.col("rank") <= r).join(truth.where(F.col("rank") <= r).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    n = first.select(F.count(F.lit(1)).alias("nq"))
    return one.agg(F.sum("hit").alias("h")).crossJoin(both.agg(F.count(F.lit(1)).alias("i"))).crossJoin(n).select((F.col("h") / F.col("nq")).alias("one_recall"), (F.col("i") / (F.col("nq") * r)).alias("intersection"))


def range_precision_recall(results: DataFrame, truth: DataFrame, queries: DataFrame, mode: str = "overall") -> DataFrame:
    """Precision and recall of range results; an empty result has precision 1, an empty truth recall 1."""
    count = lambda d, c: d.groupBy("query_id").agg(F.count(F.lit(1)).alias(c))
    hits = results.select("query_id", "vec_id").join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    each = queries.select("query_id").join(count(results, "n"), "query_id", "left").join(count(truth, "t"), "query_id", "left").join(count(hits, "h"), "query_id", "left").fillna(0, ["n", "t", "h"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    if mode == "overall":
        return each.agg(F.sum("h").alias("h"), F.sum("n").alias("n"), F.sum("t").alias("t")).select(share(F.col("h"), F.col("n")).alias("precision"), share(F.col("h"), F.col("t")).alias("recall"))
    return each.agg(F.avg(share(F.col("h"), F.col("n"))).alias("precision"), F.avg(share(F.col("h"), F.col("t"))).alias("recall"))


def pr_curve(results: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and recall of all range results nearer than each threshold, from one pass over the results."""
    t = truth.select("query_id", "vec_id", F.lit(1).alias("_t"))
    flagged = results.join(t, ["query_id", "vec_id"], "left")
    n = [x for i, c in enumerate(thresholds) for x in (F.count_if(F.col("distance") < c).alias(f"n{i}"), F.count_if((F.col("distance") < c) & F.col("_t").isNotNull()).alias(f"h{i}"))]
    each = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("h")) for i, c in enumerate(thresholds)))).alias("x")
    got = flagged.agg(*n).crossJoin(truth.agg(F.count(F.lit(1)).alias("t"))).select(each, "t")
    return got.select("x.threshold", F.when(F.col("x.n") > 0, F.col("x.h") / F.col("x.n")).otherwise(1.0).alias("precision"), F.when(F.col("t") > 0, F.col("x.h") / F.col("t")).otherwise(1.0).alias("recall"))


def latency(log: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """qps (1 / mean), mean, population deviation, exact interpolated percentiles."""
    p = lambda q: F.percentile(value, q)
    return log.groupBy(*by).agg((1 / F.avg(value)).alias("qps"), F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def label_selectivity(access: DataFrame, vectors: DataFrame) -> DataFrame:
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    return access.groupBy("label").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("label", (F.col("c") / F.col("n")).alias("selectivity"))


def cardinality(access: DataFrame) -> DataFrame:
    """Largest label, number of pairs, mean labels of labelled vectors."""
    return access.agg(F.max("label").alias("max_label"), F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) / F.count_distinct("vec_id")).alias("labels_per_vector"))


def selectivity_groups(sel: DataFrame, percentiles: list[float], per_group: int) -> DataFrame:
    """(percentile, label, selectivity): labels nearest to the selectivity at each percentile (position ceil(p n) - 1)."""
    n = sel.count()
    places = {p: max(0, -int(-p * n // 1) - 1) for p in percentiles}
    ranked = sel.withColumn("_i", F.row_number().over(Window.orderBy("selectivity", "label")) - 1)  # one row a label
    pivots = F.broadcast(ranked.where(F.col("_i").isin(list(places.values()))).select("_i", F.col("selectivity").alias("_s")))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("percentile"), F.lit(i).alias("i")) for p, i in places.items()))).alias("x")
    at = sel.sparkSession.range(1).select(wanted).select("x.*").join(pivots, F.col("i") == F.col("_i"))
    near = sel.crossJoin(F.broadcast(at)).withColumn("r", F.row_number().over(Window.partitionBy("percentile").orderBy(F.abs(F.col("selectivity") - F.col("_s")), "label")))
    return near.where(F.col("r") <= per_group).select("percentile", "label", "selectivity")


def best_config(runs: DataFrame, by: tuple[str, ...], least: float) -> DataFrame:
    """Of each group the configuration of lowest latency with at least the given recall; groups without one are left out."""
    return runs.where(F.col("recall") >= least).groupBy(*by).agg(F.min(F.struct("latency", "config", "recall")).alias("m")).select(*by, "m.config", "m.latency", "m.recall")


def pareto(runs: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that no other row beats strictly in both: the best gain at any strictly smaller cost is no larger."""
    best = runs.groupBy(cost).agg(F.max(gain).alias("_g"))  # one row for each cost
    w = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    before = best.withColumn("_before", F.max("_g").over(w)).select(cost, "_before")
    return runs.join(before, cost).where(F.col("_before").isNull() | (F.col(gain) >= F.col("_before"))).drop("_before")


def running_best(runs: DataFrame, cost: str, gain: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Operating points: rows that gain more than all cheaper ones."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_b", F.max(gain).over(w)).where(F.col("_b").isNull() | (F.col(gain) > F.col("_b"))).drop("_b")


def interpolate(points: DataFrame, x: str, y: str, at: float, by: tuple[str, ...]) -> DataFrame:
    """y at x = ``at`` on the line between the neighbouring points; groups that don't reach it are left out."""
    w = Window.partitionBy(*by).orderBy(x, y)
    n = points.withColumns({"_x": F.lead(x).over(w), "_y": F.lead(y).over(w)})
    t = F.lit(float(at))
    inside = n.where((F.col(x) <= t) & (F.col("_x") > t))
    return inside.select(*by, (F.col(y) + (F.col("_y") - F.col(y)) * (t - F.col(x)) / (F.col("_x") - F.col(x))).alias("value"))


def matrix_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Per dimension: n, nan, zero, min, max, mean and population deviation of the valid values."""
    each = vectors.select(F.posexplode(F.col(column).cast("array<double>")).alias("dim", "x"))
    ok = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    return each.groupBy("dim").agg(F.count("x").alias("n"), F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.col("x") == 0).alias("n_zero"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"))


def imbalance(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """k * sum n^2 / (sum n)^2 over the clusters that hold something."""
    n = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.count(F.lit(1)) * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("imbalance"))


def fit_cost(log: DataFrame, size: str, time: str, by: tuple[str, ...] = ()) -> DataFrame:
    return log.groupBy(*by).agg(F.regr_slope(time, size).alias("slope"), F.regr_intercept(time, size).alias("intercept"))


def same_up_to_draws(a: DataFrame, b: DataFrame, digits: int = 5) -> Column | bool:
    """Whether two kNN results agree but for the order of equal distances and the choice among ties at the cut."""
    key = lambda d, n: d.select("query_id", "rank", F.round("distance", digits).alias("d"), F.lit(n).alias("_n"))
    return key(a, 1).unionByName(key(b, -1)).groupBy("query_id", "rank", "d").agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()  # each is found once


def group_means(rows: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """(groups, n, means of the values) for each combination of the groups."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in values))


def table_bytes(rows: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """(part, n, bytes): what an array column of ``width`` bytes an entry takes."""
    return rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(column) * width), F.lit(0)).cast("long").alias("bytes"))
