"""Cluster-partitioned and tree layouts: assignment, Lloyd steps, probes, IVF searches, short lists, tree searches.

Centroids(cluster_id, centroid) are a table whose size the caller chose; up to ``BROADCAST_FLOATS`` numbers of them are
broadcast. Approximate plans take explicit centroids, so the same layout gives the same answer on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, l2sq, metric as metric_of
from .nearest import nearest, serves
from .search import top_k
from .storage import cut

#: Numbers that a broadcast side may hold (32 MB as doubles).
BROADCAST_FLOATS = 4_000_000


def _fits(table: DataFrame) -> bool:
    """Whether all centroids together are small enough to be broadcast."""
    return (table.agg(F.sum(F.size("centroid") + F.lit(2))).first()[0] or 0) <= BROADCAST_FLOATS


def _side(centroids: DataFrame) -> DataFrame:
    return F.broadcast(centroids) if _fits(centroids) else centroids


def _all(centroids: DataFrame, *keys: str) -> DataFrame:
    """One row, _all: the centroids as an array of structs."""
    return F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct(*keys, doubles("centroid").alias("centroid")))).alias("_all")))


def _nearest(own: Column, key: str) -> Column:
    """struct<d, key> of the nearest of an array of centroids; ties go to the smaller key.

    The vector is an argument, not a column inside of the lambda: where Spark compares predicates it numbers a lambda's
    variables from 0 on and takes a column of the same number for one of them. A predicate on the result, such as the one
    that a join on it implies, then seems to need the centroids only and is moved to where the column is missing.
    """
    each = F.array_repeat(doubles("embedding"), F.size(own))
    return F.array_min(F.zip_with(own, each, lambda c, v: F.struct(l2sq(v, c["centroid"]).alias("d"), c[key].alias(key))))


def assign_clusters(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with cluster_id and cluster_distance (squared); ties go to the smaller cluster.

    Centroids that fit are one broadcast row, so vectors never move. Others meet the vectors row by row, and one
    aggregation, combined map-side, finds the nearest.
    """
    if _fits(centroids):
        some = F.broadcast(_all(centroids, "cluster_id").where(F.size("_all") > 0))  # without centroids no vector has a cluster
        met = vectors.crossJoin(some).withColumn("_m", _nearest(F.col("_all"), "cluster_id"))
        return met.withColumns({"cluster_id": F.col("_m.cluster_id"), "cluster_distance": F.col("_m.d")}).drop("_all", "_m")
    met = vectors.withColumn("_row", F.monotonically_increasing_id()).crossJoin(centroids.select("cluster_id", "centroid"))
    each = met.select("_row", F.struct(*vectors.columns).alias("_v"), F.struct(l2sq("embedding", "centroid").alias("d"), F.col("cluster_id")).alias("_m"))
    near = each.groupBy("_row").agg(F.min("_m").alias("_m"), F.first("_v").alias("_v"))
    return near.select("_v.*", F.col("_m.cluster_id"), F.col("_m.d").alias("cluster_distance"))


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """New centroids(cluster_id, centroid, n): the mean of each cluster, by position, so that sums combine map-side."""
    each = assigned.select("cluster_id", F.posexplode(doubles("embedding")).alias("dim", "x"))
    means = each.groupBy("cluster_id", "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("centroid"), F.max("n").alias("n"))


def kmeans(vectors: DataFrame, centroids: DataFrame, rounds: int = 10) -> DataFrame:
    """Lloyd's iterations from given centroids; an empty cluster keeps its centroid."""
    for _ in range(rounds):
        new = lloyd_step(assign_clusters(vectors, centroids)).select("cluster_id", F.col("centroid").alias("_new"))
        centroids = centroids.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("_new", doubles("centroid")).alias("centroid"))
        centroids = cut(centroids)  # a row for each cluster; plans stay as long as one round
    return centroids


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, embedding, cluster_id, probe): the nprobe nearest clusters of each query."""
    met = queries.crossJoin(_side(centroids)).withColumn("distance", l2sq("embedding", "centroid"))
    w = Window.partitionBy("query_id").orderBy("distance", "cluster_id")
    return met.withColumn("probe", F.row_number().over(w)).where(F.col("probe") <= nprobe).drop("centroid", "distance")


def ivf_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """kNN in the nprobe nearest clusters, with an inline filter on the vectors; the join is on the cluster."""
    f, _ = metric_of(metric)
    lists = assigned.where(where) if where is not None else assigned
    p = probes(queries, centroids, nprobe).select("query_id", "cluster_id", "embedding")
    if serves(p, lists, metric):
        met = nearest(p, lists, k, metric, group="cluster_id")
    else:
        met = lists.join(p.withColumnRenamed("embedding", "_q"), "cluster_id").select("query_id", "vec_id", f("_q", "embedding").alias("distance"))
    return top_k(met, k, metric).select("query_id", "rank", "vec_id", "distance")


def ivf_range(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, radius: float, nprobe: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    f, larger = metric_of(metric)
    lists = assigned.where(where) if where is not None else assigned
    p = probes(queries, centroids, nprobe).select("query_id", "cluster_id", F.col("embedding").alias("_q"))
    met = lists.join(p, "cluster_id").select("query_id", "vec_id", f("_q", "embedding").alias("distance"))
    return met.where(F.col("distance") > radius if larger else F.col("distance") < radius)


def ivf_label_probes(queries: DataFrame, assigned: DataFrame, access: DataFrame, centroids: DataFrame, label: int, k: int, gamma: int = 5, metric: str = "l2") -> DataFrame:
    """Clusters without the label are skipped; nearest first, clusters are read until gamma * k holders have been seen."""
    f, _ = metric_of(metric)
    holders = assigned.join(access.where(F.col("label") == label).select("vec_id").distinct(), "vec_id", "left_semi")
    sizes = holders.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    near = queries.crossJoin(_side(centroids.join(sizes, "cluster_id"))).withColumn("d", l2sq("embedding", "centroid"))
    w = Window.partitionBy("query_id").orderBy("d", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    p = near.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < gamma * k)
    met = holders.join(p.select("query_id", "cluster_id", F.col("embedding").alias("_q")), "cluster_id")
    return top_k(met.select("query_id", "vec_id", f("_q", "embedding").alias("distance")), k, metric).select("query_id", "rank", "vec_id", "distance")


# ---- Bloom filters of the labels in a cluster


def bloom_positions(label: Column, bits: int = 1024, hashes: int = 3) -> Column:
    """The bits that stand for a label: the first ``hashes`` (at most four) parts of its MD5."""
    text = F.md5(label.cast("string"))
    return F.array(*(F.pmod(F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(bits)).cast("int") for k in range(hashes)))


def bloom_filters(held: DataFrame, bits: int = 1024, hashes: int = 3) -> DataFrame:
    """(cluster_id, filter): the bits set for a cluster's labels, at most ``bits`` of them. held(cluster_id, label)."""
    each = held.select("cluster_id", F.explode(bloom_positions(F.col("label"), bits, hashes)).alias("bit")).distinct()
    return each.groupBy("cluster_id").agg(F.array_sort(F.collect_list("bit")).alias("filter"))


def may_hold(own: Column, label: Column, bits: int = 1024, hashes: int = 3) -> Column:
    """False if no vector of the filter's cluster has the label; true otherwise, and now and then without one."""
    return F.size(F.array_except(bloom_positions(label, bits, hashes), own)) == 0


# ---- trees of two levels and deeper, as paths


def assign_tree(vectors: DataFrame, level1: DataFrame, level2: DataFrame) -> DataFrame:
    """vectors with n1, n2: greedy descent by the nearest child. level1(n1, centroid), level2(n1, n2, centroid)."""
    a = assign_clusters(vectors, level1.select(F.col("n1").alias("cluster_id"), "centroid")).withColumnRenamed("cluster_id", "n1").drop("cluster_distance")
    if _fits(level2):
        own = F.filter("_all", lambda c: c["n1"] == F.col("n1"))
        met = a.crossJoin(_all(level2, "n1", "n2")).withColumn("_own", own).withColumn("_m", _nearest(F.col("_own"), "n2"))
        return met.where("_m is not null").withColumn("n2", F.col("_m.n2")).drop("_all", "_own", "_m")
    met = a.withColumn("_row", F.monotonically_increasing_id()).join(level2, "n1")
    each = met.select("_row", F.struct(*a.columns).alias("_v"), F.struct(l2sq("embedding", "centroid").alias("d"), F.col("n2")).alias("_m"))
    return each.groupBy("_row").agg(F.min("_m").alias("_m"), F.first("_v").alias("_v")).select("_v.*", F.col("_m.n2"))


# ---- trees that grow where the vectors are


def _in_node(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """vectors(path, ...) of the nodes' parents with the nearest child: path becomes the child's."""
    if _fits(nodes):
        own = F.filter("_all", lambda c: c["parent"] == F.col("path"))
        met = vectors.crossJoin(_all(nodes, "parent", "child")).withColumn("_own", own).withColumn("_m", _nearest(F.col("_own"), "child"))
        return met.withColumn("path", F.coalesce(F.concat_ws("/", F.nullif("path", F.lit("")), F.col("_m.child").cast("string")), F.col("path"))).drop("_all", "_own", "_m")
    met = vectors.withColumn("_row", F.monotonically_increasing_id()).join(nodes, F.col("path") == F.col("parent"), "left")
    each = met.select("_row", F.struct(*vectors.columns).alias("_v"), F.struct(l2sq("embedding", "centroid").alias("d"), F.col("child")).alias("_m"))
    near = each.groupBy("_row").agg(F.min("_m").alias("_m"), F.first("_v").alias("_v")).select("_v.*", "_m")
    path = F.when(F.col("_m.child").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.nullif("path", F.lit("")), F.col("_m.child").cast("string")))
    return near.withColumn("path", path).drop("_m")


def train_tree(vectors: DataFrame, branch: int = 16, max_leaf: int = 128, depth: int = 9, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of a tree that splits every node of more than ``max_leaf`` vectors into ``branch`` children, level by level.

    nodes(parent, child, centroid); leaves is ``vectors`` with path, the children from the root on, such as 3/0/2 (the root
    is empty). All nodes of a level are split together: children start from the vectors of smallest id in the node and take
    ``rounds`` of Lloyd's iterations. A node whose vectors are all alike is a leaf of any size.
    """
    leaves, nodes = cut(vectors.withColumn("path", F.lit(""))), None
    for _ in range(depth):
        wide = leaves.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("embedding").alias("a"), F.max("embedding").alias("b")).where((F.col("n") > max_leaf) & (F.col("a") < F.col("b")))
        inside = leaves.join(wide.select("path"), "path", "left_semi")
        seed = F.row_number().over(Window.partitionBy("path").orderBy("vec_id"))  # each partition keeps the first rows only
        new = inside.select("path", "vec_id", "embedding").withColumn("child", seed).where(F.col("child") <= branch)
        new = cut(new.select(F.col("path").alias("parent"), (F.col("child") - 1).alias("child"), doubles("embedding").alias("centroid")))
        if new.isEmpty():
            break
        for _round in range(rounds):
            placed = _in_node(inside.withColumn("_from", F.col("path")), new)
            each = placed.select("_from", F.element_at(F.split("path", "/"), -1).cast("int").alias("child"), F.posexplode(doubles("embedding")).alias("dim", "x"))
            means = each.groupBy("_from", "child", "dim").agg(F.avg("x").alias("x")).groupBy("_from", "child").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("_new"))
            moved = new.join(means.withColumnRenamed("_from", "parent"), ["parent", "child"], "left")
            new = cut(moved.select("parent", "child", F.coalesce("_new", "centroid").alias("centroid")))
        leaves = cut(_in_node(leaves, new))
        nodes = new if nodes is None else nodes.unionByName(new)
    if nodes is None:
        nodes = vectors.limit(0).select(F.lit("").alias("parent"), F.lit(0).alias("child"), doubles("embedding").alias("centroid"))
    return nodes, leaves


def descend(vectors: DataFrame, nodes: DataFrame, depth: int = 9) -> DataFrame:
    """New ``vectors`` with their path in a trained tree: from each node to the nearest child."""
    placed, level = vectors.withColumn("path", F.lit("")), F.when(F.col("parent") == "", 0).otherwise(F.size(F.split("parent", "/")))
    levels = (nodes.agg(F.max(level)).first()[0] or 0) + 1
    for k in range(min(depth, levels)):
        placed = _in_node(placed, nodes.where(level == k))
    return placed


def path_lists(leaves: DataFrame, access: DataFrame, limit: int) -> DataFrame:
    """(label, path, vec_id): a label's lists sit at the highest nodes with at most ``limit`` of its holders, else at leaves.

    Lists are what the current vectors and grants make them, so they split and merge with every change of either.
    """
    steps = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    held = access.join(leaves.select("vec_id", steps.alias("_steps")), "vec_id").select("label", "vec_id", "_steps")
    above = held.select("label", "vec_id", "_steps", F.explode(F.sequence(F.lit(0), F.size("_steps"))).alias("_k")).withColumn("path", F.array_join(F.slice("_steps", 1, F.col("_k")), "/"))
    small = above.groupBy("label", "path").agg(F.count(F.lit(1)).alias("_n"))
    met = above.join(small, ["label", "path"]).where((F.col("_n") <= limit) | (F.col("_k") == F.size("_steps")))
    return met.groupBy("label", "vec_id").agg(F.min(F.struct("_k", "path")).alias("_m")).select("label", F.col("_m.path").alias("path"), "vec_id")


def short_lists(leaves: DataFrame, access: DataFrame, limit: int, levels: tuple[str, ...] = ("n1", "n2")) -> DataFrame:
    """(label, level, path, vec_id): a label's lists sit at the highest nodes with at most ``limit`` holders, else at leaves."""
    held = access.join(leaves.select("vec_id", *levels), "vec_id")
    sizes, level, path = [], None, None
    for k in range(len(levels) + 1):
        counts = held.groupBy("label", *levels[:k]).agg(F.count(F.lit(1)).alias(f"_c{k}"))
        sizes.append(counts)
    for k, counts in enumerate(sizes[:-1]):
        held = held.join(counts, ["label", *levels[:k]])
    level = F.lit(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        level = F.when(F.col(f"_c{k}") <= limit, F.lit(k)).otherwise(level)
    held = held.withColumn("level", level.cast("int"))
    path = F.concat_ws("/", *(F.when(F.col("level") > k, F.col(c).cast("string")) for k, c in enumerate(levels)))
    return held.select("label", "level", path.alias("path"), "vec_id")


def node_stats(leaves: DataFrame, level1: DataFrame) -> DataFrame:
    """(n1, n, var_mean): size of each node and mean squared distance of its vectors to its centroid."""
    met = leaves.join(_side(level1), "n1")
    return met.groupBy("n1").agg(F.count(F.lit(1)).alias("n"), F.avg(l2sq("embedding", "centroid")).alias("var_mean"))


def tree_search(queries: DataFrame, leaves: DataFrame, level1: DataFrame, k: int, max_candidates: int, prune: float = 1.6, boost: float = 0.0, metric: str = "l2") -> DataFrame:
    """Nodes by ``distance - boost * variance`` until max_candidates vectors, none farther than ``prune`` times the nearest."""
    f, _ = metric_of(metric)
    nodes = level1.join(node_stats(leaves, level1), "n1").withColumn("_boost", F.col("var_mean") * F.lit(float(boost)))
    near = queries.crossJoin(_side(nodes)).withColumn("s", l2sq("embedding", "centroid") - F.col("_boost"))
    w = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("s", "n1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = near.withColumns({"before": before, "best": F.min("s").over(w)}).where((F.col("before") < max_candidates) & (F.col("s") <= F.col("best") * F.lit(float(prune))))
    met = leaves.join(picked.select("query_id", "n1", F.col("embedding").alias("_q")), "n1")
    return top_k(met.select("query_id", "vec_id", f("_q", "embedding").alias("distance")), k, metric).select("query_id", "rank", "vec_id", "distance")


def tree_profile(queries: DataFrame, leaves: DataFrame, level1: DataFrame, max_candidates: int, prune: float = 1.6) -> DataFrame:
    """(query_id, nodes, read, candidates): nodes scored, nodes read and vectors measured by ``tree_search``."""
    sizes = level1.join(leaves.groupBy("n1").agg(F.count(F.lit(1)).alias("n")), "n1")
    near = queries.crossJoin(_side(sizes)).withColumn("s", l2sq("embedding", "centroid"))
    w = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("s", "n1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = (F.col("before") < max_candidates) & (F.col("s") <= F.col("best") * F.lit(float(prune)))
    return near.withColumns({"before": before, "best": F.min("s").over(w)}).groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(read).alias("read"), F.coalesce(F.sum(F.when(read, F.col("n"))), F.lit(0)).alias("candidates"))


def tree_memory(leaves: DataFrame, lists: DataFrame) -> DataFrame:
    """(vector_bytes, list_bytes, node_bytes) as stored: vectors in single, centroids in double precision, entries of 8 bytes."""
    held = leaves.agg(F.sum(F.size("embedding") * 4).cast("long").alias("vector_bytes"), (F.count_distinct("n1") + F.count_distinct("n2")).alias("_nodes"), F.max(F.size("embedding")).alias("_d"))
    return held.crossJoin(lists.agg((F.count(F.lit(1)) * 8).alias("list_bytes"))).select("vector_bytes", "list_bytes", (F.col("_nodes") * F.col("_d") * 8).cast("long").alias("node_bytes"))


def kmeans_progressive(vectors: DataFrame, centroids: DataFrame, dims: tuple[int, ...]) -> DataFrame:
    """Lloyd's iterations that look at more and more leading dimensions: one for each of ``dims``; means are of whole vectors."""
    for d in dims:
        lead = vectors.withColumn("_v", F.col("embedding")).withColumn("embedding", F.slice("embedding", 1, d))
        near = assign_clusters(lead, centroids.withColumn("centroid", F.slice("centroid", 1, d))).withColumn("embedding", F.col("_v"))
        new = lloyd_step(near).select("cluster_id", F.col("centroid").alias("_new"))
        centroids = cut(centroids.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("_new", doubles("centroid")).alias("centroid")))
    return centroids


def beam(queries: DataFrame, level1: DataFrame, level2: DataFrame, width: int, leaves: int) -> DataFrame:
    """(query_id, n1, n2): the ``width`` nearest nodes of the first level, then the ``leaves`` nearest of their children."""
    top = queries.crossJoin(_side(level1)).withColumn("s", l2sq("embedding", "centroid"))
    kept = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "n1"))).where(F.col("r") <= width)
    low = kept.select("query_id", "embedding", "n1").join(_side(level2), "n1").withColumn("s", l2sq("embedding", "centroid"))
    return low.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "n2"))).where(F.col("r") <= leaves).select("query_id", "n1", "n2")


def tree_info(leaves: DataFrame, levels: tuple[str, ...] = ("n1", "n2")) -> DataFrame:
    sizes = leaves.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("leaves"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"))


def hybrid_search(queries: DataFrame, assigned: DataFrame, access: DataFrame, centroids: DataFrame, label: int, k: int, threshold: float, nprobe: int, metric: str = "l2") -> DataFrame:
    """Cluster-pruned scan where the label is common (selectivity above the threshold), label-first exact scan where it is rare."""
    from .search import knn_label

    held = access.where(F.col("label") == label).select("vec_id").distinct()
    if held.count() / max(1, assigned.count()) > threshold:
        return ivf_search(queries, assigned.join(held, "vec_id", "left_semi"), centroids, k, nprobe, metric)
    return knn_label(queries, assigned.select("vec_id", "embedding"), access, k, label, metric)
