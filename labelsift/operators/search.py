"""Exact kNN and range search as joins, with label, formula and id filters; lookups, merges and removals.

Tables: vectors(vec_id, embedding), queries(query_id, embedding), access(vec_id, label). Results are rows
(query_id, rank, vec_id, distance), fewer than k where fewer qualify; ties go to the smaller id, null distances rank last.
Top-k by Euclidean distance or inner product is found by ``nearest``. Elsewhere a query side of at most
``BROADCAST_QUERIES`` rows and ``BROADCAST_FLOATS`` numbers is broadcast, so vectors never move; beyond that the queries are dealt into blocks and every
block meets every partition of vectors, each through an equi-join on the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import to_column
from ..functions.vectors import metric as metric_of
from .descent import slices_of, tried
from .nearest import nearest, serves
from .storage import cut, let_go

BROADCAST_QUERIES, BROADCAST_FLOATS = 10_000, 4_000_000
PROBES = 1_000  # vectors whose neighbours are found by brute force to measure a graph's recall


def fits(queries: DataFrame) -> bool:
    """Whether the queries, counted up to the bound on their rows, hold few enough numbers to be broadcast."""
    n, numbers = queries.limit(BROADCAST_QUERIES + 1).agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).first()
    return n <= BROADCAST_QUERIES and (numbers or 0) <= BROADCAST_FLOATS


def order(name: str, by: tuple[str, ...]) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc_nulls_last("distance") if metric_of(name)[1] else F.asc_nulls_last("distance"), F.asc("vec_id"))


def top_k(pairs: DataFrame, k: int, metric: str = "l2", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k nearest of each group; Spark limits each partition before the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(order(metric, by)).cast("int")).where(F.col("rank") <= k)


def pairs(queries: DataFrame, vectors: DataFrame, metric: str = "l2", bounded: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vec_id, distance, ...) of every query with every vector, queries being the stated, blocked side."""
    f, _ = metric_of(metric)
    q = queries.withColumnRenamed("embedding", "_q")
    if bounded is None:
        bounded = fits(queries)
    if bounded:
        both = vectors.crossJoin(F.broadcast(q))
    else:
        blocks = 64
        dealt = vectors.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        both = dealt.join(q.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "_block").drop("_block")
    return both.select("query_id", "vec_id", *keep, f("_q", "embedding").alias("distance"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """Exact kNN; ``where`` is a filter on the vectors' columns, applied before the join."""
    v = vectors.where(where) if where is not None else vectors
    found = nearest(queries, v, k, metric) if serves(queries, v, metric) else pairs(queries, v, metric)
    return top_k(found, k, metric).select("query_id", "rank", "vec_id", "distance")


def knn_label(queries: DataFrame, vectors: DataFrame, access: DataFrame, k: int, label: int, metric: str = "l2") -> DataFrame:
    """Exact kNN within one label."""
    ids = access.where(F.col("label") == label).select("vec_id").distinct()
    return knn(queries, vectors.join(ids, "vec_id", "left_semi"), k, metric)


def knn_by_label(queries: DataFrame, query_labels: DataFrame, vectors: DataFrame, access: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """For each (query, label of the query) the k nearest vectors with the label. query_labels(query_id, label)."""
    f, _ = metric_of(metric)
    wanted = query_labels.join(queries, "query_id")
    holders = access.join(F.broadcast(query_labels.select("label").distinct()) if query_labels.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else query_labels.select("label").distinct(), "label", "left_semi").join(vectors, "vec_id")
    if serves(wanted, holders, metric):
        found = nearest(wanted, holders, k, metric, group="label", own=True)
    else:
        found = holders.join(wanted.withColumnRenamed("embedding", "_q"), "label").select("query_id", "label", "vec_id", f("_q", "embedding").alias("distance"))
    return top_k(found, k, metric, ("query_id", "label")).select("query_id", "label", "rank", "vec_id", "distance")


def knn_formula(queries: DataFrame, wide: DataFrame, k: int, formula: str, metric: str = "l2", universe: str = "labelled") -> DataFrame:
    """Exact kNN over vectors whose labels satisfy a formula. wide(vec_id, embedding, labels)."""
    return knn(queries, wide, k, metric, to_column(formula, "labels", universe))


def knn_formulas(queries: DataFrame, wide: DataFrame, formulas: dict[int, str], k: int, metric: str = "l2", universe: str = "labelled") -> DataFrame:
    """(pred_id, query_id, rank, vec_id, distance, selectivity) for every formula and query; distances are computed once."""
    hits = F.array(*(F.when(to_column(f, "labels", universe), F.lit(i)) for i, f in sorted(formulas.items())))
    held = wide.withColumn("_preds", F.array_compact(hits)).where(F.size("_preds") > 0)
    found = pairs(queries, held, metric, keep=("_preds",)).select("query_id", "vec_id", "distance", F.explode("_preds").alias("pred_id"))
    share = selectivities(wide, formulas, universe)
    return top_k(found, k, metric, ("pred_id", "query_id")).join(F.broadcast(share), "pred_id").select("pred_id", "query_id", "rank", "vec_id", "distance", "selectivity")


def selectivities(wide: DataFrame, formulas: dict[int, str], universe: str = "labelled") -> DataFrame:
    """(pred_id, qualified, selectivity) in one scan."""
    counts = wide.agg(*(F.count_if(to_column(f, "labels", universe)).alias(f"p{i}") for i, f in sorted(formulas.items())), F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("pred_id"), F.col(f"p{i}").alias("qualified")) for i in sorted(formulas))))
    return counts.select(each.alias("x"), "n").select("x.pred_id", "x.qualified", (F.col("x.qualified") / F.col("n")).alias("selectivity"))


def knn_ids(queries: DataFrame, vectors: DataFrame, ids: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact kNN restricted to a table of ids; unknown ids are skipped."""
    return knn(queries, vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi"), k, metric)


def knn_candidates(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """kNN among each query's own candidates(query_id, vec_id)."""
    f, _ = metric_of(metric)
    met = candidates.distinct().join(queries.withColumnRenamed("embedding", "_q"), "query_id").join(vectors, "vec_id")
    return top_k(met.select("query_id", "vec_id", f("_q", "embedding").alias("distance")), k, metric).select("query_id", "rank", "vec_id", "distance")


def range_search(queries: DataFrame, vectors: DataFrame, radius: float, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """Strictly nearer than ``radius``: below it for distances, above it for similarities."""
    v = vectors.where(where) if where is not None else vectors
    found = pairs(queries, v, metric)
    return found.where(F.col("distance") > radius if metric_of(metric)[1] else F.col("distance") < radius)


def range_max_results(queries: DataFrame, vectors: DataFrame, limit: int, metric: str = "l2") -> DataFrame:
    """Range search with the largest radius that keeps the total at ``limit`` or less, ties at the radius left out."""
    found = pairs(queries, vectors, metric)
    sign = -1 if metric_of(metric)[1] else 1
    cut = found.select((F.col("distance") * sign).alias("d")).orderBy("d").limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r"))
    return found.crossJoin(F.broadcast(cut)).where((F.col("n") <= limit) | (F.col("distance") * sign < F.col("r"))).drop("n", "r")


def block_pairs(vectors: DataFrame, blocks: int = 16) -> DataFrame:
    """Every row with every row of the same table, block against block by an equi-join: query_id and _q beside the row's own columns."""
    own = [c for c in vectors.columns if c != "vec_id"]
    left = vectors.select(F.col("vec_id").alias("query_id"), F.col(own[0]).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return left.join(vectors.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "_block").drop("_block")


def knn_graph(vectors: DataFrame, k: int, metric: str = "l2", blocks: int = 16) -> DataFrame:
    """kNN of every vector among the others."""
    f, _ = metric_of(metric)
    own = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    if serves(own, vectors, metric):
        return top_k(nearest(own, vectors, k, metric, others=True), k, metric).select("query_id", "rank", "vec_id", "distance")
    met = block_pairs(vectors.select("vec_id", "embedding"), blocks).where("query_id <> vec_id").select("query_id", "vec_id", f("_q", "embedding").alias("distance"))
    return top_k(met, k, metric).select("query_id", "rank", "vec_id", "distance")


def nn_descent(vectors: DataFrame, k: int, metric: str = "l2", rounds: int = 12, settled: float = 0.001, pool: int | None = None, recall: float = 0.9) -> DataFrame:
    """An approximate kNN graph (query_id, rank, vec_id, distance): neighbours of neighbours, both ways, are tried in rounds.

    Starts from random others and holds the ``pool`` nearest found (``k`` at least; by default 30, more for many vectors),
    of which k are returned; rounds end when fewer than ``settled`` of the entries change. Ids are taken as unique.
    Candidates are tried block by block (``descent``) where ``nearest`` serves the metric. There the nearest of a thousand
    vectors are found by brute force as well; while less than ``recall`` of them are in the graph, by a hundredth to spare,
    rounds go on with a pool half as large again. Elsewhere a round joins the graph with itself and with the vectors, each on
    an id, and recall is not measured. A round's work grows with the rows and the square of the pool.
    """
    n = vectors.count()
    wanted, k = k, max(k, pool or max(30, math.ceil(2 * n**0.3)))
    numbered = cut(vectors.select("vec_id", "embedding", (F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")) * 64 + F.pmod(F.xxhash64("vec_id"), F.lit(64))).alias("_at")))
    ids = numbered.select("vec_id", "_at")
    drawn = ids.select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("_k"), "_at")
    # the next places in a random order, within one part of it and in the parts beside it
    drawn = drawn.select("query_id", F.when(F.col("_k") <= k, F.col("_at") + 64 * F.col("_k")).otherwise(F.col("_at") + F.col("_k") - k).alias("_at"))
    pairs_ = drawn.join(ids, "_at").select("query_id", "vec_id").where("query_id <> vec_id")
    first = pairs_.unionByName(pairs_.select(F.col("vec_id").alias("query_id"), F.col("query_id").alias("vec_id")))
    own = numbered.select("vec_id", "embedding").where("vec_id is not null")
    if serves(own.select(F.col("vec_id").alias("query_id"), "embedding"), own, metric):
        graph = _descend(own, first, wanted, k, n, metric, rounds, settled, recall)
    else:
        graph = _descend_joined(vectors, first, k, metric, rounds, settled * n * k)
    return graph.where(F.col("rank") <= wanted)


def _some_back(graph: DataFrame, k: int) -> DataFrame:
    """The other way a vector can have many neighbours: as many as it has the one way take part."""
    back = graph.select(F.col("vec_id").alias("query_id"), F.col("query_id").alias("vec_id"))
    return back.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("_r") <= k).drop("_r")


def _descend(vectors: DataFrame, first: DataFrame, wanted: int, k: int, n: int, metric: str, rounds: int, settled: float, recall: float) -> DataFrame:
    slices, columns = slices_of(vectors), ("query_id", "rank", "vec_id", "distance")
    none = F.array().cast(T.ArrayType(vectors.schema["vec_id"].dataType))
    lists = first.groupBy("query_id").agg(F.collect_set("vec_id").alias("fresh")).withColumn("stale", none)
    found, sides = tried(vectors, lists, None, k, metric, slices)
    graph = cut(top_k(found, k, metric).select(*columns, F.lit(False).alias("old")))
    probes = cut(vectors.withColumnRenamed("vec_id", "query_id").orderBy(F.xxhash64("query_id", F.lit(2)), "query_id").limit(PROBES))
    truth = cut(top_k(nearest(probes, vectors, wanted, metric, others=True), wanted, metric).groupBy("query_id").agg(F.max_by("distance", "rank").alias("_last"), F.count(F.lit(1)).alias("_n")))
    while True:
        before = None
        for _ in range(rounds):
            let_go(vectors.sparkSession, sides)
            now = graph.select("query_id", "vec_id").unionByName(_some_back(graph, k)).groupBy("query_id").agg(F.collect_set("vec_id").alias("_now"))
            if before is None:
                lists = now.select("query_id", F.col("_now").alias("fresh"), none.alias("stale"))
            else:
                was = before.select("query_id", F.concat("fresh", "stale").alias("_was"))
                lists = now.join(was, "query_id", "left").withColumn("_was", F.coalesce("_was", none))
                lists = lists.select("query_id", F.array_except("_now", "_was").alias("fresh"), F.array_intersect("_now", "_was").alias("stale"))
            lists = cut(lists)
            last = graph.where(F.col("rank") == k).select("query_id", F.col("distance").alias("last"))
            found, sides = tried(vectors, lists, last, k, metric, slices)
            # a distance is the same both ways, so what leads to a vector is not measured again
            back = top_k(graph.select(F.col("vec_id").alias("query_id"), F.col("query_id").alias("vec_id"), "distance"), k, metric).drop("rank")
            met = graph.select("query_id", "vec_id", "distance", F.lit(True).alias("old")).unionByName(back.unionByName(found).withColumn("old", F.lit(False)))
            met = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("distance").alias("distance"), F.max("old").alias("old"))
            graph, before = cut(top_k(met, k, metric).select(*columns, "old")), lists
            if graph.where("not old").count() <= settled * n * k:
                break
        let_go(vectors.sparkSession, sides)
        sides = []
        # of equally near vectors any will do
        beyond = F.col("distance") < F.col("_last") if metric_of(metric)[1] else F.col("distance") > F.col("_last")
        hits = graph.where(F.col("rank") <= wanted).join(F.broadcast(truth), "query_id").where(F.col("_last").isNull() | (F.col("distance").isNotNull() & ~beyond)).count()
        entries = truth.agg(F.sum("_n")).first()[0] or 0
        if hits >= min(1.0, recall + 0.01) * entries or k >= n - 1:
            return graph.select(*columns)
        k += (k + 1) // 2


def _descend_joined(vectors: DataFrame, first: DataFrame, k: int, metric: str, rounds: int, few: float) -> DataFrame:
    f, _ = metric_of(metric)

    def kept(found: DataFrame) -> DataFrame:
        met = found.where("query_id <> vec_id").distinct().join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
        return cut(top_k(met.select("query_id", "vec_id", f("_q", "embedding").alias("distance")), k, metric).select("query_id", "rank", "vec_id", "distance"))

    graph = kept(first)
    for _ in range(rounds):
        near = graph.select("query_id", "vec_id")
        back = near.select(F.col("vec_id").alias("query_id"), F.col("query_id").alias("vec_id"))
        both = cut(near.unionByName(_some_back(graph, k)).distinct())
        far = both.join(both.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("_next")), "vec_id").select("query_id", F.col("_next").alias("vec_id"))
        new = kept(near.unionByName(back).unionByName(far))
        changed = new.select("query_id", "vec_id").exceptAll(near).count()
        graph = new
        if changed <= few:
            break
    return graph


def random_results(queries: DataFrame, vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """A baseline: k vectors for each query by a hash of both ids."""
    q = queries.select("query_id")
    both = vectors.select("vec_id").crossJoin(F.broadcast(q) if fits(queries) else q)
    drawn = both.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("vec_id").cast("string"))))
    return drawn.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_h", "vec_id"))).where(F.col("rank") <= k).drop("_h")


def assign(queries: DataFrame, vectors: DataFrame, k: int = 1, metric: str = "l2") -> DataFrame:
    return knn(queries, vectors, k, metric).select("query_id", "rank", "vec_id")


def reconstruct(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("vec_id").join(vectors.select("vec_id", "embedding"), "vec_id")


def search_and_reconstruct(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    return knn(queries, vectors, k, metric).join(vectors.select("vec_id", "embedding"), "vec_id")


def merge_results(shards: list[DataFrame], k: int, metric: str = "l2", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """k-way merge of shard results; padding rows (negative ids) are skipped."""
    out = shards[0].drop("rank")
    for s in shards[1:]:
        out = out.unionByName(s.drop("rank"))
    return top_k(out.where("vec_id >= 0"), k, metric, by)


def pad_results(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows a query: missing ones have vec_id -1 and an infinite distance."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(results, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("vec_id", F.lit(-1).cast("long")).alias("vec_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def refine(base: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact re-ranking of a first, approximate result."""
    return knn_candidates(base.select("query_id", "vec_id"), queries, vectors, k, metric)
