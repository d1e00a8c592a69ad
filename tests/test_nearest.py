"""The block-wise k nearest against pairs measured one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelsift.functions import vectors as V
from labelsift.operators import evaluate as E
from labelsift.operators import nearest as N
from labelsift.operators import search as S
import labelsift.plans.extra  # noqa: F401
from labelsift.plans.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def odd_vectors(d: int, n: int = 300):
    """Copies, near ties, nulls, other lengths, non-finite components, repeated ids."""
    r = random.Random(d)
    rows = [(i, [r.choice([0.0, 0.1, 0.2, 1e-9, r.random()]) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(40)] + [(5, [0.5] * d), (5, [0.5] * d), (6, list(rows[6][1]))]
    rows += [(900, None), (901, [None] * d), (902, []), (903, [0.1] * (d + 1)), (904, [math.nan] * d), (905, [math.inf] * d), (906, [1e200] * d), (907, None)]
    return rows


def expected(queries, vectors, k, others, larger=False):
    met = queries.withColumn("_p", F.monotonically_increasing_id()).crossJoin(vectors.withColumnRenamed("embedding", "_v"))
    met = met.where("query_id <> vec_id") if others else met
    f = V.inner_product if larger else V.l2
    if vectors.where("vec_id = 0 and size(embedding) = 1").count():  # the difference itself
        f = lambda x, y: F.when((F.size(x) == 1) & (F.size(y) == 1), F.abs(F.get(x, F.lit(0)) - F.get(y, F.lit(0)))).otherwise(V.l2(x, y))
    return S.top_k(met.select("query_id", "vec_id", f("embedding", "_v").alias("distance")), k, "ip" if larger else "l2")


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, repr(r.distance)) for r in df.select("query_id", "rank", "vec_id", "distance").collect())


@pytest.mark.parametrize("d", [1, 2, 9])
@pytest.mark.parametrize("others", [False, True])
def test_odd_rows(spark, d, others):
    v = spark.createDataFrame(odd_vectors(d), SCHEMA).repartition(3)
    q = v.where("vec_id % 7 = 5 or vec_id >= 900").withColumnRenamed("vec_id", "query_id")
    for k in (1, 4):
        want = rows(expected(q, v, k, others))
        for slices, prune in ((1, True), (3, False)):
            assert rows(S.top_k(N.nearest(q, v, k, others=others, slices=slices, prune=prune), k)) == want


def test_inner_products_and_few_rows(spark):
    v = spark.createDataFrame(odd_vectors(5), SCHEMA).where("vec_id < 900")
    q = v.where("vec_id % 7 = 5").withColumnRenamed("vec_id", "query_id")
    assert rows(S.knn(q, v, 4, "ip")) == rows(expected(q, v, 4, False, True))
    few = v.where("vec_id < 3")
    assert rows(S.knn(q, few, 10)) == rows(expected(q, few, 10, False))
    assert S.knn(q.limit(0), v, 3).count() == 0 == S.knn(q, v.limit(0), 3).count()


def test_many_copies(spark):
    v = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.25), F.lit(0.5), (F.col("id") % 2).cast("double")).alias("embedding")).repartition(4)
    got = S.knn(v.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), v, 3)
    assert {(r.query_id, r.rank): r.vec_id for r in got.collect()} == {(q, k): 2 * (k - 1) + q % 2 for q in range(3) for k in (1, 2, 3)}


def test_no_pairs_as_rows(spark, sf_dir):
    """pairs once stood as rows in a join, whose count is the square of the vectors'."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    for plan in (S.knn_graph(v, 3), S.knn(v.withColumnRenamed("vec_id", "query_id"), v, 3)):
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_by_label_no_pairs_as_rows(spark):
    """every pair of query and holder of a label stood as a row of a join with one key for each label."""
    v = spark.createDataFrame(odd_vectors(5), SCHEMA)
    a = v.select("vec_id", F.explode(F.array(F.col("vec_id") % 2, F.lit(7))).alias("label"))
    wanted = a.where("vec_id % 7 = 3").select(F.col("vec_id").alias("query_id"), "label").unionByName(spark.createDataFrame([(3, 99), (3, None)], "query_id long, label long"))
    q = v.where("vec_id % 7 = 3").withColumnRenamed("vec_id", "query_id")
    got = S.knn_by_label(q, wanted, v, a, 4)
    met = a.join(v, "vec_id").join(wanted.join(q.withColumnRenamed("embedding", "_q"), "query_id"), "label").select("query_id", "label", "vec_id", V.l2("_q", "embedding").alias("distance"))
    key = lambda df: sorted(map(repr, df.select("query_id", "label", "rank", "vec_id", "distance").collect()))
    assert key(got) == key(S.top_k(met, 4, by=("query_id", "label")))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_halves_meet_no_pairs_as_rows(spark, sf_dir):
    """every pair of halves stood as a row and was sorted."""
    assert "Cross" not in plan(QUERIES["split_vectors"](spark, sf_dir))


def test_signs_are_packed_once_a_row(spark, sf_dir):
    """both vectors of every pair were packed anew."""
    text = plan(QUERIES["dist_hamming"](spark, sf_dir))
    assert "shiftleft" in text and "shiftleft" not in text[: text.index("Join")]


def test_draws_compare_two_plans_found_once(spark, sf_dir, monkeypatch):
    """F8: pairs stood as rows, and each side was found twice."""
    monkeypatch.setattr(S, "pairs", None)
    assert QUERIES["agg_knn_draws"](spark, sf_dir).first().same
    one = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "query_id long, rank int, distance double")
    assert E.same_up_to_draws(one, one) and not E.same_up_to_draws(one, one.limit(1)) and not E.same_up_to_draws(one, one.unionByName(one))
