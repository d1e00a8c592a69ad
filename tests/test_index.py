"""The index interface and its factory."""

import os
import subprocess
import sys

import pytest

from labelsift.operators import clusters as C
from labelsift.operators import search as S
from labelsift.operators.evaluate import same_up_to_draws
from labelsift.plans.fixtures import Tables
from labelsift.plans.index import FilteredIndex, SearchParams, autotune, code_size, parse_spec, spec_text


@pytest.mark.parametrize("text", ["Flat", "IVF16,Flat", "PCA32,IVF64,SQ8,RFlat", "L2norm,PQ8,IDMap", "Pad80,Flat"])
def test_specs_round_trip(text):
    assert spec_text(parse_spec(text)) == text


@pytest.mark.parametrize("text", ["", "HNSW32", "IVF16", "Flat,SQ8", "IMI2x8,Flat"])
def test_other_specs_are_refused(text):
    with pytest.raises(ValueError):
        parse_spec(text)


def test_code_sizes():
    assert [code_size(parse_spec(t), 64) for t in ("Flat", "SQ8", "PQ8", "PCA32,Flat")] == [256, 64, 8, 128]


def test_verbs(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    i = FilteredIndex.train("Flat", t.v, t.a)
    assert same_up_to_draws(i.query(t.q, 5, 3), S.knn_label(t.q, t.v, t.a, 5, 3))
    assert i.query(t.q, 5, 999).count() == 0
    assert same_up_to_draws(i.query_formula(t.q, 5, "AND 3 NOT 31"), S.knn_formula(t.q, t.wide, 5, "AND 3 NOT 31"))
    pairs = t.a.where("label = 3")
    gone = i.revoke(pairs, 1)
    assert gone.query(t.q, 5, 3).count() == 0
    assert same_up_to_draws(gone.grant(pairs, 2).query(t.q, 5, 3), i.query(t.q, 5, 3))
    assert same_up_to_draws(i.materialize_formula("OR 3 12", 500, 3).query(t.q, 5, 500), i.query_formula(t.q, 5, "OR 3 12"))
    less = i.delete(t.v.where("vec_id < 50").select("vec_id"))
    assert less.query_unfiltered(t.q, 5).where("vec_id < 50").count() == 0 and less.create(t.v.where("vec_id < 50")).duplicates().count() == 0
    i.save(f"{tmp_path}/i")
    assert same_up_to_draws(FilteredIndex.load(spark, f"{tmp_path}/i").query(t.q, 5, 3), i.query(t.q, 5, 3))


def test_clustered_index(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    i = FilteredIndex.train("IVF8,Flat", t.v, t.a, rounds=1)
    truth = S.knn(t.q, t.v, 5)
    assert same_up_to_draws(i.query_unfiltered(t.q, 5, SearchParams(nprobe=8)), truth)
    tuned = autotune(i, t.q, truth, 5, [1, 4, 8])
    assert tuned[-1][1] == 1.0 and [r for _, r in tuned] == sorted(r for _, r in tuned)
    i.save(f"{tmp_path}/i")
    assert FilteredIndex.load(spark, f"{tmp_path}/i").query(t.q, 5, 31, SearchParams(nprobe=8)).groupBy("query_id").count().where("count = 5").count() == t.q.count()


def test_clustered_searches_hold_no_pairs_as_rows(spark, sf_dir):
    """every pair of a query and a vector of its probes was sorted as a row."""
    t = Tables(spark, sf_dir)
    got = C.ivf_search(t.q, C.assign_clusters(t.v, t.c), t.c, 5, 16)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert same_up_to_draws(got, S.knn(t.q, t.v, 5))


#: Run by itself: only a new session's columns have small numbers, here each of 0 to 23 in turn.
LOW = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from labelsift.operators import clusters as C

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
low = [spark.read.schema("embedding array<float>").parquet(f"{sys.argv[1]}/embeddings.parquet") for _ in range(24)]
c = spark.range(3).select(F.col("id").alias("cluster_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("centroid"))
a, b = c.withColumnRenamed("cluster_id", "n1"), c.select(F.lit(0).cast("long").alias("n1"), F.col("cluster_id").alias("n2"), "centroid")
bad = {}
for v in low:
    placed = {"clusters": C.assign_clusters(v, c).where("cluster_id is not null"), "tree": C.assign_tree(v, a, b).where("n2 is not null"), "grown": C._in_node(v.withColumn("path", F.lit("0")), b.select(F.col("n1").cast("string").alias("parent"), F.col("n2").alias("child"), "centroid")).where("path <> ''")}
    for name, d in placed.items():
        if "!" in d._jdf.queryExecution().optimizedPlan().toString():  # Spark's mark of an operator whose input lacks a column
            bad.setdefault(name, []).append(v._jdf.queryExecution().analyzed().output().head().exprId().id())
print("lacking:", bad)
"""


def test_small_column_numbers(sf_dir):
    """F1 of the third round: where the vectors' column had the number of a lambda's variable, a predicate went to the centroids."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", LOW, sf_dir], env=env, capture_output=True, text=True, timeout=300)
    assert "lacking: {}" in done.stdout, done.stdout + done.stderr[-2000:]


def test_no_centroids_no_cluster(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert C.assign_clusters(t.v, t.c.limit(0)).isEmpty()
    assert C.assign_clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"), t.c).select("cluster_id", "cluster_distance").collect() == [(0, None)]


def test_coded_and_transformed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    truth = S.knn(t.q, t.v, 5)
    assert same_up_to_draws(FilteredIndex.train("SQ8,RFlat", t.v, t.a).query_unfiltered(t.q, 5), truth)
    assert same_up_to_draws(FilteredIndex.train("PCA64,Flat", t.v, t.a).query_unfiltered(t.q, 5), truth, 4)
    assert same_up_to_draws(FilteredIndex.train("Pad80,Flat", t.v, t.a).query_unfiltered(t.q, 5), truth, 4)
