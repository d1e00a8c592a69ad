"""Predicates, states, codecs, files, streams and the index interface."""

import itertools
import struct

import pytest
from pyspark.sql import functions as F

from labelsift.functions import predicates as P
from labelsift.functions import vectors as V
from labelsift.operators import clusters as C
from labelsift.operators import codecs as K
from labelsift.operators import evaluate as E
from labelsift.operators import prepare as R
from labelsift.operators import search as S
from labelsift.plans.fixtures import FORMULAS, Tables
from labelsift.sources import files
from labelsift.streaming import access_log


@pytest.mark.parametrize("bad", ["", "AND 1", "AND 1 2 3", "NOT", "XOR 1 2", "1 2"])
def test_malformed_formulas(bad):
    with pytest.raises(ValueError):
        P.parse(bad)


def formulas(depth):
    if depth == 0:
        return ["0", "1", "2"]
    less = formulas(depth - 1)
    return less + [f"NOT {a}" for a in less[:4]] + [f"{op} {a} {b}" for op in ("AND", "OR") for a, b in itertools.product(less[:4], repeat=2)]


@pytest.mark.parametrize("universe", ["labelled", "all"])
def test_truth_tables(spark, universe):
    sets = [list(s) for n in range(4) for s in itertools.combinations(range(3), n)]
    fs = formulas(2)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, labels array<int>")
    rows = df.select("i", *(P.to_column(f, "labels", universe).alias(f"f{k}") for k, f in enumerate(fs))).collect()
    for r in rows:
        for k, f in enumerate(fs):
            assert r[f"f{k}"] == P.evaluate(f, sets[r.i], universe)


def test_null_labels_qualify_nowhere(spark):
    df = spark.createDataFrame([(None,)], "labels array<int>")
    assert df.where(P.to_column("NOT 3")).count() == 0
    assert df.where(P.to_column("NOT 3", universe="all")).count() == 1


def test_states_match_sets():
    universe, sets = frozenset(range(4)), [frozenset(s) for n in range(5) for s in itertools.combinations(range(4), n)]

    def of(s):
        return P.State.make("SOME", s)

    def members(x):
        return {"NONE": frozenset(), "ALL": universe, "SOME": x.ids, "MOST": universe - x.ids}[x.kind]

    for a, b in itertools.product(sets, repeat=2):
        for x, y in itertools.product((of(a), ~of(universe - a)), (of(b), ~of(universe - b))):
            assert members(x & y) == a & b and members(x | y) == a | b and members(~x) == universe - a


def test_unknown_state():
    u = P.State("UNKNOWN")
    assert (u & P.State("NONE")).kind == "NONE" and (u | P.State("ALL")).kind == "ALL" and (u & P.State("ALL")).kind == "UNKNOWN"


def test_fewer_than_k_and_padding(spark, sf_dir):
    t = Tables(spark, sf_dir)
    few = t.v.where("vec_id < 3")
    got = S.knn(t.q, few, 5)
    assert got.groupBy("query_id").count().where("count <> 3").count() == 0
    padded = S.pad_results(got, t.q, 5)
    assert padded.where("vec_id = -1").count() == 2 * t.q.count()


def test_blocks_equal_broadcast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = S.pairs(t.q, t.v, bounded=True).select("query_id", "vec_id", F.round("distance", 9))
    b = S.pairs(t.q, t.v, bounded=False).select("query_id", "vec_id", F.round("distance", 9))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_all_probes_are_exact_and_recall_grows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    own, truth = C.assign_clusters(t.v, t.c), S.knn(t.q, t.v, 10)
    assert E.same_up_to_draws(C.ivf_search(t.q, own, t.c, 10, 16), truth)
    recalls = [E.recall(C.ivf_search(t.q, own, t.c, 10, n), truth).agg(F.avg("recall")).first()[0] for n in (1, 4, 16)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_short_lists_hold_each_pair_once(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lists = C.short_lists(C.assign_tree(t.v, t.l1, t.l2), t.a, 10)
    assert lists.count() == t.a.count() == lists.select("label", "vec_id").distinct().count()
    assert lists.groupBy("label", "level", "path").count().where("count > 10 and level < 2").count() == 0


def test_kmeans_lowers_the_error(spark, sf_dir):
    t = Tables(spark, sf_dir)
    error = lambda c: C.assign_clusters(t.v, c).agg(F.sum("cluster_distance")).first()[0]
    assert error(C.kmeans(t.v, t.c, 2)) < error(t.c)


def test_scalar_codec_round_trip(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lim = K.sq_limits(t.v)
    back = K.sq_decode(K.sq_encode(t.v, lim), lim).withColumnRenamed("embedding", "e2")
    assert t.v.join(back, "vec_id").agg(F.max(V.linf("embedding", "e2"))).first()[0] < 0.01


def test_pca_axes_are_orthonormal(spark, sf_dir):
    import numpy as np

    values, axes = K.pca(Tables(spark, sf_dir).v)
    assert (np.diff(values) <= 1e-12).all() and np.allclose(axes @ axes.T, np.eye(len(axes)))


def test_vector_files(spark, tmp_path):
    rows = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.5]]
    (tmp_path / "a.fvecs").write_bytes(files.encode_vectors(rows))
    (tmp_path / "a.ivecs").write_bytes(files.encode_vectors([[1, 2], [3, 4]], "ivecs"))
    (tmp_path / "a.u8").write_bytes(struct.pack("<2I", 2, 3) + bytes([0, 1, 2, 253, 254, 255]))
    (tmp_path / "a.spmat").write_bytes(struct.pack("<3q", 2, 9, 3) + struct.pack("<3q", 0, 2, 3) + struct.pack("<3i", 4, 5, 8) + struct.pack("<3f", 1, 1, 2))
    assert [r.embedding for r in files.read_vectors(spark, f"{tmp_path}/a.fvecs").orderBy("vec_id").collect()] == rows
    assert [r.embedding for r in files.read_vectors(spark, f"{tmp_path}/a.ivecs", "ivecs").orderBy("vec_id").collect()] == [[1, 2], [3, 4]]
    assert [r.embedding for r in files.read_u8bin(spark, f"{tmp_path}/a.u8").orderBy("vec_id").collect()] == [[0, 1, 2], [253, 254, 255]]
    assert [tuple(r) for r in files.read_sparse(spark, f"{tmp_path}/a.spmat").orderBy("vec_id", "label").collect()] == [(0, 4, 1.0), (0, 5, 1.0), (1, 8, 2.0)]


def test_splits(spark, sf_dir):
    v = Tables(spark, sf_dir).v
    for share in (0.0, 0.2, 0.7, 1.0):
        train, test = R.split(v, share)
        n = int(v.count() * (1 - share))
        assert train.count() == n and test.count() == v.count() - n
        assert train.join(test, "vec_id").count() == 0


def test_log_stream(spark, tmp_path):
    rows = [(1, "a", "grant", "2024-01-01 00:00:00", 1), (1, "a", "revoke", "2024-01-01 00:01:00", 2), (2, "a", "grant", "2024-01-01 00:02:00", 3)]
    log = spark.createDataFrame(rows, "vec_id long, label string, op string, t string, seq long").withColumn("ts", F.to_timestamp("t")).drop("t")
    log.repartition(1).write.parquet(f"{tmp_path}/in/part=0")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in/part=0")
    access_log.follow(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in access_log.followed(spark, f"{tmp_path}/out").collect()] == [(2, "a")]


def test_templates():
    got = P.fill_templates(["NOT {0}", "AND {0} {1}"], list(range(9)), 5)
    assert len(got) == 10 and all(P.parse(f) for f in got)


def test_bulk_formulas_agree(spark, sf_dir):
    w = Tables(spark, sf_dir).wide
    for f in FORMULAS.values():
        both = w.crossJoin(spark.createDataFrame([(f,)], "formula string"))
        assert both.where(P.evaluate_table(both) != P.to_column(f)).count() == 0


def test_resample_and_random_access(spark, sf_dir):
    v = Tables(spark, sf_dir).v
    got = R.resample(v, 300)
    assert got.count() == 300 and got.agg(F.min("new_id"), F.max("new_id")).first() == (0, 299)
    assert got.join(v, "vec_id", "left_anti").count() == 0 and got.select("vec_id").distinct().count() < 300
    n = R.random_access(v, 20, 0.3).count() / (v.count() * 20)
    assert abs(n - 0.3) < 0.03
    levels = R.selectivity_labels(v, 3, 2).groupBy("label").count().orderBy("label").collect()
    assert [round(r["count"] / v.count(), 1) for r in levels][-2:] == [1.0, 1.0]
    assert R.share_degree(Tables(spark, sf_dir).a, 6, 50).agg(F.max("label")).first()[0] < 50


def test_numbering_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 3).alias("k")).repartition(7)
    got = R.append_ids(rows, "k", "vec_id", spark.range(10).withColumnRenamed("id", "vec_id")).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(10, 5010)) and [r.k for r in got] == list(range(0, 15000, 3))
