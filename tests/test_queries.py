"""Every registered engine query against its SQL."""

import numpy as np
import pytest
from oracle import differences

import labelsift.plans.extra  # noqa: F401
from labelsift.operators import descent
from labelsift.operators import search as S
from labelsift.plans.queries import ORACLE, QUERIES


#: Approximate, so tested for recall instead.
NO_SQL = {"nndescent"}


def test_all_have_sql():
    assert QUERIES.keys() == ORACLE.keys() | NO_SQL


def test_nn_descent_recall(spark, sf_dir, duck):
    got = {(r.query_id, r.vec_id) for r in QUERIES["nndescent"](spark, sf_dir).collect()}
    assert len(got) == 10 * duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    exact = {(q, v) for q, r, v, _ in duck.sql(ORACLE["knn_graph"]).fetchall()}
    assert len(got & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_nn_descent_in_blocks(spark, monkeypatch, metric):
    """Block by block, in one slice and in several, the graph is the one of the plan that joins candidates with vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 360)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [1.0, 2.0]), (403, [1.0, 2.5]), (404, [1e200] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def run(**options):
        return sorted(map(tuple, S.nn_descent(v, 5, metric, rounds=4, pool=8, recall=0.0, **options).collect()), key=str)

    whole = run()
    monkeypatch.setattr(descent, "SLICE_FLOATS", 1_000)
    assert run() == whole and len(whole) == 5 * len(rows)
    monkeypatch.setattr(S, "serves", lambda *a: False)
    assert run() == whole


def test_nn_descent_reaches_recall(spark):
    """A pool too small for vectors without clusters grows until brute force on some of them agrees."""
    x = np.random.default_rng(6).normal(size=(1500, 40))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in S.nn_descent(v, 10, pool=10).collect()}
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    exact = {(i, int(j)) for i, r in enumerate(d.argsort(1)[:, :10]) for j in r}
    assert len(got & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == ""


def test_entry_point():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
