"""Quantisers, rotations and small k-means variants against brute force; vector files; changed indexes."""

import numpy as np
import pytest

from labelsift.operators import quantizers as Z
from labelsift.plans.index import FilteredIndex, SearchParams


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(3).standard_normal((60, 8))


@pytest.fixture
def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")


def test_product_codes(vectors, rows):
    books = Z.first_books(vectors, 2, 5)
    got = {r.vec_id: list(r.code) for r in Z.pq_encode(vectors, books).collect()}
    for i, v in enumerate(rows):
        want = [int(((np.array(b) - v[m * 4 : m * 4 + 4]) ** 2).sum(1).argmin()) for m, b in enumerate(books)]
        assert got[i] == want


def test_training_lowers_the_error(vectors, rows):
    def error(books):
        back = {r.vec_id: np.array(r.embedding) for r in Z.pq_decode(Z.pq_encode(vectors, books).select("vec_id", "code"), books).collect()}
        return sum(((rows[i] - v) ** 2).sum() for i, v in back.items())

    first = Z.first_books(vectors, 2, 5)
    assert error(Z.pq_train(vectors, first, 4)) < error(first)
    assert len(Z.rq_train(vectors, 2, 4, 2)) == 2


def test_rotations_are_orthonormal(vectors):
    for r in (Z.random_rotation(8), Z.itq(vectors, 3), Z.opq(vectors, 2, 4, 2)[0]):
        assert np.allclose(np.array(r) @ np.array(r).T, np.eye(8))


def test_rotations_better_than_random(vectors, rows):
    loss = lambda r: ((lambda y: ((y - np.sign(y)) ** 2).sum())(rows @ np.array(r).T))
    assert loss(Z.itq(vectors, 5)) < loss(Z.random_rotation(8))


def test_one_dimensional_is_optimal(spark):
    x = [1.0, 1.1, 1.2, 5.0, 5.1, 9.0, 9.5, None]
    got = Z.kmeans_1d(spark.createDataFrame([(v,) for v in x], "x double"), "x", 3)
    assert np.allclose(got, [1.1, 5.05, 9.25])
    assert Z.kmeans_1d(spark.createDataFrame([], "x double"), "x", 3) == []


def test_product_payload_searches(vectors, spark, tmp_path):
    access = spark.createDataFrame([(i, i % 2) for i in range(60)], "vec_id long, label int")
    index = FilteredIndex.train("PQ4,RFlat", vectors, access)
    index.save(str(tmp_path / "i"))
    q = vectors.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    got = FilteredIndex.load(spark, str(tmp_path / "i")).query_unfiltered(q, 1, SearchParams(k_factor=10)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 0), (1, 1), (2, 2)]


def test_vector_files_overwrite_and_refuse_nulls(spark, vectors, tmp_path):
    from labelsift.sources.table import register

    register(spark)
    path = str(tmp_path / "v")
    for _ in range(2):
        vectors.selectExpr("'' AS file", "vec_id", "cast(embedding as array<float>) AS embedding").write.format("vectorfile").mode("overwrite").save(path)
    assert spark.read.format("vectorfile").load(path).count() == 60
    with pytest.raises(Exception, match="null vector"):
        spark.sql("SELECT '' AS file, 1L AS vec_id, cast(null AS array<float>) AS embedding").write.format("vectorfile").mode("append").save(path)
    assert spark.read.format("vectorfile").load(path).count() == 60
