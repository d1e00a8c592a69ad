"""Derived tables that the engine's own queries share, as Spark DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formulas over the derived labels, by number.
FORMULAS = {0: "3", 1: "NOT 3", 2: "AND 3 31", 3: "OR 3 12", 4: "AND 3 NOT 31", 5: "OR 3 NOT 31", 6: "AND OR 3 4 NOT 31", 7: "NOT AND 3 31", 8: "AND 1 OR NOT 0 2", 9: "999"}


class Tables:
    """The tables below ``sf_dir``, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def v(self) -> DataFrame:
        return self.embeddings.select("vec_id", "embedding")

    @property
    def q(self) -> DataFrame:
        return self.embeddings.where("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), "embedding")

    @property
    def a(self) -> DataFrame:
        labels = F.array(F.col("label"), (F.col("vec_id") * 7 + 3) % 16 + 10, (F.col("vec_id") * F.col("vec_id")) % 5 + 30)
        return self.embeddings.where("vec_id % 11 <> 0").select("vec_id", F.explode(F.array_distinct(labels.cast("array<int>"))).alias("label"))

    @property
    def wide(self) -> DataFrame:
        labels = F.array_distinct(F.array(F.col("label"), (F.col("vec_id") * 7 + 3) % 16 + 10, (F.col("vec_id") * F.col("vec_id")) % 5 + 30).cast("array<int>"))
        return self.embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<int>")).otherwise(labels).alias("labels"))

    @property
    def c(self) -> DataFrame:
        return self.embeddings.where("vec_id < 16").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))

    @property
    def l1(self) -> DataFrame:
        return self.embeddings.where("vec_id < 4").select(F.col("vec_id").alias("n1"), F.col("embedding").alias("centroid"))

    @property
    def l2(self) -> DataFrame:
        return self.embeddings.where("vec_id between 16 and 31").select(F.floor((F.col("vec_id") - 16) / 4).cast("long").alias("n1"), F.col("vec_id").alias("n2"), F.col("embedding").alias("centroid"))


def _dot(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


X, Y = "z[1]::double", "z[2]::double"


def l2sq_sql(a: str, b: str) -> str:
    return _dot(a, b, f"({X}-{Y})*({X}-{Y})")


#: DuckDB forms of the same tables.
CTE = {
    "v": "v AS (SELECT vec_id, embedding FROM embeddings)",
    "q": "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 1)",
    "a": "a AS (SELECT DISTINCT vec_id, label FROM (SELECT vec_id, unnest([label, ((vec_id*7+3)%16+10)::int, ((vec_id*vec_id)%5+30)::int]) AS label FROM embeddings WHERE vec_id % 11 <> 0))",
    "wide": "wide AS (SELECT vec_id, embedding, CASE WHEN vec_id % 11 = 0 THEN []::int[] ELSE list_distinct([label, ((vec_id*7+3)%16+10)::int, ((vec_id*vec_id)%5+30)::int]) END AS labels FROM embeddings)",
    "c": "c AS (SELECT vec_id AS cluster_id, embedding AS centroid FROM embeddings WHERE vec_id < 16)",
    "asg": f"asg AS (SELECT vec_id, embedding, cluster_id, d AS cluster_distance FROM (SELECT vec_id, v.embedding, cluster_id, {l2sq_sql('v.embedding', 'centroid')} AS d FROM embeddings v, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1)",
    "pr": f"pr AS (SELECT query_id, embedding, cluster_id, probe FROM (SELECT query_id, embedding, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY {l2sq_sql('embedding', 'centroid')}, cluster_id) AS probe FROM q, c) WHERE probe <= 4)",
    "l1": "l1 AS (SELECT vec_id AS n1, embedding AS centroid FROM embeddings WHERE vec_id < 4)",
    "l2": "l2 AS (SELECT ((vec_id - 16) // 4)::bigint AS n1, vec_id AS n2, embedding AS centroid FROM embeddings WHERE vec_id BETWEEN 16 AND 31)",
    "t1": f"t1 AS (SELECT vec_id, embedding, n1 FROM (SELECT vec_id, v.embedding, n1, {l2sq_sql('v.embedding', 'centroid')} AS d FROM embeddings v, l1) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n1) = 1)",
    "leaf": f"leaf AS (SELECT vec_id, embedding, n1, n2 FROM (SELECT vec_id, t1.embedding, t1.n1, n2, {l2sq_sql('t1.embedding', 'centroid')} AS d FROM t1 JOIN l2 USING (n1)) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n2) = 1)",
}
NEEDS = {"asg": ["c"], "pr": ["q", "c"], "t1": ["l1"], "leaf": ["l1", "l2", "t1"]}


def sql(body: str, *names: str) -> str:
    """``body`` under the named tables and those that they need."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    return f"WITH {', '.join(CTE[n] for n in wanted)} {body}" if wanted else body
