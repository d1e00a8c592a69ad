"""Registered queries of adaptive trees, further sources, baselines and reports, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import evaluate as E
from ..operators import search as S
from ..sources import datasets
from ..sources.table import register
from .fixtures import Tables, l2sq_sql, sql
from .index import FilteredIndex, autotune, code_size, parse_spec, spec_text
from .more import TOTAL, _files, _leaves, draw_sql, scratch, total
from .queries import knn_rows, query, r6, top

# --------------------------------------------------------------------- sources

_files("src_u8bin", "u8bin", lambda: F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 100).cast("int")), "floor(x::double * 100 + 100)")
_files("src_npy", "npy", lambda: F.col("embedding"), "x")
_files("src_pkl", "pkl", lambda: F.col("embedding").cast("array<double>"), "x")


@query("src_spmat", sql("SELECT label, count(*) AS n FROM a GROUP BY 1", "a"))
def _(t):
    register(t.spark)
    path = scratch(t, "spmat")
    t.wide.select(F.lit("").alias("file"), "vec_id", F.col("labels").alias("embedding")).write.format("vectorfile").option("kind", "spmat").mode("append").save(path)
    return datasets.files(t.spark, path, "spmat").select(F.explode("embedding").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _synthetic_sql(d: int) -> str:
    z = lambda k, j: f"{draw_sql('vec_id', str(k))} * {float((k + 1) * (j % 7 + 1) % 5 + 1)}"
    return " + ".join(f"sin({' + '.join(z(k, j) for k in range(4))})" for j in range(d))


query("src_synth", f"SELECT vec_id, round({_synthetic_sql(6)}, 4) AS total FROM (SELECT unnest(range(500)) AS vec_id)")(lambda t: datasets.synthetic(t.spark, 500, 6).select("vec_id", total()))
query("src_registry", f"SELECT vec_id, label FROM (SELECT vec_id, unnest(range(10))::int AS label FROM (SELECT unnest(range(300)) AS vec_id)) WHERE {draw_sql('vec_id', 'label')} < 0.3")(lambda t: datasets.load(t.spark, "randperm-v300-t10-d0.3")[1])
EXACT = sql(top("q, v x"), "q", "v").replace("WITH ", "", 1).split(" SELECT query_id, rank", 1)


@query("src_standard", f"WITH {EXACT[0]}, truth AS (SELECT query_id, rank{EXACT[1]}) SELECT 'base' AS part, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 3) AS total FROM embeddings UNION ALL SELECT 'queries', count(*), round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 3) FROM q UNION ALL SELECT 'truth', count(*), sum(vec_id * rank)::double FROM truth")
def _(t):
    register(t.spark)
    folder = scratch(t, "standard")
    found = S.knn(t.q, t.v, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("z")).select("query_id", F.transform("z", lambda x: x["vec_id"].cast("int")).alias("embedding"))
    for name, rows in (("base.fvecs", t.v), ("query.fvecs", t.q.withColumnRenamed("query_id", "vec_id")), ("groundtruth.ivecs", found.withColumnRenamed("query_id", "vec_id"))):
        rows.select(F.lit("").alias("file"), "vec_id", "embedding").write.format("vectorfile").option("kind", name.split(".")[1]).mode("append").save(f"{folder}/{name}")
    v, q, truth = datasets.standard(t.spark, folder)
    added = lambda name, rows: rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(V.total(V.doubles("embedding"))), 3).alias("total"))
    return added("base", v).unionByName(added("queries", q)).unionByName(truth.agg(F.lit("truth").alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.col("vec_id") * F.col("rank")).cast("double").alias("total")))


@query("io_transform", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)) * 2 + embedding[1]::double, 4) AS total FROM embeddings")
def _(t):
    """A matrix is kept as a table of its rows."""
    path = scratch(t, "matrix")
    rows = [[2.0 * (i == j) + (i == 3 and j == 0) for j in range(64)] for i in range(64)]
    t.spark.createDataFrame(list(enumerate(rows)), "i int, row array<double>").write.parquet(path)
    back = [r.row for r in t.spark.read.parquet(path).orderBy("i").collect()]  # a row for each dimension
    return t.v.select("vec_id", total(V.linear("embedding", back)))


# ----------------------------------------------------------------------- trees


def _tree_sql(rows: str, branch: int, most: int, depth: int) -> str:
    """CTEs s0, s1, ... (vec_id, embedding, path): each level splits the nodes of more than ``most`` rows."""
    out = [f"s0 AS (SELECT vec_id, embedding, '' AS path FROM {rows})"]
    for k in range(depth):
        out.append(f"w{k} AS (SELECT path FROM s{k} GROUP BY path HAVING count(*) > {most} AND min(embedding) < max(embedding))")
        out.append(f"c{k} AS (SELECT path, child, embedding AS centroid FROM (SELECT path, embedding, row_number() OVER (PARTITION BY path ORDER BY vec_id) - 1 AS child FROM s{k} SEMI JOIN w{k} USING (path)) WHERE child < {branch})")
        out.append(_down_sql(f"s{k + 1}", f"s{k}", f"c{k}"))
    return ", ".join(out)


def _down_sql(name: str, rows: str, nodes: str) -> str:
    return f"{name} AS (SELECT vec_id, embedding, CASE WHEN child IS NULL THEN path WHEN path = '' THEN child::varchar ELSE path || '/' || child END AS path FROM (SELECT r.vec_id, r.embedding, r.path, child, row_number() OVER (PARTITION BY r.vec_id ORDER BY {l2sq_sql('r.embedding', 'centroid')}, child) AS o FROM {rows} r LEFT JOIN {nodes} n ON n.path = r.path) WHERE o = 1)"


@query("tree_train", f"WITH {_tree_sql('embeddings', 4, 40, 3)} SELECT vec_id, path FROM s3")
def _(t):
    return C.train_tree(t.v, branch=4, max_leaf=40, depth=3, rounds=0)[1].select("vec_id", "path")


LISTS = "SELECT label, path, count(*) AS n FROM (SELECT label, vec_id, arg_min(path, k) AS path FROM (SELECT *, count(*) OVER (PARTITION BY label, path) AS n FROM (SELECT label, vec_id, k, len(steps) AS deepest, array_to_string(steps[1:k], '/') AS path FROM (SELECT label, vec_id, steps, unnest(range(len(steps) + 1)) AS k FROM (SELECT label, vec_id, CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END AS steps FROM held JOIN placed USING (vec_id))))) WHERE n <= 10 OR k = deepest GROUP BY label, vec_id) GROUP BY ALL"


@query("tree_update", f"WITH {_tree_sql('(SELECT * FROM embeddings WHERE vec_id % 5 <> 0)', 4, 40, 3)}, {_down_sql('n1', '(SELECT vec_id, embedding, chr(0)[2:] AS path FROM embeddings WHERE vec_id % 5 = 0)', 'c0')}, {_down_sql('n2', 'n1', 'c1')}, {_down_sql('n3', 'n2', 'c2')}, " + sql("SELECT", "a")[5:-7] + f", held AS (SELECT * FROM a WHERE label <> 3 OR vec_id % 2 = 1), placed AS (SELECT vec_id, path FROM (SELECT * FROM s3 UNION ALL SELECT * FROM n3) WHERE vec_id % 7 <> 0) {LISTS}")
def _(t):
    """A tree of four fifths of the vectors; the others are inserted, every seventh is removed, and some grants are revoked."""
    nodes, leaves = C.train_tree(t.v.where("vec_id % 5 <> 0"), branch=4, max_leaf=40, depth=3, rounds=0)
    leaves = leaves.select("vec_id", "path").unionByName(C.descend(t.v.where("vec_id % 5 = 0"), nodes).select("vec_id", "path"))
    lists = C.path_lists(S.remove(leaves, t.v.where("vec_id % 7 = 0").select("vec_id")), t.a.where("label <> 3 or vec_id % 2 = 1"), 10)
    return lists.groupBy("label", "path").agg(F.count(F.lit(1)).alias("n"))


query("tree_memory", sql("SELECT (SELECT count(*) * 64 * 4 FROM leaf)::bigint AS vector_bytes, (SELECT count(*) * 8 FROM a JOIN leaf USING (vec_id))::bigint AS list_bytes, (SELECT (count(DISTINCT n1) + count(DISTINCT n2)) * 64 * 8 FROM leaf)::bigint AS node_bytes", "a", "leaf"))(lambda t: C.tree_memory(_leaves(t), C.short_lists(_leaves(t), t.a, 10)))
PICKED = "(SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY s, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(s) OVER (PARTITION BY query_id) AS best FROM (SELECT query_id, n1, n, " + l2sq_sql("q.embedding", "centroid") + " AS s FROM q, l1 JOIN (SELECT n1, count(*) AS n FROM leaf GROUP BY 1) USING (n1)))"
query("tree_profile", sql(f"SELECT query_id, count(*) AS nodes, count(*) FILTER (WHERE before < 200 AND s <= best * 1.6) AS read, coalesce(sum(n) FILTER (WHERE before < 200 AND s <= best * 1.6), 0)::bigint AS candidates FROM {PICKED} GROUP BY 1", "q", "l1", "leaf"))(lambda t: C.tree_profile(t.q, _leaves(t), t.l1, 200))

# --------------------------------------------------------------------- indexes

HALF_DIST = f"sqrt({l2sq_sql('q.embedding[1:32]', 'x.embedding[1:32]')})"
query("ivf_indep_q", sql(top("pr q JOIN asg x ON q.cluster_id = x.cluster_id", distance=HALF_DIST), "pr", "asg"))(lambda t: knn_rows(_apart(t)))


def _apart(t: Tables) -> DataFrame:
    """Lists by the whole vectors, distances on a projection of them."""
    p = C.probes(t.q, t.c, 4).select("query_id", "cluster_id", F.slice("embedding", 1, 32).alias("_q"))
    met = C.assign_clusters(t.v, t.c).withColumn("embedding", F.slice("embedding", 1, 32)).join(p, "cluster_id")
    return S.top_k(met.select("query_id", "vec_id", V.l2("_q", "embedding").alias("distance")), 10)


@query("idmap2", f"SELECT vec_id * 10 + 7 AS own, {TOTAL} FROM embeddings WHERE vec_id % 50 = 1")
def _(t):
    """Vectors by ids of the caller's own."""
    ids = t.v.select("vec_id", (F.col("vec_id") * 10 + 7).alias("own"))
    wanted = t.q.select((F.col("query_id") * 10 + 7).alias("own"))
    return S.reconstruct(t.v, ids.join(wanted, "own").select("vec_id")).join(ids, "vec_id").select("own", total())


query("index_random", sql("SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat_ws(':', '42', query_id, vec_id)), vec_id) AS r FROM q, (SELECT vec_id FROM embeddings)) WHERE r <= 10", "q"))(lambda t: S.random_results(t.q, t.v, 10).select("query_id", "vec_id"))


def _mean_sql(assigned: str) -> str:
    return f"SELECT cluster_id, list(x ORDER BY dim) AS centroid FROM (SELECT cluster_id, dim, avg(x) AS x FROM (SELECT cluster_id, unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM {assigned}) GROUP BY ALL) GROUP BY 1"


def _near_sql(centres: str, d: int) -> str:
    return f"(SELECT vec_id, cluster_id, embedding FROM (SELECT v.vec_id, v.embedding, cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY {l2sq_sql(f'v.embedding[1:{d}]', f'centroid[1:{d}]')}, cluster_id) AS r FROM embeddings v, {centres}) WHERE r = 1)"


query("kmeans_progressive", sql(f"SELECT cluster_id, unnest(range(64))::int AS dim, round(unnest(centroid), 4) AS x FROM (WITH m AS ({_mean_sql(_near_sql('c', 16))}) {_mean_sql(_near_sql('m', 32))})", "c"))(lambda t: C.kmeans_progressive(t.v, t.c, (16, 32)).select("cluster_id", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "dim", r6("x").alias("x")))

HITS = f"(SELECT query_id, list_sum(list_transform(list(place), lambda p: (p <= nprobe)::int)) / 10.0 AS recall, nprobe FROM (SELECT t.query_id, place FROM truth t JOIN asg USING (vec_id) JOIN (SELECT query_id, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY {l2sq_sql('embedding', 'centroid')}, cluster_id) AS place FROM q, c) p ON p.query_id = t.query_id AND p.cluster_id = asg.cluster_id), (SELECT unnest([1, 4, 16]) AS nprobe) GROUP BY query_id, nprobe)"


@query("autotune", sql("SELECT", "q", "v", "asg")[:-7] + f", truth AS (SELECT query_id, rank{EXACT[1]}) SELECT nprobe, round(recall, 4) AS recall FROM (SELECT *, coalesce(max(recall) OVER (ORDER BY nprobe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM (SELECT nprobe::int AS nprobe, avg(recall) AS recall FROM {HITS} GROUP BY 1)) WHERE recall > before")
def _(t):
    index = FilteredIndex.train("Flat", t.v, t.a)
    index = FilteredIndex(parse_spec("IVF16,Flat"), C.assign_clusters(t.v, t.c), index.log, t.c)
    found = autotune(index, t.q, S.knn(t.q, t.v, 10), 10, [1, 4, 16])
    return t.spark.createDataFrame([(n, round(r, 4)) for n, r in found], "nprobe int, recall double")


SPECS = {"Flat": 256, "IVF64,SQ8": 64, "PCA32,IVF16,PQ8,RFlat": 8, "L2norm,Pad80,Flat,IDMap": 320}
query("factory_reverse", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {n})' for s, n in SPECS.items())}) t(spec, bytes)")(lambda t: t.spark.createDataFrame([(spec_text(parse_spec(s)), code_size(parse_spec(s), 64)) for s in SPECS], "spec string, bytes int"))

# --------------------------------------------------------------------- reports

query("agg_sel_result", "SELECT event_type AS config, (user_id % 4)::int AS grp, count(*) AS n, round(avg(value), 4) AS value FROM events GROUP BY ALL")(lambda t: E.group_means(t.events.withColumn("grp", (F.col("user_id") % 4).cast("int")).withColumnRenamed("event_type", "config"), ["config", "grp"], ["value"]).select("config", "grp", "n", r6("value").alias("value")))
query("agg_memory", sql("SELECT 'vectors' AS part, count(*) AS n, sum(len(embedding) * 4)::bigint AS bytes FROM embeddings UNION ALL SELECT 'labels', count(*), sum(len(labels) * 4)::bigint FROM wide", "wide"))(lambda t: E.table_bytes(t.v, "embedding", 4, "vectors").unionByName(E.table_bytes(t.wide, "labels", 4, "labels")))
