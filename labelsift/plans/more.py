"""Further registered queries with their DuckDB equivalents: files, selectors, quantisers, trees, indexes, windows, SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import evaluate as E
from ..operators import prepare as R
from ..operators import quantizers as Z
from ..operators import search as S
from ..operators.nearest import nearest
from ..operators.storage import shared_dir
from .fixtures import FORMULAS, _dot, l2sq_sql, sql
from .index import FilteredIndex, SearchParams, parse_spec, spec_text
from .queries import IVF, L2, ORACLE, PAIRS, RUNS, WHERE, _facts, _pairs, _runs, knn_rows, query, r6, top

TOTAL = "round(list_sum(list_transform(embedding, lambda x: x::double)), 4) AS total"
BITS = "((z[1]>0)<>(z[2]>0))::int"
HAM = _dot("q.embedding", "x.embedding", BITS) + "::double"


def total(c: str = "embedding"):
    return r6(V.total(V.doubles(c))).alias("total")


def scratch(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------- files


REALS = ("fvecs", "npy", "pkl")


def _files(name: str, kind: str, f, text: str) -> None:
    @query(name, f"SELECT list_sum(list_transform(embedding, lambda x: {text}))::double AS total FROM embeddings" if kind not in REALS else f"SELECT {TOTAL} FROM embeddings")
    def _(t):
        from ..sources.table import register

        register(t.spark)
        path = scratch(t, kind)
        t.v.select(F.lit("").alias("file"), "vec_id", f().alias("embedding")).write.format("vectorfile").option("kind", kind).mode("append").save(path)
        back = t.spark.read.format("vectorfile").option("kind", kind).load(path)
        return back.select(total() if kind in REALS else V.total(V.doubles("embedding")).alias("total"))


_files("src_fvecs", "fvecs", lambda: F.col("embedding"), "x")
_files("snk_fvecs", "fvecs", lambda: F.col("embedding"), "x")
_files("udf_io", "fvecs", lambda: F.col("embedding"), "x")
_files("src_ivecs", "ivecs", lambda: F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int")), "floor(x::double * 100)")
_files("src_bvecs", "bvecs", lambda: F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 100).cast("int")), "floor(x::double * 100 + 100)")


@query("snk_cache", f"SELECT vec_id, {TOTAL} FROM embeddings")
def _(t):
    from ..sources.files import load_index, save_index

    path = scratch(t, "cache")
    save_index({"vectors": t.v}, path)
    return load_index(t.spark, path, ["vectors"])["vectors"].select("vec_id", total())


@query("snk_results", sql(top("q, v x", 5), "q", "v"))
def _(t):
    path = scratch(t, "results")
    knn_rows(S.knn(t.q, t.v, 5)).write.csv(path, header=True)
    return t.spark.read.schema("query_id long, rank long, vec_id long, distance double").csv(path, header=True)


@query("src_json_csv", sql("SELECT vec_id, coalesce(list_sum(labels), 0)::bigint AS labels FROM wide", "wide"))
def _(t):
    path = scratch(t, "json")
    t.wide.select("vec_id", F.to_json("labels").alias("labels")).write.csv(path, header=True)
    back = t.spark.read.schema("vec_id long, labels string").csv(path, header=True)
    return back.select("vec_id", F.aggregate(F.from_json("labels", "array<bigint>"), F.lit(0).cast("long"), lambda a, b: a + b).alias("labels"))


ORACLE_LIST = "SELECT vec_id, array_to_string(list_sort(labels), ' ') AS line FROM wide"


@query("snk_text_md", sql("SELECT line, count(*) AS n FROM (" + ORACLE_LIST + ") GROUP BY 1", "wide"))
def _(t):
    path = scratch(t, "labels")
    t.wide.select(F.concat_ws(" ", F.array_sort("labels").cast("array<string>")).alias("value")).write.text(path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _flat(t, spec: str = "Flat") -> FilteredIndex:
    return FilteredIndex.train(spec, t.v, t.a)


def _saved(t) -> FilteredIndex:
    path = scratch(t, "index")
    _flat(t).save(path)
    return FilteredIndex.load(t.spark, path)


for _name in ("io_write_index", "io_read_index", "io_save_load"):
    query(_name, ORACLE["knn_prefilter"])(lambda t: knn_rows(_saved(t).query(t.q, 10, 3)))

query("src_blocks", "SELECT vec_id FROM embeddings WHERE vec_id % 4 = 1")(lambda t: t.v.where("vec_id % 4 = 1").select("vec_id"))


# ---------------------------------------------------------------- preparation


@query("prep_filter_categories", "SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda c: c IN ('SMALL', 'STEEL', 'BRASS')))::int AS n FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda c: c IN ('SMALL', 'STEEL', 'BRASS'))) > 0 ORDER BY p_partkey LIMIT 50")
def _(t):
    return R.filter_categories(t.part, "p_type", ["SMALL", "STEEL", "BRASS"], 50, "p_partkey").select("p_partkey", F.size("p_type").alias("n"))


@query("prep_share_degree", sql("SELECT vec_id, count(*) * 2 AS n FROM a GROUP BY 1", "a"))
def _(t):
    mean = t.a.agg(F.count(F.lit(1)) / F.count_distinct("vec_id")).first()[0] or 1.0
    return R.share_degree(t.a, 2 * mean, 100).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


def draw_sql(*key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0)"


def _each_label(n: int) -> str:
    return f"(SELECT vec_id, unnest(range({n}))::int AS label FROM embeddings)"


query("prep_resample", f"SELECT new_id, vec_id FROM (SELECT unnest(range(300)) AS new_id) p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) v ON v.i = floor({draw_sql('new_id')} * (SELECT count(*) FROM embeddings))::bigint")(lambda t: R.resample(t.v, 300).select("new_id", "vec_id"))
query("prep_random_access", f"SELECT vec_id, label FROM {_each_label(20)} WHERE {draw_sql('vec_id', 'label')} < 0.3")(lambda t: R.random_access(t.v, 20, 0.3))
query("prep_uniform_labels", f"SELECT vec_id, label FROM {_each_label(10)} WHERE {draw_sql('vec_id', 'label', seed=7)} < 0.5")(lambda t: R.random_access(t.v, 10, 0.5, seed=7))
query("prep_selectivity_labels", f"SELECT vec_id, label FROM {_each_label(10)} WHERE {draw_sql('vec_id', 'label')} < 0.01 + label // 2 * 0.2475::double")(lambda t: R.selectivity_labels(t.v, 5, 2))


@query("prep_random_test_labels", sql("SELECT query_id, n, true AS known FROM (SELECT vec_id AS query_id, count(*) AS n FROM a WHERE vec_id % 50 = 1 GROUP BY 1)", "a"))
def _(t):
    labels = t.a.select("label").distinct()
    got = R.random_test_labels(t.a.where("vec_id % 50 = 1"), labels)
    kept = got.join(F.broadcast(labels.withColumn("k", F.lit(1))), "label", "left")
    return kept.groupBy(F.col("vec_id").alias("query_id")).agg(F.count_distinct("label").alias("n"), (F.count_if(F.col("k").isNull()) == 0).alias("known"))


query("prep_label_sample", sql(f"SELECT label FROM (SELECT DISTINCT label FROM a) ORDER BY {draw_sql('label')}, label LIMIT 5", "a"))(lambda t: R.label_sample(t.a, 5))


@query("prep_random_filters", "SELECT 12::bigint AS n, 12::bigint AS distinct_formulas")
def _(t):
    got = P.fill_templates(["AND {0} {1}", "OR {0} {1}", "AND {0} NOT {1}"], list(range(40)), 4)
    return t.spark.createDataFrame([(f,) for f in got], "formula string").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("formula").alias("distinct_formulas"))


@query("prep_template_split", sql(" UNION ALL ".join(f"SELECT {i}::int AS pred_id, count(*) AS n FROM wide WHERE {WHERE[i]}" for i in (2, 4)), "wide"))
def _(t):
    own = {i: f for i, f in FORMULAS.items() if P.template_of(f) in ("AND {} {}", "AND {} NOT {}")}
    return S.selectivities(t.wide, own).select("pred_id", F.col("qualified").alias("n"))


# ----------------------------------------------------------------- predicates

query("pred_single", sql("SELECT vec_id FROM wide WHERE list_contains(labels, 3)", "wide"))(lambda t: t.wide.where(P.to_column("3")).select("vec_id"))
query("pred_all", "SELECT vec_id FROM embeddings")(lambda t: t.v.select("vec_id"))
query("sel_all", "SELECT vec_id FROM embeddings")(lambda t: t.v.where(F.lit(True)).select("vec_id"))
query("sel_array", "SELECT vec_id FROM embeddings WHERE vec_id IN (5, 17, 40)")(lambda t: t.v.where(F.col("vec_id").isin(5, 17, 40)).select("vec_id"))
query("sel_not", "SELECT vec_id FROM embeddings WHERE NOT (vec_id >= 10 AND vec_id < 50)")(lambda t: t.v.where(~P.in_range(F.col("vec_id"), 10, 50)).select("vec_id"))
query("sel_and", "SELECT vec_id FROM embeddings WHERE vec_id >= 10 AND vec_id < 50 AND vec_id % 2 = 0")(lambda t: t.v.where(P.in_range(F.col("vec_id"), 10, 50) & (F.col("vec_id") % 2 == 0)).select("vec_id"))
query("sel_or", "SELECT vec_id FROM embeddings WHERE vec_id < 10 OR vec_id % 7 = 0")(lambda t: t.v.where(P.in_range(F.col("vec_id"), 0, 10) | (F.col("vec_id") % 7 == 0)).select("vec_id"))
query("sel_formula_ivf", ORACLE["ivf_shared_formula"])(lambda t: knn_rows(C.ivf_search(t.q, C.assign_clusters(t.wide, t.c), t.c, 10, 4, where=P.to_column(FORMULAS[5]))))
FORMULA_KNN = sql(top(f"q, wide x WHERE {WHERE[6]}"), "q", "wide")
query("sel_formula_hnsw", FORMULA_KNN)(lambda t: knn_rows(S.knn_formula(t.q, t.wide, 10, FORMULAS[6])))
query("pred_tokenize", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {len(f.split())}::bigint)" for i, f in FORMULAS.items()) + ") t(pred_id, n)")(lambda t: t.spark.sql("SELECT pred_id, CAST(size(split(trim(formula), '\\\\s+')) AS BIGINT) AS n FROM VALUES " + ", ".join(f"({i}, '{f}')" for i, f in FORMULAS.items()) + " AS t(pred_id, formula)"))
query("pred_parse", sql(f"SELECT vec_id FROM wide WHERE {WHERE[7]}", "wide"))(lambda t: t.wide.where(P.to_column(FORMULAS[7])).select("vec_id"))
query("pred_varmap", sql("SELECT cluster_id, count(*) FILTER (WHERE label = 3) AS n3, count(*) FILTER (WHERE label = 31) AS n31 FROM asg JOIN a USING (vec_id) GROUP BY 1", "asg", "a"))(lambda t: C.assign_clusters(t.v, t.c).join(t.a, "vec_id").groupBy("cluster_id").pivot("label", [3, 31]).count().na.fill(0).withColumnsRenamed({"3": "n3", "31": "n31"}))
query("filter_bitmap_many", sql("SELECT label, count(*) AS n, sum(vec_id)::bigint AS ids FROM a WHERE label < 10 GROUP BY 1", "a"))(lambda t: t.a.where("label < 10").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")))
query("sel_translated", "SELECT vec_id + 1000 AS id FROM embeddings WHERE vec_id + 1000 BETWEEN 1010 AND 1020")(lambda t: t.v.select("vec_id", (F.col("vec_id") + 1000).alias("id")).where(P.in_range(F.col("id"), 1010, 1021)).select("id"))


def _callback(name: str) -> None:
    @query(name, "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
    def _(t):
        chosen = F.pandas_udf(lambda ids: ids % 3 == 0, "boolean")
        return t.v.select("vec_id").where(chosen("vec_id"))


_callback("sel_python")
_callback("udf_selector")


@query("pred_find_tree", sql(f"SELECT vec_id FROM wide WHERE {WHERE[4]}", "wide"))
def _(t):
    """Clusters that hold no vector with label 3 are pruned before the formula is evaluated."""
    own = C.assign_clusters(t.wide, t.c)
    live = own.groupBy("cluster_id").agg(F.count_if(F.array_contains("labels", 3)).alias("n")).where("n > 0").select("cluster_id")
    return own.join(F.broadcast(live), "cluster_id", "left_semi").where(P.to_column(FORMULAS[4])).select("vec_id")


# -------------------------------------------------------------- scalars, pairs

PAIR_SUM = f"SELECT i, j, round({_dot('x', 'y', '(z[1]::double-z[2]::double)*(z[1]::double-z[2]::double)')}, 4) AS value FROM {PAIRS}"
query("pairwise_l2", PAIR_SUM)(lambda t: _pairs(t).select("i", "j", r6(V.l2sq("x", "y")).alias("value")))
query("pairwise_metric", ORACLE["dist_l1"])(lambda t: _pairs(t).select("i", "j", r6(V.metric("l1")[0]("x", "y")).alias("value")))


@query("dist_pairwise_idx", f"SELECT a.vec_id AS i, b.vec_id AS j, round({l2sq_sql('a.embedding', 'b.embedding')}, 4) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7")
def _(t):
    rows = t.v.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"), (F.col("vec_id") + 7).alias("j"))
    return rows.join(t.v.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y")), "j").select("i", "j", r6(V.l2sq("x", "y")).alias("value"))


query("bits_shuffle", "SELECT vec_id, ((embedding[3]>0)::int + 2*(embedding[1]>0)::int + 4*(embedding[2]>0)::int)::bigint AS value FROM embeddings")(lambda t: t.v.select("vec_id", F.get(V.pack_signs(V.remap("embedding", [2, 0, 1])), F.lit(0)).alias("value")))
query("hash_bytes", "SELECT vec_id, md5(vec_id::varchar) AS value FROM embeddings")(lambda t: t.v.select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("value")))
query("checksum", "SELECT sum(vec_id * vec_id % 9973)::bigint AS value FROM embeddings")(lambda t: t.v.agg(F.sum(F.col("vec_id") * F.col("vec_id") % 9973).alias("value")))


@query("range_hamming", sql(f"SELECT query_id, x.vec_id, {HAM} AS distance FROM q, v x WHERE {HAM} < 22", "q", "v"))
def _(t):
    pack = lambda d: d.withColumn("embedding", V.pack_signs("embedding"))
    return S.range_search(pack(t.q), pack(t.v), 22, "hamming").select("query_id", "vec_id", F.col("distance").cast("double").alias("distance"))


query("knn_blocks", ORACLE["knn_flat"])(lambda t: knn_rows(S.top_k(S.pairs(t.q, t.v, bounded=False), 10)))
query("blocked_query", ORACLE["knn_flat"])(lambda t: knn_rows(S.top_k(S.pairs(t.q, t.v, bounded=False), 10)))
query("replica_search", ORACLE["knn_flat"])(lambda t: knn_rows(S.knn(t.q.where("query_id % 100 < 50"), t.v, 10).unionByName(S.knn(t.q.where("query_id % 100 >= 50"), t.v, 10))))
query("knn_bitmap_sorted", ORACLE["knn_bitmap"])(lambda t: knn_rows(S.knn_ids(t.q, t.v, t.embeddings.where("vec_id % 3 = 0").select("vec_id").sort("vec_id"), 10)))
query("knn_1d", "SELECT * FROM (SELECT q.event_id AS query_id, x.event_id AS vec_id, round(abs(q.value - x.value), 4) AS distance, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(q.value - x.value), x.event_id) AS rank FROM (SELECT * FROM events WHERE event_id % 1000 = 1) q, events x) WHERE rank <= 3")(lambda t: knn_rows(S.knn(t.events.where("event_id % 1000 = 1").select(F.col("event_id").alias("query_id"), F.array("value").alias("embedding")), t.events.select(F.col("event_id").alias("vec_id"), F.array("value").alias("embedding")), 3)))
query("nearest_centroid", sql("SELECT vec_id, n1 FROM t1", "t1"))(lambda t: C.assign_clusters(t.v, t.l1.withColumnRenamed("n1", "cluster_id")).select("vec_id", F.col("cluster_id").alias("n1")))


@query("sparse_assign", f"SELECT vec_id AS row, cluster_id FROM (SELECT e.vec_id, c.vec_id AS cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({l2sq_sql('e.s', 'c.embedding')}, 9), c.vec_id) AS r FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN x::double ELSE 0 END) AS s FROM embeddings WHERE list_max(embedding) > 0.1) e, embeddings c WHERE c.vec_id < 16) WHERE r = 1")
def _(t):
    rows = t.v.select(F.col("vec_id").alias("row"), F.posexplode(V.doubles("embedding")).alias("dim", "x")).where("x > cast(0.1 as float)")
    return Z.sparse_assign(rows, t.c).select("row", "cluster_id")


# ----------------------------------------------------------------- quantisers

HALF = "(SELECT * FROM embeddings WHERE vec_id < 16)"


def _books(t, parts: int, scale: float = 1.0) -> list:
    rows = t.embeddings.where("vec_id < 16").orderBy("vec_id").select(V.doubles("embedding").alias("e")).collect()
    w = len(rows[0].e) // parts
    return [[[x * scale for x in r.e[m * w : (m + 1) * w]] for r in rows] for m in range(parts)]


CODES = f"codes AS (SELECT e.vec_id, m, c.vec_id AS c, c.embedding[m*8+1:m*8+8] AS part FROM embeddings e, {HALF} c, (SELECT unnest(range(8))::int AS m) QUALIFY row_number() OVER (PARTITION BY e.vec_id, m ORDER BY {l2sq_sql('e.embedding[m*8+1:m*8+8]', 'c.embedding[m*8+1:m*8+8]')}, c.vec_id) = 1)"
ADC = f"SELECT query_id, rank, vec_id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM (SELECT q.query_id, codes.vec_id, sum({l2sq_sql('q.embedding[m*8+1:m*8+8]', 'part')}) AS d FROM q, codes GROUP BY ALL)) WHERE rank <= 5"


def _settled(found: DataFrame) -> DataFrame:
    """Ranks by rounded distances, so that equal codes tie however their sums were added."""
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return knn_rows(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5))


def _adc(t) -> DataFrame:
    b = _books(t, 8)
    return _settled(Z.pq_search(t.q, Z.pq_encode(t.v, b).select("vec_id", "code"), b, 40))


query("pq_train", "SELECT 8::bigint AS parts, true AS improved")(lambda t: _pq_trained(t))
query("fastscan", sql(ADC, "q").replace("WITH ", f"WITH {CODES}, ", 1))(_adc)
query("pq_search", ORACLE["fastscan"])(_adc)
query("sa_codec", "WITH " + CODES + " SELECT vec_id, round(sum(list_sum(list_transform(part, lambda x: x::double))), 4) AS total FROM codes GROUP BY 1")(lambda t: Z.pq_decode(Z.pq_encode(t.v, _books(t, 8)).select("vec_id", "code"), _books(t, 8)).select("vec_id", total()))


def _error(t, books) -> float:
    back = Z.pq_decode(Z.pq_encode(t.v, books).select(F.col("embedding").alias("x"), "code"), books)
    return back.agg(F.avg(V.l2sq("x", "embedding"))).first()[0] or 0.0


def _pq_trained(t) -> DataFrame:
    first = _books(t, 8)
    better = Z.pq_train(t.v, first, 3)
    return t.spark.sql(f"SELECT CAST({len(better)} AS BIGINT) AS parts, {'true' if _error(t, better) <= _error(t, first) else 'false'} AS improved")


def _ivfpq(t) -> DataFrame:
    own, books = C.assign_clusters(t.v, t.c), _books(t, 8, 0.5)
    return _settled(Z.ivfpq_search(t.q, Z.ivfpq_encode(own, t.c, books), t.c, books, 40, 4))


RES = "res AS (SELECT vec_id, cluster_id, list_transform(list_zip(embedding, centroid), lambda z: z[1]::double - z[2]::double) AS r FROM asg JOIN c USING (cluster_id))"
RCODES = f"rcodes AS (SELECT res.vec_id, res.cluster_id, m, list_transform(h.embedding[m*8+1:m*8+8], lambda x: x::double * 0.5) AS part FROM res, {HALF} h, (SELECT unnest(range(8))::int AS m) QUALIFY row_number() OVER (PARTITION BY res.vec_id, m ORDER BY {l2sq_sql('r[m*8+1:m*8+8]', 'list_transform(h.embedding[m*8+1:m*8+8], lambda x: x::double * 0.5)')}, h.vec_id) = 1)"
IVFPQ = sql("SELECT query_id, rank, vec_id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM (SELECT query_id, rcodes.vec_id, sum(" + l2sq_sql("qr[m*8+1:m*8+8]", "part") + ") AS d FROM (SELECT query_id, cluster_id, list_transform(list_zip(embedding, centroid), lambda z: z[1]::double - z[2]::double) AS qr FROM pr JOIN c USING (cluster_id)) p JOIN rcodes USING (cluster_id) GROUP BY ALL)) WHERE rank <= 5", "pr", "asg").replace(" SELECT query_id, rank, vec_id, round(d, 4)", f", {RES}, {RCODES} SELECT query_id, rank, vec_id, round(d, 4)", 1)
query("ivfpq", IVFPQ)(_ivfpq)
query("two_layer", IVFPQ)(_ivfpq)
query("ivfpqr", sql(top(IVF, 3), "pr", "asg"))(lambda t: knn_rows(S.refine(_ivfpq_wide(t), t.q, t.v, 3)))


def _ivfpq_wide(t) -> DataFrame:
    own, books = C.assign_clusters(t.v, t.c), _books(t, 8, 0.5)
    return Z.ivfpq_search(t.q, Z.ivfpq_encode(own, t.c, books), t.c, books, 1_000_000, 4)


def _rq_sql(n: str, source: str, scale: float) -> str:
    near = l2sq_sql("s.r", f"list_transform(h.embedding, lambda x: x::double * {scale})")
    return f"{n} AS (SELECT s.vec_id, list_transform(list_zip(s.r, h.embedding), lambda z: z[1]::double - z[2]::double * {scale}) AS r FROM {source} s, {HALF} h QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY {near}, h.vec_id) = 1)"


RQ = "WITH " + _rq_sql("l1q", "(SELECT vec_id, embedding AS r FROM embeddings)", 1.0) + ", " + _rq_sql("l2q", "l1q", 0.5) + " SELECT vec_id, round(list_sum(list_transform(r, lambda x: x * x)), 4) AS rest FROM l2q"
_rq_books = lambda t: _books(t, 1) + _books(t, 1, 0.5)
query("rq", RQ)(lambda t: Z.rq_encode(t.v, _rq_books(t)).select("vec_id", r6(V.norm_sq("residual")).alias("rest")))
query("coarse_rq", RQ)(lambda t: Z.rq_decode(Z.rq_encode(t.v, _rq_books(t)).select("vec_id", F.col("embedding").alias("x"), "code"), _rq_books(t)).select("vec_id", r6(V.l2sq("x", "embedding")).alias("rest")))
HB = lambda m: f"(SELECT vec_id AS c{m}, embedding[{m}*32+1:{m}*32+32] AS h{m} FROM embeddings WHERE vec_id < 16)"
CELL = f"cell AS (SELECT v.vec_id, (c0 * 16 + c1)::bigint AS cell, v.embedding FROM embeddings v, {HB(0)}, {HB(1)} QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {l2sq_sql('v.embedding[1:32]', 'h0')}, c0, {l2sq_sql('v.embedding[33:64]', 'h1')}, c1) = 1)"
PROBE = f"pc AS (SELECT query_id, embedding, (c0 * 16 + c1)::bigint AS cell FROM q, {HB(0)}, {HB(1)} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {l2sq_sql('embedding[1:32]', 'h0')} + {l2sq_sql('embedding[33:64]', 'h1')}, c0 * 16 + c1) <= 64)"
query("imi", sql(top("pc q JOIN cell x ON q.cell = x.cell", 5), "q").replace(" SELECT query_id, rank", f", {CELL}, {PROBE} SELECT query_id, rank", 1))(lambda t: knn_rows(Z.imi_search(t.q, Z.imi_cells(t.v, _books(t, 2)), _books(t, 2), 5, 64)))
SIGN = "list_transform(list_zip({0}, {1}), lambda z: (z[1]::double > z[2]::double)::int)"
query("spectral_hash", sql(top("(SELECT query_id, cluster_id, " + SIGN.format("embedding", "centroid") + " AS b FROM pr JOIN c USING (cluster_id)) q JOIN (SELECT vec_id, cluster_id, " + SIGN.format("embedding", "centroid") + " AS w FROM asg JOIN c USING (cluster_id)) x ON q.cluster_id = x.cluster_id", 5, _dot("q.b", "x.w", "(z[1]<>z[2])::int") + "::double"), "pr", "asg"))(lambda t: knn_rows(Z.spectral_search(t.q, C.assign_clusters(t.v, t.c), t.c, 5, 4)))
SHARE = " OR ".join(f"list_sum(list_transform(range({m * 8}, {m * 8 + 8}), lambda k: ((q.embedding[k+1]>0)<>(x.embedding[k+1]>0))::int)) = 0" for m in range(4))
query("bin_multihash", sql(top(f"q JOIN v x ON {SHARE}", 5, HAM), "q", "v"))(lambda t: knn_rows(Z.multihash_search(t.q, t.v, 5)))
query("bin_flat", ORACLE["knn_hamming"])(lambda t: knn_rows(S.knn(t.q.withColumn("embedding", V.pack_signs("embedding")), t.v.withColumn("embedding", V.pack_signs("embedding")), 5, "hamming").withColumn("distance", F.col("distance").cast("double"))))
query("bin_from_float", sql(top("q, v x", 5, HAM), "q", "v"))(lambda t: knn_rows(S.knn(*(d.withColumn("embedding", V.unpack_signs(V.pack_signs("embedding"), 64)) for d in (t.q, t.v)), 5, "l2sq").withColumn("distance", F.round(F.col("distance") / 4))))


@query("bin_ivf", sql(top(IVF, 5, HAM), "pr", "asg"))
def _(t):
    p = C.probes(t.q, t.c, 4).select("query_id", "cluster_id", V.pack_signs("embedding").alias("_w"))
    own = C.assign_clusters(t.v, t.c).select("vec_id", "cluster_id", V.pack_signs("embedding").alias("w"))
    return knn_rows(S.top_k(own.join(p, "cluster_id").select("query_id", "vec_id", V.hamming("_w", "w").cast("double").alias("distance")), 5, "hamming"))


@query("ivfsq", sql(f"SELECT query_id, count(*) AS n FROM {IVF} GROUP BY 1", "pr", "asg"))
def _(t):
    from ..operators import codecs as K

    limits = K.sq_limits(t.v)
    own = C.assign_clusters(t.v, t.c)
    coded = K.sq_decode(K.sq_encode(own, limits), limits).join(own.select("vec_id", "cluster_id"), "vec_id")
    return C.ivf_search(t.q, coded, t.c, 1_000_000, 4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- rotations and k-means

NORMS = f"SELECT vec_id, round(sqrt({_dot('embedding', 'embedding', 'z[1]::double*z[2]::double')}), 4) AS value FROM embeddings"
_norms = lambda d: d.select("vec_id", r6(V.norm("embedding")).alias("value"))
query("tf_random_rot", NORMS)(lambda t: _norms(Z.rotate(t.v, Z.random_rotation(64))))
query("tf_itq", NORMS)(lambda t: _norms(Z.rotate(t.v, Z.itq(t.v, 2))))
query("tf_opq", NORMS)(lambda t: _norms(Z.rotate(t.v, Z.opq(t.v, 8, 16, 1)[0])))
query("tf_norm", "SELECT vec_id, 1.0::double AS value FROM embeddings")(lambda t: t.v.select("vec_id", r6(V.norm(V.normalize("embedding"))).alias("value")))
SPLITS = "WITH p AS (SELECT p_size::double AS x, count(*) AS n FROM part GROUP BY 1), s AS (SELECT a.x AS cut, sum(n) FILTER (WHERE p.x <= a.x) AS n1, sum(n * p.x) FILTER (WHERE p.x <= a.x) AS s1, sum(n) FILTER (WHERE p.x > a.x) AS n2, sum(n * p.x) FILTER (WHERE p.x > a.x) AS s2 FROM p, (SELECT x FROM p) a GROUP BY 1) "
query("kmeans_1d", SPLITS + "SELECT unnest([round(s1 / n1, 4), round(s2 / n2, 4)]) AS centre FROM (SELECT * FROM s WHERE n2 > 0 ORDER BY round(s1 * s1 / n1 + s2 * s2 / n2, 6) DESC, cut LIMIT 1)")(lambda t: t.spark.createDataFrame([(round(c, 4),) for c in Z.kmeans_1d(t.part, "p_size", 2)], "centre double"))


@query("kmeans_2level", "SELECT 4::bigint AS top, true AS nested")
def _(t):
    one, two = Z.two_level(t.v, 4, 4, 1)
    return one.agg(F.count(F.lit(1)).alias("top")).crossJoin(two.join(one.select("n1"), "n1").agg((F.count(F.lit(1)) <= 16).alias("nested")))


query("kmeans_simple", ORACLE["kmeans"])(lambda t: C.lloyd_step(C.assign_clusters(t.v, t.c)).select("cluster_id", F.posexplode("centroid").alias("dim", "x"), "n").select("cluster_id", "dim", r6("x").alias("x"), "n"))


@query("kmeans_sparse", sql("SELECT cluster_id, count(*) AS n FROM asg GROUP BY 1", "asg"))
def _(t):
    rows = t.v.select(F.col("vec_id").alias("row"), F.posexplode(V.doubles("embedding")).alias("dim", "x"))
    return Z.sparse_assign(rows, t.c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- trees


def _leaves(t) -> DataFrame:
    return C.assign_tree(t.v, t.l1, t.l2)


def _counted(held: DataFrame, leaves: DataFrame) -> DataFrame:
    return C.short_lists(leaves, held, 10).groupBy("label", "level", "path").agg(F.count(F.lit(1)).alias("n"))


def _lists_sql(access: str) -> str:
    return f"SELECT label, CASE WHEN c0 <= 10 THEN 0 WHEN c1 <= 10 THEN 1 ELSE 2 END AS level, CASE WHEN c0 <= 10 THEN '' WHEN c1 <= 10 THEN n1::varchar ELSE n1 || '/' || n2 END AS path, count(*) AS n FROM (SELECT label, n1, n2, count(*) OVER (PARTITION BY label) AS c0, count(*) OVER (PARTITION BY label, n1) AS c1 FROM {access} JOIN leaf USING (vec_id)) GROUP BY ALL"


query("tree_grant", sql(_lists_sql("(SELECT * FROM a UNION SELECT vec_id, 50 FROM embeddings WHERE vec_id % 5 = 0)"), "a", "leaf"))(lambda t: _counted(t.a.union(t.v.where("vec_id % 5 = 0").select("vec_id", F.lit(50))), _leaves(t)))
query("filter_batch_grant", sql(_lists_sql("(SELECT vec_id, 51 AS label FROM embeddings WHERE vec_id % 3 = 0)"), "leaf"))(lambda t: _counted(t.v.where("vec_id % 3 = 0").select("vec_id", F.lit(51).alias("label")), _leaves(t)))
query("tree_revoke", sql(_lists_sql("(SELECT * FROM a WHERE NOT (label = 3 AND vec_id % 2 = 0))"), "a", "leaf"))(lambda t: _counted(t.a.where("not (label = 3 and vec_id % 2 = 0)"), _leaves(t)))
query("tree_remove", sql("SELECT n1, count(*) AS n FROM leaf WHERE vec_id % 4 <> 0 GROUP BY 1", "leaf"))(lambda t: S.remove(_leaves(t), t.v.where("vec_id % 4 = 0").select("vec_id")).groupBy("n1").agg(F.count(F.lit(1)).alias("n")))
query("tmp_build", sql(_lists_sql(f"(SELECT vec_id, 0 AS label FROM wide WHERE {WHERE[5]})"), "wide", "leaf"))(lambda t: _counted(t.wide.where(P.to_column(FORMULAS[5])).select("vec_id", F.lit(0).alias("label")), _leaves(t)))
query("tree_path", sql("SELECT vec_id, n1 % 64 AS a, n2 % 64 AS b FROM leaf", "leaf"))(lambda t: _leaves(t).withColumn("code", V.path_code([F.col("n1"), F.col("n2")])).select("vec_id", V.path_child("code", 0).cast("long").alias("a"), V.path_child("code", 1).cast("long").alias("b")))
query("tree_sanity", "SELECT 0::bigint AS oversized, 0::bigint AS doubled")(lambda t: _sane(t))
query("tree_beam", sql("SELECT query_id, n1, n2 FROM (SELECT query_id, n1, n2, row_number() OVER (PARTITION BY query_id ORDER BY " + l2sq_sql("embedding", "centroid") + ", n2) AS r FROM (SELECT query_id, embedding, n1 FROM (SELECT query_id, embedding, n1, row_number() OVER (PARTITION BY query_id ORDER BY " + l2sq_sql("embedding", "centroid") + ", n1) AS r FROM (SELECT query_id, q.embedding, n1, centroid FROM q, l1)) WHERE r <= 2) p JOIN l2 USING (n1)) WHERE r <= 3", "q", "l1", "l2"))(lambda t: C.beam(t.q, t.l1, t.l2, 2, 3))
TREE_LABEL = top("(SELECT * FROM (SELECT query_id, embedding, n1, s, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY s, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(s) OVER (PARTITION BY query_id) AS best FROM (SELECT query_id, q.embedding, n1, n, " + l2sq_sql("q.embedding", "centroid") + " AS s FROM q, l1 JOIN (SELECT n1, count(*) AS n FROM own GROUP BY 1) USING (n1))) WHERE before < 100 AND s <= best * 1.6) q JOIN own x ON q.n1 = x.n1")
query("tree_search_label", sql(TREE_LABEL, "q", "leaf", "l1", "a").replace(" SELECT query_id, rank", ", own AS (SELECT leaf.* FROM leaf SEMI JOIN (SELECT vec_id FROM a WHERE label = 31) h USING (vec_id)) SELECT query_id, rank", 1))(lambda t: knn_rows(C.tree_search(t.q, _leaves(t).join(t.a.where("label = 31").select("vec_id"), "vec_id", "left_semi"), t.l1, 10, 100)))
query("tmp_search", sql(TREE_LABEL, "q", "leaf", "l1", "wide").replace(" SELECT query_id, rank", f", own AS (SELECT leaf.* FROM leaf SEMI JOIN (SELECT vec_id FROM wide WHERE {WHERE[5]}) h USING (vec_id)) SELECT query_id, rank", 1))(lambda t: knn_rows(C.tree_search(t.q, _leaves(t).join(t.wide.where(P.to_column(FORMULAS[5])).select("vec_id"), "vec_id", "left_semi"), t.l1, 10, 100)))


def _sane(t) -> DataFrame:
    lists = C.short_lists(_leaves(t), t.a, 10)
    big = lists.where("level < 2").groupBy("label", "path").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 10).alias("oversized"))
    twice = lists.groupBy("label", "vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("doubled"))
    return big.crossJoin(twice)


# ------------------------------------------------------------ filtered indexes

LABEL3 = ORACLE["knn_prefilter"]
for _name in ("hnsw_shared", "hnsw_per_label", "acorn", "filtered_diskann", "parlay_ivf"):  # the result contract of graph indexes
    query(_name, LABEL3)(lambda t: knn_rows(S.knn_label(t.q, t.v, t.a, 10, 3)))
for _name in ("hnsw",):
    query(_name, ORACLE["knn_flat"])(lambda t: knn_rows(S.knn(t.q, t.v, 10)))
query("nsg", ORACLE["knn_graph"])(lambda t: knn_rows(S.knn_graph(t.v, 3)))
query("nndescent")(lambda t: knn_rows(S.nn_descent(t.v, 10)))  # approximate: tested for recall
for _name in ("ivf_plus", "ivf_params", "big_batch", "shard_ivf"):
    query(_name, ORACLE["ivf_flat"])(lambda t: knn_rows(C.ivf_search(t.q, C.assign_clusters(t.v, t.c), t.c, 10, 4)))

query("filter_index", FORMULA_KNN)(lambda t: knn_rows(_flat(t).materialize_formula(FORMULAS[6], 900, 1).query(t.q, 10, 900)))
query("query_predicate", FORMULA_KNN)(lambda t: knn_rows(_flat(t).query_formula(t.q, 10, FORMULAS[6])))
query("filter_bitmap_build", FORMULA_KNN)(lambda t: knn_rows(_flat(t).query_ids(t.q, 10, t.wide.where(P.to_column(FORMULAS[6])).select("vec_id"))))
query("api_base", ORACLE["knn_flat"])(lambda t: knn_rows(_flat(t).query_unfiltered(t.q, 10)))
query("factory", ORACLE["knn_flat"])(lambda t: knn_rows(FilteredIndex.train(spec_text(parse_spec("Flat,IDMap")), t.v, t.a).query_unfiltered(t.q, 10, SearchParams())))
query("pretransform", ORACLE["knn_flat"])(lambda t: knn_rows(_flat(t, "L2norm,Pad80,Flat").query_unfiltered(t.q, 10)))
CRUD = sql(top("q, v x SEMI JOIN (SELECT vec_id FROM a WHERE label = 31 AND vec_id % 2 = 1 AND vec_id % 3 > 0) USING (vec_id)"), "q", "v", "a")


def _changed(t) -> DataFrame:
    i = _flat(t).revoke(t.a.where("label = 31 and vec_id % 2 = 0"), 1).delete(t.v.where("vec_id % 3 = 0").select("vec_id"))
    return knn_rows(i.query(t.q, 10, 31))


for _name in ("ivf_shared_crud", "hybrid_crud"):
    query(_name, CRUD)(_changed)

SHIFT = "SELECT vec_id, cluster_id FROM asg"
query("ivf_add", sql(SHIFT, "asg"))(lambda t: C.assign_clusters(t.v.where("vec_id % 2 = 0"), t.c).unionByName(C.assign_clusters(t.v.where("vec_id % 2 = 1"), t.c)).select("vec_id", "cluster_id"))
query("ivf_centroid", sql("SELECT vec_id, cluster_id FROM asg WHERE vec_id % 50 = 1", "asg"))(lambda t: C.probes(t.q, t.c, 1).select(F.col("query_id").alias("vec_id"), "cluster_id"))
query("ivf_invlist_range", sql("SELECT vec_id, cluster_id FROM asg WHERE cluster_id >= 2 AND cluster_id < 6", "asg"))(lambda t: C.assign_clusters(t.v, t.c).where(P.in_range(F.col("cluster_id"), 2, 6)).select("vec_id", "cluster_id"))
query("ivf_subset", sql("SELECT vec_id, cluster_id FROM asg WHERE vec_id % 8 = 3", "asg"))(lambda t: C.assign_clusters(t.v.where("vec_id % 8 = 3"), t.c).select("vec_id", "cluster_id"))
query("ivf_recons", sql(f"SELECT vec_id, cluster_id, {TOTAL} FROM asg WHERE vec_id % 9 = 0", "asg"))(lambda t: C.assign_clusters(t.v, t.c).where("vec_id % 9 = 0").select("vec_id", "cluster_id", total()))
BIT = "('0x' || substr(md5(label::varchar), 8 * k + 1, 8))::bigint % 64"
query("bloom", sql(f"SELECT cluster_id, label FROM (SELECT DISTINCT label FROM a) l, (SELECT cluster_id, list(DISTINCT {BIT}) AS bits FROM asg JOIN a USING (vec_id), (SELECT unnest(range(2)) AS k) GROUP BY 1) f WHERE list_has_all(bits, list_transform(range(2), lambda k: {BIT}))", "asg", "a"))(lambda t: _may_hold(t))


def _may_hold(t) -> DataFrame:
    """Clusters that a search for a label has to read, by filters so small that some are read for nothing."""
    filters = C.bloom_filters(C.assign_clusters(t.v, t.c).join(t.a, "vec_id"), 64, 2)
    return t.a.select("label").distinct().crossJoin(F.broadcast(filters)).where(C.may_hold(F.col("filter"), F.col("label"), 64, 2)).select("cluster_id", "label")


query("acorn_local_sel", sql("SELECT cluster_id, round(count(*) FILTER (WHERE list_contains(labels, 31)) / count(*), 6) AS share FROM asg JOIN wide USING (vec_id) GROUP BY 1", "asg", "wide"))(lambda t: C.assign_clusters(t.wide, t.c).groupBy("cluster_id").agg(F.round(F.count_if(F.array_contains("labels", 31)) / F.count(F.lit(1)), 6).alias("share")))


@query("ivf_update", sql(f"SELECT vec_id, cluster_id FROM (SELECT v.vec_id, cluster_id, row_number() OVER (PARTITION BY v.vec_id ORDER BY {l2sq_sql('v.e', 'centroid')}, cluster_id) AS r FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN -x ELSE x END) AS e FROM embeddings) v, c) WHERE r = 1", "c"))
def _(t):
    new = t.v.where("vec_id % 10 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    old = S.remove(C.assign_clusters(t.v, t.c), new.select("vec_id"))
    return old.unionByName(C.assign_clusters(new, t.c)).select("vec_id", "cluster_id")


@query("ivf_preassigned", sql("SELECT query_id, rank, vec_id, distance FROM (" + top("q JOIN asg x ON x.cluster_id = q.query_id % 16", 5) + ")", "q", "asg"))
def _(t):
    given = t.q.select("query_id", (F.col("query_id") % 16).alias("cluster_id"), F.col("embedding").alias("_q"))
    met = C.assign_clusters(t.v, t.c).join(given, "cluster_id").select("query_id", "vec_id", V.l2("_q", "embedding").alias("distance"))
    return knn_rows(S.top_k(met, 5))


@query("idmap", sql("SELECT query_id, rank, vec_id * 10 + 7 AS vec_id, distance FROM (" + top("q, v x") + ")", "q", "v"))
def _(t):
    ids = t.v.select("vec_id", (F.col("vec_id") * 10 + 7).alias("own"))
    return knn_rows(S.knn(t.q, t.v, 10).join(ids, "vec_id").drop("vec_id").withColumnRenamed("own", "vec_id"))


# --------------------------------------------------------------- evaluation

EVENTS_PCT = ", ".join(f"round(quantile_cont(value, {p}), 4) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
query("agg_latency_sql", f"SELECT round(1/avg(value), 4) AS qps, round(avg(value), 4) AS avg, round(stddev_pop(value), 4) AS std, {EVENTS_PCT} FROM events")(lambda t: (lambda d: d.select(*(r6(c).alias(c) for c in d.columns)))(E.latency(t.events, "value")))
query("agg_share_degree", sql("SELECT round(avg(len(labels)), 6) AS degree FROM wide", "wide"))(lambda t: t.wide.agg(F.round(F.avg(F.size("labels")), 6).alias("degree")))
query("agg_extrema", sql("SELECT query_id, min(distance) AS least, max(distance) AS most FROM (" + top("q, v x") + ") GROUP BY 1", "q", "v"))(lambda t: S.knn(t.q, t.v, 10).groupBy("query_id").agg(r6(F.min("distance")).alias("least"), r6(F.max("distance")).alias("most")))
query("agg_vector_bytes", "SELECT count(*) * 64 * 4 AS bytes FROM embeddings")(lambda t: t.v.agg(F.sum(F.size("embedding") * 4).alias("bytes")))
query("agg_multi_run", f"SELECT config, round(avg(latency), 2) AS mean, round(stddev_pop(latency), 2) AS std FROM ({RUNS}) GROUP BY 1")(lambda t: _runs(t).groupBy("config").agg(F.round(F.avg("latency"), 2).alias("mean"), F.round(F.stddev_pop("latency"), 2).alias("std")))
SELS = "(SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS selectivity FROM a GROUP BY 1)"
query("agg_sel_filter", sql(f"SELECT vec_id, label FROM a SEMI JOIN (SELECT label FROM {SELS} WHERE selectivity <= 0.1) USING (label)", "a"))(lambda t: t.a.join(F.broadcast(E.label_selectivity(t.a, t.v).where("selectivity <= 0.1").select("label")), "label", "left_semi").select("vec_id", "label"))
query("agg_intersection", f"WITH t AS ({sql(top('q, v x'), 'q', 'v')}), r AS ({sql(top(IVF), 'pr', 'asg')}) SELECT round((SELECT count(*) FROM r JOIN t USING (query_id, vec_id)) / (SELECT count(*) FROM t), 6) AS share")(lambda t: _overlap(t))


def _overlap(t) -> DataFrame:
    found, truth = C.ivf_search(t.q, C.assign_clusters(t.v, t.c), t.c, 10, 4), S.knn(t.q, t.v, 10)
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


@query("agg_sel_group", sql(f"SELECT percentile, label FROM (SELECT p.p AS percentile, s.label, row_number() OVER (PARTITION BY p.p ORDER BY abs(s.selectivity - pv.selectivity), s.label) AS r FROM (SELECT unnest([0.25, 0.5, 1.0])::double AS p) p JOIN (SELECT *, row_number() OVER (ORDER BY selectivity, label) - 1 AS i, count(*) OVER () AS n FROM {SELS}) pv ON pv.i = greatest(0, ceil(p.p * pv.n) - 1) JOIN {SELS} s ON true) WHERE r <= 2", "a"))
def _(t):
    return E.selectivity_groups(E.label_selectivity(t.a, t.v), [0.25, 0.5, 1.0], 2).select("percentile", "label")


query("agg_knn_draws", "SELECT true AS same")(lambda t: t.spark.createDataFrame([(bool(E.same_up_to_draws(S.knn(t.q, t.v, 5), S.top_k(nearest(t.q, t.v, 5, slices=4, prune=False), 5))),)], "same boolean"))


# ------------------------------------------------------ top-k, sorting, windows

for _name in ("topk_heap", "topk_reservoir", "topk_approx", "tree_running_list", "limit_overscan"):
    query(_name, ORACLE["refine"])(lambda t: knn_rows(S.top_k(S.knn(t.q, t.v, 50).drop("rank"), 5)))
query("topk_addn", ORACLE["knn_flat"])(lambda t: knn_rows(S.merge_results([S.knn(t.q, t.v.where(f"vec_id % 2 = {i}"), 10) for i in range(2)], 10)))
query("limit_k", sql("SELECT query_id, vec_id, round(d, 4) AS distance FROM (SELECT query_id, x.vec_id, " + L2 + " AS d FROM q, v x WHERE query_id = 1) ORDER BY d, vec_id LIMIT 10", "q", "v"))(lambda t: S.pairs(t.q.where("query_id = 1"), t.v).orderBy("distance", "vec_id").limit(10).select("query_id", "vec_id", r6("distance").alias("distance")))
query("sort_argsort", "SELECT vec_id, list_transform(list_sort(list_transform(range(8), lambda i: {'v': embedding[i+1], 'i': i})), lambda z: z.i)[1:3] AS perm FROM embeddings")(lambda t: t.v.select("vec_id", F.slice(F.transform(F.array_sort(F.transform(F.slice("embedding", 1, 8), lambda x, i: F.struct(x.alias("v"), i.cast("long").alias("i")))), lambda z: z["i"]), 1, 3).alias("perm")))
query("sort_bucket", "SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")(lambda t: t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")))
query("sort_partition", "SELECT event_id FROM events ORDER BY value, event_id LIMIT 100")(lambda t: t.events.orderBy("value", "event_id").limit(100).select("event_id"))
query("sort_rank_ties", "SELECT l_orderkey, l_linenumber, r FROM (SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem)")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.rank().over(Window.partitionBy("l_orderkey").orderBy("l_quantity")).cast("long").alias("r")))
query("sort_range_results", ORACLE["range_flat"])(lambda t: S.range_search(t.q, t.v, 1.25).repartition("query_id").sortWithinPartitions("query_id", "distance").select("query_id", "vec_id", r6("distance").alias("distance")))
NEARC = f"(SELECT query_id, cluster_id, n, {l2sq_sql('embedding', 'centroid')} AS d FROM (SELECT query_id, q.embedding, cluster_id, centroid, n FROM q, c JOIN (SELECT cluster_id, count(*) AS n FROM asg GROUP BY 1) USING (cluster_id)))"
query("win_prefix_probe", sql(f"SELECT query_id, cluster_id FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY d, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {NEARC}) WHERE b < 100", "q", "asg"))(lambda t: _near(t).withColumn("b", F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("d", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("b < 100").select("query_id", "cluster_id"))
query("win_prune_best", sql(f"SELECT query_id, cluster_id FROM (SELECT *, min(d) OVER (PARTITION BY query_id) AS b FROM {NEARC}) WHERE d <= 1.2 * b", "q", "asg"))(lambda t: _near(t).withColumn("b", F.min("d").over(Window.partitionBy("query_id"))).where("d <= 1.2D * b").select("query_id", "cluster_id"))


def _near(t) -> DataFrame:
    sizes = C.assign_clusters(t.v, t.c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = t.c.join(sizes, "cluster_id")
    return t.q.crossJoin(F.broadcast(nodes)).select("query_id", "cluster_id", "n", V.l2sq("embedding", "centroid").alias("d"))


# ----------------------------------------------------------- sets and scalars

THREE, OTHER = "SELECT vec_id FROM a WHERE label = 3", "SELECT vec_id FROM a WHERE label = 31"
_ids = lambda t, n: t.a.where(F.col("label") == n).select("vec_id")
query("set_intersect", sql(f"{THREE} INTERSECT {OTHER}", "a"))(lambda t: _ids(t, 3).intersect(_ids(t, 31)))
query("set_union", sql(f"{THREE} UNION {OTHER}", "a"))(lambda t: _ids(t, 3).union(_ids(t, 31)).distinct())
query("set_difference", sql(f"{THREE} EXCEPT {OTHER}", "a"))(lambda t: _ids(t, 3).exceptAll(_ids(t, 31)))
query("set_merge", sql(f"{THREE} UNION ALL {OTHER}", "a"))(lambda t: _ids(t, 3).union(_ids(t, 31)))
query("set_contains", sql("SELECT vec_id, list_contains(labels, 12) AS has FROM wide", "wide"))(lambda t: t.wide.select("vec_id", F.array_contains("labels", 12).alias("has")))
query("set_prefix_restrict", sql("SELECT vec_id FROM leaf WHERE n1 = 2", "leaf"))(lambda t: _leaves(t).where("n1 = 2").select("vec_id"))
query("set_permute", "SELECT (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS place, vec_id FROM embeddings")(lambda t: t.v.crossJoin(F.broadcast(t.v.agg(F.count(F.lit(1)).alias("n")))).select(((F.col("vec_id") * 7 + 1) % F.col("n")).alias("place"), "vec_id"))
query("set_roaring", sql("SELECT label, count(DISTINCT vec_id) AS n FROM a GROUP BY 1", "a"))(lambda t: t.a.select("label", F.bitmap_bucket_number("vec_id").alias("b"), F.bitmap_bit_position("vec_id").alias("p")).groupBy("label", "b").agg(F.bitmap_count(F.bitmap_construct_agg("p")).alias("n")).groupBy("label").agg(F.sum("n").alias("n")))
query("str_categories", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first FROM part")(lambda t: t.part.select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("first")))
query("str_template", "SELECT vec_id, 'AND ' || label || ' ' || (label + 1) AS formula FROM embeddings")(lambda t: t.embeddings.select("vec_id", F.format_string("AND %d %d", F.col("label"), F.col("label") + 1).alias("formula")))
query("str_pattern_and", "SELECT vec_id, label AS a, label + 1 AS b FROM embeddings")(lambda t: t.embeddings.withColumn("f", F.format_string("AND %d %d", F.col("label"), F.col("label") + 1)).select("vec_id", *(F.regexp_extract("f", r"^AND (\d+) (\d+)$", k).cast("int").alias(n) for k, n in ((1, "a"), (2, "b")))))
query("str_factory", "SELECT * FROM (VALUES ('IVF64,Flat', 64), ('PCA32,IVF16,SQ8', 16)) t(spec, nlist)")(lambda t: t.spark.createDataFrame([("IVF64,Flat",), ("PCA32,IVF16,SQ8",)], "spec string").withColumn("nlist", F.regexp_extract("spec", r"IVF(\d+)", 1).cast("int")))
query("str_dataset_key", "SELECT p_partkey, split_part(p_brand, '#', 2) AS part FROM part")(lambda t: t.part.select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part")))
query("json_list", "SELECT vec_id, round(embedding[1]::double + embedding[2]::double, 4) AS total FROM embeddings")(lambda t: t.v.select("vec_id", r6(V.total(F.from_json(F.to_json(V.doubles(F.slice("embedding", 1, 2))), "array<double>"))).alias("total")))
query("map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE -1 END AS code FROM events")(lambda t: t.events.select("event_id", F.coalesce(F.element_at(F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2)), F.col("event_type")), F.lit(-1)).alias("code")))


# --------------------------------------------------------------- SQL, streams


@query("sql_boolean_col", sql(top("q, wide x WHERE query_id = 1 AND list_contains(x.labels, 31)", 10), "q", "wide"))
def _(t):
    flags = t.wide.select("vec_id", "embedding", F.array_contains("labels", 31).alias("label_31"))
    return knn_rows(S.knn(t.q.where("query_id = 1"), flags, 10, where=F.col("label_31")))


query("sql_complex", sql(top("q, wide x WHERE query_id = 1 AND (list_contains(x.labels, 3) OR list_contains(x.labels, 12))", 10), "q", "wide"))(lambda t: knn_rows(S.knn(t.q.where("query_id = 1"), t.wide, 10, where=F.expr("array_contains(labels, 3) OR array_contains(labels, 12)"))))
query("sql_strict_order", ORACLE["refine"])(lambda t: knn_rows(S.refine(S.knn(t.q, t.v, 5), t.q, t.v, 5)))
query("sql_schema", sql("SELECT vec_id, len(labels) AS n FROM wide", "wide"))(lambda t: t.wide.select("vec_id", F.size("labels").cast("long").alias("n")))


@query("stream_insert", "SELECT DISTINCT user_id AS vec_id, event_type AS label FROM events")
def _(t):
    """Grants arrive as a file stream; what is there is handled and the query ends."""
    from ..streaming.access_log import follow, followed

    base = scratch(t, "stream")
    log = t.events.select(F.col("user_id").alias("vec_id"), F.col("event_type").alias("label"), F.lit("grant").alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    log.write.parquet(f"{base}/in")
    arriving = t.spark.readStream.schema(log.schema).parquet(f"{base}/in")
    follow(arriving, f"{base}/out", f"{base}/mark").trigger(availableNow=True).start().awaitTermination()
    return followed(t.spark, f"{base}/out")


query("prep_embed_text", "SELECT vec_id, round((embedding[1]::double + embedding[3]::double) / 2, 4) AS pooled FROM embeddings")(lambda t: t.v.select("vec_id", r6(F.get(V.masked_mean(F.transform(F.slice("embedding", 1, 3), lambda x: F.array(x.cast("double"))), F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))), F.lit(0))).alias("pooled")))
query("idalloc", "SELECT l_suppkey AS label, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS code FROM (SELECT DISTINCT l_suppkey FROM lineitem)")(lambda t: R.label_encode(_facts(t), "label").withColumn("code", F.col("code").cast("long")))
