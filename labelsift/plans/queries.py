"""The engine's registered queries with their DuckDB equivalents, one entry for each operator of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import codecs as K
from ..operators import evaluate as E
from ..operators import prepare as R
from ..operators import search as S
from ..operators.nearest import nearest
from .fixtures import FORMULAS, Tables, _dot, l2sq_sql, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 4)


def knn_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, F.col("query_id").cast("long"), F.col("rank").cast("long").alias("rank"), F.col("vec_id").cast("long"), r6("distance").alias("distance"))


L2 = f"sqrt({l2sq_sql('q.embedding', 'x.embedding')})"


def top_sql(source: str, k: int = 10, distance: str = L2, by: str = "query_id", more: str = "", desc: str = "") -> str:
    """kNN rows over ``source``, a FROM clause with q and x."""
    cols = ", ".join(c for c in (more, "query_id") if c)
    return f"SELECT {cols}, rank, vec_id, round(distance, 4) AS distance FROM (SELECT {cols}, x.vec_id, distance, row_number() OVER (PARTITION BY {by} ORDER BY distance {desc}, x.vec_id) AS rank FROM (SELECT *, {distance} AS distance FROM {source}) x) WHERE rank <= {k}"


def top(source: str, k: int = 10, distance: str = L2, by: str = "query_id", more: str = "", desc: str = "") -> str:
    cols = ", ".join(c for c in (more, "query_id") if c)
    return f"SELECT {cols}, rank, vec_id, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d {desc}, vec_id) AS rank FROM (SELECT {cols}, x.vec_id, {distance} AS d FROM {source})) WHERE rank <= {k}"


# ------------------------------------------------------------------ distances

X, Y = "z[1]::double", "z[2]::double"
PX, PY = "(abs(z[1]::double)+0.001)", "(abs(z[2]::double)+0.001)"


def _pairs(t: Tables, own: Callable[[str], Column] = F.col) -> DataFrame:
    """The stated queries with every vector; ``own`` is worked out for each row before they meet."""
    a = t.q.select(F.col("query_id").alias("i"), own("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("j"), own("embedding").alias("y"))
    return b.crossJoin(F.broadcast(a) if S.fits(t.q) else a)


PAIRS = "(SELECT a.vec_id AS i, b.vec_id AS j, a.embedding AS x, b.embedding AS y FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 1)"
POSITIVE = lambda c: F.transform(V.doubles(c), lambda a: F.abs(a) + 0.001)


def _distance(name: str, f: Callable[[Column, Column], Column], text: str) -> None:
    query(name, f"SELECT i, j, round({text}, 4) AS value FROM {PAIRS}")(lambda t: _pairs(t).select("i", "j", r6(f(F.col("x"), F.col("y"))).alias("value")))


def _d(term: str) -> str:
    return _dot("x", "y", term)


_distance("dist_l2sq", V.l2sq, _d(f"({X}-{Y})*({X}-{Y})"))
_distance("dist_l2", V.l2, f"sqrt({_d(f'({X}-{Y})*({X}-{Y})')})")
_distance("dist_ip", V.inner_product, _d(f"{X}*{Y}"))
_distance("dist_l1", V.l1, _d(f"abs({X}-{Y})"))
_distance("dist_linf", V.linf, f"list_max(list_transform(list_zip(x, y), lambda z: abs({X}-{Y})))")
_distance("dist_lp", lambda x, y: V.lp(x, y, 3), _d(f"pow(abs({X}-{Y}), 3)"))
_distance("dist_canberra", V.canberra, _d(f"coalesce(abs({X}-{Y})/nullif(abs({X})+abs({Y}),0),0)"))
_distance("dist_braycurtis", V.braycurtis, f"{_d(f'abs({X}-{Y})')}/{_d(f'abs({X}+{Y})')}")
_distance("dist_jaccard", lambda x, y: V.jaccard(POSITIVE(x), POSITIVE(y)), f"{_d(f'least({PX},{PY})')}/{_d(f'greatest({PX},{PY})')}")
_distance("dist_jensenshannon", lambda x, y: V.jensenshannon(POSITIVE(x), POSITIVE(y)), f"{_d(f'-{PX}*ln(({PX}+{PY})/2/{PX})-{PY}*ln(({PX}+{PY})/2/{PY})')}/2")
_distance("dist_cosine", V.cosine, f"{_d(f'{X}*{Y}')}/(sqrt({_dot('x', 'x', f'{X}*{Y}')})*sqrt({_dot('y', 'y', f'{X}*{Y}')}))")
query("dist_hamming", f"SELECT i, j, round({_d('((z[1]>0)<>(z[2]>0))::int') + '::double'}, 4) AS value FROM {PAIRS}")(lambda t: _pairs(t, V.pack_signs).select("i", "j", V.hamming("x", "y").cast("double").alias("value")))
_distance("dist_gen_hamming", lambda x, y: V.generalized_hamming(F.transform(x, lambda a: F.floor(a * 10)), F.transform(y, lambda a: F.floor(a * 10))).cast("double"), _d("(floor(z[1]*10)<>floor(z[2]*10))::int") + "::double")
_distance("vec_ip_to_l2", lambda x, y: V.ip_to_l2sq(V.norm_sq(x), V.norm_sq(y), V.inner_product(x, y)), _d(f"({X}-{Y})*({X}-{Y})"))
_distance("vec_madd", lambda x, y: V.total(V.madd(x, 0.5, y)), _d(f"{X}+0.5*{Y}"))
_distance("vec_add", lambda x, y: V.total(V.add(x, y)), _d(f"{X}+{Y}"))
_distance("vec_sub", lambda x, y: V.total(V.sub(x, y)), _d(f"{X}-{Y}"))


def _scalar(name: str, f: Callable[[], Column], text: str, kind: str | None = None) -> None:
    query(name, f"SELECT vec_id, {text} AS value FROM embeddings")(lambda t: t.embeddings.select("vec_id", (f().cast(kind) if kind else f()).alias("value")))


_scalar("vec_norm", lambda: r6(V.norm("embedding")), f"round(sqrt({_dot('embedding', 'embedding', f'{X}*{Y}')}), 4)")
_scalar("vec_normalize", lambda: r6(V.total(V.normalize("embedding"))), f"round(list_sum(list_transform(embedding, lambda x: x::double)) / sqrt({_dot('embedding', 'embedding', f'{X}*{Y}')}), 4)")
_scalar("vec_add_scalar", lambda: r6(V.total(V.add_scalar("embedding", 2))), "round(list_sum(list_transform(embedding, lambda x: x::double + 2)), 4)")
_scalar("vec_argmin", lambda: V.argmin("embedding"), "(list_position(embedding, list_min(embedding)) - 1)::int")
_scalar("vec_dim_check", lambda: F.size("embedding"), "len(embedding)::int")
_scalar("vec_to_literal", lambda: V.to_literal(F.slice("embedding", 1, 3)), "'[' || array_to_string(list_transform(embedding[1:3], lambda x: printf('%.6f', x::double)), ',') || ']'")
_scalar("bits_pack", lambda: F.get(V.pack_signs(F.slice("embedding", 1, 32)), F.lit(0)), "list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::bigint << i) ELSE 0 END))::bigint")
_scalar("bits_unpack", lambda: V.total(V.unpack_signs(V.pack_signs("embedding"), 64)), "list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::double ELSE -1.0::double END))")
_scalar("prep_rescale", lambda: r6(V.total(V.rescale_u8(F.transform("embedding", lambda a: F.floor(a.cast("double") * 100 + 100))))), "round(list_sum(list_transform(embedding, lambda x: floor(x::double*100+100)/255-0.5)), 4)")
_scalar("tf_remap", lambda: r6(V.total(V.remap("embedding", [3, -1, 0]))), "round(embedding[4]::double + embedding[1]::double, 4)")
_scalar("tf_linear", lambda: r6(V.total(V.linear(F.slice("embedding", 1, 2), [[1, 2], [0, 1]], [1, 1]))), "round(embedding[1]::double + 3*embedding[2]::double + 2, 4)")
_scalar("topk_kmin_kmax", lambda: r6(V.total(V.doubles(F.slice(F.array_sort("embedding"), 1, 5)))), "round(list_sum(list_transform(list_sort(embedding)[1:5], lambda x: x::double)), 4)")
_scalar("path_bits", lambda: V.path_child(V.path_code([F.col("vec_id") % 64, F.col("vec_id") % 7]), 1), "(vec_id % 7)::int")

# ---------------------------------------------------------------------- joins


@query("knn_flat", sql(top("q, v x"), "q", "v"))
def _(t):
    return knn_rows(S.knn(t.q, t.v, 10))


@query("knn_flat_ip", sql(top("q, v x", distance=_dot("q.embedding", "x.embedding", f"{X}*{Y}"), desc="DESC"), "q", "v"))
def _(t):
    return knn_rows(S.knn(t.q, t.v, 10, "ip"))


@query("topk_merge", sql(top("q, v x"), "q", "v"))
def _(t):
    return knn_rows(S.merge_results([S.knn(t.q, t.v.where(f"vec_id % 3 = {i}"), 10) for i in range(3)], 10))


@query("shard_search", sql(top("q, v x", 5), "q", "v"))
def _(t):
    return knn_rows(S.merge_results([S.knn(t.q, t.v.where(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == i), 5) for i in range(4)], 5))


@query("topk_single", sql(top("q, v x", 1), "q", "v"))
def _(t):
    return knn_rows(S.knn(t.q, t.v, 1))


@query("assign", sql("SELECT query_id, rank, vec_id FROM (" + top("q, v x", 3) + ")", "q", "v"))
def _(t):
    return S.assign(t.q, t.v, 3).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("search_recons", sql(f"SELECT query_id, rank, vec_id, distance, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) AS total FROM ({top('q, v x', 5)}) JOIN embeddings USING (vec_id)", "q", "v"))
def _(t):
    return S.search_and_reconstruct(t.q, t.v, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", r6("distance").alias("distance"), r6(V.total(V.doubles("embedding"))).alias("total"))


@query("knn_prefilter", sql(top("q, v x SEMI JOIN (SELECT vec_id FROM a WHERE label = 3) USING (vec_id)"), "q", "v", "a"))
def _(t):
    return knn_rows(S.knn_label(t.q, t.v, t.a, 10, 3))


FLAGSHIP = sql(top("q JOIN a qa ON q.query_id = qa.vec_id JOIN a h ON h.label = qa.label JOIN v x ON x.vec_id = h.vec_id", by="query_id, label", more="qa.label").replace("SELECT qa.label, query_id, rank", "SELECT label, query_id, rank"), "q", "a", "v")


@query("knn_filtered_batch", FLAGSHIP)
def _(t):
    labels = t.a.where("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), "label")
    return knn_rows(S.knn_by_label(t.q, labels, t.v, t.a, 10), "label")


WHERE = {i: P.to_sql(f, "labels", "list_contains") for i, f in FORMULAS.items()}
P_ROWS = " UNION ALL ".join(f"SELECT {i} AS pred_id, vec_id, embedding FROM wide WHERE {w}" for i, w in WHERE.items())


@query("knn_predicate_batch", sql(f"SELECT pred_id, query_id, rank, vec_id, distance, round(n / (SELECT count(*) FROM wide), 6) AS selectivity FROM ({top('q, p x', 5, by='pred_id, query_id', more='pred_id')}) JOIN (SELECT pred_id, count(*) AS n FROM p GROUP BY 1) USING (pred_id)", "q", "wide").replace(" SELECT pred_id, query_id", f", p AS ({P_ROWS}) SELECT pred_id, query_id", 1))
def _(t):
    got = S.knn_formulas(t.q, t.wide, FORMULAS, 5)
    return knn_rows(got, "pred_id", F.round("selectivity", 6).alias("selectivity"))


@query("knn_bitmap", sql(top("q, v x SEMI JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) USING (vec_id)"), "q", "v"))
def _(t):
    return knn_rows(S.knn_ids(t.q, t.v, t.embeddings.where("vec_id % 3 = 0").select("vec_id"), 10))


def _by_residue(t: Tables, n: int) -> DataFrame:
    """Each query with the vectors (vec_id, y) whose ids it names: those that with its own add up to a multiple of ``n``."""
    own = t.q.withColumn("_r", F.pmod(-F.col("query_id"), F.lit(n)))
    return t.v.select("vec_id", F.col("embedding").alias("y"), F.pmod("vec_id", F.lit(n)).alias("_r")).join(F.broadcast(own) if S.fits(t.q) else own, "_r").drop("_r")


@query("knn_by_ids", sql(top("q JOIN v x ON (x.vec_id + q.query_id) % 7 = 0", 5), "q", "v"))
def _(t):
    return knn_rows(S.knn_candidates(_by_residue(t, 7).select("query_id", "vec_id"), t.q, t.v, 5))


@query("dist_by_idx", sql(f"SELECT query_id, x.vec_id, round({L2}, 4) AS distance FROM q JOIN v x ON (x.vec_id + q.query_id) % 17 = 0", "q", "v"))
def _(t):
    own = _by_residue(t, 17)
    return own.select("query_id", "vec_id", r6(V.l2("embedding", "y")).alias("distance"))


@query("range_flat", sql(f"SELECT * FROM (SELECT query_id, x.vec_id, round({L2}, 4) AS distance FROM q, v x WHERE {L2} < 1.25)", "q", "v"))
def _(t):
    return S.range_search(t.q, t.v, 1.25).select("query_id", "vec_id", r6("distance").alias("distance"))


@query("range_tenant", sql(f"SELECT query_id, x.vec_id, round({L2}, 4) AS distance FROM q, wide x WHERE list_contains(labels, 3) AND {L2} < 1.3", "q", "wide"))
def _(t):
    return S.range_search(t.q, t.wide, 1.3, where=P.to_column("3")).select("query_id", "vec_id", r6("distance").alias("distance"))


@query("range_maxres", sql(f"SELECT query_id, vec_id, round(d, 4) AS distance FROM (SELECT query_id, x.vec_id, {L2} AS d FROM q, v x) WHERE d < (SELECT max(d) FROM (SELECT {L2} AS d FROM q, v x ORDER BY d LIMIT 51))", "q", "v"))
def _(t):
    return S.range_max_results(t.q, t.v, 50).select("query_id", "vec_id", r6("distance").alias("distance"))


@query("range_threshold", sql(f"SELECT query_id, x.vec_id, round({L2}, 4) AS distance FROM q, v x WHERE {L2} < 1.1", "q", "v"))
def _(t):
    return S.range_search(t.q, t.v, 1.25).where("distance < 1.1").select("query_id", "vec_id", r6("distance").alias("distance"))


@query("knn_hamming", sql(top("q, v x", 5, _dot("q.embedding", "x.embedding", "((z[1]>0)<>(z[2]>0))::int") + "::double"), "q", "v"))
def _(t):
    pack = lambda d: d.withColumn("embedding", V.pack_signs("embedding"))
    return knn_rows(S.knn(pack(t.q), pack(t.v), 5, "hamming").withColumn("distance", F.col("distance").cast("double")))


@query("match_hamming", sql(f"SELECT count(*) AS matches FROM v a, v b WHERE a.vec_id < b.vec_id AND {_dot('a.embedding', 'b.embedding', '((z[1]>0)<>(z[2]>0))::int')} <= 22", "v"))
def _(t):
    w = t.v.select("vec_id", V.pack_signs("embedding").alias("w"))
    return S.block_pairs(w).where((F.col("query_id") < F.col("vec_id")) & (V.hamming("_q", "w") <= 22)).agg(F.count(F.lit(1)).alias("matches"))


@query("knn_graph", sql("SELECT query_id, rank, vec_id, distance FROM (" + top("(SELECT vec_id AS query_id, embedding FROM embeddings) q JOIN (SELECT vec_id, embedding FROM embeddings) x ON q.query_id <> x.vec_id", 3) + ")"))
def _(t):
    return knn_rows(S.knn_graph(t.v, 3))


@query("reconstruct", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) AS total FROM embeddings WHERE vec_id % 9 = 0")
def _(t):
    return S.reconstruct(t.v, t.embeddings.where("vec_id % 9 = 0").select("vec_id")).select("vec_id", r6(V.total(V.doubles("embedding"))).alias("total"))


@query("anti_delete", "SELECT count(*) AS left_over, sum(vec_id)::bigint AS ids FROM embeddings WHERE vec_id % 4 <> 0")
def _(t):
    return S.remove(t.v, t.embeddings.where("vec_id % 4 = 0").select("vec_id")).agg(F.count(F.lit(1)).alias("left_over"), F.sum("vec_id").alias("ids"))


@query("id_join", "SELECT l.l_orderkey AS k, e.vec_id FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN embeddings e ON e.vec_id = l.l_orderkey")
def _(t):
    keys = t.lineitem.select(F.col("l_orderkey").alias("k")).distinct()
    return keys.join(t.v.select("vec_id"), F.col("k") == F.col("vec_id"), "left")


@query("refine", sql("SELECT query_id, rank, vec_id, distance FROM (" + top("q, v x", 5) + ")", "q", "v"))
def _(t):
    return knn_rows(S.refine(S.knn(t.q, t.v, 20, "l2sq"), t.q, t.v, 5))


# ----------------------------------------------------------------- predicates


@query("pred_eval", sql(" UNION ALL ".join(f"SELECT {i} AS pred_id, count(*) AS n, coalesce(sum(vec_id), 0)::bigint AS ids FROM wide WHERE {w}" for i, w in WHERE.items()), "wide"))
def _(t):
    s, each = t.spark, None
    w = t.wide
    agg = w.agg(*(x for i, f in FORMULAS.items() for x in (F.count_if(P.to_column(f)).alias(f"n{i}"), F.coalesce(F.sum(F.when(P.to_column(f), F.col("vec_id"))), F.lit(0)).alias(f"s{i}"))))
    return agg.select(F.explode(F.array(*(F.struct(F.lit(i).alias("pred_id"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("ids")) for i in FORMULAS))).alias("x")).select("x.*")


@query("pred_table", ORACLE["pred_eval"])
def _(t):
    formulas = t.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{f}')" for i, f in FORMULAS.items()) + " AS t(pred_id, formula)")
    both = t.wide.select("vec_id", "labels").crossJoin(F.broadcast(formulas))
    ok = both.withColumn("ok", P.evaluate_table(both))
    return ok.groupBy("pred_id").agg(F.count_if("ok").alias("n"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("vec_id"))), F.lit(0)).alias("ids"))


@query("pred_universe_all", sql("SELECT count(*) AS n FROM wide WHERE NOT list_contains(labels, 3)", "wide"))
def _(t):
    return t.wide.where(P.to_column("NOT 3", universe="all")).agg(F.count(F.lit(1)).alias("n"))


@query("pred_qualified", sql(f"SELECT vec_id FROM wide WHERE {WHERE[6]}", "wide"))
def _(t):
    return t.wide.where(P.to_column(FORMULAS[6])).select("vec_id")


@query("pred_to_sql", sql(f"SELECT vec_id FROM wide WHERE {WHERE[8]}", "wide"))
def _(t):
    return t.wide.where(P.to_sql(FORMULAS[8])).select("vec_id")


@query("pred_and", sql("SELECT vec_id FROM a WHERE label = 3 INTERSECT SELECT vec_id FROM a WHERE label = 31", "a"))
def _(t):
    return t.a.where("label = 3").select("vec_id").intersect(t.a.where("label = 31").select("vec_id"))


@query("pred_or", sql("SELECT vec_id FROM a WHERE label = 3 UNION SELECT vec_id FROM a WHERE label = 12", "a"))
def _(t):
    return t.a.where("label in (3, 12)").select("vec_id").distinct()


@query("pred_not", sql("SELECT vec_id FROM a EXCEPT SELECT vec_id FROM a WHERE label = 3", "a"))
def _(t):
    return t.a.select("vec_id").distinct().join(t.a.where("label = 3"), "vec_id", "left_anti")


@query("pred_state", sql("SELECT cluster_id, CASE WHEN n = 0 THEN 'NONE' WHEN n = total THEN 'ALL' ELSE 'SOME' END AS state FROM (SELECT cluster_id, count(*) AS total, count(*) FILTER (WHERE list_contains(labels, 31)) AS n FROM asg JOIN wide USING (vec_id) GROUP BY 1)", "asg", "wide"))
def _(t):
    got = C.assign_clusters(t.wide, t.c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("labels", 31)).alias("c"))
    least, most = P.cluster_state("31", {31: F.col("c")}, F.col("n"))
    return got.select("cluster_id", P.state_name(least, most, F.col("n")).alias("state"))


@query("sel_range", "SELECT vec_id FROM embeddings WHERE vec_id >= 10 AND vec_id < 50")
def _(t):
    return t.v.where(P.in_range(F.col("vec_id"), 10, 50)).select("vec_id")


@query("sel_bitmap", "SELECT vec_id FROM embeddings WHERE vec_id < 16 AND vec_id % 2 = 0")
def _(t):
    return t.v.where(P.in_bitmap(F.col("vec_id"), bytes([0b01010101, 0b01010101]))).select("vec_id")


@query("sel_batch", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT user_id FROM events)")
def _(t):
    return t.v.select("vec_id").join(t.events.select(F.col("user_id").alias("vec_id")).distinct(), "vec_id", "left_semi")


@query("sel_xor", "SELECT vec_id FROM embeddings WHERE (vec_id % 2 = 0) <> (vec_id % 3 = 0)")
def _(t):
    return t.v.where((F.col("vec_id") % 2 == 0) != (F.col("vec_id") % 3 == 0)).select("vec_id")


@query("sel_tenant", sql("SELECT vec_id FROM wide WHERE vec_id < 200 AND list_contains(labels, 3)", "wide"))
def _(t):
    return t.wide.where((F.col("vec_id") < 200) & P.to_column("3")).select("vec_id")


# ---------------------------------------------------------- clusters and trees

IVF = "pr q JOIN asg x ON q.cluster_id = x.cluster_id"


@query("kmeans_assign", sql("SELECT vec_id, cluster_id, round(cluster_distance, 4) AS d FROM asg", "asg"))
def _(t):
    return C.assign_clusters(t.v, t.c).select("vec_id", "cluster_id", r6("cluster_distance").alias("d"))


@query("kmeans", sql("SELECT cluster_id, dim, round(avg(x), 4) AS x, count(*) AS n FROM (SELECT cluster_id, unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM asg) GROUP BY ALL", "asg"))
def _(t):
    got = C.lloyd_step(C.assign_clusters(t.v, t.c))
    return got.select("cluster_id", F.posexplode("centroid").alias("dim", "x"), "n").select("cluster_id", "dim", r6("x").alias("x"), "n")


@query("ivf_flat", sql(top(IVF), "pr", "asg"))
def _(t):
    return knn_rows(C.ivf_search(t.q, C.assign_clusters(t.v, t.c), t.c, 10, 4))


@query("ivf_range", sql(f"SELECT query_id, x.vec_id, round({L2}, 4) AS distance FROM {IVF} WHERE {L2} < 1.25", "pr", "asg"))
def _(t):
    return C.ivf_range(t.q, C.assign_clusters(t.v, t.c), t.c, 1.25, 4).select("query_id", "vec_id", r6("distance").alias("distance"))


@query("ivf_shared", sql(top("pr q JOIN asg ON q.cluster_id = asg.cluster_id JOIN wide x ON x.vec_id = asg.vec_id WHERE list_contains(x.labels, 31)"), "pr", "asg", "wide"))
def _(t):
    return knn_rows(C.ivf_search(t.q, C.assign_clusters(t.wide, t.c), t.c, 10, 4, where=P.to_column("31")))


@query("ivf_shared_formula", sql(top(f"pr q JOIN asg ON q.cluster_id = asg.cluster_id JOIN wide x ON x.vec_id = asg.vec_id WHERE {WHERE[5]}".replace("labels", "x.labels")), "pr", "asg", "wide"))
def _(t):
    return knn_rows(C.ivf_search(t.q, C.assign_clusters(t.wide, t.c), t.c, 10, 4, where=P.to_column(FORMULAS[5])))


@query("ivf_per_label", sql(top("pr q JOIN asg ON q.cluster_id = asg.cluster_id JOIN a ON a.vec_id = asg.vec_id JOIN v x ON x.vec_id = a.vec_id WHERE a.label = 12"), "pr", "asg", "a", "v"))
def _(t):
    own = C.assign_clusters(t.v, t.c).join(t.a.where("label = 12").select("vec_id"), "vec_id", "left_semi")
    return knn_rows(C.ivf_search(t.q, own, t.c, 10, 4))


@query("ivf_bloom", sql("SELECT query_id, rank, vec_id, distance FROM (" + top("(SELECT query_id, q.embedding, cluster_id FROM (SELECT q.query_id, q.embedding, c.cluster_id, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY " + l2sq_sql("q.embedding", "c.centroid") + ", cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q, c JOIN (SELECT cluster_id, count(*) AS n FROM asg JOIN a USING (vec_id) WHERE label = 31 GROUP BY 1) USING (cluster_id)) q WHERE before < 50) q JOIN asg x ON x.cluster_id = q.cluster_id JOIN (SELECT vec_id FROM a WHERE label = 31) h ON h.vec_id = x.vec_id") + ")", "q", "asg", "a"))
def _(t):
    return knn_rows(C.ivf_label_probes(t.q, C.assign_clusters(t.v, t.c), t.a, t.c, 31, 10))


@query("ivf_list_tools", sql("SELECT cluster_id, count(*) AS n FROM asg GROUP BY 1", "asg"))
def _(t):
    return C.assign_clusters(t.v, t.c).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("ivf_dedup", "SELECT min(vec_id) AS vec_id, count(*) AS copies FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::double * 2)::int) AS e FROM embeddings) GROUP BY e")
def _(t):
    return t.v.groupBy(F.transform("embedding", lambda x: F.round(x.cast("double") * 2).cast("int")).alias("e")).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).drop("e")


@query("residual", sql(f"SELECT vec_id, round(sqrt({l2sq_sql('embedding', 'centroid')}), 4) AS norm FROM asg JOIN c USING (cluster_id)", "asg"))
def _(t):
    return C.assign_clusters(t.v, t.c).join(t.c, "cluster_id").select("vec_id", r6(V.norm(V.sub("embedding", "centroid"))).alias("norm"))


@query("tree_insert", sql("SELECT vec_id, n1, n2 FROM leaf", "leaf"))
def _(t):
    return C.assign_tree(t.v, t.l1, t.l2).select("vec_id", "n1", "n2")


@query("tree_shortlists", sql("SELECT label, CASE WHEN c0 <= 10 THEN 0 WHEN c1 <= 10 THEN 1 ELSE 2 END AS level, CASE WHEN c0 <= 10 THEN '' WHEN c1 <= 10 THEN n1::varchar ELSE n1 || '/' || n2 END AS path, count(*) AS n FROM (SELECT label, n1, n2, count(*) OVER (PARTITION BY label) AS c0, count(*) OVER (PARTITION BY label, n1) AS c1 FROM a JOIN leaf USING (vec_id)) GROUP BY ALL", "a", "leaf"))
def _(t):
    return C.short_lists(C.assign_tree(t.v, t.l1, t.l2), t.a, 10).groupBy("label", "level", "path").agg(F.count(F.lit(1)).alias("n"))


@query("tree_score", sql(f"SELECT n1, count(*) AS n, round(avg({l2sq_sql('embedding', 'centroid')}), 4) AS var_mean FROM leaf JOIN l1 USING (n1) GROUP BY 1", "leaf", "l1"))
def _(t):
    return C.node_stats(C.assign_tree(t.v, t.l1, t.l2), t.l1).select("n1", "n", r6("var_mean").alias("var_mean"))


@query("tree_search_unfiltered", sql("SELECT query_id, rank, vec_id, distance FROM (" + top("(SELECT * FROM (SELECT query_id, embedding, n1, s, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY s, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(s) OVER (PARTITION BY query_id) AS best FROM (SELECT query_id, q.embedding, n1, n, " + l2sq_sql("q.embedding", "centroid") + " AS s FROM q, l1 JOIN (SELECT n1, count(*) AS n FROM leaf GROUP BY 1) USING (n1))) WHERE before < 200 AND s <= best * 1.6) q JOIN leaf x ON q.n1 = x.n1") + ")", "q", "leaf", "l1"))
def _(t):
    return knn_rows(C.tree_search(t.q, C.assign_tree(t.v, t.l1, t.l2), t.l1, 10, 200))


@query("tree_info", sql("SELECT count(*) AS leaves, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, min(n) AS least, max(n) AS most FROM (SELECT n1, n2, count(*) AS n FROM leaf GROUP BY ALL)", "leaf"))
def _(t):
    return C.tree_info(C.assign_tree(t.v, t.l1, t.l2)).select("leaves", r6("mean").alias("mean"), r6("std").alias("std"), "least", "most")


@query("hybrid", ORACLE["knn_prefilter"])
def _(t):
    return knn_rows(C.hybrid_search(t.q, C.assign_clusters(t.v, t.c), t.a, t.c, 3, 10, 0.5, 4))


@query("split_vectors", sql("SELECT query_id, sum(d)::double AS distance, list(vec_id ORDER BY part) AS ids FROM (SELECT query_id, part, vec_id, round(d, 4) AS d FROM (SELECT query_id, part, x.vec_id, " + l2sq_sql("q.embedding[part*32+1:part*32+32]", "x.embedding[part*32+1:part*32+32]") + " AS d FROM q, v x, range(2) r(part)) QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY d, vec_id) = 1) GROUP BY 1", "q", "v").replace("sum(d)::double AS distance", "round(sum(d), 3) AS distance"))
def _(t):
    halves = lambda d, key: d.select(key, F.posexplode(F.array(*(F.slice("embedding", p * 32 + 1, 32) for p in range(2)))).alias("part", "embedding"))
    best = S.top_k(nearest(halves(t.q, "query_id"), halves(t.v, "vec_id"), 1, "l2sq", group="part", own=True), 1, "l2sq", ("query_id", "part"))
    return best.groupBy("query_id").agg(F.round(F.sum(r6("distance")), 3).alias("distance"), F.transform(F.array_sort(F.collect_list(F.struct("part", "vec_id"))), lambda z: z["vec_id"]).alias("ids"))


# ------------------------------------------------------------------- codecs

SQ_LIMITS = "SELECT dim, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1"


@query("sq_train", SQ_LIMITS)
def _(t):
    return K.sq_limits(t.v)


@query("sq", f"SELECT vec_id, sum(floor((x - lo) / (hi - lo) * 255))::bigint AS codes FROM (SELECT vec_id, unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) JOIN ({SQ_LIMITS}) USING (dim) GROUP BY 1")
def _(t):
    got = K.sq_encode(t.v, K.sq_limits(t.v))
    return got.select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("codes"))


@query("rowwise_minmax", "SELECT vec_id, round(list_min(embedding)::double, 4) AS lo, list_sum(list_transform(embedding, lambda x: round((x::double - list_min(embedding)::double) / (list_max(embedding)::double - list_min(embedding)::double) * 255)))::bigint AS codes FROM embeddings")
def _(t):
    return K.rowwise(t.v).select("vec_id", r6("lo").alias("lo"), F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("codes"))


PQ = f"SELECT vec_id, m, c FROM (SELECT e.vec_id, m, c.vec_id AS c, row_number() OVER (PARTITION BY e.vec_id, m ORDER BY {l2sq_sql('e.embedding[m*8+1:m*8+8]', 'c.embedding[m*8+1:m*8+8]')}, c.vec_id) AS r FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 16) c, (SELECT unnest(range(8))::int AS m)) WHERE r = 1"


@query("pq", PQ)
def _(t):
    return K.pq_encode(t.v, t.c.select(F.col("cluster_id").alias("c"), "centroid"), 8)


@query("lsh", sql(top("q, v x", 5, _dot("q.embedding", "x.embedding", "((z[1]>0)<>(z[2]>0))::int") + "::double"), "q", "v"))
def _(t):
    return QUERIES["knn_hamming"](t.spark, t.dir)


@query("bin_hash", sql("SELECT a.vec_id AS i, b.vec_id AS j FROM v a, v b WHERE a.vec_id < b.vec_id AND list_sum(list_transform(range(12), lambda k: ((a.embedding[k+1]>0)<>(b.embedding[k+1]>0))::int)) <= 1 AND " + _dot("a.embedding", "b.embedding", "((z[1]>0)<>(z[2]>0))::int") + " <= 24", "v"))
def _(t):
    return K.hash_pairs(t.v, 12, 1, 24)


@query("tf_center", "SELECT dim, round(avg(x), 4) AS mean FROM (SELECT unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1")
def _(t):
    return K.mean_vector(t.v).select("dim", r6("mean").alias("mean"))


@query("tf_pca", "SELECT count(DISTINCT dim) AS dims, round(sum(v), 3) AS variance FROM (SELECT dim, var_samp(x) AS v FROM (SELECT unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1)")
def _(t):
    values, _ = K.pca(t.v)
    return t.spark.sql(f"SELECT CAST({len(values)} AS BIGINT) AS dims, round(CAST({float(sum(values))!r} AS DOUBLE), 3) AS variance")


# --------------------------------------------------------------- evaluation

TRUTH = sql(top("q, v x"), "q", "v")
EVAL = f"WITH t AS ({TRUTH}), r AS ({sql(top(IVF), 'pr', 'asg')}), q AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 1)"


def _both(t):
    return C.ivf_search(t.q, C.assign_clusters(t.v, t.c), t.c, 10, 4), S.knn(t.q, t.v, 10)


@query("agg_recall", f"{EVAL} SELECT query_id, n AS returned, 10::bigint AS expected, h AS hits, round(h / n, 6) AS recall_ref, round(h / 10, 6) AS recall FROM (SELECT r.query_id, count(*) AS n, count(t.vec_id) AS h FROM r LEFT JOIN t ON r.query_id = t.query_id AND r.vec_id = t.vec_id GROUP BY 1)")
def _(t):
    return E.recall(*_both(t)).withColumns({"recall_ref": F.round("recall_ref", 6), "recall": F.round("recall", 6)})


@query("agg_recall_at", f"{EVAL} SELECT round((SELECT count(*) FROM t JOIN r USING (query_id, vec_id) WHERE t.rank = 1 AND r.rank <= 5) / (SELECT count(*) FROM q), 6) AS one_recall, round((SELECT count(*) FROM t JOIN r USING (query_id, vec_id) WHERE t.rank <= 5 AND r.rank <= 5) / ((SELECT count(*) FROM q) * 5), 6) AS intersection")
def _(t):
    return E.recall_at(*_both(t), 5).select(F.round("one_recall", 6).alias("one_recall"), F.round("intersection", 6).alias("intersection"))


@query("agg_range_pr", f"{EVAL} SELECT round((SELECT count(*) FROM r JOIN t USING (query_id, vec_id)) / (SELECT count(*) FROM r), 6) AS precision, round((SELECT count(*) FROM r JOIN t USING (query_id, vec_id)) / (SELECT count(*) FROM t), 6) AS recall")
def _(t):
    return E.range_precision_recall(*_both(t), t.q).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("agg_pr_curve", f"{EVAL} SELECT threshold, round(coalesce(h / nullif(n, 0), 1), 6) AS precision, round(h / 100 * 100 / (SELECT count(*) FROM t), 6) AS recall FROM (SELECT threshold::double AS threshold, count(r.vec_id) AS n, count(t.vec_id) AS h FROM (SELECT unnest([1.0, 1.2, 1.3]) AS threshold) LEFT JOIN r ON r.distance < threshold LEFT JOIN t USING (query_id, vec_id) GROUP BY 1)")
def _(t):
    r, g = _both(t)
    r = r.withColumn("distance", r6("distance"))
    return E.pr_curve(r, g, [1.0, 1.2, 1.3]).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


PCT = ", ".join(f"round(quantile_cont(value, {p}), 4) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(c).alias(c) for c in df.columns if c not in keys))


@query("agg_latency", f"SELECT event_type, round(1/avg(value), 4) AS qps, round(avg(value), 4) AS avg, round(stddev_pop(value), 4) AS std, {PCT} FROM events GROUP BY 1")
def _(t):
    return _rounded(E.latency(t.events, "value", ("event_type",)), "event_type")


@query("agg_per_label", f"SELECT user_id, round(1/avg(value), 4) AS qps, round(avg(value), 4) AS avg, round(stddev_pop(value), 4) AS std, {PCT} FROM events GROUP BY 1")
def _(t):
    return _rounded(E.latency(t.events, "value", ("user_id",)), "user_id")


SEL = "sel AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS selectivity FROM a GROUP BY 1)"


@query("agg_selectivity", sql(f"SELECT label, round(selectivity, 6) AS selectivity FROM (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS selectivity FROM a GROUP BY 1)", "a"))
def _(t):
    return E.label_selectivity(t.a, t.v).select("label", F.round("selectivity", 6).alias("selectivity"))


@query("agg_predicate_sel", sql(" UNION ALL ".join(f"SELECT {i} AS pred_id, count(*) AS qualified, round(count(*) / (SELECT count(*) FROM wide), 6) AS selectivity FROM wide WHERE {w}" for i, w in WHERE.items()), "wide"))
def _(t):
    return S.selectivities(t.wide, FORMULAS).select("pred_id", "qualified", F.round("selectivity", 6).alias("selectivity"))


@query("agg_cardinality", sql("SELECT max(label) AS max_label, count(*) AS pairs, round(count(*) / count(DISTINCT vec_id), 6) AS labels_per_vector FROM a", "a"))
def _(t):
    return E.cardinality(t.a).select("max_label", "pairs", F.round("labels_per_vector", 6).alias("labels_per_vector"))


@query("agg_matrix_stats", "SELECT dim, count(x) AS n, 0::bigint AS n_nan, count(*) FILTER (WHERE x = 0) AS n_zero, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM (SELECT unnest(range(64))::int AS dim, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1")
def _(t):
    return _rounded(E.matrix_stats(t.v), "dim", "n", "n_nan", "n_zero")


@query("agg_histogram", sql("SELECT round(count(*) * sum(n * n) / (sum(n) * sum(n)), 6) AS imbalance FROM (SELECT cluster_id, count(*) AS n FROM asg GROUP BY 1)", "asg"))
def _(t):
    return E.imbalance(C.assign_clusters(t.v, t.c)).select(F.round("imbalance", 6).alias("imbalance"))


@query("agg_fit_cost", "SELECT event_type, round(regr_slope(value, event_id), 8) AS slope, round(regr_intercept(value, event_id), 4) AS intercept FROM events GROUP BY 1")
def _(t):
    return E.fit_cost(t.events, "event_id", "value", ("event_type",)).select("event_type", F.round("slope", 8).alias("slope"), r6("intercept").alias("intercept"))


RUNS = "SELECT l_suppkey AS config, l_returnflag AS grp, round(avg(l_extendedprice), 4) AS latency, round(avg(l_discount) * 10, 6) AS recall FROM lineitem GROUP BY ALL"


def _runs(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("config"), F.col("l_returnflag").alias("grp")).agg(F.round(F.avg("l_extendedprice"), 4).alias("latency"), F.round(F.avg("l_discount") * 10, 6).alias("recall"))


@query("agg_best_config", f"SELECT grp, config, latency, recall FROM ({RUNS}) WHERE recall >= 0.5 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY latency, config) = 1")
def _(t):
    return E.best_config(_runs(t), ("grp",), 0.5)


@query("win_running_best", f"WITH r AS ({RUNS}) SELECT config, grp, latency, recall FROM (SELECT *, max(recall) OVER (PARTITION BY grp ORDER BY latency, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE b IS NULL OR recall > b")
def _(t):
    return E.running_best(_runs(t), "latency", "recall", ("grp",))


@query("win_pareto", f"WITH r AS (SELECT config, latency, recall FROM ({RUNS}) WHERE grp = 'A') SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.latency < r.latency AND s.recall > r.recall)")
def _(t):
    return E.pareto(_runs(t).where("grp = 'A'").drop("grp"), "latency", "recall").select("config", "latency", "recall")


@query("win_interp", "WITH p AS (SELECT event_type, event_id AS x, value AS y, lead(event_id) OVER w AS x2, lead(value) OVER w AS y2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id, value)) SELECT event_type, round(y + (y2 - y) * (5000.5 - x) / (x2 - x), 4) AS value FROM p WHERE x <= 5000.5 AND x2 > 5000.5")
def _(t):
    return E.interpolate(t.events, "event_id", "value", 5000.5, ("event_type",)).select("event_type", r6("value").alias("value"))


# -------------------------------------------------------------- preparation

BIG = "SELECT DISTINCT l_partkey AS vec_id, l_suppkey AS label FROM lineitem"


def _facts(t):
    return t.lineitem.select(F.col("l_partkey").alias("vec_id"), F.col("l_suppkey").alias("label")).distinct()


@query("prep_top_n_m", f"WITH f AS ({BIG}) SELECT vec_id, label FROM f WHERE vec_id IN (SELECT vec_id FROM f GROUP BY 1 ORDER BY count(*) DESC, vec_id LIMIT 50) AND label IN (SELECT label FROM f GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 10)")
def _(t):
    return R.top_n_m(_facts(t), 50, 10)


@query("prep_split", "SELECT count(*) FILTER (WHERE i < floor(n * 0.8)) AS train, count(*) FILTER (WHERE i >= floor(n * 0.8)) AS test FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)")
def _(t):
    train, test = R.split(t.v, 0.2)
    return train.agg(F.count(F.lit(1)).alias("train")).crossJoin(test.agg(F.count(F.lit(1)).alias("test")))


@query("prep_top_categories", "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS c FROM part) GROUP BY 1 ORDER BY n DESC, c LIMIT 5")
def _(t):
    return R.top_categories(t.part, "p_type", 5)


@query("prep_label_encode", "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def _(t):
    return R.label_encode(t.part, "p_brand").withColumn("code", F.col("code").cast("long"))


@query("prep_dedup_union", sql("SELECT DISTINCT label FROM a", "a"))
def _(t):
    return t.wide.select(F.explode("labels").alias("label")).distinct()


@query("prep_filter_labels", sql("SELECT vec_id, label FROM a WHERE label IN (3, 12, 31)", "a"))
def _(t):
    return t.a.where("label in (3, 12, 31)")


@query("prep_count_queries", sql("SELECT n AS labels, count(*) AS queries FROM (SELECT vec_id, count(*) AS n FROM a GROUP BY 1) GROUP BY 1", "a"))
def _(t):
    return t.a.groupBy("vec_id").agg(F.count(F.lit(1)).alias("labels")).groupBy("labels").agg(F.count(F.lit(1)).alias("queries"))


@query("prep_random_split", sql("SELECT vec_id, dense_rank() OVER (ORDER BY label) - 1 AS label FROM a WHERE label IN (3, 12, 31)", "a"))
def _(t):
    return R.label_split(t.a, [3, 12, 31]).select("vec_id", F.col("label").cast("long").alias("label"))


@query("prep_selectivity_split", sql("SELECT vec_id, label FROM a WHERE label IN (SELECT label FROM a GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM embeddings) BETWEEN 0.08 AND 0.5)", "a"))
def _(t):
    return R.selectivity_split(t.a, t.v, 0.08, 0.5)


@query("prep_predicates_to_labels", sql(" UNION ALL ".join(f"SELECT vec_id, {i} AS label FROM wide WHERE {w}" for i, w in WHERE.items()), "wide"))
def _(t):
    return R.predicates_to_labels(t.wide, FORMULAS)


# ---------------------------------------------------------- sets and scalars


@query("set_ops", sql("SELECT vec_id, len(list_intersect(labels, [3, 31])) AS both, len(list_distinct(list_concat(labels, [3, 31]))) AS any, len(list_filter(labels, lambda x: x NOT IN (3, 31))) AS rest FROM wide", "wide"))
def _(t):
    k = F.array(F.lit(3), F.lit(31))
    return t.wide.select("vec_id", F.size(F.array_intersect("labels", k)).cast("long").alias("both"), F.size(F.array_union("labels", k)).cast("long").alias("any"), F.size(F.array_except("labels", k)).cast("long").alias("rest"))


@query("set_code", "SELECT min(vec_id) AS vec_id FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: (x > 0)::int) AS c FROM embeddings) GROUP BY c")
def _(t):
    return t.v.groupBy(V.pack_signs(F.slice("embedding", 1, 4)).alias("c")).agg(F.min("vec_id").alias("vec_id")).drop("c")


@query("set_index_merge", "SELECT vec_id FROM embeddings UNION ALL SELECT vec_id + 100000 FROM embeddings")
def _(t):
    return R.merge_tables(t.v, t.v, 100_000).select("vec_id")


@query("str_tokenize", "SELECT p_partkey, len(string_split(p_type, ' ')) AS n FROM part")
def _(t):
    return t.part.select("p_partkey", F.size(F.split("p_type", r"\s+")).cast("long").alias("n"))


@query("str_params", "SELECT event_id, (json_extract(props, '$.k'))::bigint AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("md5_key", "SELECT vec_id, md5(vec_id || ':' || label) AS k FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"))).alias("k"))


# ------------------------------------------------------- SQL surface, streams


@query("sql_single", sql(top("q, wide x WHERE query_id = 1 AND list_contains(x.labels, 3)", 10), "q", "wide"))
def _(t):
    t.wide.createOrReplaceTempView("labelsift_items")
    t.q.createOrReplaceTempView("labelsift_queries")
    d = "sqrt(aggregate(zip_with(i.embedding, q.embedding, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, v) -> s + v))"
    got = t.spark.sql(f"SELECT query_id, vec_id, {d} AS distance FROM labelsift_items i CROSS JOIN labelsift_queries q WHERE query_id = 1 AND array_contains(labels, 3) ORDER BY distance, vec_id LIMIT 10")
    return knn_rows(got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))))


@query("sql_wide_labels", sql("SELECT vec_id, list_contains(labels, 3) AS label_3, list_contains(labels, 31) AS label_31 FROM wide", "wide"))
def _(t):
    return t.wide.select("vec_id", *(F.array_contains("labels", n).alias(f"label_{n}") for n in (3, 31)))


@query("sql_bulk_load", "SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY p_partkey) AS vec_id, p_partkey FROM part")
def _(t):
    return R.append_ids(t.part.select("p_partkey"), "p_partkey", "vec_id", t.embeddings)


@query("stream_revoke", "SELECT user_id AS vec_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 5 <> 0")
def _(t):
    from ..streaming.access_log import current_access

    log = t.events.select(F.col("user_id").alias("vec_id"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 5 == 0, "revoke").otherwise("grant").alias("op"), "ts", F.col("event_id").alias("seq"))
    return current_access(log)


@query("win_sliding_slices", "SELECT event_id // 1000 AS slice, count(*) AS n FROM events WHERE event_id // 1000 > (SELECT max(event_id // 1000) FROM events) - 3 GROUP BY 1")
def _(t):
    from ..streaming.access_log import last_slices

    return last_slices(t.events.withColumn("slice", F.floor(F.col("event_id") / 1000)), "slice", 3).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
