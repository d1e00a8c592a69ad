"""Product, residual and structured quantisers, rotations and the smaller k-means variants.

A codebook is a list of books, one for each slice (product) or level (residual), each a list of vectors. Its size is the
caller's choice and doesn't grow with the data; it travels as one broadcast row, so encoding is a projection without a
shuffle. Codes are arrays of positions in the books; equal distances go to the smaller position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import add, doubles, hamming, l2sq, pack_signs, sub
from .clusters import probes
from .search import top_k

BOOKS = "array<array<array<double>>>"
#: Queries whose distance tables are broadcast; a table has a number for each vector of the codebook.
BROADCAST_TABLES = 2_000


def books_row(spark, books: list) -> DataFrame:
    """The codebook as one row, _books[part][position] -> vector."""
    return spark.createDataFrame([([[[float(x) for x in v] for v in b] for b in books],)], f"_books {BOOKS}")


def _cut(v: Column, m: Column | int, parts: int) -> Column:
    width = F.floor(F.size(v) / parts).cast("int")
    return F.slice(v, m * width + 1, width)


def _nearest(x: Column, book: Column) -> Column:
    """Position of the nearest vector of a book."""
    return F.array_min(F.transform(book, lambda c, i: F.struct(l2sq(x, c).alias("d"), i.alias("i"))))["i"]


# ------------------------------------------------------------ product quantiser


def pq_encode(vectors: DataFrame, books: list, column: str = "embedding") -> DataFrame:
    """``vectors`` with code array<int>: the nearest vector of each slice's book."""
    parts = len(books)
    met = vectors.crossJoin(F.broadcast(books_row(vectors.sparkSession, books)))
    code = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda m: _nearest(_cut(doubles(column), m, parts), F.get("_books", m)))
    return met.withColumn("code", code).drop("_books")


def pq_decode(codes: DataFrame, books: list) -> DataFrame:
    """``codes`` with embedding: the books' vectors end to end."""
    met = codes.crossJoin(F.broadcast(books_row(codes.sparkSession, books)))
    return met.withColumn("embedding", F.flatten(F.zip_with("code", "_books", lambda c, b: F.get(b, c)))).drop("_books")


def pq_tables(queries: DataFrame, books: list, column: str = "embedding") -> DataFrame:
    """``queries`` with table: squared distance of each slice to each vector of its book."""
    parts = len(books)
    met = queries.crossJoin(F.broadcast(books_row(queries.sparkSession, books)))
    table = F.transform("_books", lambda b, m: F.transform(b, lambda c: l2sq(_cut(doubles(column), m, parts), c)))
    return met.withColumn("table", table).drop("_books")


def _looked_up(code: Column | str, table: Column | str) -> Column:
    return F.aggregate(F.zip_with(code, table, lambda c, t: F.get(t, c)), F.lit(0.0), lambda a, b: a + b)


def pq_search(queries: DataFrame, codes: DataFrame, books: list, k: int) -> DataFrame:
    """kNN by asymmetric distances: sums of looked-up entries. Few queries (counted) are broadcast, so codes don't move."""
    q = pq_tables(queries, books).select("query_id", "table")
    if queries.limit(BROADCAST_TABLES + 1).count() <= BROADCAST_TABLES:
        both = codes.crossJoin(F.broadcast(q))
    else:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(63)))
        both = codes.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int")).join(q.withColumn("_block", blocks), "_block")
    met = both.select("query_id", "vec_id", _looked_up("code", "table").alias("distance"))
    return top_k(met, k, "l2sq").select("query_id", "rank", "vec_id", "distance")


def pq_search_symmetric(queries: DataFrame, codes: DataFrame, books: list, k: int) -> DataFrame:
    """kNN between codes: the queries are encoded as well."""
    decoded = pq_decode(pq_encode(queries, books).select("query_id", "code"), books)
    return pq_search(decoded, codes, books, k)


def _summed(rows: DataFrame) -> list:
    """Sums of rows(i, j, n, s array) over all partitions, as (i, j, dim, n, s): as many rows as the model has numbers."""
    each = rows.select("i", "j", "n", F.posexplode("s").alias("dim", "s"))
    return each.groupBy("i", "j", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def _sums_schema() -> str:
    return "i int, j int, n long, s array<double>"


def _sums_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["i", "j", "n", "s"])


def _moments(batches, size: int):
    """Sums and counts by (part, position) of a partition's slices."""
    total: dict = {}
    for b in batches:
        if not len(b):
            continue
        x = np.array(b.column(0).to_pylist(), np.float64)
        code = np.array(b.column(1).to_pylist())
        parts = code.shape[1]
        w = x.shape[1] // parts
        for m in range(parts):
            s, n = total.setdefault(m, (np.zeros((size, w)), np.zeros(size, np.int64)))
            np.add.at(s, code[:, m], x[:, m * w : (m + 1) * w])
            n += np.bincount(code[:, m], minlength=size)
    if total:
        yield _sums_batch([(m, c, n[c], s[c]) for m, (s, n) in total.items() for c in np.flatnonzero(n)])


def first_books(vectors: DataFrame, parts: int, size: int) -> list:
    """Slices of the ``size`` vectors with the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select(doubles("embedding").alias("e")).collect()  # the codebook
    w = len(rows[0].e) // parts if rows else 0
    return [[r.e[m * w : (m + 1) * w] for r in rows] for m in range(parts)]


def pq_train(vectors: DataFrame, books: list, rounds: int = 10) -> list:
    """Lloyd's rounds in every slice at once, one scan a round; sums are added up by an aggregation. Empty ones stay."""
    for _ in range(rounds):
        size = max(map(len, books), default=0)
        coded = pq_encode(vectors, books).select(doubles("embedding"), "code")
        new = [np.array(b, float) for b in books]
        for r in _summed(coded.mapInArrow(lambda it, size=size: _moments(it, size), _sums_schema())):
            new[r.i][r.j, r.dim] = r.s / r.n
        moved = any(np.abs(a - np.array(b, float)).max(initial=0) > 1e-12 for a, b in zip(new, books, strict=True))
        books = [b.tolist() for b in new]
        if not moved:
            break
    return books


def ivfpq_encode(assigned: DataFrame, centroids: DataFrame, books: list) -> DataFrame:
    """(vec_id, cluster_id, code) of the residual to the cluster's centroid."""
    rest = assigned.select("vec_id", "cluster_id", "embedding").join(F.broadcast(centroids.select("cluster_id", "centroid")), "cluster_id")
    return pq_encode(rest.withColumn("_rest", sub("embedding", "centroid")), books, "_rest").select("vec_id", "cluster_id", "code")


def ivfpq_search(queries: DataFrame, codes: DataFrame, centroids: DataFrame, books: list, k: int, nprobe: int) -> DataFrame:
    """kNN by looked-up distances of residuals in the nprobe nearest clusters; the join is on the cluster."""
    p = probes(queries, centroids, nprobe).join(F.broadcast(centroids.select("cluster_id", "centroid")), "cluster_id")
    tables = pq_tables(p.withColumn("_rest", sub("embedding", "centroid")), books, "_rest").select("query_id", "cluster_id", "table")
    met = codes.join(tables, "cluster_id").select("query_id", "vec_id", _looked_up("code", "table").alias("distance"))
    return top_k(met, k, "l2sq").select("query_id", "rank", "vec_id", "distance")


# ----------------------------------------------------------- residual quantiser


def rq_encode(vectors: DataFrame, books: list, column: str = "embedding") -> DataFrame:
    """``vectors`` with code and residual: at each level the vector of the book that is nearest to what is left."""
    out = vectors.crossJoin(F.broadcast(books_row(vectors.sparkSession, books))).withColumns({"residual": doubles(column), "code": F.array().cast("array<int>")})
    for level in range(len(books)):
        out = out.withColumn("_c", _nearest(F.col("residual"), F.get("_books", F.lit(level))))
        out = out.withColumns({"residual": sub("residual", F.get(F.get("_books", F.lit(level)), F.col("_c"))), "code": F.concat("code", F.array("_c"))})
    return out.drop("_books", "_c")


def rq_decode(codes: DataFrame, books: list) -> DataFrame:
    met = codes.crossJoin(F.broadcast(books_row(codes.sparkSession, books)))
    picked = F.zip_with("code", "_books", lambda c, b: F.get(b, c))
    return met.withColumn("embedding", F.aggregate(F.slice(picked, 2, F.size("code")), F.get(picked, F.lit(0)), lambda a, b: add(a, b))).drop("_books")


def rq_train(vectors: DataFrame, levels: int, size: int, rounds: int = 10) -> list:
    """Each level's book by k-means on the residuals of the levels before it."""
    books: list = []
    for _ in range(levels):
        rest = rq_encode(vectors, books).select("vec_id", F.col("residual").alias("embedding")) if books else vectors.select("vec_id", "embedding")
        books += pq_train(rest, first_books(rest, 1, size), rounds)
    return books


# ----------------------------------------------------- structured coarse quantisers


def imi_cells(vectors: DataFrame, books: list) -> DataFrame:
    """``vectors`` with cell: the mixed-radix number of their positions in the two half books."""
    size = len(books[1])
    return pq_encode(vectors, books).withColumn("cell", F.get("code", F.lit(0)).cast("long") * size + F.get("code", F.lit(1))).drop("code")


def imi_search(queries: DataFrame, celled: DataFrame, books: list, k: int, nprobe: int) -> DataFrame:
    """kNN in the nprobe cells with the smallest sums of half distances."""
    size = len(books[1])
    t = pq_tables(queries, books)
    sums = F.flatten(F.transform(F.get("table", F.lit(0)), lambda a, i: F.transform(F.get("table", F.lit(1)), lambda b, j: F.struct((a + b).alias("d"), (i.cast("long") * size + j).alias("cell")))))
    p = t.select("query_id", F.col("embedding").alias("_q"), F.explode(F.slice(F.array_sort(sums), 1, nprobe)).alias("x")).select("query_id", "_q", "x.cell")
    met = celled.join(F.broadcast(p) if queries.limit(10_001).count() <= 10_000 else p, "cell")
    return top_k(met.select("query_id", "vec_id", F.sqrt(l2sq("_q", "embedding")).alias("distance")), k).select("query_id", "rank", "vec_id", "distance")


def spectral_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """kNN by Hamming distance of the signs of residuals in the nprobe nearest clusters."""
    c = F.broadcast(centroids.select("cluster_id", "centroid"))
    bits = assigned.join(c, "cluster_id").select("vec_id", "cluster_id", pack_signs(sub("embedding", "centroid")).alias("w"))
    p = probes(queries, centroids, nprobe).join(c, "cluster_id").select("query_id", "cluster_id", pack_signs(sub("embedding", "centroid")).alias("_w"))
    met = bits.join(p, "cluster_id").select("query_id", "vec_id", hamming("_w", "w").cast("double").alias("distance"))
    return top_k(met, k, "hamming").select("query_id", "rank", "vec_id", "distance")


def hash_tables(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """(vec_id, w, tab, h): disjoint runs of ``bits`` signs, one for each table; w holds all signs."""
    word = lambda m: F.get(pack_signs(F.slice("embedding", m * bits + 1, bits)), F.lit(0))
    hashes = F.array(*(word(m) for m in range(tables)))
    return vectors.select("vec_id", pack_signs("embedding").alias("w"), F.posexplode(hashes).alias("tab", "h"))


def multihash_search(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 4, bits: int = 8) -> DataFrame:
    """Hamming kNN among vectors that share a hash with the query in any table, each verified once."""
    q = hash_tables(queries.withColumnRenamed("query_id", "vec_id"), tables, bits).select(F.col("vec_id").alias("query_id"), F.col("w").alias("_w"), "tab", "h")
    met = hash_tables(vectors, tables, bits).join(q, ["tab", "h"]).select("query_id", "vec_id", hamming("_w", "w").cast("double").alias("distance")).distinct()
    return top_k(met, k, "hamming").select("query_id", "rank", "vec_id", "distance")


# -------------------------------------------------------------------- rotations


def random_rotation(d: int, seed: int = 1234) -> list[list[float]]:
    """Rows of a seeded orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).T.tolist()


def _cross(rows: DataFrame) -> np.ndarray:
    """Sum of outer products a bᵀ over rows (a, b), added up by an aggregation."""

    def run(batches):
        s = None
        for b in batches:
            if len(b):
                t = np.array(b.column(0).to_pylist(), np.float64).T @ np.array(b.column(1).to_pylist(), np.float64)
                s = t if s is None else s + t
        if s is not None:
            yield _sums_batch([(i, 0, 1, v) for i, v in enumerate(s)])

    got = _summed(rows.mapInArrow(run, _sums_schema()))
    d = 1 + max((r.i for r in got), default=-1)
    out = np.zeros((d, d))
    for r in got:
        out[r.i, r.dim] = r.s
    return out


def rotate(vectors: DataFrame, rows: list[list[float]], column: str = "embedding", to: str = "embedding") -> DataFrame:
    """``vectors`` with the rows of a matrix applied; the matrix is one broadcast row."""
    met = vectors.crossJoin(F.broadcast(books_row(vectors.sparkSession, [rows])))
    turned = F.transform(F.get("_books", F.lit(0)), lambda r: F.aggregate(F.zip_with(r, doubles(column), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return met.withColumn(to, turned).drop("_books")


def itq(vectors: DataFrame, rounds: int = 10, seed: int = 1234) -> list[list[float]]:
    """Rotation (rows) that brings vectors nearer to their signs: signs and Procrustes in turn, one scan a round."""
    first = vectors.select(F.size("embedding").alias("d")).first()
    d = first.d if first else 0
    r = np.array(random_rotation(d, seed)) if d else np.zeros((0, 0))
    for _ in range(rounds if d else 0):
        y = rotate(vectors.select(doubles("embedding").alias("x")), r.tolist(), "x", "y")
        u, _, vt = np.linalg.svd(_cross(y.select("x", F.transform("y", lambda a: F.when(a > 0, F.lit(1.0)).otherwise(F.lit(-1.0))).alias("b"))))
        r = (u @ vt).T
    return r.tolist()


def opq(vectors: DataFrame, parts: int, size: int, rounds: int = 4, seed: int = 1234) -> tuple[list[list[float]], list]:
    """(rotation, books): product quantiser and Procrustes rotation in turn."""
    first = vectors.select(F.size("embedding").alias("d")).first()
    if first is None:
        return [], []
    r, books = np.array(random_rotation(first.d, seed)), None
    for _ in range(rounds):
        turned = rotate(vectors.select("vec_id", doubles("embedding").alias("x")), r.tolist(), "x")
        books = pq_train(turned, books or first_books(turned, parts, size), 2)
        coded = pq_decode(pq_encode(turned, books).select("x", "code"), books)
        u, _, vt = np.linalg.svd(_cross(coded.select("x", "embedding")))
        r = (u @ vt).T
    return r.tolist(), pq_train(rotate(vectors.select("vec_id", "embedding"), r.tolist()), books, 2)


# ---------------------------------------------------------------- k-means variants


def kmeans_1d(rows: DataFrame, column: str, k: int, bins: int = 4096) -> list[float]:
    """Optimal centres of one column, by dynamic programming over its distinct values.

    Beyond ``bins`` distinct values, values count as the means of ``bins`` bins of equal width. Nulls and NaN take no part.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    points = x.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    if points.limit(bins + 1).count() > bins:
        ends = F.broadcast(x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
        binned = x.crossJoin(ends).withColumn("b", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
        points = binned.groupBy("b").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).select("x", "n")
    got = sorted((r.x, r.n) for r in points.collect())  # at most ``bins`` rows
    if len(got) <= k:
        return [v for v, _ in got]
    v, n = np.array([p[0] for p in got]), np.array([p[1] for p in got], float)
    c0, c1, c2 = (np.r_[0.0, np.cumsum(n * v**p)] for p in range(3))
    cost = lambda i, j: np.maximum(0, c2[j] - c2[i] - (c1[j] - c1[i]) ** 2 / (c0[j] - c0[i]))
    m = len(v)
    best, back = np.r_[0.0, cost(np.zeros(m, int), np.arange(1, m + 1))], []
    for _ in range(1, k):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            i = np.arange(j)
            t = best[:j] + cost(i, np.full(j, j))
            at[j] = int(t.argmin())
            new[j] = t[at[j]]
        best = new
        back.append(at)
    cuts, j = [m], m
    for at in reversed(back):
        j = int(at[j])
        cuts.append(j)
    edges = [0, *sorted({c for c in cuts if c})]
    return [float((c1[b] - c1[a]) / (c0[b] - c0[a])) for a, b in zip(edges, edges[1:], strict=False)]


def two_level(vectors: DataFrame, first: int, second: int, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """level1(n1, centroid) and level2(n1, n2, centroid): k-means, then k-means inside each cluster, all clusters at once."""
    from .clusters import assign_clusters, kmeans
    from .storage import cut

    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(first)
    top = kmeans(vectors, seeds.select(F.col("vec_id").alias("cluster_id"), doubles("embedding").alias("centroid")), rounds)
    inside = assign_clusters(vectors, top).select("vec_id", "embedding", F.col("cluster_id").alias("n1"))
    w = Window.partitionBy("n1").orderBy(F.xxhash64("vec_id"), "vec_id")
    low = cut(inside.withColumn("r", F.row_number().over(w)).where(F.col("r") <= second).select("n1", F.col("vec_id").alias("n2"), doubles("embedding").alias("centroid")))
    for _ in range(rounds):
        near = inside.join(F.broadcast(low), "n1").groupBy("vec_id").agg(F.min(F.struct(l2sq("embedding", "centroid").alias("d"), "n2")).alias("m")).select("vec_id", F.col("m.n2").alias("n2"))
        each = inside.join(near, "vec_id").select("n1", "n2", F.posexplode(doubles("embedding")).alias("dim", "x")).groupBy("n1", "n2", "dim").agg(F.avg("x").alias("x"))
        new = each.groupBy("n1", "n2").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("_new"))
        low = cut(low.join(new, ["n1", "n2"], "left").select("n1", "n2", F.coalesce("_new", "centroid").alias("centroid")))
    return top.select(F.col("cluster_id").alias("n1"), "centroid"), low


def sparse_assign(sparse: DataFrame, centroids: DataFrame) -> DataFrame:
    """(row, cluster_id, distance): nearest dense centroid of sparse rows(row, dim, x); rows without entries are absent.

    |x - c|² = |x|² - 2 x·c + |c|², so each entry meets only its dimension of the centroids, which are few and broadcast.
    """
    long = centroids.select("cluster_id", F.posexplode(doubles("centroid")).alias("dim", "c"))
    norms = long.groupBy("cluster_id").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    dots = sparse.join(F.broadcast(long), "dim").groupBy("row", "cluster_id").agg(F.sum(F.col("x") * F.col("x") - 2 * F.col("x") * F.col("c")).alias("s"))
    near = dots.join(F.broadcast(norms), "cluster_id").groupBy("row").agg(F.min(F.struct((F.col("s") + F.col("cc")).alias("d"), "cluster_id")).alias("m"))
    return near.select("row", F.col("m.cluster_id").alias("cluster_id"), F.col("m.d").alias("distance"))
