"""Filtered indexes with one set of verbs over tables, and a factory that reads specifications such as ``PCA32,IVF64,Flat``.

An index holds DataFrames: vectors(vec_id, embedding[, cluster_id]) and an append-only log of grants and revocations; each
verb returns DataFrames or a new state of the same index. Graph indexes of other systems are served by their result
contract: exact or cluster-pruned plans.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import to_column
from ..functions.vectors import linear, normalize, pad
from ..operators import clusters, codecs, quantizers, search
from ..operators.storage import cut
from ..streaming.access_log import current_access


@dataclass
class IndexSpec:
    transforms: tuple[tuple[str, int], ...] = ()
    nlist: int = 0
    payload: str = "Flat"
    parts: int = 0
    refine: bool = False
    id_map: bool = False
    metric: str = "l2"


@dataclass
class SearchParams:
    """``nprobe`` lists are read; approximate payloads keep k * ``k_factor`` candidates for refinement."""

    nprobe: int = 8
    k_factor: int = 4
    universe: str = "labelled"


def parse_spec(text: str, metric: str = "l2") -> IndexSpec:
    """Transforms PCA<d>, L2norm, Pad<d>; coarse IVF<n>; payload Flat, SQ8, PQ<m>; then RFlat and IDMap. Others are refused."""
    spec = IndexSpec(metric=metric)
    seen = False
    for part in text.split(","):
        if m := re.fullmatch(r"PCA(\d+)|Pad(\d+)", part):
            spec.transforms += ((part[:3], int(m[1] or m[2])),)
        elif part == "L2norm":
            spec.transforms += (("L2norm", 0),)
        elif m := re.fullmatch(r"IVF(\d+)", part):
            spec.nlist = int(m[1])
        elif part in ("Flat", "SQ8") or re.fullmatch(r"PQ\d+", part):
            if seen:
                raise ValueError(f"{text!r} has two payloads")
            seen, spec.payload, spec.parts = True, "PQ" if part.startswith("PQ") else part, int(part[2:]) if part.startswith("PQ") else 0
        elif part == "RFlat":
            spec.refine = True
        elif part in ("IDMap", "IDMap2"):
            spec.id_map = True
        else:
            raise ValueError(f"{text!r}: {part!r} is not supported")
    if not seen:
        raise ValueError(f"{text!r} has no payload")
    return spec


def spec_text(spec: IndexSpec) -> str:
    parts = [f"{n}{d}" if d else n for n, d in spec.transforms]
    parts += [f"IVF{spec.nlist}"] if spec.nlist else []
    parts += [f"PQ{spec.parts}" if spec.payload == "PQ" else spec.payload]
    return ",".join(parts + ["RFlat"] * spec.refine + ["IDMap"] * spec.id_map)


def code_size(spec: IndexSpec, d: int) -> int:
    """Bytes a stored vector takes."""
    for name, n in spec.transforms:
        d = n if name in ("PCA", "Pad") else d
    return {"Flat": 4 * d, "SQ8": d, "PQ": spec.parts}[spec.payload]


class FilteredIndex:
    """create, grant, revoke, delete, query by label, formula or ids, and without a filter; save and load."""

    def __init__(self, spec: IndexSpec, vectors: DataFrame, log: DataFrame, centroids: DataFrame | None = None, axes: tuple = (), books: list | None = None, limits: list | None = None):
        self.spec, self.vectors, self.log, self.centroids, self.axes, self.books, self.limits = spec, vectors, log, centroids, axes, books, limits

    def _with(self, vectors: DataFrame, log: DataFrame) -> FilteredIndex:
        return FilteredIndex(self.spec, vectors, log, self.centroids, self.axes, self.books, self.limits)

    @classmethod
    def train(cls, spec: IndexSpec | str, vectors: DataFrame, access: DataFrame, rounds: int = 2, metric: str = "l2") -> FilteredIndex:
        """vectors(vec_id, embedding), access(vec_id, label). Centroids start from the vectors of the smallest hashes."""
        spec = parse_spec(spec, metric) if isinstance(spec, str) else spec
        axes = []
        v = vectors.select("vec_id", "embedding")
        for name, n in spec.transforms:
            rows = codecs.pca(v)[1][:n].tolist() if name == "PCA" else None
            axes.append(rows)
            v = _apply(v, name, n, rows)
        centroids = None
        if spec.nlist:
            first = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(spec.nlist)
            centroids = clusters.kmeans(v, first.select(F.col("vec_id").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid")), rounds)
            v = clusters.assign_clusters(v, centroids)
        books = quantizers.pq_train(v, quantizers.first_books(v, spec.parts, 256), rounds) if spec.payload == "PQ" else None
        limits = [[r.lo, r.hi] for r in codecs.sq_limits(v).orderBy("dim").collect()] if spec.payload == "SQ8" else None  # a row for each dimension
        log = access.select("vec_id", "label", F.lit("grant").alias("op"), F.lit(0).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("seq"))
        index = cls(spec, v, log, centroids, tuple(axes), books, limits)
        index.vectors = index._coded(v)  # encoded once; searches read the codes
        return index

    def _coded(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with code, for payloads that have one."""
        if self.spec.payload == "SQ8":
            return codecs.sq_codes(vectors, self.limits)
        return quantizers.pq_encode(vectors, self.books) if self.spec.payload == "PQ" else vectors

    # -- changes

    def _logged(self, rows: DataFrame, op: str, seq: int) -> FilteredIndex:
        entry = rows.select("vec_id", "label", F.lit(op).alias("op"), F.lit(0).cast("timestamp").alias("ts"), F.lit(seq).cast("long").alias("seq"))
        return self._with(self.vectors, self.log.unionByName(entry))

    def grant(self, rows: DataFrame, seq: int) -> FilteredIndex:
        """rows(vec_id, label); of entries for one pair the largest ``seq`` holds."""
        return self._logged(rows, "grant", seq)

    def revoke(self, rows: DataFrame, seq: int) -> FilteredIndex:
        return self._logged(rows, "revoke", seq)

    def create(self, vectors: DataFrame) -> FilteredIndex:
        """New vectors; ids that are there already are an error of the caller that ``duplicates`` shows."""
        v = self.transformed(vectors)
        v = clusters.assign_clusters(v, self.centroids) if self.centroids is not None else v
        return self._with(self.vectors.unionByName(self._coded(v).select(self.vectors.columns)), self.log)

    def duplicates(self) -> DataFrame:
        return self.vectors.groupBy("vec_id").count().where("count > 1").select("vec_id")

    def delete(self, ids: DataFrame) -> FilteredIndex:
        return self._with(search.remove(self.vectors, ids), self.log.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"))

    # -- reads

    def access(self) -> DataFrame:
        return current_access(self.log)

    def transformed(self, rows: DataFrame) -> DataFrame:
        for (name, n), axes in zip(self.spec.transforms, self.axes, strict=True):
            rows = _apply(rows, name, n, axes)
        return rows

    def _search(self, queries: DataFrame, vectors: DataFrame, k: int, p: SearchParams) -> DataFrame:
        q = self.transformed(queries)
        exact = vectors
        wide = k * p.k_factor if self.spec.refine and self.spec.payload != "Flat" else k
        if self.spec.payload == "SQ8":
            vectors = codecs.sq_values(vectors.drop("embedding"), self.limits).drop("code")
        elif self.spec.payload == "PQ":
            vectors = quantizers.pq_decode(vectors.drop("embedding"), self.books).drop("code")  # distances to decoded vectors are asymmetric distances
        found = clusters.ivf_search(q, vectors, self.centroids, wide, p.nprobe, self.spec.metric) if self.spec.nlist else search.knn(q, vectors, wide, self.spec.metric)
        return search.refine(found, q, exact, k, self.spec.metric) if wide != k else found

    def query_unfiltered(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        return self._search(queries, self.vectors, k, params or SearchParams())

    def query(self, queries: DataFrame, k: int, label: int, params: SearchParams | None = None) -> DataFrame:
        """An unknown label finds nothing."""
        held = self.access().where(F.col("label") == label).select("vec_id")
        return self._search(queries, self.vectors.join(held, "vec_id", "left_semi"), k, params or SearchParams())

    def wide(self) -> DataFrame:
        labels = self.access().groupBy("vec_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
        return self.vectors.join(labels, "vec_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast(labels.schema["labels"].dataType)))

    def query_formula(self, queries: DataFrame, k: int, formula: str, params: SearchParams | None = None) -> DataFrame:
        p = params or SearchParams()
        return self._search(queries, self.wide().where(to_column(formula, "labels", p.universe)).drop("labels"), k, p)

    def query_ids(self, queries: DataFrame, k: int, ids: DataFrame, params: SearchParams | None = None) -> DataFrame:
        return self._search(queries, self.vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi"), k, params or SearchParams())

    def materialize_formula(self, formula: str, label: int, seq: int, universe: str = "labelled") -> FilteredIndex:
        """The formula's vectors under a label of their own, for queries that come often."""
        held = self.wide().where(to_column(formula, "labels", universe)).select("vec_id", F.lit(label).cast(self.log.schema["label"].dataType).alias("label"))
        return self.grant(held, seq)

    # -- storage

    def save(self, path: str) -> None:
        """Vectors are stored by cluster, so that probes read their own files; the folder must be new."""
        self.vectors.repartition("cluster_id").sortWithinPartitions("cluster_id").write.mode("error").parquet(f"{path}/vectors") if self.spec.nlist else self.vectors.write.mode("error").parquet(f"{path}/vectors")
        self.log.write.mode("error").parquet(f"{path}/log")
        if self.centroids is not None:
            self.centroids.write.mode("error").parquet(f"{path}/centroids")
        meta = json.dumps({"spec": asdict(self.spec), "axes": self.axes, "books": self.books, "limits": self.limits})
        self.log.sparkSession.createDataFrame([(meta,)], "value string").write.mode("error").text(f"{path}/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FilteredIndex:
        meta = json.loads(spark.read.text(f"{path}/spec").first()[0])
        spec = IndexSpec(**meta["spec"] | {"transforms": tuple((n, d) for n, d in meta["spec"]["transforms"])})
        read = lambda n: spark.read.parquet(f"{path}/{n}")
        return cls(spec, read("vectors"), read("log"), read("centroids") if spec.nlist else None, tuple(meta["axes"]), meta["books"], meta["limits"])


def _apply(rows: DataFrame, name: str, n: int, axes: list | None) -> DataFrame:
    e = {"PCA": lambda: linear("embedding", axes), "L2norm": lambda: normalize("embedding"), "Pad": lambda: pad("embedding", n)}[name]()
    return rows.withColumn("embedding", e)


def autotune(index: FilteredIndex, queries: DataFrame, truth: DataFrame, k: int, nprobes: list[int]) -> list[tuple[int, float]]:
    """(nprobe, mean recall) of the settings worth having: each better than every cheaper one."""
    from ..operators.evaluate import recall

    truth = cut(truth)  # k rows for each query, found once
    out: list[tuple[int, float]] = []
    for n in sorted(nprobes):
        r = recall(index.query_unfiltered(queries, k, SearchParams(nprobe=n)), truth).agg(F.avg("recall")).first()[0] or 0.0
        if not out or r > out[-1][1]:
            out.append((n, r))
    return out
