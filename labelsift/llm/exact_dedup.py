"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k``, a mergeable frequent-items sketch) names the digests that may be
frequent. One pass counts exactly those and finds the row that stays in each; these verified winners, at most
``heavy`` rows, are broadcast, and copies of frequent texts are decided map-side. All other digests take an ordinary
shuffle, where no group can hold more than about N / ``counters`` rows.

Defined results: null text is the empty text; two texts are equal when identical after lower-casing A-Z only (equal
SHA-256 of the UTF-8 bytes); of equal texts the row with the largest id stays, a null id being smallest; of repeated
rows with that id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, materialize, unused


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, counters: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(folded(F.col(text_col)), 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    code = F.xxhash64("digest")
    summary = digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {heavy}, {counters})").alias("top"))
    frequent = summary.selectExpr("inline(top)").select(F.col("item").alias("code"))
    stay = F.max(F.struct("doc_id", "row"))
    winners = (
        digests.join(F.broadcast(frequent), code == F.col("code"), "left_semi")
        .groupBy("digest").agg(stay.alias("stay"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    winners = materialize(winners, "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    cold = rest.withColumns({"stay": stay.over(group), "group_size": F.count(F.lit(1)).over(group)})
    return hot.select(cold.columns).unionByName(cold).select(
        "doc_id",
        F.col("stay.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stay.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of repeated rows one."""
    key, digest = unused(docs, "key"), unused(docs, "digest")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("stay_id"), F.unhex("text_sha256").alias("stay_digest"))
    own = docs.withColumns({digest: F.unhex(F.sha2(folded(F.col(text_col)), 256)), key: F.col(id_col).cast("long")})
    stays = own.join(kept.hint("shuffle_hash"), (own[key].eqNullSafe(kept["stay_id"])) & (own[digest] == kept["stay_digest"]), "left_semi")
    return stays.dropDuplicates([key, digest]).drop(digest, key)


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
