"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts of the cells (source, language, topic) are raked: each round scales the cells' weights so that the sums by
source, then by language, then by topic match their targets. A document's probability is its cell's weight per token,
divided by the largest of these, so that the sample is the largest whose expected token mix is the raked one; documents
are drawn by a hash of their id, the same on every run. Only cells are iterated on, never documents; the cells' table is
broadcast if it has at most ``BROADCAST_CELLS`` rows and joined by a shuffle otherwise.

Targets are shares by category; categories without tokens are left out and the rest scaled up, categories without a
target get share 0. By default a margin's targets are its own shares, tempered (raised to ``temper`` and scaled). The
topic is ``topic_of``, any string Column of ``docs``; without it, the form of the text.
Defined results: a null source, language or topic is the category "(none)"; null text has no tokens; cells without
tokens get the probability 1; repeated rows share one fate; a null id is hashed as the empty string; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
BROADCAST_CELLS = 20_000
#: Where no topic column is given: a document's topic is its form, by what it holds, first match first.
TOPICS = (("@", "contact"), ("icens", "licensed"), ("|", "table"), ("password=", "secret"))
MARGINS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    out = F
    for needle, name in TOPICS:
        out = out.when(F.coalesce(F.contains(text, F.lit(needle)), F.lit(False)), name)
    return out.otherwise("prose")


def _margins(text_col: str, topic_of: Column | None) -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col)) if topic_of is None else topic_of}


def _keyed(docs: DataFrame, id_col: str, text_col: str, topic_of: Column | None) -> DataFrame:
    own = _margins(text_col, topic_of)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(m) for m, c in own.items()))


def _target(cells: DataFrame, margin: str, shares: dict | None, temper: float) -> DataFrame:
    """(margin, t): the target share of each category with tokens."""
    n = cells.groupBy(margin).agg(F.sum("n").alias("n"))
    if shares is None:
        t = F.pow(F.col("n"), F.lit(temper))
    else:
        t = F.lit(0.0)
        for category, share in shares.items():
            t = F.when(F.col(margin) == category, F.lit(float(share))).otherwise(t)
    return n.select(margin, t.alias("t")).withColumn("t", F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0))))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, temper: float = 0.8, rounds: int = 40, tolerance: float = 1e-12, strict: bool = False) -> DataFrame:
    """``cells`` (source, lang, topic, n) with weights w whose margins match the targets; their sum is that of n."""
    targets = targets or {}
    total, count = cells.agg(F.sum("n"), F.count(F.lit(1))).first()
    whole = F.lit(float(total or 0.0))
    w = cells.withColumn("w", F.col("n").cast("double"))
    for m in MARGINS:  # each margin's targets stand beside the cells
        t = _target(cells, m, targets.get(m), temper).withColumnRenamed("t", f"t_{m}")
        w = w.join(F.broadcast(t) if count <= BROADCAST_CELLS else t, m)
    off = 0.0
    for _ in range(rounds):
        for m in MARGINS:
            now = F.sum("w").over(Window.partitionBy(m))
            w = w.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"t_{m}") * whole / now).otherwise(0.0))
        # what the round has left: the last margin is met, the others may be off again
        left = [F.abs(F.sum("w").over(Window.partitionBy(m)) / whole - F.col(f"t_{m}")) for m in MARGINS]
        w = materialize(w.withColumn("off", F.greatest(*left)), "raked")  # a few hundred bytes; short plans keep generated code small
        off = w.agg(F.max("off")).first()[0] or 0.0
        w = w.drop("off")
        if off <= tolerance:
            break
    if strict and off > tolerance:
        raise RuntimeError(f"a margin is off by {off:.3g} of the whole after {rounds} rounds")
    return w.select(*MARGINS, "n", "w")


def _weighed(docs: DataFrame, targets: dict[str, dict] | None, temper: float, id_col: str, text_col: str, topic_of: Column | None, **raking) -> tuple[DataFrame, DataFrame]:
    """Ids with their cells, and the cells with r, the weight per token."""
    tokens = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("n")
    keyed = materialize(_keyed(docs, id_col, text_col, topic_of).select("_id", *MARGINS, tokens), "keyed")  # texts are read once
    cells = materialize(keyed.groupBy(*MARGINS).agg(F.sum("n").alias("n")), "cells")
    return keyed, materialize(rake(cells.where("n > 0"), targets, temper, **raking).withColumn("r", F.col("w") / F.col("n")), "ratios")


def _draw(id_: Column, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, temper: float = 0.8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None, **raking) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, probability, kept."""
    keyed, ratio = _weighed(docs, targets, temper, id_col, text_col, topic_of, **raking)
    top, count = ratio.agg(F.max("r"), F.count(F.lit(1))).first()
    side = ratio.select(*MARGINS, (F.col("r") / F.lit(float(top or 1.0))).alias("p"))
    joined = keyed.select("_id", *MARGINS).join(F.broadcast(side) if count <= BROADCAST_CELLS else side, list(MARGINS), "left")
    p = F.coalesce("p", F.lit(1.0))
    return joined.select(F.col("_id").alias("doc_id"), *MARGINS, F.round(p, 6).alias("probability"), (_draw(F.col("_id"), seed) < p).alias("kept"))


def resample_mix(docs: DataFrame, targets: dict[str, dict] | None = None, temper: float = 0.8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None, **raking) -> DataFrame:
    """The rows of ``docs``, each as often as its cell weighs: at 2.3 per token twice, and three tenths of the cell a third time.

    So the expected tokens are as many as before, in the raked mix; where ``mix`` thins every cell to fit the one that weighs
    most, here cells short of their share are repeated. Rows of cells without tokens stay as they are.
    """
    _, ratio = _weighed(docs, targets, temper, id_col, text_col, topic_of, **raking)
    fresh = {m: unused(docs, f"_{m}") for m in (*MARGINS, "r", "copy")}
    side = ratio.select(*(F.col(m).alias(fresh[m]) for m in MARGINS), F.col("r").alias(fresh["r"]))
    keyed = docs.withColumns({fresh[m]: F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in _margins(text_col, topic_of).items()})
    met = keyed.join(F.broadcast(side) if ratio.count() <= BROADCAST_CELLS else side, [fresh[m] for m in MARGINS], "left")
    r = F.coalesce(fresh["r"], F.lit(1.0))
    times = (F.floor(r) + (_draw(F.col(id_col).cast("long"), seed) < r - F.floor(r)).cast("int")).cast("int")
    return met.withColumn(fresh["copy"], F.explode(F.array_repeat(F.lit(True), times))).select(*docs.columns)


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with their columns. Rows of one id share one fate, but for those in different cells."""
    id_col, own = options.get("id_col", "doc_id"), _margins(options.get("text_col", "text"), options.get("topic_of"))
    drawn = mix(docs, **options).where("kept").select(F.col("doc_id").alias("drawn_id"), *(F.col(m).alias(f"drawn_{m}") for m in MARGINS)).distinct()
    fresh = {m: unused(docs, f"_{m}") for m in ("id", *MARGINS)}
    keyed = docs.withColumns({fresh["id"]: F.col(id_col).cast("long"), **{fresh[m]: F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in own.items()}})
    on = keyed[fresh["id"]].eqNullSafe(drawn["drawn_id"])
    for m in MARGINS:
        on = on & (keyed[fresh[m]] == drawn[f"drawn_{m}"])
    return keyed.join(drawn, on, "left_semi").drop(*fresh.values())


def op6_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(temper: float = 0.8, rounds: int = 40, seed: int = 17) -> str:
    case = " ".join(f"WHEN contains(text, '{n}') THEN '{t}'" for n, t in TOPICS)
    sql = [
        f"""d AS (SELECT doc_id, text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {case} ELSE 'prose' END AS topic FROM documents)""",
        rf"""c AS (SELECT * FROM (SELECT source, lang, topic, sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS n FROM d GROUP BY ALL) WHERE n > 0)""",
        *(f"t_{m} AS (SELECT {m}, t / sum(t) OVER () AS t FROM (SELECT {m}, pow(sum(n), {temper}) AS t FROM c GROUP BY {m}))" for m in MARGINS),
        "w0 AS (SELECT source, lang, topic, n, n::DOUBLE AS w FROM c)",
    ]
    for k in range(rounds * 3):
        m = MARGINS[k % 3]
        sql.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, n, w * t * (SELECT sum(n) FROM c) / sum(w) OVER (PARTITION BY {m}) AS w FROM w{k} JOIN t_{m} USING ({m}))")
    sql.append(f"r AS (SELECT source, lang, topic, w / n / (SELECT max(w / n) FROM w{rounds * 3}) AS p FROM w{rounds * 3})")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"
    return f"WITH {', '.join(sql)} SELECT doc_id, d.source, d.lang, d.topic, round(coalesce(p, 1.0), 6) AS probability, {draw} < coalesce(p, 1.0) AS kept FROM d LEFT JOIN r USING (source, lang, topic)"
