"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and the five-letter beginnings of longer words, hashed. Severity has ordered
grades. Labels tell toxic from clean only, so the grades are ordinal by construction, not by judgement: 0 for texts
labelled clean; labelled toxic texts are graded 1 to ``grades`` - 1 by how many of their words are such as training texts
show almost only when toxic (quantiles of that number, from the training sample). Grade 1 and up is what labels check.
The model shares one weight vector across the ordered thresholds, P(grade >= k) = sigmoid(w.x - t_k), and maximises the
likelihood of the grades, P(grade = k) = P(grade >= k) - P(grade >= k + 1). It returns expected severity, the sum of
these probabilities, and a grade: how many P(grade >= k) are reached, the first at ``CUT``, which held-out labels chose,
the others at one half. A text is toxic if its grade isn't 0.

The fit takes at most ``sample`` labelled rows of either label (the smallest by a hash of the id), a documented bound;
scoring covers every whole text. Defined results: null text is the empty text; rows with null or duplicate labels take no
part in the fit (of duplicates one label, the largest, does); without labels of both kinds nothing is toxic; repeated
rows are scored each; an empty table gives an empty result; columns named like the result's give way to them, all others
stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, unused

BITS = 20
WORD = re.compile(r"[^\W\d_]+")
CACHE = 100_000
#: A text is toxic from this P(grade >= 1) on; higher grades are given from one half on. Thresholds are so far apart at least.
CUT, HALF, GAP = 0.1, 0.5, 1e-3


def features(word: str) -> list[str]:
    return [word, "^" + word[:5], "^" + word[:4]] if len(word) > 5 else [word]


def slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) >> (64 - BITS)


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Ordinal:
    """One weight vector and ordered thresholds; ``cache`` keeps words' sums."""

    weights: np.ndarray
    thresholds: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "cache": {}}

    def margin(self, text: str | None) -> float:
        """w.x, a sum over the distinct features of the text."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        total, seen = 0.0, set()
        for w in words(text):
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple((s, float(self.weights[s])) for s in map(slot, features(w)) if self.weights[s] != 0)
            for s, v in got:
                if s not in seen:
                    seen.add(s)
                    total += v
        return total

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - margin[:, None], -40, 40)))


def slots(text: str | None) -> np.ndarray:
    """The hashed features of a text, each once."""
    return np.unique(np.fromiter((slot(f) for w in words(text) for f in features(w)), np.int32))


def severity(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades of training texts from their features (``col`` of ``row``); see the module."""
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    seen1 = np.bincount(col, toxic[row])
    seen0 = np.bincount(col) - seen1
    marks = (seen1 >= 3) & (seen1 / n1 > 20 * (seen0 + 0.5) / n0)
    told = np.bincount(row, marks[col], len(toxic))
    out = np.zeros(len(toxic), int)
    if toxic.any():
        cuts = np.quantile(told[toxic == 1], np.linspace(0, 1, grades)[1:-1])
        out[toxic == 1] = 1 + np.searchsorted(cuts, told[toxic == 1], side="right")
    return out


def loss(margin: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, its gradient by each margin, and by each threshold.

    P(grade = k) = s_k - s_(k+1) with s_k = sigmoid(margin - t_k), s_0 = 1 and s_(last + 1) = 0.
    """
    n, rows = len(margin), np.arange(len(margin))
    s = 1 / (1 + np.exp(np.clip(thresholds - margin[:, None], -40, 40)))
    s = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
    above, below = s[rows, grade], s[rows, grade + 1]
    p = np.maximum(above - below, 1e-12)
    slope = s * (1 - s)
    by_threshold = np.zeros((n, s.shape[1]))
    by_threshold[rows, grade] += slope[rows, grade] / p
    by_threshold[rows, grade + 1] -= slope[rows, grade + 1] / p
    return float(-np.log(p).mean()), (above + below - 1) / n, by_threshold[:, 1:-1].sum(0) / n


def fit(rows: list[np.ndarray], toxic: np.ndarray, grades: int = 4, rounds: int = 400, rate: float = 0.3, l1: float = 1e-4, screen: float = 5.0) -> Ordinal:
    """Adaptive gradient descent on the cumulative-link likelihood; ``rows`` are the features of each text."""
    nothing = Ordinal(np.zeros(1 << BITS, np.float32), np.full(grades - 1, 40.0))
    if len(rows) == 0 or toxic.min() == toxic.max() or not any(map(len, rows)):
        return nothing
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, col = np.unique(np.concatenate(rows), return_inverse=True)
    grade = severity(row, col, toxic, grades)
    both = np.bincount(col), np.bincount(col, toxic[row])
    n1 = toxic.mean()
    z = (both[1] - n1 * both[0]) / np.sqrt(np.maximum(both[0] * n1 * (1 - n1), 1e-9))
    tells = (both[0] >= 2) & (z >= screen)  # features whose split by label chance would seldom give
    used, number = used[tells], np.cumsum(tells) - 1
    row, col = row[tells[col]], number[col[tells[col]]]
    if not len(used):
        return nothing
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    t, t2 = np.linspace(2, grades, grades - 1), np.full(grades - 1, 1e-8)
    for _ in range(rounds):
        _, by_margin, by_threshold = loss(np.bincount(row, w[col], len(rows)), t, grade)
        g = np.bincount(col, by_margin[row], len(used))
        g2 += g * g
        step = rate / np.sqrt(g2)
        w = np.maximum(w - step * (g + l1), 0)  # words can only add to severity
        t2 += by_threshold * by_threshold
        t = t - rate * by_threshold / np.sqrt(t2)
        t = t[0] + np.r_[0, np.maximum(np.diff(t), GAP).cumsum()]  # ordered thresholds
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return Ordinal(full, t)


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000, grades: int = 4) -> Ordinal:
    """Model of at most ``sample`` texts of either label."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("_y = 1").orderBy(*order).limit(sample).unionByName(known.where("_y = 0").orderBy(*order).limit(2 * sample))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([slots(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], ["w", "y"])

    # at most 3 * sample ids are broadcast; of texts of one id the first by content takes part
    chosen = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y")).orderBy("_id")
    got = chosen.select("_text", "_y").mapInArrow(run, "w array<int>, y int").toArrow()
    rows = [np.asarray(x.values) for c in got.column(0).chunks for x in c]
    return fit(rows, np.array(got.column(1).to_pylist(), int), grades)


def graded(p: np.ndarray) -> np.ndarray:
    """Grades of rows of P(grade >= 1), P(grade >= 2), ...: how many of these are reached, the first at ``CUT``, others at ``HALF``."""
    return (p >= np.r_[CUT, np.full(p.shape[1] - 1, HALF)]).cumprod(1).sum(1)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", names: tuple[str, str, str] = ("expected_severity", "grade", "toxic")) -> DataFrame:
    """The columns of ``docs`` and three more: expected severity (double), grade (int) and toxic (boolean: the grade isn't 0).

    Columns of ``docs`` that have one of these names (in any case) give way.
    """
    spark = prepare(docs.sparkSession)
    blob = spark.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])

    def run(batches):
        for b in batches:
            m = blob.value
            p = m.at_least(np.array([m.margin(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], float).reshape(-1))
            grade = graded(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], [*b.schema.names, *names])

    schema = docs.withColumns(dict(zip(names, (F.lit(0.0), F.lit(0), F.lit(False)), strict=True))).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_docs: DataFrame | None = None) -> DataFrame:
    """The documents that aren't called toxic, with their columns."""
    model = fit_labels(fit_docs if fit_docs is not None else docs, labels)
    names = tuple(unused(docs, n) for n in ("severity", "grade", "toxic"))
    return score(docs, model, names=names).where(~F.col(names[2])).drop(*names)


def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).drop("text")
