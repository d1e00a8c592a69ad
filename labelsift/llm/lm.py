"""Language-model scoring with a probabilistic suffix tree over words.

Contexts of one to ``depth`` words (at most three) are candidates when training texts hold them ``context_min`` times. A
context stays as a state when the divergence of its next-symbol distribution from its parent's (the context without its
oldest word), summed over its tokens, outweighs half a logarithm of N for each distribution entry; entries are next words
seen ``entry_min`` times there. A state whose parent is not kept falls back to the nearest shorter one. Next-symbol
distributions are absolutely discounted and fall back, normalised, to the parent and in the end to the smoothed word
distribution (c + 0.1) / (N + 0.1 (V + 1)). A text's tokens are scored in the longest state of the tree that is a suffix of
what stands before; contexts do not reach across texts.

The minimum counts are fixed, so the tree grows with the corpus. Counts cover every training token and take ordinary
shuffles; divergences are summed up on the executors. Candidates and states are broadcast in slices of at
most ``SLICE`` rows, by a hash of a context's newest word: all states of a token are in one slice, and a larger tree takes
more passes over the texts, with the same result. Words seen fewer than ``HEAD_MIN`` times, or beyond the ``HEAD`` most
frequent, are not broadcast:
their tokens meet their counts in a shuffle. Words and contexts are identified by 64-bit hashes.

Defined results: null text is the empty text (one end token); a document with a null id is held out; repeated rows are
scored, and counted, once each; an empty table gives an empty result; with no training text every count is zero; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, prepare, salted_join
from .tokens import WINDOW, Index, hashed_words, mixed, parts

ALPHA, DISCOUNT = 0.1, 0.5
END = b"\n"  # no word holds white space
END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
#: Rows of states, entries or candidate contexts that are broadcast at once; words whose counts are.
SLICE, HEAD, HEAD_MIN = 1 << 22, 1 << 22, 4
#: Pairs that a task holds at once, about.
PAIRS = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a context with one more, newer, word. The empty context's key is 0."""
    return mixed(context * _A + word)


def entry_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * _B ^ word)


@dataclass
class Tree:
    """Head words' counts, and by context length the states (log10 of the weight that goes to the parent) and entries (log10 of
    the probability against that of the word without context); all sorted by unsigned key."""

    total: int
    types: int
    words: Index
    counts: np.ndarray
    states: list[tuple[Index, np.ndarray]] = field(default_factory=list)
    entries: list[tuple[Index, np.ndarray]] = field(default_factory=list)

    @property
    def norm(self) -> float:
        return self.total + ALPHA * (self.types + 1)

    def base(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the smoothed probability of head words (0 for others), and which are head words."""
        at, known = self.words.find(words)
        return np.where(known, np.log10(((self.counts[at] if len(self.counts) else 0) + ALPHA) / self.norm), 0.0), known

    def log_gain(self, contexts: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        """log10 of P(word | longest state among ``contexts``, the shortest first) against P(word) without context.

        A context key that no state has, such as 0, stands for none.
        """
        out = np.zeros(len(words))
        for keys, (states, gamma), (entries, logs) in zip(contexts, self.states, self.entries, strict=False):
            at, on = states.find(keys)
            out[on] += gamma[at[on]] if len(states) else 0.0
            on = np.flatnonzero(on)
            at, hit = entries.find(entry_key(keys[on], words[on]))
            out[on[hit]] = logs[at[hit]] if len(entries) else 0.0
        return out


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens by row) of a column of texts; each row ends with the end token."""
    words, sizes = hashed_words(column)
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(len(words) + len(sizes), np.uint64)
    out[ends] = END_HASH
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words
    return out, sizes + 1


def contexts_of(words: np.ndarray, depth: int) -> list[np.ndarray]:
    """By length, the key of the context before each token; 0 where it would reach across an end token."""
    out, last = [], np.zeros(len(words), np.uint64)
    inside = np.zeros(len(words), bool)
    inside[1:] = words[:-1] != END_HASH
    valid = inside
    for k in range(depth):
        key = np.zeros(len(words), np.uint64)
        key[1:] = extended(last[:-1], words[:-1])
        if k:
            before = np.zeros(len(words), bool)
            before[1:] = valid[:-1]
            valid = inside & before
        key[~valid] = 0
        out.append(key)
        last = key
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _counted(pairs: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all tokens, end tokens included."""

    def run(batches):
        for b in chain.from_iterable(parts(b, 0, 2 * WINDOW) for b in batches):
            word, n = np.unique(_tokens(b.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(word), pa.array(n.astype(np.int64))], ["word", "n"])

    return train.select("_text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sliced(contexts: DataFrame, slices: int, k: int) -> DataFrame:
    return contexts if slices == 1 else contexts.where(F.pmod(F.xxhash64("last"), F.lit(slices)) == k)


def next_counts(train: DataFrame, contexts: DataFrame, words: DataFrame, order: int, above: DataFrame | None, least: int) -> DataFrame:
    """(context, word, n) over all training tokens for ``contexts`` (context, last) of ``order`` words and next ``words`` (word), of pairs seen ``least`` times.

    ``above`` (last, context, word) are the entries of contexts without the oldest word: what is rare there can't be frequent
    here, so other pairs aren't counted. Pairs go to the shuffle as the places of both in the broadcast lists.
    """
    slices = max(1, -(-max(contexts.count(), above.count() if above is not None else 0) // SLICE))
    word_slices = max(1, -(-words.count() // SLICE))
    found = None
    for k, m in ((k, m) for k in range(slices) for m in range(word_slices)):
        own = Index(np.sort(_arrow(_sliced(contexts, slices, k).select("context"))[0].view(np.uint64)))
        nexts = Index(np.sort(_arrow(words.where(F.pmod(F.xxhash64("word"), F.lit(word_slices)) == m).select("word"))[0].view(np.uint64)))
        parents = None
        if above is not None:
            parents = Index(np.sort(entry_key(*(x.view(np.uint64) for x in _arrow(_sliced(above, slices, k).select("context", "word"))))))
        blob = train.sparkSession.sparkContext.broadcast((own, nexts, parents))

        def run(batches, blob=blob):
            own, nexts, parents = blob.value
            held, size = [], 0
            for b in chain.from_iterable(parts(b, 0) for b in batches):
                w, _ = _tokens(b.column(0))
                keys = contexts_of(w, order)
                on = np.flatnonzero(keys[-1])
                if parents is not None:
                    on = on[parents.find(entry_key(keys[-2][on], w[on]))[1]]
                context, known = own.find(keys[-1][on])
                context, on = context[known], on[known]
                word, known = nexts.find(w[on])
                held.append(context[known] << 32 | word[known])
                size += len(held[-1])
                if size > PAIRS:
                    yield _counted(held)
                    held, size = [], 0
            if size:
                yield _counted(held)

        def named(batches, blob=blob):
            own, nexts, _ = blob.value
            for b in batches:
                pair = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([_signed(own.keys[pair >> 32]), _signed(nexts.keys[pair & 0xFFFFFFFF]), b.column(1)], ["context", "word", "n"])

        rows = train.select("_text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        part = materialize(rows.where(F.col("n") >= F.lit(least)).mapInArrow(named, "context long, word long, n long"), "contexts")
        blob.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def _arrow(df: DataFrame) -> list[np.ndarray]:
    t = df.toArrow()
    return [c.to_numpy() if t.num_rows else np.empty(0, np.int64) for c in t.columns]


def divergent(entries: DataFrame, order: int, blob, tokens: int) -> DataFrame:
    """(last, context, gamma, word, gain) of the states among the contexts of ``entries`` (context, parent, last, total, word, n, c).

    Divergences are sums over entries, so no context has to come together in one task.
    """

    def measured(batches):
        for b in batches:
            context, parent, last, total, word, n, c, held, size = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            tree = blob.value
            base = np.log10((c + ALPHA) / tree.norm)
            above = [last] if order == 2 else [last, parent] if order == 3 else []
            below = 10.0 ** (base + tree.log_gain([x.view(np.uint64) for x in above], word.view(np.uint64)))
            left = 1 - (held - DISCOUNT * size) / total
            p = (n - DISCOUNT) / total + left * below
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (last, context, np.log10(left), word, np.log10(p) - base, n * np.log(p / below), total - held, size)], ["last", "context", "gamma", "word", "gain", "told", "rest", "size"])

    sums = entries.groupBy("context").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("size"))
    columns = ["context", "parent", "last", "total", "word", "n", "c", "held", "size"]
    each = salted_join(entries, sums, "context", "word").select(columns)
    each = materialize(each.mapInArrow(measured, "last long, context long, gamma double, word long, gain double, told double, rest long, size long"), "measured")
    whole = each.groupBy("context", "gamma", "rest", "size").agg(F.sum("told").alias("told"))
    kept = whole.where(F.col("told") + F.col("rest") * F.col("gamma") * F.log(F.lit(10.0)) > (F.col("size") + 1) * 0.5 * F.log(F.lit(float(max(tokens, 2))))).select("context")
    return salted_join(each.select("last", "context", "gamma", "word", "gain"), kept, "context", "word").select("last", "context", "gamma", "word", "gain")


class Model:
    """Tables of a trained tree, in the shared folder: all words' counts, and by context length the states' entries."""

    def __init__(self, tree: Tree, counts: DataFrame, head_min: int):
        self.tree, self.counts, self.head_min = tree, counts, head_min
        self.tables: list[DataFrame] = []

    @property
    def rows(self) -> int:
        return sum(t.count() for t in self.tables)

    def trees(self):
        """The tree in slices: (number of slices, this one, tree)."""
        slices = max(1, -(-self.rows // SLICE))
        for k in range(slices):
            tree = Tree(self.tree.total, self.tree.types, self.tree.words, self.tree.counts)
            for t in self.tables:
                context, gamma, word, gain = _arrow(_sliced(t, slices, k).select("context", "gamma", "word", "gain"))
                keys, first = np.unique(context.view(np.uint64), return_index=True)
                entries = entry_key(context.view(np.uint64), word.view(np.uint64))
                order = np.argsort(entries)
                tree.states.append((Index(keys), gamma[first]))
                tree.entries.append((Index(entries[order]), gain[order]))
            yield slices, k, tree


def train_model(train: DataFrame, depth: int = 3, context_min: int = 128, entry_min: int = 16) -> Model:
    """``train`` has _text."""
    if not 1 <= depth <= 3 or context_min < entry_min:
        raise ValueError("contexts have one to three words, and are no rarer than entries")
    sc = train.sparkSession.sparkContext
    counts = materialize(word_counts(train), "words")
    total, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    # the fewest tokens that a word of the head may have: HEAD_MIN, or a higher power of two that leaves at most HEAD words
    sizes = counts.where(F.col("n") >= HEAD_MIN).groupBy(F.floor(F.log2("n")).alias("b")).count().orderBy(F.desc("b")).collect()  # at most 63 rows
    head_min, size = 1 << 62, 0
    for r in sizes:
        size += r["count"]
        if size > HEAD:
            break
        head_min = max(HEAD_MIN, 1 << r.b)
    word, n = _arrow(counts.where(F.col("n") >= head_min).select("word", "n"))
    order = np.argsort(word.view(np.uint64))
    model = Model(Tree(total, types, Index(word.view(np.uint64)[order]), n[order]), counts, head_min)
    if not total:
        return model

    def grown(batches):
        for b in batches:
            context, parent, word, n = (_unsigned(c) for c in b.columns)
            none = np.zeros(len(word), np.uint64)
            yield pa.RecordBatch.from_arrays([*map(_signed, (extended(context, word), np.where(context == 0, none, extended(parent, word)), extended(none, word), n))], ["context", "parent", "last", "total"])

    # a context is followed by as many tokens as it has places, as it doesn't hold the end token
    schema, inner = "context long, parent long, last long, total long", F.col("word") != int(END_HASH.view(np.int64))
    zero = F.lit(0).cast("long")
    often = counts.where((F.col("n") >= context_min) & inner).select(zero.alias("context"), zero.alias("parent"), "word", "n")
    words, above = counts.where(F.col("n") >= entry_min).select("word", F.col("n").alias("c")), None
    for order in range(1, depth + 1):
        contexts = materialize(often.mapInArrow(grown, schema), "candidates")
        if contexts.isEmpty():
            break
        pairs = salted_join(next_counts(train, contexts, words, order, above, entry_min), contexts, "context", "word")
        entries = materialize(salted_join(pairs, words, "word", "context"), "entries")
        found = None
        for slices, k, tree in model.trees():
            blob = sc.broadcast(tree)
            part = materialize(divergent(_sliced(entries, slices, k), order, blob, total), "states")
            blob.unpersist()
            found = part if found is None else found.unionByName(part)
        model.tables.append(found)
        above = entries.select("last", "context", "word")
        often = entries.where((F.col("n") >= context_min) & inner).select("context", "parent", "word", "n")
    return model


def pst_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see the module."""
    spark = prepare(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_held", held)
    model = train_model(rows.where(~F.col("_held")), **options)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    scored = more = None
    for slices, k, tree in model.trees():
        blob = spark.sparkContext.broadcast(tree)

        def run(batches, blob=blob, slices=slices, k=k):
            tree = blob.value
            for b in chain.from_iterable(parts(b, 2) for b in batches):
                w, sizes = _tokens(b.column(2))
                delta = tree.log_gain(contexts_of(w, len(tree.states)), w)
                starts = np.cumsum(sizes) - sizes
                add = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
                if k:
                    yield pa.RecordBatch.from_arrays([b.column(3), pa.array(add(delta))], ["_row", "_delta"])
                    continue
                base, known = tree.base(w)
                rare_at = np.flatnonzero(~known)
                cut = np.searchsorted(rare_at, np.r_[starts, len(w)])
                rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _signed(w[rare_at]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(3), b.column(1), pa.array(sizes), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(delta)), rare],
                    ["doc_id", "_row", "held_out", "n_tokens", "_head", "_base", "_delta", "_rare"],
                )

        source = rows.select("_id", "_held", "_text", "_row")
        if not k:
            scored = materialize(source.mapInArrow(run, "doc_id long, _row long, held_out boolean, n_tokens long, _head long, _base double, _delta double, _rare array<long>"), "scored")
        else:
            part = materialize(source.mapInArrow(run, "_row long, _delta double"), "scored")
            more = part if more is None else more.unionByName(part)
    known = model.counts.where(F.col("n") < model.head_min).withColumnRenamed("n", "c")
    rare = scored.select("_row", F.explode("_rare").alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("k"))
    met = rare.join(known.hint("shuffle_hash"), "word", "left")
    value = F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / model.tree.norm)
    summed = met.groupBy("_row").agg(F.sum(value).alias("_rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("_met"))
    out = scored.drop("_rare").join(summed, "_row", "left")
    if more is not None:
        out = out.join(more.groupBy("_row").agg(F.sum("_delta").alias("_more")), "_row").withColumn("_delta", F.col("_delta") + F.col("_more"))
    base = F.col("_base") + F.coalesce("_rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("_head") + F.coalesce("_met", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tree.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("_delta")).alias("score"),
    )


def op2_pst_score(spark, sf_dir):
    return pst_score(documents(spark, sf_dir))
