"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay
[23,12] code. A word's keys are the codewords nearest to the words within one flip of it: one or six of them, and two
words that differ in at most two bits always share one. By pigeonhole, fingerprints that differ in at most four bits
either agree wholly in one segment and have at most two errors in another, or have errors (1, 1, at most 2) in some
order, so that halves of two segments agree while the third has at most two. Each fingerprint therefore emits the keys
(whole segment, fuzzy segment) and (half, half, fuzzy segment); an equi-join on the key finds every pair within four
bits, and each is verified by counting differing bits.

Fingerprints are made distinct first, so exact copies never meet each other. Groups (rows of one key) are settled
exactly without expanding them into pairs: a block of a group is walked in one task from pivots to what they reach, and
links come out only where they join something new. A group beyond ``BLOCK_ROWS`` rows or ``BLOCK_WEIGHT`` of payload is
dealt into blocks; what the walks leave in different components then visits the other blocks. Components come from
large-star and small-star rounds over the links, as DataFrames written to the shared folder.

The verified stage (``drop_near_copies``) fingerprints each text five times: its distinct words, and the words around
four anchors, the shingles of least hash under four hash functions (the shingle alone, or 16 words). Edits anywhere
leave most anchors and their surroundings alone, so appended, cut and edited copies meet as well. Texts whose fingerprints are in one component of
Hamming links are compared by the exact Jaccard similarity of their shingle hashes.

Defined results: null text is the empty text, whose fingerprint is zero and links like any other; texts of fewer words
than a shingle are hashed whole; repeated rows keep a row each; a null id gets its group's smallest non-null id (null
if there is none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, parallelism, prepare, release, salted_join
from .tokens import hashed_words, mixed, parts

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23,12,7] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SMALL_BUCKET = 16
#: A task walks at most so many rows of a group, holding at most so many words of payload (one very long text aside).
BLOCK_ROWS, BLOCK_WEIGHT, HELD_BYTES = 2048, 1 << 19, 1 << 25
#: Blocks of a large group whose representatives visit all blocks before the rest does.
REPRESENTATIVES = 16
#: For the verified stage: words taken with each anchor of a text, at least its shingle.
ANCHORS = (0, 0, 16, 16)
#: At most so many ids are broadcast.
BROADCAST_IDS = 1 << 20


# ---------------------------------------------------------------- Golay keys


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 3 bytes of a word, and per syndrome the up to six patterns that lead to its keys (0 = no more)."""
    by_byte = np.array([[_remainder(b << s) for b in range(256)] for s in (0, 8)] + [[_remainder((b & 127) << 16) for b in range(256)]], np.int32)
    single = np.array([_remainder(1 << i) for i in range(23)])
    leader = np.full(2048, -1, np.int64)
    flips = [0] + [1 << i for i in range(23)]
    flips += [1 << i | 1 << j for i in range(23) for j in range(i)]
    flips += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    for p in flips:  # the code is perfect: these 2048 patterns have all syndromes
        leader[_remainder(p)] = p
    patterns = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        found = {int(leader[s])} | {int(leader[s ^ single[i]]) ^ 1 << i for i in range(23)}
        patterns[s, : len(found)] = sorted(found, key=lambda p: (p.bit_count(), p))
    return by_byte, patterns


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """For words of up to 23 bits, an n x 6 array of 12-bit codeword indices, -1 where there are fewer."""
    by_byte, patterns = golay_tables()
    w = words.astype(np.int64)
    syndrome = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    p = patterns[syndrome]
    return np.where(p < 0, -1, (w[:, None] ^ p) >> 11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of each; keys of different forms never meet."""
    seg = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    fuzzy = [codeword_keys(s) for s in seg]
    rows, keys = [], []

    def emit(form: int, exact: np.ndarray, third: int) -> None:
        at, col = np.nonzero(fuzzy[third] >= 0)
        rows.append(at)
        keys.append(np.int64(form) << 48 | exact[at] << 12 | fuzzy[third][at, col])

    form = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                emit(form, seg[i], j)
                form += 1
    for third in range(3):
        a, b = (seg[x] for x in range(3) if x != third)
        for ha in ((a & 2047), (a >> 11)):
            for hb in ((b & 2047), (b >> 11)):
                emit(form, ha << 11 | hb, third)
                form += 1
    return np.concatenate(rows), np.concatenate(keys)


# ------------------------------------------------------------- fingerprints


def _votes(hashes: list[int] | np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def fingerprint(text: bytes, width: int, seed: int = 42, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of ``width``-word shingles of the lower-cased bytes, repeats included; memory is bounded by ``chunk`` hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    spans = list(zip(starts, ends[min(width, len(words)) - 1 :], strict=False))
    h = xxhash.xxh64_intdigest
    votes = sum(_votes([h(joined[s:e], seed) for s, e in spans[k : k + chunk]]) for k in range(0, len(spans), chunk))
    return int(np.packbits(votes * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), _longs([fingerprint(t or b"", width, seed) for t in texts])], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------- groups settled


class Prints:
    """The fingerprints of a block; ``near`` marks those within ``bits`` of one."""

    def __init__(self, payloads: list[int], bits: int):
        self.items = self.read(payloads)
        self.bits = bits

    @staticmethod
    def read(payloads: list[int]) -> np.ndarray:
        return np.array(payloads, np.int64).view(np.uint64)

    def near(self, item) -> np.ndarray:
        return np.bitwise_count(self.items ^ item) <= self.bits


class ShingleSets:
    """The sets of a block as sorted hashes, with an index from hash to sets; ``near`` marks the sets of at least the similarity."""

    def __init__(self, payloads: list[bytes], similarity: float):
        self.items = self.read(payloads)
        self.similarity = similarity
        self.n = np.array([len(x) for x in self.items], np.int64)
        self.hashes, which = np.unique(np.concatenate([np.empty(0, np.uint64), *self.items]), return_inverse=True)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)[np.argsort(which, kind="stable")]
        self.starts = np.r_[0, np.cumsum(np.bincount(which, minlength=len(self.hashes)))]

    @staticmethod
    def read(payloads: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(p, np.uint64) for p in payloads]

    def near(self, item: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(item):
            return self.n == len(item)
        at = np.minimum(np.searchsorted(self.hashes, item), len(self.hashes) - 1)
        at = at[self.hashes[at] == item]
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        before = np.cumsum(size) - size
        same = np.bincount(self.owner[np.repeat(first - before, size) + np.arange(size.sum())], minlength=len(self.n))
        return same >= self.similarity * (self.n + len(item) - same) - 1e-9


def _walk(nodes: np.ndarray, block: Prints | ShingleSets) -> Iterator[tuple[int, int]]:
    """Links that connect all that pairs of the block connect: from pivots to what nothing has reached yet."""
    left = np.ones(len(nodes), bool)
    for pivot in range(len(nodes)):
        todo = [pivot] if left[pivot] else []
        left[pivot] = False
        while todo:
            p = todo.pop()
            got = np.flatnonzero(left & block.near(block.items[p])) if left.any() else ()
            for x in got:
                yield int(nodes[p]), int(nodes[x])
            left[got] = False
            todo += list(got)


def _visit(nodes: np.ndarray, roots: np.ndarray, block: Prints | ShingleSets, visitors: list) -> Iterator[tuple[int, int]]:
    """Links of ``visitors`` (node, root, payload) to the block's rows, where they join roots that aren't joined yet."""
    joined: dict[int, int] = {}

    def find(r: int) -> int:
        while r in joined:
            r = joined[r]
        return r

    for (node, root, _), item in zip(visitors, block.read([v[2] for v in visitors]), strict=True):
        for x in np.flatnonzero((roots != root) & block.near(item)):
            a, b = find(root), find(int(roots[x]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                yield node, int(nodes[x])


def _by_block(rows: DataFrame, make: Callable) -> DataFrame:
    """Links (a, b) from rows (grp, block, visitor, node, root, payload): each block walked, or visited if it has visitors."""
    n = parallelism(rows.sparkSession)
    columns = ["grp", "block", "visitor", "node", "root", "payload"]

    def settled(held: list) -> list[tuple[int, int]]:
        own = [r for r in held if not r[2]]
        guests = [(r[3], r[4], r[5]) for r in held if r[2]]
        if not own or len(held) < 2:
            return []
        nodes, block = np.array([r[3] for r in own], np.int64), make([r[5] for r in own])
        return list(_visit(nodes, np.array([r[4] for r in own], np.int64), block, guests) if guests else _walk(nodes, block))

    def run(batches):
        held: list = []
        size = 0
        out: list[tuple[int, int]] = []
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(len(columns))), strict=True):
                if held and held[0][:2] != r[:2]:
                    out += settled(held)
                    held, size = [], 0
                elif r[2] and (len(held) >= 2 * BLOCK_ROWS or size >= HELD_BYTES):  # many visitors come in parts
                    out += settled(held)
                    held, size = [x for x in held if not x[2]], 0
                held.append(r)
                size += len(r[5]) if isinstance(r[5], bytes) else 8
            if len(out) > 1 << 16:
                yield _pairs(out)
                out = []
        yield _pairs(out + settled(held))

    dealt = rows.select(columns).repartition(n, "grp", "block").sortWithinPartitions("grp", "block", "visitor", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])


def settle(rows: DataFrame, make: Callable, weight: str | None = None) -> DataFrame:
    """Links (a, b) that connect, in each group of ``rows`` (grp, node, payload), all that its pairs connect.

    ``make`` builds a block from a list of payloads. Every pair of a group is either compared or already connected by
    links. Groups of one block take one round. Of larger ones, representatives of the largest components of some blocks
    visit all blocks, then all rows outside the group's largest component do.
    """
    total = F.sum(weight) if weight else F.lit(0)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(total / BLOCK_WEIGHT)).cast("int")
    large = materialize(rows.groupBy("grp").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    some = large.count()
    side = F.broadcast(large) if some <= BROADCAST_IDS else large  # at most rows / BLOCK_ROWS and weight / BLOCK_WEIGHT groups
    dealt = rows.join(side, "grp", "left").select(
        "grp", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int").alias("block"), F.lit(False).alias("visitor"), "node", F.col("node").alias("root"), "payload", "blocks"
    )
    found = materialize(_by_block(dealt, make).distinct(), "links")
    if not some:
        return found
    members = materialize(dealt.where("blocks > 1").drop("root", "visitor"), "members")
    for first in (True, False):
        roots = components(found)
        rooted = members.join(roots, "node", "left").select("grp", "block", "blocks", "node", F.coalesce("root", "node").alias("root"), "payload")
        in_block = rooted.groupBy("grp", "block", "root").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
        main = in_block.groupBy("grp", "root").agg(F.sum("c").alias("c")).groupBy("grp").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        main = materialize(main.select("grp", "main"), "main")
        side = F.broadcast(main) if main.count() <= BROADCAST_IDS else main
        open_rows = rooted.join(side, "grp")
        if first:  # the largest component of each of the first blocks sends one row
            speak = in_block.where(F.col("block") < REPRESENTATIVES).groupBy("grp", "block").agg(F.max_by("node", F.struct("c", "root")).alias("node"))
            guests = open_rows.join(F.broadcast(speak) if some <= BROADCAST_IDS // REPRESENTATIVES else speak, ["grp", "block", "node"], "left_semi")
        else:
            guests = open_rows.where("root <> main")
        guests = guests.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"), "node", "root", "payload")
        both = open_rows.select("grp", "block", F.lit(False).alias("visitor"), "node", "root", "payload").unionByName(guests)
        found = materialize(found.unionByName(_by_block(both, make)).distinct(), "links")
    return found


# -------------------------------------------------------------------- links


def _spanning(both: np.ndarray) -> np.ndarray:
    """As few of the links as connect what all of them connect: a dense cluster has no more of them than members."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = []
    for k, (a, b) in enumerate(both.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return both[keep]


def bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a < b) that connect all that rows of equal key connect, and the rows (key, fp) of buckets beyond
    ``BLOCK_ROWS``. Rows are sorted by key. All pairs of small buckets are looked at, others are walked.
    """
    n = len(keys)
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[cut, n])
    small, wide = np.repeat(size <= SMALL_BUCKET, size), np.repeat(size > BLOCK_ROWS, size)
    out = [np.empty((0, 2), np.uint64)]
    for k in range(1, SMALL_BUCKET):
        i = np.flatnonzero(small[:-k] & (keys[:-k] == keys[k:])) if k < n else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= bits]
        out.append(np.stack([fps[i], fps[i + k]], 1))
    for c in np.flatnonzero((size > SMALL_BUCKET) & (size <= BLOCK_ROWS)):
        own = fps[cut[c] : cut[c] + size[c]].view(np.int64)
        out.append(np.array([*_walk(own, Prints(own, bits))], np.int64).reshape(-1, 2).view(np.uint64))
    both = np.concatenate(out).view(np.int64)
    both.sort(axis=1)
    return _spanning(np.unique(both[both[:, 0] != both[:, 1]], axis=0)), np.stack([keys[wide], fps[wide].view(np.int64)], 1)


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) with a < b between the distinct fingerprints ``nodes.fp``: of pairs at most ``max_bits`` (<= 4) apart,
    as many as connect all of them."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys cover up to four differing bits")

    def emit(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                at, key = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["key", "fp"])

    def join(batches):
        """(null, a, b) for links, (key, fp, null) for rows of large buckets; memory is bounded by a batch."""
        keys, fps, going = np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(e, rows):
            key = pa.array(np.r_[np.zeros(len(e), np.int64), rows[:, 0]], mask=np.r_[np.ones(len(e), bool), np.zeros(len(rows), bool)])
            b = pa.array(np.r_[e[:, 1], np.zeros(len(rows), np.int64)], mask=np.r_[np.zeros(len(e), bool), np.ones(len(rows), bool)])
            return pa.RecordBatch.from_arrays([key, pa.array(np.r_[e[:, 0], rows[:, 1]]), b], ["key", "a", "b"])

        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
            if going is not None and len(keys):  # a large bucket that began before
                end = int(np.searchsorted(keys, going, "right"))
                yield out(np.empty((0, 2), np.int64), np.stack([keys[:end], fps[:end]], 1))
                going = going if end == len(keys) else None
                keys, fps = keys[end:], fps[end:]
            if len(keys) >= 1 << 18:
                end = int(np.searchsorted(keys, keys[-1]))
                if len(keys) - end > BLOCK_ROWS:  # the last bucket is large already
                    going, end = keys[-1], len(keys)
                yield out(*bucket_links(keys[:end], fps[:end].view(np.uint64), max_bits))
                keys, fps = keys[end:], fps[end:]
        if len(keys):
            yield out(*bucket_links(keys, fps.view(np.uint64), max_bits))

    n = parallelism(nodes.sparkSession)
    keyed = nodes.select("fp").mapInArrow(emit, "key long, fp long")
    found = materialize(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(join, "key long, a long, b long"), "buckets")
    some = found.where("key is null").select("a", "b").distinct()
    rest = found.where("key is not null").select(F.col("key").alias("grp"), F.col("a").alias("node"), F.col("a").alias("payload"))
    if not rest.isEmpty():
        some = some.unionByName(settle(rest, lambda x: Prints(x, max_bits))).distinct()
    return some


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node of its component (large-star, small-star)."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = salted_join(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root", "fp").select("fp", "component_id")
    return salted_join(prints, named, "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------- verified near-duplicate stage


def shingle_set(text: str | None, width: int = 5) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(v: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``shingle_set``, in order of place, from hashes of the words."""
    k = min(width, len(v))
    h = np.zeros(len(v) - k + 1 if len(v) else 0, np.uint64)
    for i in range(k):
        h += v[i : i + len(h)] * np.uint64(pow(int(_ODD), i + 1, 1 << 64))
    return mixed(h)


def word_print(v: np.ndarray) -> int:
    """SimHash of the distinct words, as a signed long."""
    u = np.unique(v)
    votes = sum(_votes(u[k : k + (1 << 16)]) for k in range(0, len(u), 1 << 16))
    return int(np.packbits(votes * 2 > len(u), bitorder="little").view(np.int64)[0]) if len(u) else 0


def anchored_prints(v: np.ndarray, shingles: np.ndarray) -> list[int]:
    """SimHashes of a text's distinct words and of the words around each anchor."""
    if not len(v):
        return [0] * (len(ANCHORS) + 1)
    out, width = [word_print(v)], len(v) - len(shingles) + 1
    for k, words in enumerate(ANCHORS):
        at = int(mixed(shingles * _ODD + np.uint64(7919 * k + 1)).argmin())
        more = max(0, words - width)
        out.append(word_print(v[max(0, at - more // 2) : at + width + more - more // 2]))
    return out


def _each(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Word hashes, shingle hashes, sorted distinct shingle hashes and a hash of these, of each text."""
    words, sizes = hashed_words(column)
    for v in np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else ():
        s = shingle_hashes(v, width)
        u = np.unique(s)
        yield v, s, u, xxhash.xxh64_intdigest(u.tobytes(), 7)


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def near_groups(prints: DataFrame) -> DataFrame:
    """(grp, node) of ``prints`` (node, p0, p1, ...): nodes whose fingerprints of one kind are in one component of Hamming
    links; groups of two nodes or more."""
    kinds = [c for c in prints.columns if c != "node"]
    # anchors' fingerprints are of one kind, but take the shuffle two by two: its files go as each result is written
    named = lambda k, c: F.xxhash64(F.lit(min(k, 1)), c)
    edges = None
    for together in (kinds[:1], *(kinds[k : k + 2] for k in range(1, len(kinds), 2))):
        k = kinds.index(together[0])
        got = links(prints.select(F.explode(F.array(*together)).alias("fp")).distinct()).select(named(k, F.col("a")).alias("a"), named(k, F.col("b")).alias("b"))
        edges = got if edges is None else edges.unionByName(got)
    roots = components(edges)
    each = prints.select("node", F.explode(F.array_distinct(F.array(*(named(k, F.col(c)) for k, c in enumerate(kinds))))).alias("fp"))
    grouped = each.join(roots, each["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("grp"), each["node"]).distinct()
    grouped = materialize(grouped.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(8)).cast("int")), "grouped")
    several = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    return materialize(grouped.join(several, ["grp", "salt"]).select("grp", "node"), "groups")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row (the smallest id) of each group of near copies.

    Candidates are texts with fingerprints in one component of Hamming links (see the module). Near copies are candidates
    whose ``width``-word shingles have a Jaccard similarity of at least ``similarity``, measured on 64-bit hashes; groups
    are the components of such pairs, and every pair of candidates is settled. Equal sets of shingles are one node. Rows
    with a null id and rows without a near copy stay; rows that share an id share one fate, and go if the text of any of
    them has a near copy of smaller id.
    """
    prepare(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    names = [f"p{k}" for k in range(len(ANCHORS) + 1)]

    def name(batches):
        for b in chain.from_iterable(parts(b, 1) for b in batches):
            found = [(x, *anchored_prints(v, s)) for v, s, _, x in _each(b.column(1), width)]
            nodes = _longs([f[0] for f in found])
            prints = np.array([f[1:] for f in found], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, *(pa.array(prints[:, k]) for k in range(len(names)))], ["doc_id", "node", *names])

    rows = materialize(texts.mapInArrow(name, "doc_id long, node long, " + ", ".join(f"{p} long" for p in names)), "prints")
    first = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", *names)).alias("m")).select("node", "m.*"), "nodes")
    groups = near_groups(first.select("node", *names))
    active = materialize(groups.select("node").distinct().join(first, "node").select("node", "doc_id"), "active")

    def sets(batches):
        for b in chain.from_iterable(parts(b, 1) for b in batches):
            found = [(x, len(u), u.tobytes()) for _, _, u, x in _each(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([_longs([f[0] for f in found]), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], ["node", "n", "payload"])

    ids = active.select(F.col("doc_id").alias("_id"))
    chosen = texts.join(F.broadcast(ids) if active.count() <= BROADCAST_IDS else ids, "_id", "left_semi")
    shingled = materialize(chosen.mapInArrow(sets, "node long, n int, payload binary"), "sets")
    shingled = shingled.join(active.select("node"), "node", "left_semi").dropDuplicates(["node"])
    roots = components(settle(groups.join(shingled, "node"), lambda x: ShingleSets(x, similarity), "n"))
    kept = first.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    kept = salted_join(kept, kept.groupBy("root").agg(F.min("doc_id").alias("kept")), "root", "node").select("node", "kept")
    drop = salted_join(rows.select("node", "doc_id"), kept, "node", "doc_id").where("doc_id <> kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs[id_col].cast("long") == drop["_drop"], "left_anti")


def op1_simhash_near_dedup(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))
