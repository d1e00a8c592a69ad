"""The training-data operators against brute force, SQL and exact round trips, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import differences
from pyspark.sql import functions as F

from labelsift.llm import ann, bpe, exact_dedup, html_text, licenses, lm, mixing, pii, simhash, tokens, toxicity
from labelsift.llm.queries import ORACLE_SQL, QUERIES

LONG = "lorem ipsum dolor " * 3000
TEXTS = [None, "", " \t\n", "Same text here now", "same TEXT here now", "same text here now", "É É é", "one two three four five six seven eight nine ten", LONG, "x@y.org 10.0.0.1", None]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, stay string, digest string, n long, p string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, a null id, and columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", "s", 1, 7, "a", None, 2, "p") for i, t in enumerate(TEXTS)]
    names = "_id _text _row _held _drop _key _digest node grp root payload fp0 a b key word context label license similarity found severity grade toxic kept keep_id probability topic value h w".split()
    return spark.createDataFrame([*rows, rows[3], (None, "same text here now", *rows[3][2:])], SCHEMA).withColumns({c: F.lit(f"own {c}") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name]) == ""


# ---- exact dedup


def test_exact_dedup_cases(odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(TEXTS) + 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in by.values())
    same = by[hashlib.sha256(b"same text here now").hexdigest()]
    assert len(same) == 5 and {r.keep_id for r in same} == {5}
    assert {r.keep_id for r in by[hashlib.sha256(b"").hexdigest()]} == {10}
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0
    clash = odd.drop("digest").withColumns({c: F.lit("x") for c in ("Digest", "stay_id", "stay_digest", "doc_id_")})
    assert exact_dedup.keep_one(clash).columns == clash.columns and exact_dedup.keep_one(clash).count() == len(by)
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)


def test_heavy_hitters_and_rest_agree(docs):
    a, b = exact_dedup.exact_dedup(docs, heavy=1, counters=64), exact_dedup.exact_dedup(docs)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ---- simhash


def plain_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    import xxhash

    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 500)
    keys = [set(k[k >= 0].tolist()) for k in simhash.codeword_keys(w)]
    assert {len(k) for k in keys} <= {1, 6}
    for i in range(23):
        for j in range(i + 1):
            other = simhash.codeword_keys(w ^ (1 << i | 1 << j))
            assert all(a & set(b[b >= 0].tolist()) for a, b in zip(keys, other, strict=True))


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    at, ka = simhash.fuzzy_keys(a)
    bt, kb = simhash.fuzzy_keys(b)
    assert len(set(zip(at.tolist(), ka.tolist(), strict=True)) & set(zip(bt.tolist(), kb.tolist(), strict=True))) >= len(a)
    assert {i for i, _ in set(zip(at.tolist(), ka.tolist(), strict=True)) & set(zip(bt.tolist(), kb.tolist(), strict=True))} == set(range(len(a)))


def noisy_prints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = lambda lo, hi: np.uint64(1) << rng.integers(lo, hi, 60).astype(np.uint64)
    return np.unique(np.concatenate([b ^ flips(0, 20) ^ flips(20, 40) for b in base]))


def plain_links(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]


def test_large_buckets_lose_no_connection():
    fps = noisy_prints()
    got, wide = simhash.bucket_links(np.zeros(len(fps), np.int64), fps, 4)
    got = [(np.int64(a).astype(np.uint64).item(), np.int64(b).astype(np.uint64).item()) for a, b in got]
    assert len(wide) == 0 and classes(got, fps.tolist()) == classes(plain_links(fps.tolist()), fps.tolist())


@pytest.mark.parametrize("rows", [7, 40])
def test_groups_of_many_blocks_are_settled(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    fps = noisy_prints().view(np.int64).tolist()
    groups = spark.createDataFrame([(g, f, f) for g in (1, 2) for f in fps] + [(3, 5, 5)], "grp long, node long, payload long")
    got = [(r.a, r.b) for r in simhash.settle(groups, lambda x: simhash.Prints(x, 4)).collect()]
    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert classes(got, fps) == classes(want, fps)


def test_sets_of_many_blocks_are_settled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, (3, 40), dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base[k % 3])[:36], rng.integers(0, 1 << 60, 2, dtype=np.uint64)]) for k in range(90)] + [np.empty(0, np.uint64)]
    groups = spark.createDataFrame([(1, k, len(x), bytearray(x.tobytes())) for k, x in enumerate(sets)], "grp long, node long, n int, payload binary")
    got = [(r.a, r.b) for r in simhash.settle(groups, lambda x: simhash.ShingleSets(x, 0.7), "n").collect()]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.jaccard({*sets[i].tolist()}, {*sets[j].tolist()}) >= 0.7]
    assert classes(got, range(len(sets))) == classes(want, range(len(sets)))


def test_near_dedup_matches_brute_force(docs, texts):
    got = simhash.near_dedup(docs).collect()
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    want = classes([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got)


def test_near_dedup_cases(odd, empty):
    got = simhash.near_dedup(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {0}
    assert {r.component_id for r in got if r.doc_id is None} == {3}
    assert simhash.near_dedup(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_verified_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(4000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    near = [b.replace(b.split()[150], "changed", 1) for b in base]
    rows = [(k, t) for k, t in enumerate(base + near)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.doc_id for r in left.collect()}
    assert set(range(30)) <= ids and len(ids) <= 31


def near_copy_classes(spark, texts):
    """What the verified stage keeps of ``texts``, and what brute force over all pairs keeps."""
    left = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [simhash.shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
    return {r.doc_id for r in left.collect()}, set(classes(pairs, range(len(sets))).values())


def test_verified_stage_joins_large_groups_by_way_of_a_third_text(spark):
    rng = np.random.default_rng(11)
    texts = []
    for edits, copies in ((5, 200), (9, 60)):
        base = rng.choice([f"w{k}" for k in range(4000)], 300)
        for k in range(copies):
            copy = base.copy()
            copy[rng.choice(300, edits, replace=False)] = [f"x{edits}_{k}_{e}" for e in range(edits)]
            texts.append(" ".join(copy))
        texts.append(" ".join(base))  # last, so that no smallest id is the middle of its group
    got, want = near_copy_classes(spark, texts)
    assert got == want


def test_verified_stage_finds_appended_cut_and_short_copies(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(4000)]
    texts = ["a b c d", "a b c d e", "", "A  b c d"]
    for n in (8, 12, 20, 50, 100, 400):
        for _ in range(10):
            base = list(rng.choice(words, n))
            more = list(rng.choice(words, max(1, n // 5)))
            texts += [" ".join(t) for t in (base, base + more, more[: n // 6] + base, base[: n - n // 6], base[: n // 2] + ["changed"] + base[n // 2 :])]
    got, want = near_copy_classes(spark, texts)
    assert len(want) < len(texts) / 2 and want <= got  # nothing goes that has no near copy
    assert len(got - want) <= 0.03 * (len(texts) - len(want))


def test_verified_stage_compares_texts_of_one_fingerprint(spark):
    rng = np.random.default_rng(13)
    words = [f"w{k}" for k in range(200)]
    other = list(rng.permutation(words))
    texts = [" ".join(rng.permutation(words)), " ".join(other), " ".join([other[1], other[0], *other[2:]])]
    assert near_copy_classes(spark, texts) == ({0, 1}, {0, 1})


def test_verified_stage_recall_on_all_pairs(spark, docs, texts):
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    ids = sorted(texts)
    sets = {i: simhash.shingle_set(texts[i]) for i in ids}
    met = collections.defaultdict(list)  # sets of that similarity share one of the first fifth, by any order
    for i in ids:
        for s in sorted(sets[i], key=hash)[: len(sets[i]) - math.ceil(0.8 * len(sets[i])) + 1]:
            met[s].append(i)
    pairs = {(a, b) for m in met.values() for k, b in enumerate(m) for a in m[:k]}
    near = [(a, b) for a, b in pairs if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    want = set(classes(near, ids).values())
    assert want <= kept and len(kept - want) <= 0.05 * (len(ids) - len(want))


# ---- language model


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.mark.parametrize("window", [8, 64, 1 << 20])
def test_hashed_words(window, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", window)
    tokens._powers.cache_clear()
    rng = np.random.default_rng(20)
    known = {}
    for k in range(200):
        texts = ["".join(rng.choice(list("ab AB\t\n é\xa0\x1c\x0b"), rng.integers(0, 30))) for _ in range(rng.integers(0, 6))] + [None, "x" * 1000 * (k % 2)]
        h, n = tokens.hashed_words(pa.array(texts, pa.string()).slice(k % 2))
        want = [(t or "").encode().lower().split() for t in texts[k % 2 :]]
        assert n.tolist() == [len(w) for w in want]
        assert all(known.setdefault(w, x) == x for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    tokens._powers.cache_clear()


def test_index_finds_what_is_there():
    rng = np.random.default_rng(21)
    keys = np.unique(np.r_[rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64)])
    wanted = np.r_[keys, rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.uint64(60)]
    at, hit = tokens.Index(keys[::2]).find(wanted)
    assert (hit == np.isin(wanted, keys[::2])).all() and (keys[::2][at[hit]] == wanted[hit]).all()
    assert not tokens.Index(keys[:0]).find(wanted)[1].any()


def test_scores(docs, texts):
    got = lm.pst_score(docs).collect()
    words_of = {i: plain_tokens(t) for i, t in texts.items()}
    c = collections.Counter(w for i, ws in words_of.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = words_of[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    held = [r for r in lm.pst_score(docs, context_min=16, entry_min=4).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_tree(texts, depth, context_min, entry_min):
    """Word counts and, by context (oldest word first), (left, {word: probability}) of the states; and P(word | context)."""
    c, follow = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for ws in texts:
        c.update(ws)
        for i, w in enumerate(ws):
            for k in range(1, min(i, depth) + 1):
                follow[k][tuple(ws[i - k : i])][w] += 1
    n, v, states = sum(c.values()), len(c), {}

    def p(context, w):
        for k in range(len(context) + 1):
            if context[k:] in states or not context[k:]:
                break
        context = context[k:]
        if not context:
            return (c[w] + 0.1) / (n + 0.1 * (v + 1))
        left, own = states[context]
        return own[w] if w in own else left * p(context[1:], w)

    frequent = {(w,) for w in c if c[w] >= context_min and w != b"\n"}
    for k in range(1, depth + 1):
        new = {}
        for context in frequent:
            nexts = follow[k][context]
            total, own = sum(nexts.values()), {w: m for w, m in nexts.items() if m >= entry_min}
            if not own:
                continue
            left = 1 - sum(m - 0.5 for m in own.values()) / total
            prob = {w: (m - 0.5) / total + left * p(context[1:], w) for w, m in own.items()}
            gain = sum(m * math.log(prob[w] / p(context[1:], w)) for w, m in own.items()) + (total - sum(own.values())) * math.log(left)
            if gain > 0.5 * (len(own) + 1) * math.log(n):
                new[context] = left, prob
        frequent = {(*context, w) for context in frequent for w, m in follow[k][context].items() if m >= context_min and w != b"\n"}
        states.update(new)
    return c, states, p


@pytest.mark.parametrize("depth, rows", [(3, 1 << 20), (2, 60)])
def test_scores_match_a_plain_tree(spark, monkeypatch, depth, rows):
    monkeypatch.setattr(lm, "SLICE", rows)
    monkeypatch.setattr(lm, "HEAD", 12 if rows < 100 else 1 << 20)
    rng = np.random.default_rng(18)
    words = [f"w{k}" for k in range(12)]
    rules = {tuple(rng.choice(words, n)): str(rng.choice(words)) for n in (1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3) for _ in range(8)}
    texts = {}
    for i in range(800):
        ws = [str(rng.choice(words))]
        while len(ws) < 20:
            told = [w for n in (3, 2, 1) if (w := rules.get(tuple(ws[-n:])))]
            ws.append(told[0] if told and rng.random() < 0.8 else str(rng.choice(words)) if rng.random() < 0.9 else f"rare{rng.integers(900)}")
        texts[i] = " ".join(ws)
    words_of = {i: plain_tokens(t) for i, t in texts.items()}
    train = [ws for i, ws in words_of.items() if zlib.crc32(str(i).encode()) % 10]
    c, states, p = plain_tree(train, depth, 20, 4)
    assert all(any(len(k) == d for k in states) for d in range(1, depth + 1))
    got = lm.pst_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), depth=depth, context_min=20, entry_min=4)
    for r in got.collect():
        ws = words_of[r.doc_id]
        want = sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), w)) for k, w in enumerate(ws))
        assert r.score == pytest.approx(want, rel=1e-9) and r.n_known == sum(c[w] > 0 for w in ws)
    held = lambda name: sum(r[name] for r in got.collect() if r.held_out)
    assert held("score") > held("base_score")


def test_next_symbols_sum_to_one():
    rng = np.random.default_rng(19)
    words = ["a", "b", "c", "d"]
    c, states, p = plain_tree([[*rng.choice(words, 30, p=[0.6, 0.2, 0.1, 0.1]), "x", "a", "b"] for _ in range(50)], 2, 20, 4)
    for context in [(), *states]:
        assert sum(p(context, w) for w in [*c, "unknown"]) == pytest.approx(1.0)


def test_depth_is_refused_beyond_three_words(odd):
    with pytest.raises(ValueError):
        lm.pst_score(odd, depth=4)


def test_score_cases(odd, empty):
    got = lm.pst_score(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (0, 1, 2, 10))
    assert all(r.held_out for r in got if r.doc_id is None)
    assert lm.pst_score(empty).count() == 0


# ---- BPE


def test_bpe_equals_the_library(odd, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib = Tokenizer.from_file(path)
    strange = ["Héllo   wörld!! <|endoftext|> don't 12345 ERHE中😀 \x1c a\x85b ΑΣ ΣΑΣ İstanbul  x é ﬁ ½ ٣ <|ENDOFTEXT|>", "'", "'S 'RE it's we'll", "a" * 99, "\0abc", "\1x", "<|startoftext|><|endoftext|>", " x　y"]
    mine = bpe.TrieBPE(path)
    for t, (ids, n) in zip(strange, mine.encode(strange), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{n}I", ids)) == want, t
        assert mine.decode(ids) == lib.decode(want, skip_special_tokens=False)
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 10**7).alias("doc_id"), "text"))
    rows = {r.doc_id: r for r in bpe.bpe_digests(both, path).collect()}
    for r in both.collect():
        e = lib.encode(r.text or "", add_special_tokens=False)
        g = rows[r.doc_id]
        assert g.n_tokens == len(e.ids) and g.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library_on_any_characters():
    mine = bpe.TrieBPE(bpe.vocabulary_path())
    rng = np.random.default_rng(6)
    pool = [*map(chr, range(0x300)), "\u0301", "日", "😀", "\u200d", "\u2028", "\ue000", *mine.special, "the", "'s"]
    draw = lambda n: "".join(pool[k] for k in rng.integers(0, len(pool), n))
    strange = ["\0\0", "\0!", "a\0!b", "é\0!", "\0", "日\0\0x", "\1<|endoftext|>"]
    strange += [chr(a) + chr(b) for a in range(0x300) for b in (0, 33, 65, 0x20, int(rng.integers(0x300)))]
    strange += [draw(3) for _ in range(5000)] + [draw(40) for _ in range(500)] + [draw(20_000)]
    for t, (ids, n) in zip(strange, mine.encode(strange), strict=True):
        want = mine.library.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{n}I", ids)) == want, t
        assert mine.decode(ids) == mine.library.decode(want, skip_special_tokens=False)


def test_bpe_round_trip(odd, empty):
    path = bpe.vocabulary_path()
    ids = bpe.bpe_encode(odd, path)
    assert bpe.bpe_decode(ids, path).count() == odd.count()
    assert bpe.bpe_encode(empty, path).count() == 0 and bpe.bpe_digests(empty, path).count() == 0


# ---- nearest neighbours


def test_recall_against_brute_force(spark, sf_dir, duck):
    got = ann.op4_additive_ann(spark, sf_dir).collect()
    want = duck.sql(ann.BRUTE_FORCE_SQL).fetchall()
    exact = {(q, v): s for q, v, s, _ in want}
    hit = [(r.query_id, r.vec_id) for r in got if (r.query_id, r.vec_id) in exact]
    assert len(hit) / len(want) >= 0.9
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in got if (r.query_id, r.vec_id) in exact)


def test_ann_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (40, []), (11, [0.5, 0.5]), (12, [0.5, 0.5]), (20, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    aq, index = ann.build_index(t)
    q = ann.valid_vectors(t, "vec_id", "embedding").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(aq, index, q, 20).orderBy("query_id", "rank").collect()]
    assert [x for x in got if x[0] == 0] == [(0, 1, 3), (0, 2, 20), (0, 3, 20), (0, 4, 11), (0, 5, 12)]
    assert ann.build_index(t.limit(0)) == (None, None)


def test_ann_distances(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    aq, index = ann.build_index(t)
    q = ann.valid_vectors(t, "vec_id", "embedding").where("vec_id = 7").withColumnRenamed("vec_id", "query_id")
    assert ann.search(aq, index, q, 3, metric="l2").count() == 3


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_blocks_that_are_left_out_hold_nothing_nearer(spark, metric):
    """With everything of a block reranked the search is exact, so any loss would come from a block left out."""
    rng = np.random.default_rng(22)
    centres = rng.normal(size=(12, 8)) * 4
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.3
    t = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int")
    coder, index = ann.build_index(t, levels=4, block_rows=40)
    q = ann.valid_vectors(t, "vec_id", "embedding").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert index.count() > 12 and coder.kind == "float64"
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(coder, index, q, 7, metric=metric).collect()}
    for i in range(0, 900, 20):
        s = x @ x[i] if metric == "ip" else np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(900), -s if metric == "ip" else s)) if j != i][:7]
        assert [got[i, k + 1][0] for k in range(7)] == order
        assert [got[i, k + 1][1] for k in range(7)] == pytest.approx(s[order], abs=1e-12)


def test_ann_measures_doubles(spark):
    t = spark.createDataFrame([(0, [1.0, 1e-10]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    coder, index = ann.build_index(t)
    q = ann.valid_vectors(t, "vec_id", "embedding").where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert ann.search(coder, index, q).first().score == 1.0000000001
    assert ann.search(coder, index, q.limit(0)).count() == 0


# ---- pages


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="no-sidebar"><header><p>Site header</p></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div id=cookie-notice><p>We use cookies on this site</p></div>%s<h1>A  title &amp; more</h1><p>First   line<br>goes on &eacute;.<p>Second <b>bold</b> paragraph with words.
<aside><p>Related</p></aside><form><input name=a><label>Mail</label></form><p>Third one is here, too.</p>%s<section class="comments"><p>Nice post really it is</p></section><footer>&copy; x</footer></body></html>"""
WANT = "A title & more\nFirst line goes on é.\nSecond bold paragraph with words.\nThird one is here, too."


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return html_text.fit_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"), sample=100)


def test_pages(weights):
    assert html_text.main_text(PAGE % ("<article>", "</article>"), weights) == WANT
    assert html_text.main_text(PAGE % ("<div>", "</div>"), weights) == WANT
    assert [html_text.main_text(x, weights) for x in (None, "", "<nav>menu</nav>", "<", "<p", "&amp;&#65;", "<p>a&nbsp; b</p>")] == ["", "", "", "<", "", "&A", "a\xa0 b"]


def test_pages_of_other_layouts(weights):
    body = " ".join(f"word{k}" for k in range(150))
    text = lambda page: html_text.main_text(page, weights)
    assert text(f'<body><div class="social-science"><p>{body}</p></div></body>') == body
    assert text(f"<body><p>{body}</p><table><tr><td>a</td><td>b</td></tr></table><ul><li>x</li><li>y z</li></ul></body>") == f"{body}\na\nb\nx\ny z"
    assert text(f"<article><p>{body}</p></article><article><p>{body} 2</p></article>") == f"{body}\n{body} 2"
    assert text(f"<article><p>a short card</p></article><div><p>{body}</p></div>").endswith(body)
    assert text(f"<div>{body}</div><div>{body}</div>") == f"{body}\n{body}"
    assert text("<p>" + "long text " * 200_000 + "</p>") == ("long text " * 200_000).strip()
    assert text("<div>" * 5000 + body) == body


def test_pages_keep_their_articles(spark, sf_dir, weights):
    """With the labels, without them, and without any name that tells what is boilerplate; the fit saw 100 of the pages."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op5_html_extraction(spark, sf_dir).collect():
        page = pages[r.page_id]
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(p for p in parts if p)
        assert r.text == want and r.n_chars == len(r.text)
        plain = re.sub(r"<(/?)article>", r"<\1div>", page)
        assert html_text.main_text(plain, weights) == want
        assert html_text.main_text(re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", plain).replace(' class="ad"', ""), weights) == want


def test_scan_finds_the_largest_sum():
    rng = np.random.default_rng(8)
    for _ in range(300):
        seq = [(-float(rng.integers(0, 4)), float(rng.integers(0, 4))) for _ in range(int(rng.integers(0, 9)))]
        total = lambda i, j: sum(w for _, w in seq[i:j]) + sum(t for t, _ in seq[i + 1 : j])
        ranges = [(i, j) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)]
        i, j = html_text.best_region(seq)
        assert (total(i, j) if i < j else 0) == max([0, *(total(*r) for r in ranges)])


def test_page_tables(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>text here</p>", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "text here", 9), (1, "", 0), (1, "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- mixing


def test_targets_are_met(spark):
    rows = [(i, " ".join("w" * 5), "en" if i % 3 else "de", "a" if i % 4 else "b", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.8, "de": 0.2, "xx": 0.5}})
    kept = got.where("kept").groupBy("source").count().collect()
    n = {r.source: r["count"] for r in kept}
    assert abs(n["a"] / sum(n.values()) - 0.5) < 0.05
    share = got.groupBy("source").agg(F.sum("probability").alias("p")).collect()
    p = {r.source: r.p for r in share}
    assert p["a"] / sum(p.values()) == pytest.approx(0.5, abs=0.01)


def test_raking_settles(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 500))) for a in range(6) for b in range(3) for c in range(4) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n long")
    got = {(r.source, r.lang, r.topic): r.w for r in mixing.rake(cells, strict=True, temper=0.5).collect()}
    w = {r[:3]: float(r[3]) for r in rows}
    total, share = sum(w.values()), []
    for m in range(3):
        n = collections.Counter()
        for r in rows:
            n[r[m]] += r[3]
        share.append({k: v**0.5 / sum(x**0.5 for x in n.values()) for k, v in n.items()})
    for _ in range(200):
        for m in range(3):
            now = collections.Counter()
            for k, x in w.items():
                now[k[m]] += x
            w = {k: x * share[m][k[m]] * total / now[k[m]] for k, x in w.items()}
    assert got == pytest.approx(w, rel=1e-8)
    apart = spark.createDataFrame([("a", "x", "t", 1), ("b", "y", "t", 1)], "source string, lang string, topic string, n long")
    with pytest.raises(RuntimeError):
        mixing.rake(apart, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}}, rounds=3, strict=True)


def test_pipeline_mixes_whole_shares(spark, sf_dir):
    """The pipeline's mixing meets op6's tempered shares and loses no tokens on the whole."""
    import corpus_pipeline as p

    n = {("a", "en"): 6000, ("a", "de"): 1500, ("b", "en"): 1000, ("b", "de"): 100}
    rows, k = [], 0
    for (source, lang), many in n.items():
        rows += [(k + i, "w " * 5, lang, source, 10) for i in range(many)]
        k += many
    rows.append((k, None, "xx", "c", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.mix_sources(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sum(r.text is None for r in kept) == 1
    held = collections.Counter((r.source, r.lang) for r in kept if r.text)
    assert abs(sum(held.values()) - 8600) < 250
    for m, parts in ((0, ("a", "b")), (1, ("en", "de"))):
        own = {c: sum(v for x, v in n.items() if x[m] == c) ** 0.8 for c in parts}
        now = {c: sum(v for x, v in held.items() if x[m] == c) for c in parts}
        for c in parts:
            assert abs(now[c] / sum(now.values()) - own[c] / sum(own.values())) < 0.015
    times = collections.Counter(r.doc_id for r in kept if (r.source, r.lang) == ("b", "de"))
    assert len(times) == 100 and max(times.values()) - min(times.values()) <= 1
    assert {tuple(r) for r in kept} <= set(rows)


def test_mixing_cases(odd, empty):
    assert mixing.resample_mix(empty).count() == 0 and mixing.resample_mix(odd).columns == odd.columns
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("lang = '(none)'").count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.sample_mix(empty).count() == 0
    assert mixing.sample_mix(odd).columns == odd.columns


# ---- toxicity


def test_held_out_toxicity():
    rng = np.random.default_rng(4)
    bad, good = [f"vile{k}" for k in "abcdefgh"], [f"good{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]

    def text(toxic):
        return " ".join(rng.permutation([*rng.choice(good, 60), *(rng.choice(bad, rng.integers(1, 8)) if toxic else [])]))

    y = np.array([i % 4 == 0 for i in range(1200)], int)
    rows = [text(t) for t in y]
    m = toxicity.fit([toxicity.slots(r) for r in rows[:800]], y[:800])
    assert (np.diff(m.thresholds) >= 0).all()
    p = m.at_least(np.array([m.margin(r) for r in rows[800:]]))
    called = toxicity.graded(p) > 0
    assert called[y[800:] == 1].mean() > 0.95 and called[y[800:] == 0].mean() < 0.02
    assert (np.diff(p, axis=1) <= 0).all()


def test_likelihood_and_gradients_match_the_plain_definition():
    rng = np.random.default_rng(9)
    m, t, y = rng.normal(0, 2, 50), np.array([-1.0, 0.5, 2.0]), rng.integers(0, 4, 50)

    def plain(m, t):
        at_least = lambda k, x: 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + math.exp(t[k - 1] - x))
        return -sum(math.log(at_least(k, x) - at_least(k + 1, x)) for x, k in zip(m, y, strict=True)) / len(m)

    value, by_m, by_t = toxicity.loss(m, t, y)
    assert value == pytest.approx(plain(m, t))
    step = lambda n, k: 1e-6 * np.eye(n)[k]
    assert by_m == pytest.approx([(plain(m + step(50, k), t) - plain(m - step(50, k), t)) / 2e-6 for k in range(50)], abs=1e-6)
    assert by_t == pytest.approx([(plain(m, t + step(3, k)) - plain(m, t - step(3, k))) / 2e-6 for k in range(3)], abs=1e-6)


def test_grades_of_probabilities():
    p = np.array([[0.05, 0.01, 0.0], [toxicity.CUT, 0.1, 0.0], [0.9, 0.5, 0.1], [0.9, 0.8, 0.7], [0.04, 0.03, 0.02]])
    assert toxicity.graded(p).tolist() == [0, 1, 2, 3, 0]


def test_toxicity_cases(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit_labels(odd, labels)
    clash = odd.drop("toxic").withColumns({"Toxic": F.lit("y"), "_severity": F.lit(1), "_toxic": F.lit(2)})
    got = toxicity.score(clash, model)
    assert got.columns == [c for c in clash.columns if c.lower() not in ("grade", "toxic")] + ["expected_severity", "grade", "toxic"] and got.count() == odd.count()
    assert all(r.toxic == (r.grade > 0) and 0 <= r.expected_severity <= 3 for r in got.collect())
    assert toxicity.drop_toxic(clash, labels.limit(0)).exceptAll(clash).isEmpty() and toxicity.drop_toxic(clash, labels.limit(0)).count() == odd.count()
    assert toxicity.drop_toxic(empty, labels).count() == 0 and toxicity.drop_toxic(clash, labels).columns == clash.columns
    long = spark.createDataFrame([(1, "vile " + "word " * 300_000)], "doc_id long, text string")
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[toxicity.slot("vile")] = 9
    assert toxicity.score(long, toxicity.Ordinal(weights, np.array([1.0, 2.0, 30.0]))).first().grade == 2


# ---- licences


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful
 */
int main() { return 0; }
"""


def test_licenses(spark, empty):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", mit), ("a/b/x.txt", "nothing here"), ("a/b/c/y.txt", "intro text.\nLicensed under the Apache License, Version 2.0.\nmore"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("z/q.txt", None), ("a/top.txt", "plain"), (None, mit), ("a/b/c/d/e.txt", "the of and license to kill")]
    rows += [("h/main.c", GPL_HEADER), ("h/spdx.py", "# SPDX-License-Identifier: Apache-2.0\nimport os"), ("h/other.py", "# SPDX-License-Identifier: Foo-1.0"), ("k/LICENSE", "                 GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software"), ("k/a", "x"), ("m/LICENSE.md", "MIT License\n\nCopyright (c) someone\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files"), ("m/b/c", "y")]
    rows += [("n/bsd.c", "// Redistribution and use in source and binary forms,\n// with or without modification, are permitted\n// provided that the following conditions\n// are met:\n"), ("n/two.c", "This program is licensed under the GNU General Public License, version 2."), ("n/long.txt", "word " * 200_000 + "\n" + mit + "\n" + "word " * 1000)]
    files = spark.createDataFrame([(*r, "old", 1.0, "r") for r in rows], "path string, text string, license string, similarity double, _row string")
    out = licenses.scan(files)
    assert out.columns == ["_row", "path", "license", "similarity", "found", "license_dir"] and {r._row for r in out.collect()} == {"r"}
    got = {r.path: (r.license, r.found, r.license_dir) for r in out.collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.txt": ("GPL-3.0", "inherited", "a/b"), "a/b/c/y.txt": ("Apache-2.0", "own", None), "a/b/COPYING": ("GPL-3.0", "own", None), "z/q.txt": (None, None, None), "a/top.txt": ("MIT", "inherited", "a"), "": ("MIT", "own", None), "a/b/c/d/e.txt": ("GPL-3.0", "inherited", "a/b"),
        "h/main.c": ("GPL-3.0", "own", None), "h/spdx.py": ("Apache-2.0", "own", None), "h/other.py": (None, None, None), "k/LICENSE": ("GPL-3.0", "own", None), "k/a": ("GPL-3.0", "inherited", "k"), "m/LICENSE.md": ("MIT", "own", None), "m/b/c": ("MIT", "inherited", "m"),
        "n/bsd.c": ("BSD-3-Clause", "own", None), "n/two.c": ("GPL-2.0", "own", None), "n/long.txt": ("MIT", "own", None),
    }
    assert licenses.scan(empty.withColumn("path", F.col("source"))).count() == 0


def test_inheritance_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["Released under the MIT License.", "Released under the ISC License.", "nothing", None]
    rows = [("/".join(["r", *rng.choice(list("ab"), rng.integers(0, 6)), f"f{k}"]), texts[int(rng.choice(4, p=[0.1, 0.1, 0.7, 0.1]))]) for k in range(400)]
    own = {p: {"Released under the MIT License.": "MIT", "Released under the ISC License.": "ISC"}.get(t) for p, t in rows}
    given = {}
    for p in sorted(p for p in own if own[p]):
        given.setdefault(p.rpartition("/")[0], own[p])

    def licence(p):
        d = p
        while own[p] is None and d:
            d = d.rpartition("/")[0]
            if d in given:
                return given[d]
        return own[p]

    got = licenses.scan(spark.createDataFrame(rows, "path string, text string"), speaks=F.lit(True)).collect()
    assert {r.path: r.license for r in got} == {p: licence(p) for p in own}


def plain_units(text):
    paragraphs = [re.sub(licenses.BREAK, " ", p) for p in re.split(licenses.PARAGRAPH, text)]
    return {*re.split(licenses.SENTENCE, text), *(s for p in paragraphs for s in re.split(licenses.STOP, p)), *paragraphs, " ".join(paragraphs)}


def test_cosines_match_brute_force(spark, docs, texts):
    n, df = len(texts), collections.Counter()
    vocabulary = {t for _, _, s in licenses.TEMPLATES for t in licenses._terms(s)}
    for t in texts.values():
        df.update(vocabulary & set(licenses._terms(t or "")))
    st = licenses.Statements(df, n, 0.7)
    templates = collections.defaultdict(dict)
    for k, name, t, x, _ in st.rows:
        templates[k, name][t] = x
    want = {}
    for i, text in texts.items():
        best = None
        for s in plain_units(text or ""):
            tf = collections.Counter(licenses._terms(s))
            v = {t: c * st.idf.get(t, st.unseen) for t, c in tf.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for (k, name), w in templates.items():
                cos = round(sum(v.get(t, 0) * x for t, x in w.items()) / norm, 6) if norm else 0
                if cos >= 0.7 and set(licenses._terms(licenses.TEMPLATES[k][1])) <= v.keys():
                    best = min(best or (-cos, name), (-cos, name))
        want[i] = best and best[1]
    files = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    got = {r.doc_id: r.license for r in licenses.scan(files).collect()}
    assert got == want and any(want.values())


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


STRANGE = [
    None, "", "a@b.c%x@d.e a@b..c a@b.c. x@y-.z.w1. ..@a.b 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 a@b@c.d",
    "4111 1111 1111 1111 1 2 3 4111-1111-1111-1111-- 4111  111111111111 +1 (988) 555-2485 +12+3456789012 ++1 23456789- +1-2",
    "é😀 4111111111111111 x1.2.3.4 a@b.co  c@d.ef", "9 " * 20000, "1." * 30000, "a." * 20000 + "@b.c", "12345678901234567890 " * 50, "x@" + "a." * 3000 + "b", "+1 " + "2 " * 5000,
]


def test_spans_match_plain_patterns(spark, docs):
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {r.doc_id: r for r in pii.find(both).collect()}
    for r in both.collect():
        want, g = plain_spans(r.text), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(g.spans.split(",")) if want else True
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_patterns_find_unseen_identifiers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"some text mailbox: u{i}{rng.integers(1000)}@mail.example.org and more words") for i in range(60)]
    rows += [(100, "he said mailbox: hidden4711@localhost and went"), (101, "in 1999 there were 123456 birds")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "id:17:37" and got[100].n_email == 0 and got[101].spans == ""


def test_secrets_lead_to_unseen_ones(spark):
    rng = np.random.default_rng(16)
    code = lambda n, of: "".join(rng.choice(list(of), n - 1)) + "7"
    rows = [(i, f"word {i % 7} some password={code(20, '0123456789abcdef')} and more") for i in range(40)]
    rows += [(50, f"then ABCD{code(16, 'ABCDEFGHIJ0123456789')} came"), (51, 'the token: "abc123def456" is'), (52, "in 1999 there were 22.5 of 31 birds, 7th"), (53, "password= none at all")]
    got = {r.doc_id: (r.spans, r.n_id, r.n_spans) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = len("word 0 some password=")
    assert got[0] == (f"id:{start}:{start + 20}", 1, 1) and got[50] == ("id:5:25", 1, 1) and got[51] == ("id:12:24", 1, 1) and got[52] == got[53] == ("", 0, 0)


def test_pattern_scores_match_brute_force(spark):
    rng = np.random.default_rng(17)
    values = [f"v{k}" if k % 5 else f"value{k:04d}" for k in range(120)]
    seeds = {v for v in values if len(v) > 6 and rng.random() < 0.5}
    rows = [(v, v in seeds, [f"p{rng.integers(6) + 6 * (len(v) < 6)}" for _ in range(rng.integers(0, 3))]) for v in values for _ in range(2)]
    # a value is a seed if any of its places is
    rows.append(("value0000", True, ["p1"]))
    seeds.add("value0000")
    patterns = collections.defaultdict(set)
    for v, _, ps in rows:
        patterns[v] |= set(ps)
    score = {v: float(v in seeds) for v in patterns}
    for _ in range(3):
        conf = {}
        for p in {p for ps in patterns.values() for p in ps}:
            inside = [v for v in patterns if p in patterns[v]]
            pos = sum(score[v] for v in inside)
            neg = sum(1.0 if len(v) < 6 and v not in seeds else 0.05 * (1 - score[v]) for v in inside)
            conf[p] = pos / (pos + neg + 1)
        for v in patterns:
            miss = math.prod([1 - conf[p] for p in patterns[v] if conf[p] >= 0.8])
            score[v] = 1.0 if v in seeds else 0.0 if len(v) < 6 else 1 - miss
    want = {v: x for v, x in score.items() if x >= 0.8 and v not in seeds}
    got = pii.bootstrap(spark.createDataFrame(rows, "value string, seed boolean, patterns array<string>")).collect()
    assert want and {r.value: r.score for r in got} == pytest.approx(want)


def test_pii_cases(odd, empty):
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    left = docs
    for name, stage in p.STAGES[:-1]:
        before, left = left, stage(spark, left, sf_dir)
        assert left.columns == docs.columns
        assert {tuple(r) for r in left.collect()} <= {tuple(r) for r in before.collect()}, name
        if name == "exact dedup":
            n = exact_dedup.exact_dedup(before).where("kept").count()
            assert left.count() == n
    assert p.STAGES[-1][1](spark, left, sf_dir).count() == left.count() == p.run(spark, sf_dir).count()


def test_pipeline_on_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline as p

    left = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        left = stage(spark, left, sf_dir)
    left.count()
