"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie over byte symbols (the last byte of a word carries the end-of-word mark).
A depth-first walk gives each node the last token of its prefix's encoding: among the tokens that end there, the one
that follows the last token at its own start without a merge across the joint. Siblings share all states above them,
so the encoding of a shared prefix is computed once; a word's tokens are read back along the last tokens. The trie is
held as the sorted list of words, where the depth-first walk is one pass with a stack cut back to the common prefix.

Encoding follows the tokenizers library for a file with NFC, white-space replacement and lower-casing as normalizer,
a removing Split and ByteLevel as pre-tokenizers, an end-of-word suffix and no decoder; other files are refused.

Defined results: null is the empty text, with no ids and the empty string as decoded text; whole texts of any length
are encoded; strings of special tokens are special tokens; rows are independent, so ties and repeats change nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare

#: Fixed value: the split pattern of the supported files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS_KEPT = 250_000
JOINS_KEPT = 300_000
TOGETHER = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [chr(b) for b in range(256)], 0
    for b in range(256):
        if b not in own:
            out[b], n = chr(256 + n), n + 1
    return out


class TrieBPE:
    """One tokenizer file; words are encoded through the trie and kept up to ``WORDS_KEPT``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"].get("Regex") != SPLIT or spec["decoder"]:
            raise ValueError(f"{path}: not a BPE file of the supported form")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.library = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbols)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the library's \s in full, so that control characters that only Python counts as white space stay
        self.ascii = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")
        self.latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+")
        self.plain = regex.compile("[\x00-ɏ]*")
        self.known: dict[str | tuple[str], bytes] = {}
        #: vocabulary entries: their ids if their own symbols encode to them, else -2; -1 until that has been asked
        self.whole: dict[str, int] = dict.fromkeys(self.vocab, -1)
        self.joins: dict[int, bool] = {}

    # -- words

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, after normalizing, before the byte alphabet."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        if self.plain.fullmatch(normal):
            return self.latin.findall(normal)
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def spelled(self, word: str) -> str:
        """A word in the byte alphabet, one character a byte."""
        return word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])

    def merge(self, units: list[str]) -> list[str]:
        """The plain definition: merge the first pair of lowest rank until none is left."""
        units = list(units)
        while len(units) > 1:
            r, i = min((self.ranks.get((units[i], units[i + 1]), 1 << 60), i) for i in range(len(units) - 1))
            if r == 1 << 60:
                break
            units[i : i + 2] = [units[i] + units[i + 1]]
        return units

    def _parts(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            head = token[: -len(self.suffix)]
            return [*head[:-1], head[-1] + self.suffix] if head else list(token)
        return list(token)

    def stands(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: their symbols together encode to just these two."""
        if len(self.joins) > JOINS_KEPT:
            self.joins.clear()
        pair = [self.token[a], self.token[b]]
        got = self.joins[a << 20 | b] = self.merge(self._parts(pair[0]) + self._parts(pair[1])) == pair
        return got

    def _last(self, prefix: str, end: int, suffix: str, tokens: list[int]) -> tuple[int, int]:
        """The last token of ``prefix[:end]`` and where it starts; ``tokens`` has the last tokens of shorter prefixes."""
        whole, joins = self.whole, self.joins
        for start in range(max(0, end - self.longest), end):
            t = whole.get(prefix[start:end] + suffix)
            if t is None:
                continue
            if t < 0:
                if t == -1:  # not asked yet whether its own symbols encode to it
                    s = prefix[start:end] + suffix
                    t = whole[s] = self.vocab[s] if self.merge(self._parts(s)) == [s] else -2
                if t < 0:
                    continue
            if not start:
                return t, 0
            before = tokens[start - 1]
            fits = joins.get(before << 20 | t)
            if fits or fits is None and self.stands(before, t):
                return t, start
        raise ValueError(f"no encoding of {prefix[:end]!r}")

    # -- the trie

    def learn(self, words: set[str]) -> None:
        """Encode new words by one depth-first walk over their trie."""
        path, tokens, starts = "", [], []  # the prefix walked to; last token of each prefix, and where it starts
        suffix, pack = self.suffix, struct.pack
        for spelled, word in sorted([(self.spelled(w), w) for w in words]):
            n = len(spelled) - 1  # the end symbol differs from the same byte inside a word: it is a leaf of its own
            same, top = 0, min(len(path), n)
            while same < top and path[same] == spelled[same]:
                same += 1
            del tokens[same:], starts[same:]
            for end in range(same + 1, n + 1):
                t, start = self._last(spelled, end, "", tokens)
                tokens.append(t)
                starts.append(start)
            path = spelled[:n]
            t, at = self._last(spelled, n + 1, suffix, tokens)
            out = [t]
            while at:
                out.append(tokens[at - 1])
                at = starts[at - 1]
            out.reverse()
            self.known[word] = pack(f"<{len(out)}I", *out)

    # -- texts

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Ids of each text as little-endian 32-bit integers, and their number. Texts are walked together up to ``TOGETHER`` characters."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= TOGETHER:
                out += map(b"".join, self._encoded(part))
                part, size = [], 0
        out += map(b"".join, self._encoded(part))
        return [(ids, len(ids) // 4) for ids in out]

    def _encoded(self, texts):
        split = []
        for text in texts:
            segments = self.cut.split(text or "") if self.cut else [text or ""]
            words: list[str | tuple[str]] = []  # a special token is a tuple, so that no word is taken for one
            for k, s in enumerate(segments):
                if k % 2:
                    words.append((s,))
                elif s:
                    words += self.pieces(s)
            split.append(words)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = set().union(*split) - self.known.keys()
        for w in [w for w in fresh if isinstance(w, tuple)]:
            self.known[w] = struct.pack("<I", self.special[w[0]])
            fresh.discard(w)
        if fresh:
            self.learn(fresh)
        return ([*map(self.known.__getitem__, words)] for words in split)

    def decode(self, ids: bytes) -> str:
        """As the library decodes without a decoder and with special tokens: token strings joined by spaces."""
        return " ".join(map(self.token.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(2)
def tokenizer(path: str) -> TrieBPE:
    return TrieBPE(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array<int>)."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            got = bpe.encode(b.column(1).to_pylist())
            ids = [list(struct.unpack(f"<{n}I", x)) for x, n in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in got], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of arrays of ids (null: none)."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(struct.pack(f"<{len(x or [])}I", *(x or []))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids, in one pass over the texts."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            out = []
            for ids, n in bpe.encode(b.column(1).to_pylist()):
                out.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, ids, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_bpe(spark, sf_dir, path: str | None = None):
    return bpe_digests(documents(spark, sf_dir), path or vocabulary_path())
