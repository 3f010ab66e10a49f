"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

Leaf i of a word's tree holds the rank of the pair that starts at symbol i, with i in the low bits, so the root is the
leftmost lowest-rank merge. A merge changes three leaves at most; each is carried towards the root until a node keeps
its value, in as many steps as the tree is high at most. It ends when the root holds no pair that can merge. Short words
of a size class step together in arrays, each in its own tree; wide ones go alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import Memory, hold_alone, load, short_batches, text_or_empty
from crawlmill.llm.encoding import byte_letters, segments, word_bpe_path

#: Fixed by the vocabulary: what of a normalised text is a word.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that a worker remembers of words, and of chunks between blanks; characters that learn together.
WORD_BYTES, CHUNK_BYTES, TOGETHER = 64 << 20, 112 << 20, 1 << 21
#: Words that step together, and the symbols that the widest of them have.
ROWS, WIDE = 1 << 14, 64
#: Texts with characters from here on are cut by the library's own pattern, whose version of Unicode differs.
_OLD = "\u0220"
_PLACE = 32  # bits of a leaf that hold the symbol's place
_NONE = 1 << 62


class PairRanks:
    """Merge ranks of symbol pairs, and the segment tree that applies them."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocabulary.values()) + 1
        self.leaves = {vocabulary[a] * self.size + vocabulary[b]: rank << _PLACE for rank, (a, b) in enumerate(pairs)}
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.keys = np.array(sorted(self.leaves), np.int64)
        self.values = np.array([self.leaves[k] for k in self.keys.tolist()], np.int64)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols of a word, merged until no pair can."""
        n, size, leaf = len(symbols), self.size, self.leaves.get
        width = 1 << max(1, (n - 1).bit_length())
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(symbols[i] * size + symbols[i + 1], _NONE) | i
        for i in range(width - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        sym, before, after = symbols[:], list(range(-1, n - 1)), list(range(1, n + 1))

        def put(place: int, value: int) -> None:
            i = width + place
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                if value > other:
                    value = other
                if tree[i] == value:
                    return
                tree[i] = value

        while (root := tree[1]) < _NONE:
            at = root & ((1 << _PLACE) - 1)
            gone = after[at]
            sym[at] = int(self.made[root >> _PLACE])
            sym[gone] = -1
            far = after[at] = after[gone]
            put(gone, _NONE)
            if far < n:
                before[far] = at
                put(at, leaf(sym[at] * size + sym[far], _NONE) | at)
            else:
                put(at, _NONE)
            near = before[at]
            if near >= 0:
                put(near, leaf(sym[near] * size + sym[at], _NONE) | near)
        return [s for s in sym if s >= 0]

    def merge_all(self, words: list[list[int]]) -> list[bytes]:
        """Each word's merged symbols as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = array("I", self.merge(w)).tobytes()
            else:
                classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, rows in classes.items():
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                for r, ids in zip(part, self._step([words[r] for r in part], 1 << bits)):
                    out[r] = ids
        return out

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; a right symbol below zero is the end of the word."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at] | place, _NONE)

    def _step(self, words: list[list[int]], width: int) -> list[bytes]:
        """Words of `width` symbols at most, all at once: a row of arrays each."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        # place `width` stands for "no symbol" on either side
        sym = np.full((n, width + 1), -1, np.int32)
        sym[np.arange(width + 1) < sizes[:, None]] = np.fromiter((s for w in words for s in w), np.int32, int(sizes.sum()))
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        after[after >= sizes[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = self._leaf(sym[:, :width], sym[:, 1:], np.broadcast_to(np.arange(width), (n, width)))
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            left = root & ((1 << _PLACE) - 1)
            right = after[live, left]
            far, near = after[live, right], before[live, left]
            sym[live, left] = self.made[root >> _PLACE]
            sym[live, right] = -1
            after[live, left] = far
            before[live, far] = left
            tree[live, width + right] = _NONE
            tree[live, width + left] = self._leaf(sym[live, left], np.where(far < width, sym[live, far], -1), left)
            has = near < width
            rows, at = live[has], near[has]
            tree[rows, width + at] = self._leaf(sym[rows, at], sym[rows, left[has]], at)
            for rows, at in ((live, width + right), (live, width + left), (rows, width + at)):
                while len(at) and at[0] > 1:
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            live = live[tree[live, 1] < _NONE]
        kept = sym >= 0
        raw, ends = sym[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class WordBpe:
    """The codec of a tokenizer file whose words are lower-case and end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = dict(spec["model"]["vocab"])
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.ranks = PairRanks(vocabulary, spec["model"]["merges"])
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + suffix] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in added.items()}
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")")
        self.added = added
        library = Tokenizer.from_file(path)
        self.normalise, self.library_cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(WORD).findall
        self.words, self.chunks = Memory(self._unlearned, WORD_BYTES), Memory(self._unlearned, CHUNK_BYTES)

    @staticmethod
    def _unlearned(key: str) -> bytes:
        raise KeyError(key)

    def _symbols(self, word: str) -> list[int]:
        """Of a word, given as one character per byte."""
        raw = word.encode("latin-1")
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def _cut(self, text: str) -> list[str]:
        """The words of a text without special tokens, one character per byte."""
        if text.isascii():
            return self.split(text.lower())
        text = self.normalise(text)
        if max(text, default="") < _OLD:
            return [w.encode("utf-8").decode("latin-1") for w in self.split(text)]
        return ["".join([chr(self.byte_of[c]) for c in w]) for w, _ in self.library_cut(text)]

    def _words(self, chunk: str) -> list[str | int]:
        """Words, and ids of special tokens, of what stands between two blanks."""
        if "<|" in chunk and self.special.search(chunk):
            return [w for i, p in enumerate(self.special.split(chunk)) for w in ([self.added[p]] if i % 2 else self._cut(p))]
        return self._cut(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks not remembered; the words that are new among them go through their trees together."""
        self.words.turn()
        self.chunks.turn()
        cut = {c: self._words(c) for c in self.chunks.unknown(chunks)}
        new = self.words.unknown({w for ws in cut.values() for w in ws if isinstance(w, str)})
        for w, ids in zip(new, self.ranks.merge_all([self._symbols(w) for w in new])):
            self.words.keep(w, ids)
        for c, ws in cut.items():
            self.chunks.keep(c, b"".join([self.words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in ws]))

    def decode(self, ids: bytes) -> str:
        """Without a decoder in its file, a tokenizer joins the tokens' strings with blanks."""
        return " ".join(map(self.strings.__getitem__, array("I", ids)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        parts, at = [(own, s) for own, t in zip(out, texts) for s in segments(t)], 0
        while at < len(parts):
            cut, size = [], 0
            while at + len(cut) < len(parts) and (not cut or size + len(parts[at + len(cut)][1]) <= TOGETHER):
                size += len(parts[at + len(cut)][1])
                cut.append(parts[at + len(cut)][1].split(" "))
            self._learn(set().union(*cut))
            for (own, _), chunks in zip(parts[at:], cut):
                own.append(b"".join(map(self.chunks.__getitem__, chunks)))
            at += len(cut)
        return [b"".join(x) for x in out]


_codecs: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The worker's codec for a tokenizer file, until another stage takes the worker."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    hold_alone(_codecs, _codecs.clear)
    return _codecs[path]


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded: each whole text encoded, and its ids decoded.

    Null texts are empty; repeated rows and null doc_ids each give a row; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    path = tokenizer or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = codec(path)
            ids = own.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, hashed where it is encoded."""
    short_batches(docs.sparkSession)
    path = tokenizer or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rows = codec(path), []
            for doc_id, ids in zip(b.column(0).to_pylist(), own.encode(b.column(1).to_pylist())):
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
