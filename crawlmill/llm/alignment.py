"""Alignment of the tokens of two tokenizers by sparse products.

A text's tokens of either tokenizer are rows of a token-byte incidence matrix. Gustavson's product of A's and the transpose
of B's gives the overlap links, whose values are the bytes shared. Where no link crosses, both tokenizers end a token:
groups are cut there. The product of the token-group matrices gives the links of tokens that share a group.

Neither tokenizer merges across the cuts of `Aligner.pieces`, so the alignment of a text is that of its pieces in order; a
worker aligns the pieces that it does not remember together, as one matrix whose blocks are the pieces.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import broadcast_model, commonest, hold_alone, load, short_batches, text_or_empty, written
from crawlmill.llm.encoding import PieceEncoder, byte_bpe_path, piece_bpe_path, segments

#: Bytes of pieces and alignments that a worker remembers, about.
STORE_BYTES = 128 << 20
#: What a piece costs besides its text, its groups' text and 8 bytes a link.
PIECE_BYTES = 300
#: Id pairs whose counts all workers hold, the commonest; links of other pairs meet their counts by a join.
TOP_PAIRS = 1 << 20
#: Id pairs that a task counts before it sends them.
COUNTED = 1 << 21


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has the columns indices[indptr[i] : indptr[i + 1]], with values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int


def incidence(sizes: np.ndarray) -> Csr:
    """Rows that hold the next sizes[i] columns each."""
    indptr = np.append(0, np.cumsum(sizes))
    return Csr(indptr, np.arange(indptr[-1]), np.ones(int(indptr[-1]), np.int64), int(indptr[-1]))


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    return Csr(np.append(0, np.cumsum(np.bincount(m.indices, minlength=m.columns))), rows[order], m.values[order], len(m.indptr) - 1)


def gustavson(a: Csr, b: Csr) -> Csr:
    """a times b, row by row: the rows of b that a row of a names, scaled and summed."""
    sizes = np.diff(b.indptr)[a.indices]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(b.indptr[a.indices] - (ends - sizes), sizes)
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), sizes)
    key, value = row * b.columns + b.indices[at], np.repeat(a.values, sizes) * b.values[at]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.zeros(0, np.int64)
    value = np.add.reduceat(value, first) if total else value
    row, column = np.divmod(key[first], max(b.columns, 1))
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=len(a.indptr) - 1))), column, value, b.columns)


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Csr:
    """A tokens by B tokens, from their sizes in bytes: the bytes that they share."""
    return gustavson(incidence(a_sizes), transposed(incidence(b_sizes)))


def groups_of(overlap: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: a group ends where no link crosses. Each token has a link."""
    first, last = overlap.indices[overlap.indptr[:-1]], overlap.indices[overlap.indptr[1:] - 1]
    of_a = np.append(0, np.cumsum(first[1:] > last[:-1])) if len(first) else np.zeros(0, np.int64)
    of_b = np.zeros(overlap.columns, np.int64)
    of_b[overlap.indices] = np.repeat(of_a, np.diff(overlap.indptr))
    return of_a, of_b


def group_links(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, links) of each id pair that shares a group, by group: how many tokens of the one meet how many of the other.

    Rows of the incidence matrices are the ids that occur in a group, values how often they do, so a group of many equal
    tokens does not give their square.
    """
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    ids, groups = [], []
    for x, of in ((a, of_a), (b, of_b)):
        width = int(x.max(initial=0)) + 1
        row, times = np.unique(of * width + x, return_counts=True)
        ids.append(row % width)
        groups.append(Csr(np.arange(len(row) + 1), row // width, times, n))
    links = gustavson(groups[0], transposed(groups[1]))
    row = np.repeat(np.arange(len(ids[0])), np.diff(links.indptr))
    return groups[0].indices[row], ids[0][row], ids[1][links.indices], links.values


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i] ... start[i] + size[i] - 1, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Aligner:
    """Alignments of pieces of texts, remembered within a number of bytes."""

    def __init__(self, a_path: str, b_path: str, most_bytes: int = STORE_BYTES):
        import sentencepiece

        self.a = PieceEncoder(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.most = most_bytes
        byte_of = {c: b for b, c in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for spelt, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, spelt)) if all(c in byte_of for c in spelt) else spelt.encode()
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_vocabulary = n
        # pieces of the second vocabulary that a cut of the first would part
        if any(re.search("[^▁]▁|\n", p) for p in plain):
            raise ValueError("a piece of the second tokenizer holds a line feed, or a blank after another character")
        odd = {p[i - 1] for p in plain for i in range(1, len(p)) if p[i] in ".," and (p[i - 1].isalnum())}
        self.unsafe = re.compile("[" + re.escape("".join(sorted(odd))) + "]") if odd else None
        self.lead = self.b.encode("\n")  # of a text that begins with a line feed: the blank that the tokenizer adds, and the feed
        numbers = [str(i).encode() for i in range(max(len(self.a_bytes), n))]
        self.spelt = [x + sep for sep in (b",", b"|", b";") for x in numbers]
        self.numbers = len(numbers)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.used = 0
        self.right = np.zeros(0, bool)
        self.sums = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, distinct links of a group
        self.link_at = np.zeros(0, np.int64)
        self.codes = self.times = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Where neither tokenizer's tokens can cross; text begins with the blank that both see before it."""
        out = []
        for s in segments(text):
            out += _CUT.split(s) if self.unsafe and self.unsafe.search(s) else self.a._cut(s)
        return out

    def _encode_b(self, new: list[str]) -> list[list[int]]:
        # the tokenizer adds a blank before a text; where the piece has none, a line feed is put first
        bare = [p[:1] != " " or p == " " for p in new]
        out = self.b.encode(["\n" + p if x else p[1:] for p, x in zip(new, bare)], num_threads=1)
        return [ids[len(self.lead) :] if x else ids for ids, x in zip(out, bare)]

    def _given_back(self, new: list[str], a_ids: list[bytes], b_ids: list[list[int]]) -> np.ndarray:
        """Whether the tokens of a piece, joined, are the piece, of either tokenizer."""
        raw = [p.encode() for p in new]
        a, b = array("I", b"".join(a_ids)), list(chain.from_iterable(b_ids))
        sizes = np.array(list(map(len, raw)), np.int64)
        of = np.arange(len(new))
        for token_sizes, ids, n in ((self.a_size, a, [len(x) // 4 for x in a_ids]), (self.b_size, b, list(map(len, b_ids)))):
            if not np.array_equal(_sum(np.repeat(of, n), token_sizes[np.array(ids, np.int64)], len(new)), sizes):
                break
        else:
            joined = b"".join(raw)
            if joined == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)):
                return np.ones(len(new), bool)
        return np.array([p == b"".join(map(self.b_bytes.__getitem__, y)) == b"".join(map(self.a_bytes.__getitem__, array("I", x))) for p, x, y in zip(raw, a_ids, b_ids)])

    def learn(self, new: list[str]) -> None:
        """Align pieces and remember them."""
        if not new:
            return
        a_ids = [self.a._piece(p) for p in new]
        b_ids = self._encode_b(new)
        right = self._given_back(new, a_ids, b_ids)
        if not right.all():
            a_ids = [x if r else b"" for x, r in zip(a_ids, right)]
            b_ids = [x if r else [] for x, r in zip(b_ids, right)]
        a_n, b_n = np.array(list(map(len, a_ids)), np.int64) // 4, np.array(list(map(len, b_ids)), np.int64)
        a, b = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_n.sum()))
        of_a, of_b = groups_of(overlap_links(self.a_size[a], self.b_size[b]))
        group, left, right_ids, times = group_links(a, of_a, b, of_b)
        codes = left * self.b_vocabulary + right_ids
        groups_before = np.append(of_a, of_a[-1] + 1 if len(of_a) else 0)[np.append(0, np.cumsum(a_n))]
        link_at = np.searchsorted(group, groups_before)
        links_before = np.append(0, np.cumsum(times))[link_at]
        # each group's A tokens, then its B tokens
        n_groups = int(of_a[-1]) + 1 if len(of_a) else 0
        a_before, b_before = (np.append(0, np.cumsum(np.bincount(g, minlength=n_groups))) for g in (of_a, of_b))
        written_as = np.empty(len(a) + len(b), np.int64)
        written_as[np.arange(len(a)) + b_before[of_a]] = a + self.numbers * np.append(of_a[1:] != of_a[:-1], True)[: len(a)]
        written_as[np.arange(len(b)) + a_before[of_b + 1]] = b + 2 * self.numbers * np.append(of_b[1:] != of_b[:-1], True)[: len(b)]
        words = list(map(self.spelt.__getitem__, written_as.tolist()))
        ends = np.append(0, np.cumsum(a_n + b_n)).tolist()
        text = [b"".join(words[x:y]) for x, y in zip(ends, ends[1:])]
        base = len(self.text)
        self.index.update(zip(new, range(base, base + len(new))))
        self.text += text
        self.used += sum(map(len, new)) + sum(map(len, text)) + PIECE_BYTES * len(new) + 16 * len(codes)
        self.right = np.append(self.right, right)
        self.sums = np.vstack([self.sums, np.stack([a_n, b_n, np.diff(groups_before), np.diff(links_before), np.diff(link_at)], axis=1)])
        self.link_at = np.append(self.link_at, link_at[:-1] + len(self.codes))
        self.codes, self.times = np.append(self.codes, codes), np.append(self.times, times)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))

    def _compact(self) -> None:
        """Forget the pieces that were used once since the last time, or all if that leaves too many."""
        keep = np.flatnonzero(self.uses > 1)
        names = list(self.index)
        kept = [names[i] for i in keep.tolist()]
        text, right, sums, link_at, codes = [self.text[i] for i in keep.tolist()], self.right[keep], self.sums[keep], self.link_at[keep], self.codes
        times = self.times
        self.clear()
        used = sum(map(len, kept)) + sum(map(len, text)) + PIECE_BYTES * len(kept) + 16 * int(sums[:, 4].sum())
        if used < self.most // 2:
            self.index, self.text, self.used = dict(zip(kept, range(len(kept)))), text, used
            self.right, self.sums, self.uses = right, sums, np.zeros(len(kept), np.int64)
            at = _ranges(link_at, sums[:, 4])
            self.codes, self.times = codes[at], times[at]
            self.link_at = np.cumsum(sums[:, 4]) - sums[:, 4]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place) of each piece of the texts in order, and whether a text's alignment is right. Empty texts have none."""
        if self.used > self.most:
            self._compact()
        cut = [self.pieces(" " + t) if t else [] for t in texts]
        self.learn(list(set().union(*cut).difference(self.index)))
        sizes = np.array([len(c) for c in cut], np.int64)
        place = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        self.uses += np.bincount(place, minlength=len(self.uses))
        doc = np.repeat(np.arange(len(texts)), sizes)
        right = np.bincount(doc[~self.right[place]], minlength=len(texts)) == 0
        keep = right[doc]
        return doc[keep], place[keep], right & (sizes > 0)

    def links(self, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code of the id pair, links) of each group of the pieces."""
        n = self.sums[place, 4]
        at = _ranges(self.link_at[place], n)
        return np.repeat(doc, n), self.codes[at], self.times[at]


_CUT = re.compile(r"(?<=\S)(?= )")
_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two tokenizer files, until another stage takes the worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    hold_alone(_aligners, _aligners.clear)
    return _aligners[a_path, b_path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def _alignments(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """Each text's counts and groups, its distinct id pairs in order as differences of codes, and how many links have each.

    A pair's code is A's id times B's vocabulary plus B's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = aligner(a_path, b_path)
            width, n = len(own.a_bytes) * own.b_vocabulary, b.num_rows
            doc, place, right = own.places(b.column(1).to_pylist())
            totals = [_sum(doc, own.sums[place, k], n) for k in range(4)]
            piece, times = np.unique(doc << 32 | place, return_counts=True)
            of, code, links = own.links(piece >> 32, piece & 0xFFFFFFFF)
            key, links = _added(of * width + code, links * np.repeat(times, own.sums[piece & 0xFFFFFFFF, 4]))
            of, code = np.divmod(key, width)
            step = np.diff(code, prepend=0)
            first = np.searchsorted(of, np.arange(n + 1))
            step[first[:-1][first[1:] > first[:-1]]] = code[first[:-1][first[1:] > first[:-1]]]
            cuts = first.tolist()
            codes, links = step.astype("<u8").tobytes(), links.astype("<u4").tobytes()
            ends, at = np.searchsorted(doc, np.arange(n + 1)).tolist(), place.tolist()
            groups = [b"".join(map(own.text.__getitem__, at[x:y]))[:-1] if r else b"" for x, y, r in zip(ends, ends[1:], right)]
            if digest:
                groups = [hashlib.sha256(g).hexdigest().encode() if r else g for g, r in zip(groups, right)]
            held = [pa.array([raw[size * x : size * y] for x, y in zip(cuts, cuts[1:])], pa.binary()) for raw, size in ((codes, 8), (links, 4))]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, totals), pa.array(groups, pa.binary()).cast(pa.string()), *held], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "links"]
    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, links binary")


def _codes(steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each pair of a column of differences of codes."""
    steps = steps.to_pylist()
    sizes = np.array([len(x) // 8 for x in steps], np.int64)
    code = np.cumsum(np.frombuffer(b"".join(steps), "<u8").astype(np.int64))
    before = np.append(0, code)[np.cumsum(sizes) - sizes]
    return np.repeat(np.arange(len(steps)), sizes), code - np.repeat(before, sizes)


def pair_counts(alignments: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(code, n): how many documents hold the id pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts = np.zeros(0, np.int64)
        for b in batches:
            fresh = _codes(b.column(0))[1]
            codes, counts = _added(np.append(codes, fresh), np.append(counts, np.ones(len(fresh), np.int64)))
            if len(codes) > counted:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])
                codes = counts = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return alignments.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, top_pairs: int = TOP_PAIRS, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: the alignment of each whole text.

    A link joins an A token and a B token of one group; its count is how many documents hold its id pair linked.
    n_best counts the links whose count is the highest of their A id (ties included), count_sum adds up counts. groups lists
    each group's A ids and B ids, `a1,a2|b1;a3|b2,b3`; with `digest`, groups_sha256 is its hash instead. Null and empty texts, and those that a tokenizer does not give back
    byte by byte, have no tokens: zeros and an empty text. Repeated rows each count and give a row, as do null doc_ids; other
    columns are ignored; no rows give no rows. Texts are cut in pieces, so a very long one needs memory for its own pieces only.
    Documents are aligned once and their id pairs written; what moves between tasks is a count per id pair, and for pairs
    beyond the `top_pairs` commonest a row per document that holds them.
    """
    spark = docs.sparkSession
    short_batches(spark)
    a_path, b_path = a_path or byte_bpe_path(), b_path or piece_bpe_path()
    rows = written(_alignments(docs, a_path, b_path, digest).withColumn("row", F.monotonically_increasing_id()), "alignments", "zstd")
    counts = written(pair_counts(rows), "pair-counts")
    width = aligner(a_path, b_path).b_vocabulary
    a_id = F.expr(f"cast(code div {width} as int)")
    # a row per id of the vocabulary, and at most top_pairs rows
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("best")).toArrow()
    top = commonest(counts, "code", top_pairs).toArrow()
    order = np.argsort(top["code"].to_numpy())
    highest = np.zeros(len(aligner(a_path, b_path).a_bytes), np.int64)
    highest[best["a"].to_numpy()] = best["best"].to_numpy()
    known_codes = top["code"].to_numpy()[order]
    is_best = top["n"].to_numpy()[order] == highest[known_codes // width]
    model = broadcast_model(spark, (np.append(known_codes, -1), np.append(top["n"].to_numpy()[order], 0), np.append(is_best, False)))
    rare_type = pa.list_(pa.struct([("code", pa.int64()), ("links", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, is_best = model.value  # the last place stands for other pairs
        for b in batches:
            of, code = _codes(b.column("codes"))
            links = np.frombuffer(b"".join(b.column("links").to_pylist()), "<u4").astype(np.int64)
            at = np.searchsorted(codes[:-1], code)
            known = codes[at] == code
            at[~known] = len(codes) - 1
            per_doc = [pa.array(_sum(of, links * x[at], b.num_rows)) for x in (is_best, times)]
            offsets = np.searchsorted(of[~known], np.arange(b.num_rows + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(code[~known]), pa.array(links[~known])], ["code", "links"])
            rare = pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(rare_type)
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *per_doc, rare], [*kept, "n_best", "count_sum", "rare"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    found = rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long, rare array<struct<code: long, links: long>>")
    out = [*kept[1:6], "n_best", "count_sum", F.col("groups").alias("groups_sha256" if digest else "groups")]
    if top.num_rows == counts.count():
        return found.select(*out)  # no pair is rare
    found = written(found, "alignments-counted")
    rare = found.select("row", F.explode("rare").alias("x")).select("row", "x.code", "x.links").join(counts, "code")
    highest_of = F.broadcast(spark.createDataFrame(best.to_pandas()).withColumnsRenamed({"a": "a_id"}))
    rare = rare.join(highest_of, a_id == F.col("a_id"))
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    total = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return found.join(more, "row", "left").select(*out[:5], *total, out[-1])


def _sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of the values that are at it; `at` ascends."""
    ends = np.searchsorted(at, np.arange(n + 1))
    return np.diff(np.append(0, np.cumsum(values))[ends])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every document, groups as their hash. No rows give no rows."""
    return align(load(spark, sf_dir, "documents"), digest=True)
