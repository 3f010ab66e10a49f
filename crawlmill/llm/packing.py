"""Best-fit packing of documents into training sequences under several capacities at once."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import load, short_batches, text_or_empty, written
from crawlmill.llm.encoding import byte_bpe_path, encoder

#: Pieces that one task packs, about. Larger groups waste less: each leaves only its last sequences unfilled.
GROUP_ROWS = 1 << 16


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Attention cost of a piece is its length squared, as in block-diagonal attention.

    rule "norm" takes the sequence whose weighted residual is smallest once the piece is in; "dot" takes the one whose
    residual has the largest weighted dot product with the piece's demand.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"


def vector_best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Pieces are placed longest first, ties in their order.

    Open sequences are held by residual tokens and, within those, by residual documents in the order of residual
    attention. Under "norm" the best of a list is the first that fits, under "dot" the last, so a list costs one bisection
    however many sequences are alike. A piece looks at residuals from its own length up; for "norm" the token term alone
    bounds the score from below, so the search ends at the first residual that cannot win.
    """
    wt, wd, wa = cap.weights[0] / cap.tokens**2, cap.weights[1] / cap.documents**2, cap.weights[2] / cap.attention**2
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(cap.tokens + 1)]  # by residual tokens and documents: (attention, sequence)
    filled, count, norm = 0, 0, cap.rule == "norm"  # bit r of filled: room[r] has a sequence
    for at in order.tolist():
        n = int(lengths[at])
        cost = n * n
        if n > cap.tokens or cost > cap.attention:
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        best, found = None, None
        mask = filled >> n
        while mask:
            r = n + (mask & -mask).bit_length() - 1
            floor = wt * (r - n) ** 2
            if norm and best is not None and floor >= best:
                break
            for docs, held in room[r].items():
                i = bisect_left(held, (cost, -1)) if norm else len(held) - 1
                if i < len(held) and held[i][0] >= cost:
                    attention = held[i][0]
                    score = floor + wd * (docs - 1) ** 2 + wa * (attention - cost) ** 2 if norm else -(wt * r * n + wd * docs + wa * attention * cost)
                    if best is None or score < best:
                        best, found = score, (r, docs, i)
            mask &= mask - 1
        if found is None:
            r, docs, attention, s, count = cap.tokens, cap.documents, cap.attention, count, count + 1
        else:
            r, docs, i = found
            attention, s = room[r][docs].pop(i)
            if not room[r][docs]:
                del room[r][docs]
                if not room[r]:
                    filled &= ~(1 << r)
        sequence[at], offset[at] = s, cap.tokens - r
        if r > n and docs > 1:
            insort(room[r - n].setdefault(docs - 1, []), (attention - cost, s))
            filled |= 1 << (r - n)
    return sequence, offset


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, cut only where longer than capacity.

    Pieces of a cut document hold `capacity` ids but for the first, which takes what is over.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, b"" if end_id is None else struct.pack("<I", end_id)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if piece == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    for c, x in zip(cols, (doc_id, piece, start, length, zlib.crc32(part), part if with_ids else None)):
                        c.append(x)
                    start += length
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """pieces with sequence_id and offset. Only lengths move between tasks; groups are dealt at random."""
    groups = max(1, round(pieces.count() / GROUP_ROWS))
    names = pieces.columns
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = vector_best_fit(table["length"].to_numpy(), cap)
        return table.select(names).append_column("sequence_id", pa.array((key[0].as_py() << 36) + sequence)).append_column("offset", pa.array(offset))

    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return dealt.groupBy("pack_group").applyInArrow(fit, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, cap: Capacity = Capacity(), end_id: int | None = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    offset is the number of ids before the piece in its sequence. Null texts are empty and take the end id alone;
    repeated rows and null doc_ids are ordinary rows; other columns are ignored; no rows give no rows.
    """
    pieces = encode_pieces(docs, tokenizer or byte_bpe_path(), cap.tokens, end_id)
    return pack(written(pieces, "pieces"), cap)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
