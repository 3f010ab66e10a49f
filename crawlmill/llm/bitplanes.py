"""Token ids in binary files: blocks of ids transposed into planes, each plane compressed by itself, with an index.

A file is a sequence of rows, each followed by one byte 0A. Every row but the last is a chunk:

    b"TPC1" | mode u8 (1 bit planes, 8 byte planes) | ids u32 | planes u8 | size of each plane u32 | planes (zstd)

The last is the index:

    b"TPX1" | chunks u32 | documents u32 | chunk offset u64, ids u32 each | size u32, zstd of the documents | row size u32

The documents are three arrays of signed 64-bit integers: whether doc_id is known, doc_id, and number of ids. All
numbers are little-endian. The row size, just before the final 0A, counts the index row, so that a reader starts there.

A file ends after FILE_CHUNKS chunks: its last chunk takes what is left of the document that it is in, so a file holds
whole documents, and at most FILE_CHUNKS * BLOCK_IDS ids and one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.llm.archives import read_files, write_rows
from crawlmill.llm.common import load, scan_partitions, shared_path, short_batches, text_or_empty, written
from crawlmill.llm.encoding import byte_bpe_path, encoder

#: Ids in a chunk, chunks in a file.
BLOCK_IDS, FILE_CHUNKS = 1 << 16, 64
END_ID = 2


def pack_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """A chunk of ids. Planes above the largest id are left out."""
    squeeze = zstandard.ZstdCompressor(level=level)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        spread = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(spread[:, i]) for i in range(top)]
    else:
        planes = [np.ascontiguousarray(raw[:, i]) for i in range((top + 7) // 8)]
    packed = [squeeze.compress(p.tobytes()) for p in planes]
    return b"TPC1" + struct.pack(f"<BIB{len(packed)}I", 1 if bits else 8, len(ids), len(packed), *map(len, packed)) + b"".join(packed)


def unpack_planes(chunk: bytes) -> np.ndarray:
    mode, n, count = struct.unpack_from("<BIB", chunk, 4)
    sizes = struct.unpack_from(f"<{count}I", chunk, 10)
    at, expand = 10 + 4 * count, zstandard.ZstdDecompressor()
    out = np.zeros((n, 32 if mode == 1 else 4), np.uint8)
    for i, size in enumerate(sizes):
        plane = np.frombuffer(expand.decompress(chunk[at : at + size]), np.uint8)
        out[:, i] = np.unpackbits(plane, count=n) if mode == 1 else plane
        at += size
    if mode == 1:
        out = np.packbits(out, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class FileWriter:
    """Rows of one file after another: feed documents in order, then close. Every file but the last has chunks + 1 rows."""

    def __init__(self, bits: bool = False, block: int = BLOCK_IDS, chunks: int = FILE_CHUNKS):
        self.bits, self.block, self.most = bits, block, chunks
        self._begin()

    def _begin(self) -> None:
        self.held: list[bytes] = []
        self.size = self.at = 0
        self.chunks: list[tuple[int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size < 4 * self.block:
            return
        data, at = b"".join(self.held), 0
        while len(data) - at >= 4 * self.block and len(self.chunks) < self.most - 1:
            yield self._chunk(data[at : at + 4 * self.block])
            at += 4 * self.block
        self.held, self.size = [data[at:]], len(data) - at
        if self.size >= 4 * self.block:
            yield from self.close()

    def _chunk(self, data: bytes) -> bytes:
        row = pack_planes(np.frombuffer(data, "<u4"), self.bits)
        self.chunks.append((self.at, len(data) // 4))
        self.at += len(row) + 1
        return row

    def close(self) -> Iterator[bytes]:
        if not self.docs:
            return
        if self.size:
            yield self._chunk(b"".join(self.held))
        index = b"TPX1" + struct.pack("<II", len(self.chunks), len(self.docs)) + b"".join(struct.pack("<QI", *c) for c in self.chunks)
        docs = zstandard.ZstdCompressor(level=3).compress(np.array(self.docs, "<i8").reshape(-1, 3).T.tobytes())
        index += struct.pack("<I", len(docs)) + docs
        yield index + struct.pack("<I", len(index) + 4)
        self._begin()


def read_file(content: bytes | pa.Buffer) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, its ids) of each document, chunk by chunk through the index."""
    view = memoryview(content)[:-1]
    (size,) = struct.unpack_from("<I", view, len(view) - 4)
    index = view[len(view) - size :]
    if bytes(index[:4]) != b"TPX1":
        raise ValueError("not a token file")
    n_chunks, n_docs = struct.unpack_from("<II", index, 4)
    chunks = [struct.unpack_from("<QI", index, 12 + 12 * i) for i in range(n_chunks)]
    at = 12 + 12 * n_chunks
    (packed,) = struct.unpack_from("<I", index, at)
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(index[at + 4 : at + 4 + packed])), "<i8").reshape(3, n_docs)
    ends = [c[0] for c in chunks[1:]] + [len(view) - size]
    held, have, nxt, start = [], 0, 0, 0
    for known, doc_id, n in docs.T.tolist():
        while have < n:
            ids = unpack_planes(bytes(view[chunks[nxt][0] : ends[nxt] - 1]))
            held.append(ids)
            have += len(ids)
            nxt += 1
        ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, "<u4")
        yield (doc_id if known else None), start, ids[:n].tobytes()
        held, have, start = [ids[n:]], have - n, start + n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, bits: bool = False, block: int = BLOCK_IDS, chunks: int = FILE_CHUNKS) -> None:
    """Encode docs (doc_id, text) and write them as token files in ascending doc_id order, null ids first.

    Spark's range partitioning deals ascending ranges of doc_id, as many as the scan has partitions; a range is written
    as one file after another, so files are bounded whatever a range holds.
    """
    short_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), b"" if end_id is None else struct.pack("<I", end_id)
        out = FileWriter(bits, block, chunks)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if rows := list(out.add(doc_id.as_py(), own.encode([text.as_py()])[0] + end)):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["row"])
        if rows := list(out.close()):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["row"])
        own.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange(scan_partitions(rows), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    write_rows(dealt.mapInArrow(pack, "row binary"), "row", path, "\n", chunks + 1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, content): files in the order of their documents, by the numbers of the task and of its file."""
    numbers = [F.regexp_extract("path", r"part-(\d+)[^/]*-c(\d+)[^/]*$", i).cast("long") for i in (1, 2)]
    return read_files(spark, path).select((numbers[0] * 1_000_000 + numbers[1]).alias("file_no"), "content")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, doc_id, file_start, ids) of every document in the token files; ids as little-endian 32-bit."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, content in zip(b.column(0).to_pylist(), b.column(1)):
                for part in _some(read_file(content.as_buffer())):
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(part), pa.int64()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.binary())], ["file_no", "doc_id", "file_start", "ids"])

    return _files(spark, path).mapInArrow(unpack, "file_no long, doc_id long, file_start long, ids binary")


def _some(rows: Iterator[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Documents in lists of about `size` bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[2]) + 64
        if held >= size:
            yield part
            part, held = [], 0
    yield part


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, start counting the ids of all documents before it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(no, doc_id, start, len(ids) // 4, zlib.crc32(ids)) for doc_id, start, ids in read_file(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["file_no", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    docs = written(_files(spark, path).mapInArrow(digest, "file_no long, doc_id long, file_start long, n_tokens long, ids_crc32 long"), "token-index")
    # one row per file: the ids of the files before it
    files = docs.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file_no", (F.sum("n").over(W.orderBy("file_no")) - F.col("n")).alias("before"))
    return docs.join(files, "file_no").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, repeated doc_ids stand next to each other in any order, null doc_ids come first."""
    path = shared_path(spark, "tokens")
    write_tokens(load(spark, sf_dir, "documents"), path, byte_bpe_path())
    return token_index(spark, path)
