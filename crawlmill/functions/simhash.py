"""64-bit SimHash signatures of token lists."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions.text import preprocessed

_MASK = (1 << 64) - 1
#: The lowest bit of either half of a long.
_LANES = 0x0000000100000001


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(distance: int) -> list[int]:
    """Masks, as signed longs: values within `distance` bits of each other are equal under one of them at least.

    Each mask leaves out `distance` blocks of bits. The fewer bits may differ, the more blocks there are beside those, so
    that masks stay wide: at 3 bits 20 masks of 32 bits, at 1 bit 4 of 48.
    """
    count = distance + (3 if distance <= 4 else 2 if distance <= 8 else 1)
    starts = [64 * i // count for i in range(count + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(starts, starts[1:])]
    masks = [sum(c) for c in combinations(each, count - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks(signature: Column, distance: int) -> Column:
    """Rows (block, part): what each of the masks leaves of a signature, to be joined by equality."""
    return F.posexplode(F.array(*[signature.bitwiseAND(F.lit(m)) for m in block_masks(distance)])).alias("block", "part")


def signatures(docs: DataFrame, key: str, tokens: Column | None = None, text: str = "text") -> DataFrame:
    """(key, signature) over tokens with repeats, in the JVM: a bit is set where most token hashes have it.

    A document without tokens gets no row: it is an exact-duplicate class of its own. Rows that share a key have a row each.
    """
    listed = preprocessed(F.coalesce(F.col(text), F.lit(""))) if tokens is None else tokens
    # a document's tokens are summed up where they are: one row per document moves
    rows = docs.select(key, F.monotonically_increasing_id().alias("_row"), listed.alias("_tokens"))
    hashed = rows.select(key, "_row", F.explode("_tokens").alias("w")).select(key, "_row", F.xxhash64("w").alias("h"))
    # bits i and i + 32 are counted in the low and the high half of one sum
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]
    summed = hashed.groupBy(key, "_row").agg(F.count("*").alias("total"), *lanes)
    bits = F.lit(0).cast("long")
    for i in range(64):
        v = F.col(f"v{i % 32}")
        votes = F.shiftrightunsigned(v, 32) if i >= 32 else v.bitwiseAND(F.lit(_MASK >> 32))
        bits = bits.bitwiseOR(F.shiftleft((votes * 2 > F.col("total")).cast("long"), i))
    return summed.select(key, bits.alias("signature"))


@functools.lru_cache(maxsize=1 << 16)
def sip24(data: bytes, k0: int = 1, k1: int = 2) -> int:
    """SipHash-2-4 of the published description."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def turn(x: int, n: int) -> int:
        return ((x << n) | (x >> (64 - n))) & _MASK

    def rounds(n: int) -> None:
        for _ in range(n):
            v[0] = (v[0] + v[1]) & _MASK
            v[1] = turn(v[1], 13) ^ v[0]
            v[0] = turn(v[0], 32)
            v[2] = (v[2] + v[3]) & _MASK
            v[3] = turn(v[3], 16) ^ v[2]
            v[0] = (v[0] + v[3]) & _MASK
            v[3] = turn(v[3], 21) ^ v[0]
            v[2] = (v[2] + v[1]) & _MASK
            v[1] = turn(v[1], 17) ^ v[2]
            v[2] = turn(v[2], 32)

    padded = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for (word,) in struct.iter_unpack("<Q", padded):
        v[3] ^= word
        rounds(2)
        v[0] ^= word
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def parity_signature(tokens: list[str]) -> int | None:
    """The signature that stored rule files hold: a bit is set where most SipHash-2-4 values have it clear."""
    if not tokens:
        return None
    hashes = np.fromiter((sip24(t.encode() + b"\xff") for t in tokens), np.uint64, len(tokens))
    votes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int.from_bytes(np.packbits(2 * votes < len(tokens)).tobytes(), "big")


def parity_signatures(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, signature) comparable with signatures in stored rule files, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parity_signature(t) for t in b.column(1).to_pylist()]
            signed = [None if s is None else s - (1 << 64) if s >> 63 else s for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], [key, "signature"])

    rows = docs.select(F.col(key).cast("long"), preprocessed(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return rows.mapInArrow(run, f"{key} long, signature long").where("signature is not null")
