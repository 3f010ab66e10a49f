"""SimHash near-duplicates: segment bit counts as an embedding, a grid join under Manhattan distance, exact checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import connected_components, load, short_batches, text_hashes, without_rows, written
from crawlmill.llm.encoding import segments

_WHITE = re.compile(rb"[\x20\x09-\x0D]+")
#: Bits 0, 2, 4 ...: the low bit of each two-bit segment.
_LOW = 0x5555555555555555
#: Fingerprints of one cell that one task compares with each other; larger cells are split into pairs of blocks.
BLOCK = 2048


def votes_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(votes: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included; zero where there is no word. Long texts go in steps."""
    digest, votes, total, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in segments(text or ""):
        words = held + [w for w in _WHITE.split(part.encode("utf-8", "surrogatepass").lower()) if w]
        n = len(words) - shingle + 1
        if n > 0:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            votes += votes_of(np.fromiter((digest(g, 42) for g in grams), np.uint64, n))
            total += n
        held = words[max(n, 0) :]
    if not total and held:
        votes, total = votes_of(np.array([digest(b" ".join(held), 42)], np.uint64)), 1
    return majority(votes, total) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 3, beside: list[Column] = []) -> DataFrame:
    """(doc_id, fp) with fp as the signed long of the same bits, and h1, h2 of the long columns beside."""
    short_batches(docs.sparkSession)
    extra = [f"h{i + 1}" for i in range(len(beside))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *extra])

    rows = docs.select(F.col("doc_id").cast("long"), "text", *beside)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {x} long" for x in extra))


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each count written in unary (0: 00, 1: 01, 2: 11).

    In that form the Manhattan distance of two vectors of counts is the bit count of their xor. It is never more than
    the Hamming distance of the fingerprints.
    """
    low, other = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(other).bitwiseOR(F.shiftleft(low.bitwiseAND(other), 1))


def _cell_masks(distance: int, blocks: int) -> list[int]:
    """Masks of the segments that must agree: all but `distance` of the blocks of segments, for each choice of them."""
    parts = np.array_split(np.arange(32), blocks)
    masks = [sum(3 << (2 * int(s)) for s in part) for part in parts]
    out = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that join all fingerprints of a cell that chains of close pairs connect, one fewer than each chain has."""
    a, b, left = [], [], fps.view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                a += [at] * len(found)
                b += found.tolist()
                queue += list(found)
                left = left[~near]
    return a, b


def close_pairs(distinct: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b): edges between distinct fingerprints within `distance` bits whose chains reach all that close pairs reach.

    distinct has one column fp. Grid: vectors within Manhattan distance d agree on all but d of the blocks of their
    coordinates, so every close pair meets in a cell. In a cell, the Manhattan bound and then the exact bits are
    checked. A cell emits a spanning forest of its close pairs, never all of them; a cell of more than BLOCK members
    is split into pairs of blocks, so no task holds more than two blocks of it.
    """
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(_cell_masks(distance, blocks))])
    cells = distinct.withColumn("e", embedding(F.col("fp"))).select("fp", "e", F.explode(cells).alias("cell"))
    large = cells.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    large = written(large, "simhash-large-cells")
    if large.isEmpty():
        dealt = cells.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        # a member of block k goes to the pairs (k, 0) ... (k, parts - 1); equal rows of a pair meet in one run
        own = F.pmod(F.xxhash64("fp", F.lit(9)), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = cells.join(large, "cell", "left").withColumn("k", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        dealt = dealt.select("fp", "e", "cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    parts = max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(F.xxhash64("cell", "i", "j").alias("run"), "fp", "e").repartition(parts, "run").sortWithinPartitions("run")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            ready = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            yield links(*[h[:ready] for h in held])
            held = [h[ready:] for h in held]
        yield links(*held)

    def links(run: np.ndarray, fp: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(run)))
        small = np.repeat(size <= 16, size)
        for step in range(1, 16):
            at = np.flatnonzero((run[:-step] == run[step:]) & small[step:]) if len(run) > step else []
            if not len(at):
                break
            at = at[np.bitwise_count((e[at] ^ e[at + step]).view(np.uint64)) <= distance]
            at = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance]
            a.append(fp[at].view(np.uint64))
            b.append(fp[at + step].view(np.uint64))
        for s, n in zip(start[size > 16], size[size > 16]):
            x, y = forest(fp[s : s + n], distance)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").where("a <> b")


def components(rows: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, root, low, n) of the distinct fp of rows (doc_id, fp): the root of its component, and in it the smallest
    doc_id and the number of rows."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-nodes")
    roots = connected_components(close_pairs(nodes.select("fp"), distance)).withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    return written(rooted.select("fp", "root").join(lows, "root").select("fp", "root", "low", "n"), "simhash-named")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, group_size.

    Documents link where their fingerprints differ in at most `distance` bits; component_id is the smallest doc_id that
    links reach. Null texts have fingerprint zero. A null doc_id takes part in links but never names a component that
    has another; repeated rows and doc_ids each give a row. Other columns of docs are ignored.
    """
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    named = components(rows, distance)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"), F.col("n").alias("group_size"))


def drop_near_copies(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """docs with one row of each group of near duplicates, one of the smallest doc_id; all columns, whatever their names.

    A null doc_id stays only where its group has no other. Of rows that share the smallest doc_id the one of the smallest
    text hash stays, of rows that repeat it one. No rows give no rows.
    """
    rows = written(fingerprints(docs, shingle, text_hashes()), "simhash-rows")
    keys = rows.groupBy("doc_id", "h1", "h2", "fp").agg(F.count("*").alias("times")).join(components(rows, distance), "fp")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("first"))
    keys = written(keys.join(first, "root").withColumn("kept", F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2").eqNullSafe(F.col("first"))), "simhash-keys")
    gone, twice = (x.select("doc_id", "h1", "h2") for x in (keys.where("not kept"), keys.where("kept and times > 1")))
    return without_rows(docs, [F.col("doc_id").cast("long"), *text_hashes()], gone, twice)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
