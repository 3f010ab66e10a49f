"""Shards of near equal bytes: a minimax contiguous partition of ordered atomic groups, with DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.llm.common import load, text_or_empty

#: Cells of the hash order. Groups (equal texts) are atomic; a cell holds whole groups, neighbours in hash order.
CELLS = 1 << 16
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows that one task numbers, about.
ROWS_PER_RUN = 200_000


def feasible_cuts(ends: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Greedy check: how many leading cells each shard may end at if none holds more than capacity, or None."""
    cuts, start = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, start + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        start = int(ends[at - 1]) if at else 0
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which `shards` contiguous runs hold all sizes, and the ends of those runs.

    Binary search over the capacity; each is checked greedily in `shards` bisections of the running sum.
    """
    ends = np.cumsum(np.array(sizes, np.int64)) if sizes else np.zeros(0, np.int64)
    low, high = max([0, *sizes]), int(ends[-1]) if len(ends) else 0
    while low < high:
        mid = (low + high) // 2
        if feasible_cuts(ends, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, even_cuts(ends, shards, low)


def even_cuts(ends: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts under the capacity, each as near to an equal share of what is left as the rest allows.

    The greedy check fills shards from the left and leaves the last one short. Filling from the right gives the least
    end of each shard for which the rest still fits; between the two, the cut nearest to the equal share is taken.
    """
    least, stop = [0] * shards, len(ends)
    for i in range(shards - 1, 0, -1):
        least[i - 1] = stop = int(np.searchsorted(ends, (int(ends[stop - 1]) if stop else 0) - capacity, side="left")) + 1 if stop and ends[stop - 1] > capacity else 0
    cuts, start = [], 0
    for i in range(shards):
        share = start + ((int(ends[-1]) if len(ends) else 0) - start) / (shards - i)
        at = int(np.searchsorted(ends, share, side="left"))
        before, after = (int(ends[at - 1]) if at else 0), int(ends[min(at, len(ends) - 1)]) if len(ends) else 0
        at = at if share - before <= after - share else at + 1
        at = min(max(at, least[i] if i < shards - 1 else len(ends), cuts[-1] if cuts else 0), int(np.searchsorted(ends, start + capacity, side="right")), len(ends))
        cuts.append(at)
        start = int(ends[at - 1]) if at else 0
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts stay together (null is the empty text). Groups follow the order of their hash; a group larger than an
    equal share gets a shard of its own, first in the order, and the rest is cut where the smallest feasible capacity
    cuts it. slot numbers the rows of a shard from 0. Repeated rows and null doc_ids are ordinary rows; no rows give no
    rows. The driver receives at most CELLS sums and `shards` large groups, whatever the input.
    """
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", (F.octet_length("t").cast("long") + OVERHEAD).alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.xxhash64("t").alias("h"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 48).cast("int"))
    total = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # groups above an equal share of what is left: fewer than `shards` of them
    groups = rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("s"))
    large = {(r["h"], r["text_crc32"]): r["s"] for r in groups.where(F.col("s") > total["s"] / shards).collect()}
    apart, left = [], total["s"]
    for key, s in sorted(large.items(), key=lambda x: -x[1]):
        if len(apart) < shards - 1 and s > left / (shards - len(apart)):
            apart.append(key)
            left -= s
    own = F.lit(None).cast("int")
    for i, (h, c) in enumerate(apart):
        own = F.when((F.col("h") == h) & (F.col("text_crc32") == c), F.lit(i)).otherwise(own)
    rows = rows.withColumn("own", own)
    cells = rows.where("own is null").groupBy("cell").agg(F.sum("size").alias("s")).orderBy("cell").collect()
    _, cuts = minimax_cuts([r["s"] for r in cells], shards - len(apart))
    # a shard begins at the first cell past its predecessor's end; a shard without cells begins past all of them
    begins = [cells[c]["cell"] if c < len(cells) else CELLS for c in cuts[:-1]]
    place = F.lit(len(apart)) + F.size(F.filter(F.array(*[F.lit(b) for b in begins]).cast("array<int>"), lambda b: b <= F.col("cell")))
    placed = rows.select("doc_id", "size", "text_crc32", F.coalesce("own", place).cast("int").alias("shard"))
    # rows of a shard are numbered in runs of bounded length: a place in the run and the run's first number
    runs = max(1, -(-total["n"] // ROWS_PER_RUN))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
    firsts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    firsts = firsts.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32")) - 1
    numbered = placed.withColumn("within", within).join(firsts, ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(load(spark, sf_dir, "documents"))
