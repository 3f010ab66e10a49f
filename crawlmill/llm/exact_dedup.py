"""Exact deduplication: counting quotient filters find repeated fingerprints, byte grouping confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.llm.common import load, text_hashes, text_or_empty, without_rows, written
from crawlmill.llm.quotient_filter import CountingQuotientFilter

#: Each run of these characters counts as one space.
WHITE = r"[\x20\x09-\x0D]+"
#: Distinct fingerprints that one merging group holds, about.
SLICE_ROWS = 250_000


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), WHITE, " ")


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once.

    Each partition builds one filter per slice of the fingerprint range; the filters of a slice merge. A fingerprint
    costs a partition one entry however often it occurs there, so a hot one is no burden.
    """
    slice_bits = max(3, int(np.ceil(np.log2(max(1, rows / SLICE_ROWS)))))
    low = 64 - slice_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        part = (values >> np.uint64(low)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        mask = (np.uint64(1) << np.uint64(low)) - np.uint64(1)
        slices, filters = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(values))):
            slices.append(int(part[a]))
            filters.append(CountingQuotientFilter.from_counts(values[a:b] & mask, counts[a:b].astype(np.uint64), low).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(filters, pa.binary())], ["slice", "filter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in table["filter"].to_pylist()])
        values, counts = merged.items()
        values = values[counts > 1] | (np.uint64(key[0].as_py()) << np.uint64(low))
        return pa.table({"fp": pa.array(values.view(np.int64)), "n": pa.array(counts[counts > 1].astype(np.int64))})

    return fps.select("fp").mapInArrow(build, "slice int, filter binary").groupBy("slice").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_no, unique in the result, and h1 and h2,
    hashes of the text as it is.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. The smallest
    doc_id of a group stays; a null doc_id stays only where all are null. Of rows that repeat a text and its smallest
    doc_id exactly one stays. Other columns of docs are ignored; no rows give no rows.
    """
    h1, h2 = text_hashes()
    norm = docs.select("doc_id", normalised().alias("norm"), h1.alias("h1"), h2.alias("h2"))
    rows = written(norm.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), "h1", "h2"), "exact-rows")
    twice = written(repeated_fingerprints(rows, rows.count()), "exact-repeated")
    # byte verification: grouping compares whole texts; copies in a task fall together before anything moves
    doubted = norm.withColumn("fp", F.xxhash64("norm")).join(twice, "fp", "left_semi")
    groups = doubted.groupBy("norm").agg(F.min("doc_id").alias("g_keep"), F.count("*").alias("g_size")).where("g_size > 1")
    groups = written(groups.select(F.sha2("norm", 256).alias("text_sha256"), "g_keep", "g_size"), "exact-groups")
    joined = rows.join(groups, "text_sha256", "left")
    # a smallest doc_id that occurs several times with the same text: its first row stays
    ties = joined.where("g_size > 1 and doc_id <=> g_keep").groupBy("text_sha256").agg(F.min("row_no").alias("g_first"), F.count("*").alias("g_ties")).where("g_ties > 1").drop("g_ties")
    joined = joined.join(ties, "text_sha256", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("g_size").isNull(), F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("g_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("g_keep")) & F.coalesce(F.col("row_no") == F.col("g_first"), F.lit(True)))).alias("kept"),
        "text_sha256",
        "row_no",
        "h1",
        "h2",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_dedup drops, all columns kept, whatever their names.

    Null texts are empty ones. The smallest doc_id of a group stays, a null doc_id only where all are null, and of rows
    that repeat a text and its smallest doc_id one. No rows give no rows.
    """
    keys = exact_dedup(docs).groupBy("doc_id", "h1", "h2").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys.where("not kept or n > 1"), "exact-gone")
    gone, twice = keys.where("not kept").drop("kept", "n"), keys.where("kept").drop("kept", "n")
    return without_rows(docs, [F.col("doc_id"), *text_hashes()], gone, twice)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents")).drop("row_no", "h1", "h2")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
