"""Running counts, first sightings, top terms and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.constants import HIGH_ERROR_RATIO
from crawlmill.functions import urls
from crawlmill.storage import written


def trigger(requests: Column, errors: Column, s403: Column, s429: Column, threads: int = 50) -> Column:
    """The policy that running counts trigger, or null: Errors, then Status403, then Status429."""
    kind = F.when(errors >= max(threads // 2, 25), F.lit("Errors"))
    kind = kind.when(s403 / requests >= HIGH_ERROR_RATIO, F.lit("Status403")).when(s429 / requests >= HIGH_ERROR_RATIO / 3, F.lit("Status429"))
    return F.when(requests >= max(threads, 50), kind)


#: Rows of a block of a running count.
BLOCK_ROWS = 1 << 20


def blocked(rows: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `block`: blocks of about block_rows rows, in order of the columns. Written, so that blocks stay as they are."""
    n = max(1, -(-rows.count() // block_rows))
    return written(rows.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), "blocks")


def running_counts(rows: DataFrame, key: str, order: list[str], counts: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with each of the counts (sums of whole numbers) up to and with the row, by key, in order; and `block`.

    Two levels: a key's rows lie in blocks whose totals are summed up first, and each block counts on from what came before
    it, so a key of any number of rows needs no task of its own. A null key is a key.
    """
    held = blocked(rows.withColumns({f"_{n}": c for n, c in counts.items()}), [key, *order], block_rows)
    totals = held.groupBy(F.col(key).alias("_key"), F.col("block").alias("_block")).agg(*[F.sum(f"_{n}").alias(f"_in_{n}") for n in counts])
    before = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # as many rows as blocks
    totals = totals.select("_key", "_block", *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in counts])
    inside = W.partitionBy(key, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = held.select("*", *[F.sum(f"_{n}").over(inside).alias(f"_run_{n}") for n in counts])
    run = run.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return run.select(*rows.columns, "block", *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in counts])


def numbered(rows: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `place`, from 1 on in order of the columns, which no two rows share; no task holds more than a block."""
    held = blocked(rows, order, block_rows)
    sizes = held.groupBy("block").count()  # a row per block
    sizes = sizes.select("block", (F.sum("count").over(W.orderBy("block")) - F.col("count")).alias("_before"))
    inside = W.partitionBy("block").orderBy(*order)
    return held.withColumn("_inside", F.row_number().over(inside)).join(sizes, "block").select(*rows.columns, (F.col("_inside") + F.col("_before")).alias("place"))


def policy_triggers(log: DataFrame, threads: int = 50, order: str = "event_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scan_url, trigger, ts, requests): the first trigger of each scan, in order of time."""
    whole = {"requests": F.lit(1), "errors": F.col("error").isNotNull().cast("int"), "s403": F.coalesce((F.col("status") == 403).cast("int"), F.lit(0)), "s429": F.coalesce((F.col("status") == 429).cast("int"), F.lit(0))}
    run = running_counts(log.select("scan_url", "ts", order, "error", "status"), "scan_url", ["ts", order], whole, block_rows)
    found = run.withColumn("trigger", trigger(F.col("requests"), F.col("errors"), F.col("s403"), F.col("s429"), threads)).where("trigger is not null")
    return found.groupBy("scan_url").agg(F.min_by(F.struct("trigger", "ts", "requests"), F.struct("ts", order)).alias("x")).select("scan_url", "x.trigger", "x.ts", "x.requests")


def trigger_directions(log: DataFrame, seconds: int = 3600) -> DataFrame:
    """(scan_url, since, errors, direction, streak) per window of time: down where errors came, else up with a streak.

    Windows without requests are not checks.
    """
    start = F.window("ts", f"{seconds} seconds").start
    checks = log.groupBy("scan_url", start.alias("since")).agg(F.count("error").alias("errors"))
    w = W.partitionBy("scan_url").orderBy("since")
    marked = checks.withColumn("island", F.sum((F.col("errors") > 0).cast("int")).over(w))
    up = F.col("errors") == 0
    streak = F.sum(up.cast("int")).over(W.partitionBy("scan_url", "island").orderBy("since"))
    return marked.select("scan_url", "since", "errors", F.when(up, F.lit("up")).otherwise(F.lit("down")).alias("direction"), F.when(up, streak).otherwise(0).cast("long").alias("streak"))


def first_seen(responses: DataFrame) -> DataFrame:
    """The earliest row of each (url, method)."""
    w = W.partitionBy("url", "method").orderBy("timestamp")
    return responses.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def top_terms(vocabulary: DataFrame, k: int) -> DataFrame:
    """The k terms of highest score, ties in order of the term."""
    return vocabulary.orderBy(F.desc("score"), "term").limit(k)


def remaining_words(words: DataFrame, offset: int) -> DataFrame:
    """Words from a position on."""
    return words.where(F.col("pos") >= offset)


def by_depth(found: DataFrame) -> DataFrame:
    """(url, depth) in order of depth, then url."""
    return found.select("url", urls.depth(F.col("url")).alias("depth")).orderBy("depth", "url")
