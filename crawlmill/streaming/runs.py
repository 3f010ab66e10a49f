"""Running a stream over what has landed so far, as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.storage import shared_path


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Everything that an append-mode stream emits over the files that are there."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last row of each key that an update-mode stream emits over the files that are there."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    each_batch(stream, keep, path)
    rows = spark.read.parquet(path)
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, "_last.*")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], path: str) -> None:
    """Run a foreachBatch step over the files that are there."""
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()


def sessions(stream: DataFrame, name: str) -> DataFrame:
    """Session windows over the files that are there, those still open included: a complete-mode run."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
