"""Whole binary files through Spark's own writers and readers.

Executors cannot open a remote store, but Spark's text writer stores the bytes of a string column as they are, with a
set separator after each row, and the binaryFile reader returns whole files. A file format whose rows end in that
separator byte can so be written to any store that Spark knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, column: str, path: str, end: str, rows_per_file: int = 0) -> None:
    """Write a binary column, each row followed by the one-byte `end`, a file per partition (or per rows_per_file)."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", rows_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file that is not empty."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
