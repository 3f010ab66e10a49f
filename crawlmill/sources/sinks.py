"""Writers of responses, report lines and run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlmill.functions import measures

_FIELDS = "type url original_url path wildcard status method content_length line_count word_count headers extension truncated timestamp".split()


def response_json(responses: DataFrame) -> DataFrame:
    """(value): one JSON object per response, fields in fixed order; a missing extension is an empty text."""
    rows = responses.withColumn("type", F.lit("response")).withColumn("extension", F.coalesce("extension", F.lit("")))
    return rows.select(F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def write_responses(responses: DataFrame, path: str) -> None:
    response_json(responses).write.text(path)


def stream_responses(responses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing a stream of responses as write_responses does; a restart with the same checkpoint goes on where it stopped.

    Takes what has landed and ends; files that a failed batch left are not part of the log that readers of the folder follow.
    """
    return response_json(responses).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def report_line(location: Column | None = None) -> Column:
    """status, method, lines, words and bytes in columns, then the url, with `=> target` for redirects."""
    target = measures.redirect_target(F.col("status"), F.col("url"), location) if location is not None else F.lit(None).cast("string")
    shown = F.when(target.isNotNull(), F.concat("url", F.lit(" => "), target)).otherwise(F.col("url"))
    sizes = [F.lpad(F.col(c).cast("string"), 8, " ") for c in ("line_count", "word_count", "content_length")]
    line = F.concat(F.col("status").cast("string"), F.lit(" "), F.lpad("method", 8, " "), F.lit(" "), sizes[0], F.lit("l "), sizes[1], F.lit("w "), sizes[2], F.lit("c "), shown)
    return F.when(F.col("truncated"), F.concat(line, F.lit(" (truncated to size limit)"))).otherwise(line)


def report_lines(responses: DataFrame, silent: bool = False, location: Column | None = None) -> DataFrame:
    return responses.select((F.col("url") if silent else report_line(location)).alias("value"))


def write_report(responses: DataFrame, path: str, silent: bool = False, location: Column | None = None) -> None:
    report_lines(responses, silent, location).write.text(path)


def write_state(path: str, **tables: DataFrame) -> None:
    """Each part of a run's state as a Parquet table under path."""
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")


#: Rows that one file of a state's part holds.
CHUNK_ROWS = 10_000


def write_state_files(path: str, chunk_rows: int = CHUNK_ROWS, **parts: DataFrame) -> None:
    """A run's state as nested JSON of any size: parts are those of state_json, in its columns.

    Each file is an object with some rows of one part, at most about chunk_rows; a manifest with each part's number of rows
    comes last, so a state without one is incomplete. read_state_files takes the objects as one state.
    """
    sizes = {}
    for name, rows in parts.items():
        sizes[name] = rows.count()
        item = F.col(rows.columns[0]) if name == "collected_extensions" else F.struct(*rows.columns)
        dealt = rows.select(item.alias("item")).repartition(max(1, -(-sizes[name] // chunk_rows))).groupBy(F.spark_partition_id().alias("chunk"))
        value = F.first("item") if name == "statistics" else F.collect_list("item")
        written = dealt.agg(value.alias(name)).select(F.to_json(F.struct(name)).alias("value"))
        written.write.option("maxRecordsPerFile", 1).text(f"{path}/parts/{name}")
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([*sizes.items()], "part string, rows long").coalesce(1).write.json(f"{path}/manifest")


def state_json(scans: DataFrame, responses: DataFrame, statistics: DataFrame, extensions: DataFrame, rules: DataFrame) -> DataFrame:
    """(value): a whole small state as one JSON object, for exports; large states go to write_state."""
    lists = [t.agg(F.collect_list(F.struct(*t.columns)).alias(n)) for n, t in (("scans", scans), ("responses", responses), ("filters", rules))]
    lists.append(extensions.agg(F.collect_list("extension").alias("collected_extensions")))
    lists.append(statistics.limit(1).select(F.struct(*statistics.columns).alias("statistics")))
    out = lists[0]
    for one in lists[1:]:
        out = out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct("*")).alias("value"))
