"""Readers of run output, state files, word lists, targets and logs. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlmill.functions import measures, urls
from crawlmill.operators.rules import RULE_SCHEMA, matches_regex

#: Parts of a word list whose sizes one task sums up.
PARTS_PER_BLOCK = 4096
RESPONSE_SCHEMA = (
    "type string, url string, original_url string, path string, wildcard boolean, status int, method string, "
    "content_length long, line_count long, word_count long, headers map<string,string>, extension string, "
    "truncated boolean, timestamp double"
)
SCAN_SCHEMA = "id string, url string, normalized_url string, scan_type string, status string, num_requests long, requests_made_so_far long"
LOG_SCHEMA = "type string, message string, level string, time_offset float, module string"
_COUNTERS = (
    "timeouts requests expected_per_scan total_expected errors successes redirects client_errors server_errors total_scans "
    "initial_targets links_extracted extensions_collected status_200s status_301s status_302s status_401s status_403s "
    "status_429s status_500s status_503s status_504s status_508s wildcards_filtered responses_filtered "
    "resources_discovered url_format_errors redirection_errors connection_errors request_errors certificate_errors"
).split()
STATISTICS_SCHEMA = ", ".join(["type string", *[f"{c} long" for c in _COUNTERS], "directory_scan_times array<double>", "total_runtime array<double>", "targets array<string>"])
_RULE_FILE = (
    "filter_code int, line_count long, word_count long, content_length long, compiled string, raw_string string, "
    "hash decimal(20,0), original_url string, cutoff int, method string, status_code int, dont_filter boolean"
)
STATE_SCHEMA = f"scans array<struct<{SCAN_SCHEMA}>>, responses array<struct<{RESPONSE_SCHEMA}>>, statistics struct<{STATISTICS_SCHEMA}>, collected_extensions array<string>, filters array<struct<{_RULE_FILE}>>"


def _with_defaults(rows: DataFrame) -> DataFrame:
    values = {"url": "http://localhost", "original_url": "", "path": "", "wildcard": False, "status": 200, "method": "GET", "content_length": 0, "line_count": 0, "word_count": 0, "truncated": False, "timestamp": 0.0}
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in values.items()}
    filled["extension"] = F.when(F.col("extension") != "", F.col("extension"))
    return rows.withColumns(filled).withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long"))).drop("type")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response rows of an NDJSON file; missing keys take their defaults."""
    return _with_defaults(spark.read.schema(RESPONSE_SCHEMA).json(path).where("type = 'response'"))


def read_run_output(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same file split by type: responses, statistics, logs and configuration (as text)."""
    lines = spark.read.text(path).withColumn("type", F.get_json_object("value", "$.type"))

    def of(kind: str, schema: str) -> DataFrame:
        return lines.where(F.col("type") == kind).select(F.from_json("value", schema).alias("x")).select("x.*")

    return {"responses": _with_defaults(of("response", RESPONSE_SCHEMA)), "statistics": of("statistics", STATISTICS_SCHEMA), "logs": of("log", LOG_SCHEMA), "configuration": lines.where("type = 'configuration'").select("value")}


@dataclass(frozen=True)
class State:
    scans: DataFrame
    responses: DataFrame
    statistics: DataFrame
    collected_extensions: DataFrame
    rules: DataFrame


def rule_kind() -> Column:
    """A stored rule's kind by the fields that it has, tried in this order."""
    tests = [("regex", "raw_string"), ("words", "word_count"), ("wildcard", "dont_filter"), ("size", "content_length"), ("lines", "line_count"), ("similarity", "hash"), ("status", "filter_code")]
    plain = {"words", "size", "lines"}
    out = None
    for kind, field in tests:
        test = F.col(field).isNotNull() & (F.col("dont_filter").isNull() if kind in plain else F.lit(True))
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def read_state(spark: SparkSession, path: str) -> State:
    """A stored run, its arrays as tables. A cancelled scan counts as complete, an unknown status as not started."""
    whole = spark.read.schema(STATE_SCHEMA).json(path, multiLine=True)
    scans = whole.select(F.inline("scans"))
    status = F.when(F.col("status") == "Cancelled", F.lit("Complete")).when(F.col("status").isin("NotStarted", "Complete", "Running"), F.col("status")).otherwise(F.lit("NotStarted"))
    scans = scans.withColumn("status", status).withColumn("scan_type", F.when(F.col("scan_type") == "Directory", F.lit("Directory")).otherwise(F.lit("File")))
    rules = whole.select(F.inline("filters")).withColumn("kind", rule_kind()).where("kind is not null")
    # hashes above 2^63 - 1 keep their bits in a signed long
    two63, two64 = "9223372036854775808", "18446744073709551616"
    signed = F.expr(f"cast(case when hash >= cast('{two63}' as decimal(20,0)) then hash - cast('{two64}' as decimal(20,0)) else hash end as bigint)")
    rules = rules.withColumn("hash", signed).withColumn("regex", F.col("raw_string"))
    return State(scans, _with_defaults(whole.select(F.inline("responses"))), whole.select("statistics.*"), whole.select(F.explode("collected_extensions").alias("extension")), rules.select(*[x.split()[0] for x in RULE_SCHEMA.split(", ")]))


def read_state_files(spark: SparkSession, path: str) -> State:
    """A state of write_state_files; an error where its manifest is missing or counts other rows than its parts have."""
    manifest = {r["part"]: r["rows"] for r in spark.read.schema("part string, rows long").json(f"{path}/manifest").collect()}  # five at most
    state = read_state(spark, f"{path}/parts/*")
    there = {"scans": state.scans, "responses": state.responses, "collected_extensions": state.collected_extensions}
    for name, table in there.items():
        if table.count() != manifest.get(name, 0):
            raise ValueError(f"{path}: {name} has not the {manifest.get(name, 0)} rows of the manifest")
    return State(state.scans, state.responses, state.statistics.where(F.col("requests").isNotNull()), state.collected_extensions, state.rules)


def words_of(lines: DataFrame, value: str = "value") -> DataFrame:
    """(pos, word) of lines in (part, line) order: no empty and no # lines, leading slashes off, an empty word first.

    Positions are dense: each part numbers its own lines, and adds the lines of the parts before it.
    """
    word = F.regexp_replace(value, "\r$", "")
    rows = lines.withColumn("w", word).where("w <> '' and not startswith(w, '#')").select("part", "line", F.ltrim("w", F.lit("/")).alias("word"))
    # lines before a part: those of its block of parts, and of the blocks before; no task sums up all parts
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("part") / PARTS_PER_BLOCK))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("bn"))
    blocks = blocks.select("block", (F.sum("bn").over(W.orderBy("block")) - F.col("bn")).alias("earlier"))
    within = F.sum("n").over(W.partitionBy("block").orderBy("part")) - F.col("n")
    sizes = sizes.withColumn("within", within).join(blocks, "block").select("part", (F.col("earlier") + F.col("within")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy("line"))
    numbered = rows.withColumn("own", own).join(sizes, "part").select((F.col("before") + F.col("own")).cast("long").alias("pos"), "word")
    first = lines.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("").alias("word"))
    return first.unionByName(numbered)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word) of a word list, in file order; words that repeat stay."""
    lines = spark.read.text(path, lineSep="\n").withColumn("at", F.monotonically_increasing_id())
    return words_of(lines.select("value", F.shiftright("at", 33).alias("part"), F.col("at").alias("line")))


def read_targets(targets: DataFrame, deny: Sequence[str] = (), deny_regex: Sequence[str] = (), protocol: str = "https") -> DataFrame:
    """targets (target) with a protocol where they have none; an excluded target is an error."""
    rows = targets.withColumn("target", F.when(~F.col("target").startswith("http"), F.concat(F.lit(f"{protocol}://"), "target")).otherwise(F.col("target")))
    bare = F.rtrim("target", F.lit("/"))
    bad = rows.where(bare.isin([d.rstrip("/") for d in deny]) | matches_regex(deny_regex, "target")).first()
    if bad:
        raise ValueError(f"target {bad['target']} is excluded")
    return rows


def responses_from(captured: DataFrame, url: str = "url", body: str = "body", status: str | None = "status", method: str | None = None, headers: str | None = None, limit: int | None = None) -> DataFrame:
    """Responses of any captured table: url, status, method, headers, text, truncated and the measures."""
    data = F.col(body).cast("binary")
    text = measures.capped_text(data, limit) if limit else F.make_valid_utf8(data.cast("string"))
    cut = measures.is_truncated(data, limit) if limit else F.lit(False)
    made = captured.select(
        F.col(url).alias("url"),
        (F.col(status) if status else F.lit(200)).cast("int").alias("status"),
        (F.col(method) if method else F.lit("GET")).alias("method"),
        (F.col(headers) if headers else F.create_map().cast("map<string,string>")).alias("headers"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(cut, F.lit(False)).alias("truncated"),
        urls.extension(F.col(url)).alias("extension"),
    )
    return measures.with_measures(made)


def read_logs(spark: SparkSession, path: str, least: str | None = None) -> DataFrame:
    """Log rows; with `least`, only those of that level or above."""
    levels = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]
    rows = spark.read.schema(LOG_SCHEMA).json(path).where("type = 'log'").drop("type")
    return rows.where(F.col("level").isin(levels[levels.index(least) :])) if least else rows


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level", "module").agg(F.count("*").alias("messages"))
