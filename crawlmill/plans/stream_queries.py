"""Streams over the events, pages and documents files, run over what is there; each gives what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions import measures, urls
from crawlmill.operators import rules
from crawlmill.plans import adapters as A
from crawlmill.plans.queries import _COARSE, _FILE_URL, _HIT_SQL, _RUNNING, _SCRIPT_ROWS, _TERMS, _WILD_HIT, _WILD_SQL, _files, _hit_rules, _wild_rules, query
from crawlmill.sources import sinks
from crawlmill.storage import shared_path
from crawlmill.streaming import runs, streams

def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = A.table(spark, sf_dir, name).schema
    # a pattern, as a stream's folder may be a single file here
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")


def _log(spark, sf_dir):
    return A.log_rows(_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _pages(spark, sf_dir):
    p = _stream(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.lit("all").alias("scan_url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("ts"), F.col("html").alias("text"))


@query(f"WITH {A.RESP} SELECT page_id, content_length, line_count, word_count FROM resp")
def st1_measured(spark, sf_dir):
    return runs.appended(streams.measured_responses(_pages(spark, sf_dir)).select("page_id", "content_length", "line_count", "word_count"), "st1")


def _coarse(rows):
    return rows.withColumns({c: F.floor(F.col(c) / d).cast("long") for c, d in (("content_length", 4000), ("word_count", 200), ("line_count", 50))})


@query(f"WITH {_WILD_SQL}, r AS ({_COARSE}) SELECT page_id, status FROM r WHERE NOT EXISTS (SELECT 1 FROM rule f WHERE {_WILD_HIT})")
def st1_without_wildcards(spark, sf_dir):
    rows = _coarse(measures.with_measures(A.page_rows(_stream(spark, sf_dir, "pages"))))
    return runs.appended(rules.without_wildcards(rows, _wild_rules(spark, sf_dir)).select("page_id", "status"), "st1-rules")


@query(f"{_HIT_SQL} SELECT page_id, rule_kind FROM hit")
def st1_attributed(spark, sf_dir):
    rows = _coarse(measures.with_measures(A.page_rows(_stream(spark, sf_dir, "pages"))))
    return runs.appended(rules.with_looked_up_hit(rows, _hit_rules(spark, sf_dir)).select("page_id", "rule_kind"), "st1-attributed")


@query(f"WITH {A.LOG} SELECT DISTINCT scan_url AS url, method FROM log")
def st2_first_seen(spark, sf_dir):
    rows = _log(spark, sf_dir).select("ts", F.col("scan_url").alias("url"), "method")
    # the stream forgets after an hour of event time; what it shows again then is dropped from the table
    return runs.appended(streams.first_seen(rows, "1 hour").select("url", "method"), "st2").distinct()


@query(f"""WITH {A.LOG} SELECT time_bucket(INTERVAL 1 DAY, ts) AS since, scan_url, count(*) AS requests, count(error) AS errors, count(*) FILTER (status // 100 = 2) AS successes,
  count(*) FILTER (status // 100 = 3) AS redirects, count(*) FILTER (status // 100 = 4) AS client_errors, count(*) FILTER (status // 100 = 5) AS server_errors FROM log GROUP BY 1, 2""")
def st3_running_statistics(spark, sf_dir):
    found = streams.running_statistics(_log(spark, sf_dir), "1 day", "2 hours")
    return runs.latest(found.withColumn("since", F.col("window.start")).drop("window"), ["since", "scan_url"], "st3")


@query(f"""WITH {A.LOG}, {_RUNNING.replace('>= 10', '>= 25')}, f AS (SELECT *, row_number() OVER (PARTITION BY scan_url ORDER BY ts, event_id) AS p FROM t WHERE trigger IS NOT NULL)
SELECT scan_url, trigger, requests FROM f WHERE p = 1""")
def st4_policy_triggers(spark, sf_dir):
    found = runs.appended(streams.policy_triggers(_log(spark, sf_dir), delay="2 hours", idle=90 * 86400.0), "st4")
    return found.groupBy("scan_url").agg(F.min_by(F.struct("trigger", "requests"), "requests").alias("x")).select("scan_url", "x.*")


@query(f"WITH {_SCRIPT_ROWS} SELECT DISTINCT link FROM x2")
def st5_unseen_links(spark, sf_dir):
    return runs.appended(streams.unseen_links(_pages(spark, sf_dir)).select("link"), "st5").distinct()


@query(f"""WITH u AS (SELECT {_FILE_URL} AS url FROM pages), p AS (SELECT list_filter(string_split(string_split({A.PATH.format('url')}, '/')[-1], '.'), lambda x: x <> '') AS parts FROM u)
SELECT DISTINCT parts[-1] AS extension FROM p WHERE len(parts) > 1""")
def st5_unseen_extensions(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("ts", _files().alias("url"))
    return runs.appended(streams.unseen_extensions(rows).select("extension"), "st5-extensions").distinct()


@query(f"WITH {_TERMS} SELECT term, df, round(score, 9) AS score FROM v WHERE score > 0")
def st6_vocabulary(spark, sf_dir):
    path = shared_path(spark, "st6-terms")
    docs = _stream(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs.each_batch(docs, streams.landed_terms("doc_id", path), path)
    sums = runs.latest(streams.merged_terms(spark, path), ["term"], "st6")
    n = spark.read.parquet(f"{path}/docs/*").agg(F.sum("docs")).first()[0]
    return streams.term_scores(sums, n).select("term", "df", F.round("score", 9).alias("score"))


@query(f"WITH {A.LOG} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS since, scan_url, count(*) AS requests FROM log GROUP BY 1, 2")
def st7_request_rates(spark, sf_dir):
    found = streams.request_rates(_log(spark, sf_dir), "1 hour", delay="2 hours")
    return runs.latest(found.withColumn("since", F.col("window.start")).drop("window"), ["since", "scan_url"], "st7")


@query(f"""WITH {A.LOG}, s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, scan_url FROM log), w AS (SELECT b - to_hours(k) AS since, scan_url FROM s, (SELECT unnest([0, 1]) AS k))
SELECT since, scan_url, count(*) AS requests FROM w GROUP BY 1, 2""")
def st7_sliding_rates(spark, sf_dir):
    found = streams.request_rates(_log(spark, sf_dir), "2 hours", "1 hour", "2 hours")
    return runs.latest(found.withColumn("since", F.col("window.start")).drop("window"), ["since", "scan_url"], "st7-sliding")


@query(f"""WITH {A.LOG}, g AS (SELECT scan_url, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY scan_url ORDER BY ts)),
s AS (SELECT scan_url, ts, sum(fresh) OVER (PARTITION BY scan_url ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT scan_url, min(ts) AS since, count(*) AS requests FROM s GROUP BY scan_url, n""")
def st7_sessions(spark, sf_dir):
    found = streams.scan_sessions(_log(spark, sf_dir), "12 hours", "1 second")
    return runs.sessions(found.select("session_window", "scan_url", "requests"), "st7-sessions").select("scan_url", F.col("session_window.start").alias("since"), "requests")


@query()
def k1_streamed_json(spark, sf_dir):
    """K1 over a stream of pages: what the streaming sink writes."""
    path = shared_path(spark, "k1")
    pages = measures.with_measures(A.page_rows(_stream(spark, sf_dir, "pages"))).drop("text")
    empty = {"path": urls.path(F.col("url")), "wildcard": F.lit(False), "headers": F.create_map().cast("map<string,string>"), "extension": urls.extension(F.col("url")), "truncated": F.lit(False)}
    sinks.stream_responses(pages.withColumns(empty), path, f"{path}-state").awaitTermination()
    return spark.read.text(path)
