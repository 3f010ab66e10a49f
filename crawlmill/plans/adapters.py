"""The given tables seen as responses, request logs, words, targets, scans and probes; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions import measures, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status(key: str) -> Column:
    k = F.col(key) % 10
    return F.when(k == 6, 301).when(k == 7, 403).when(k == 8, 404).when(k == 9, 500).otherwise(200).cast("int")


def resp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: url, original_url, method, status, location, timestamp, text."""
    return page_rows(table(spark, sf_dir, "pages"))


def page_rows(p: DataFrame) -> DataFrame:
    p = p.withColumn("status", _status("page_id"))
    bare, kind = F.regexp_extract("url", r"^([^?#]*)", 1), F.col("page_id") % 60
    name = F.regexp_extract(bare, "([^/]*)$", 1)
    location = F.when(kind == 6, F.concat("url", F.lit("/"))).when(kind == 16, F.lit("/moved")).when(kind == 26, F.concat(name, F.lit("/")))
    location = location.when(kind == 36, F.concat(F.lit("./"), name, F.lit("/"))).when(kind == 46, F.concat(F.regexp_extract(bare, "^[^:]*:(.*)$", 1), F.lit("/")))
    return p.select("page_id", "url", F.concat(urls.origin(F.col("url")), F.lit("/")).alias("original_url"), F.lit("GET").alias("method"), "status", location.alias("location"), (F.lit(1.7e9) + F.col("page_id")).alias("timestamp"), F.col("html").alias("text"))


def measured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.with_measures(resp_pages(spark, sf_dir)).drop("text")


def resp_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("http://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit("GET").alias("method"), _status("doc_id").alias("status"), "text")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: event_id, ts, scan_url, url, method, status, error."""
    return log_rows(table(spark, sf_dir, "events"))


def log_rows(e: DataFrame) -> DataFrame:
    scan = F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit("/"))
    status = F.when(F.col("event_type").isin("click", "view"), 200).when(F.col("event_type") == "purchase", 301).when(F.col("event_type") == "signup", F.when(F.col("user_id") % 3 == 0, 403).otherwise(429))
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, F.lit("timeout")).otherwise(F.lit("connection")))
    return e.select("event_id", "ts", scan.alias("scan_url"), F.concat(scan, F.col("event_id").cast("string")).alias("url"), F.lit("GET").alias("method"), status.cast("int").alias("status"), error.alias("error"))


def words_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): distinct first words of documents that are plain."""
    first = F.regexp_extract("text", r"^([A-Za-z0-9_-]+)", 1)
    return table(spark, sf_dir, "documents").select(first.alias("word")).where("word <> ''").distinct()


def targets_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("target")).distinct()


def scans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of each page's host, and of its first folder where page_id is even: url, scan_type, status, requests."""
    p = table(spark, sf_dir, "pages")
    folder = F.regexp_extract("url", r"^([a-z]+://[^/]+/[^/?#]+/)", 1)
    host = p.select(F.concat(urls.origin(F.col("url")), F.lit("/")).alias("url"))
    deep = p.where("page_id % 2 = 0").select(folder.alias("url")).where("url <> ''")
    s = host.unionByName(deep).distinct()
    n = F.length("url")
    status = F.when(n % 3 == 0, F.lit("Complete")).when(n % 3 == 1, F.lit("Running")).otherwise(F.lit("NotStarted"))
    return s.select("url", F.when(n % 5 == 0, F.lit("File")).otherwise(F.lit("Directory")).alias("scan_type"), status.alias("status"), (n % 7).cast("long").alias("requests_made_so_far"))


def probe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page as a probe of its host, its measures made coarse so that probes agree at times."""
    r = measured_pages(spark, sf_dir).where("page_id % 5 = 0")
    coarse = {c: F.floor(F.col(c) / d).cast("long") for c, d in (("content_length", 4000), ("word_count", 200), ("line_count", 50))}
    return r.withColumns(coarse).withColumns({"target": urls.host(F.col("url")), "extension": F.lit("")})


#: The adapters as SQL, for use before a query: WITH {RESP}, {LOG} ...
_STATUS = "CASE {0} % 10 WHEN 6 THEN 301 WHEN 7 THEN 403 WHEN 8 THEN 404 WHEN 9 THEN 500 ELSE 200 END"
LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, chr(10))) - CAST(suffix({0}, chr(10)) AS INTEGER) END"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\t-\r\x{{85}}\p{{Z}}]+'), lambda x: x <> ''))"
HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
ORIGIN = "regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
PATH = "(CASE WHEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) END)"
_NAME = "regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '([^/]*)$', 1)"
RESP = f"""resp AS (SELECT page_id, url, {ORIGIN.format('url')} || '/' AS original_url, 'GET' AS method,
  {_STATUS.format('page_id')} AS status,
  CASE page_id % 60 WHEN 6 THEN url || '/' WHEN 16 THEN '/moved' WHEN 26 THEN {_NAME} || '/' WHEN 36 THEN './' || {_NAME} || '/'
    WHEN 46 THEN regexp_extract(url, '^[^:?#]*:([^?#]*)', 1) || '/' END AS location, 1.7e9 + page_id AS timestamp,
  html AS text, strlen(html) AS content_length, {LINES.format('html')} AS line_count, {WORDS.format('html')} AS word_count FROM pages)"""
DOCS = f"""rdocs AS (SELECT doc_id, 'http://' || source || '.example/' || lang || '/' || doc_id AS url, 'GET' AS method, {_STATUS.format('doc_id')} AS status, text FROM documents)"""
LOG = """log AS (SELECT event_id, ts, 'http://h' || user_id || '/' AS scan_url, 'http://h' || user_id || '/' || event_id AS url, 'GET' AS method,
  CASE WHEN event_type IN ('click', 'view') THEN 200 WHEN event_type = 'purchase' THEN 301
       WHEN event_type = 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 403 ELSE 429 END END AS status,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'connection' END END AS error FROM events)"""
WORDLIST = "wordlist AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z0-9_-]+)', 1) AS word FROM documents WHERE regexp_extract(text, '^([A-Za-z0-9_-]+)', 1) <> '')"
TARGETS = f"targets AS (SELECT DISTINCT {ORIGIN.format('url')} AS target FROM pages)"
SCANS = f"""scans AS (SELECT url, CASE WHEN length(url) % 5 = 0 THEN 'File' ELSE 'Directory' END AS scan_type,
  CASE length(url) % 3 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Running' ELSE 'NotStarted' END AS status, length(url) % 7 AS requests_made_so_far
  FROM (SELECT {ORIGIN.format('url')} || '/' AS url FROM pages
        UNION SELECT regexp_extract(url, '^([a-z]+://[^/]+/[^/?#]+/)', 1) FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '^([a-z]+://[^/]+/[^/?#]+/)', 1) <> ''))"""
PROBES = f"""probes AS (SELECT page_id, url, method, status, location, timestamp, {HOST.format('url')} AS target, '' AS extension,
  content_length // 4000 AS content_length, word_count // 200 AS word_count, line_count // 50 AS line_count FROM resp WHERE page_id % 5 = 0)"""
