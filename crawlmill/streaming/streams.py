"""The same analyses over streams of responses and request logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlmill.constants import HIGH_ERROR_RATIO
from crawlmill.functions import measures, urls
from crawlmill.operators.aggregates import term_sums
from crawlmill.operators.extraction import script_links
from crawlmill.operators.rules import with_looked_up_hit


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the files that land in a folder, of fixed schema and bounded micro-batches."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def measured_responses(stream: DataFrame, rules: DataFrame | None = None, signature: str | None = None, headers: str | None = None) -> DataFrame:
    """Measures of each response; with a static rule table, of those only that no rule of any kind hits."""
    out = measures.with_measures(stream)
    return with_looked_up_hit(out, rules, signature, headers=headers).where("rule_kind is null").drop("rule_kind") if rules is not None else out


def first_seen(stream: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first row of each (url, method) within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url", "method"])


def running_statistics(stream: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests, errors and status classes per window of event time and scan."""
    kind = measures.status_class(F.col("status"))
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "scan_url")
    return rows.agg(F.count("*").alias("requests"), F.count("error").alias("errors"), *[F.count_if(kind == c).alias(n) for c, n in ((2, "successes"), (3, "redirects"), (4, "client_errors"), (5, "server_errors"))])


def request_rates(stream: DataFrame, width: str = "10 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Requests per window, tumbling or sliding."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(w, "scan_url").agg(F.count("*").alias("requests"))


def scan_sessions(stream: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests per scan between idle gaps."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "scan_url").agg(F.count("*").alias("requests"))


def unseen_links(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Links of script text that a scan has not shown within the delay. stream: scan_url, ts, text."""
    rows = stream.withWatermark("ts", delay)
    keyed = rows.withColumn("key", F.struct("scan_url", "ts"))
    found = script_links(keyed, "key").select("key.scan_url", "key.ts", "link")
    return found.dropDuplicatesWithinWatermark(["scan_url", "link"])


def unseen_extensions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", delay).select("ts", urls.extension(F.col("url")).alias("extension")).where("extension is not null")
    return rows.dropDuplicatesWithinWatermark(["extension"])


_COUNTS = "requests long, errors long, s403 long, s429 long, cooled long"
_OUT = "scan_url string, trigger string, ts timestamp, requests long"


class Policies:
    """Running counts of a scan; they leave the state when the watermark has passed the scan's last request by `idle` seconds.

    Counts come and go with the rows, many scans at a time, so that a scan costs no calls to the state store.
    """

    def __init__(self, threads: int, cool: float, idle: float):
        self.least, self.most_errors = max(threads, 50), max(threads // 2, 25)
        self.cool, self.idle = int(cool * 1e6), int(idle * 1e3)

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # a scan's rows of one micro-batch, in order of time
        parts = list(rows)
        ts, event_id, status, late = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("ts", "event_id", "status", "failed"))
        ts = ts.astype("datetime64[us]")
        order = np.lexsort((event_id, ts))
        ts, status, late = ts[order], status[order], late[order].astype(bool)
        n, errors, s403, s429, cooled = state.get if state.exists else (0, 0, 0, 0, -(1 << 62))
        now = ts.astype("int64")
        requests = n + np.arange(1, len(now) + 1)
        errors, s403, s429 = (x + np.cumsum(hit) for x, hit in ((errors, late), (s403, status == 403), (s429, status == 429)))
        kinds = [errors >= self.most_errors, s403 / requests >= HIGH_ERROR_RATIO, s429 / requests >= HIGH_ERROR_RATIO / 3]
        kind = np.select(kinds, [0, 1, 2], -1)
        ready = np.flatnonzero((kind >= 0) & (requests >= self.least))
        out, at = [], int(np.searchsorted(now[ready], cooled))
        while at < len(ready):
            i = ready[at]
            out.append(i)
            cooled = int(now[i]) + self.cool
            at = max(at + 1, int(np.searchsorted(now[ready], cooled)))
        state.update((int(requests[-1]), int(errors[-1]), int(s403[-1]), int(s429[-1]), cooled))
        state.setTimeoutTimestamp(max(int(now[-1]) // 1000, state.getCurrentWatermarkMs()) + max(self.idle, 1))
        if out:
            names = np.array(["Errors", "Status403", "Status429"], object)
            yield pd.DataFrame({"scan_url": key[0], "trigger": names[kind[out]], "ts": ts[out], "requests": requests[out]})


def policy_triggers(stream: DataFrame, threads: int = 50, timeout: float = 7.0, delay: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """A row whenever a scan's running counts trigger a policy, at most once per cool-down of min(timeout / 2, 30) s.

    Rows later than the watermark are dropped. A scan whose last request lies `idle` seconds behind the watermark leaves the
    state, and begins anew if it comes back. A scan's rows of one micro-batch are held in a worker.
    """
    rows = stream.select("scan_url", "event_id", "ts", "status", F.col("error").isNotNull().alias("failed")).withWatermark("ts", delay)
    return rows.groupBy("scan_url").applyInPandasWithState(Policies(threads, min(timeout / 2, 30.0), idle), _OUT, _COUNTS, "append", GroupStateTimeout.EventTimeTimeout)


def landed_terms(key: str, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: writes a micro-batch's sums per term (documents, sum of shares) and its number of documents.

    A batch that runs again replaces what its first try wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        term_sums(batch, key).write.mode("overwrite").parquet(f"{path}/terms/{number}")
        batch.agg(F.count("*").alias("docs")).write.mode("overwrite").parquet(f"{path}/docs/{number}")

    return step


def merged_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, tf): sums so far of the terms that a batch of landed sums changes; the state store merges them by term."""
    landed = spark.readStream.schema("term string, df long, tf double").parquet(f"{path}/terms/*")
    return landed.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def term_scores(sums: DataFrame, docs: int) -> DataFrame:
    """(term, df, score) of sums per term over `docs` documents, scores above 0."""
    score = F.col("tf") / F.col("df") * F.log10(F.lit(docs) / F.col("df"))
    return sums.select("term", "df", score.alias("score")).where("score > 0")
