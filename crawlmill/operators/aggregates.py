"""Statistics of runs, scans, probes and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.constants import IGNORED_EXTENSIONS, STATUS_CODES
from crawlmill.functions import measures, urls
from crawlmill.functions.text import term_counter, terms
from crawlmill.operators.joins import owning_scan
from crawlmill.operators.windows import BLOCK_ROWS, numbered
from crawlmill.storage import written

#: Status codes and error kinds that run statistics count one by one.
COUNTED_CODES = [200, 301, 302, 401, 403, 429, 500, 503, 504, 508]
ERROR_KINDS = ["timeout", "url_format", "redirection", "connection", "request", "certificate"]


def run_statistics(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of requests, errors by kind, status classes and single codes; one row, or one per value of `by`."""
    kind = measures.status_class(F.col("status"))
    aggs = [F.count_if(F.col("status").isNotNull() | F.col("error").isNotNull()).alias("requests"), F.count("error").alias("errors")]
    aggs += [F.count_if(F.col("error") == k).alias(f"{k}_errors") for k in ERROR_KINDS]
    aggs += [F.count_if(kind == c).alias(n) for c, n in ((2, "successes"), (3, "redirects"), (4, "client_errors"), (5, "server_errors"))]
    aggs += [F.count_if(F.col("status") == c).alias(f"status_{c}s") for c in COUNTED_CODES]
    return log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)


def host_rollup(responses: DataFrame) -> DataFrame:
    """Responses per host and status class, per host, and in all."""
    rows = responses.select(urls.host(F.col("url")).alias("host"), measures.status_class(F.col("status")).alias("status_class"))
    return rows.rollup("host", "status_class").agg(F.count("*").alias("responses"))


def scan_counters(log: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    """Requests, errors, 403s and 429s of each scan; a request belongs to the deepest scan above its url."""
    owned = log.join(owning_scan(log, scans, key), key) if "scan_url" not in log.columns else log.drop("scan_url").join(owning_scan(log, scans, key), key)
    return owned.groupBy("scan_url").agg(F.count("*").alias("requests"), F.count("error").alias("errors"), F.count_if(F.col("status") == 403).alias("status_403s"), F.count_if(F.col("status") == 429).alias("status_429s"))


#: Statistics that a merge does not add up.
NOT_MERGED = ["expected_per_scan", "total_expected", "total_scans", "initial_targets", "certificate_errors", "total_runtime", "targets"]


def merged_statistics(current: DataFrame, others: DataFrame) -> DataFrame:
    """Statistics of several runs: counters add up, but NOT_MERGED keep the current run's values; durations append.

    Columns are long counters, and directory_scan_times as an array.
    """
    both = current.withColumn("now", F.lit(True)).unionByName(others.withColumn("now", F.lit(False)), allowMissingColumns=True)
    aggs = []
    for c, kind in current.dtypes:
        if c in NOT_MERGED:
            aggs.append(F.max(F.when(F.col("now"), F.col(c))).alias(c))
        elif kind.startswith("array"):
            aggs.append(F.flatten(F.collect_list(c)).alias(c))
        else:
            aggs.append(F.sum(c).alias(c))
    return both.agg(*aggs)


def probe_rules(probes: DataFrame, status_codes: Sequence[int] = STATUS_CODES) -> DataFrame:
    """404-like signatures: within target, method, extension and status, the measures on which all probes agree.

    Groups of fewer than two probes, targets with fewer than two probes in all, and groups that agree on nothing give
    no rule. Each status is judged by itself.
    """
    keys = ["target", "method", "extension"]
    rows = probes.where(F.col("status").isin(list(status_codes)))
    same = [F.when(F.min(m) == F.max(m), F.min(m)).alias(m) for m in ("content_length", "word_count", "line_count")]
    found = rows.groupBy(*keys, "status").agg(F.count("*").alias("probes"), *same, F.min_by("url", F.struct("timestamp", "url")).alias("representative"))
    return found.where("probes >= 2 and coalesce(content_length, word_count, line_count) is not null")


def wildcard_directories(rules: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, is_wildcard_directory): whether any representative of the target's rules is a directory."""
    reps = rules.select("target", F.col("representative").alias("url")).join(probes.select("url", "status", "location").dropDuplicates(["url"]), "url")
    found = F.bool_or(measures.is_directory(F.col("status"), F.col("url"), F.col("location")))
    return reps.groupBy("target").agg(F.coalesce(found, F.lit(False)).alias("is_wildcard_directory"))


def term_counts(docs: DataFrame, key: str, text: str = "text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """(key, term, n, n_terms) of each document."""
    listed = terms(F.coalesce(F.col(text), F.lit("")), stop_words) if stop_words is not None else terms(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key, listed.alias("terms")).select(key, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    return rows.groupBy(key, "n_terms", "term").agg(F.count("*").alias("n"))


#: Terms of documents that a task sums up at a time.
SUMMED = 1 << 19


def _summed(texts: DataFrame, stop_words: Sequence[str] | None, most: int) -> DataFrame:
    """(term, df, tf) of a column of texts, each a document: sums of some documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = term_counter(stop_words) if stop_words is not None else term_counter()
        found, shares = [], []

        def sent() -> Iterator[pa.RecordBatch]:
            rows = pa.table({"term": pa.array(found, pa.string()), "share": pa.array(shares, pa.float64())})
            sums = rows.group_by("term").aggregate([("share", "count"), ("share", "sum")])
            yield from sums.select(["term", "share_count", "share_sum"]).rename_columns(["term", "df", "tf"]).to_batches()

        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                counts = counted(text.decode(errors="replace"))
                total = sum(counts.values())
                found += counts
                shares += [n / total for n in counts.values()]
                if len(found) > most:
                    yield from sent()
                    found, shares = [], []
        yield from sent()

    return texts.mapInArrow(run, "term string, df long, tf double")


def term_sums(docs: DataFrame, key: str, text: str = "text", stop_words: Sequence[str] | None = None, most: int = SUMMED) -> DataFrame:
    """(term, df, tf): how many documents hold each term, and the sum of its shares of their terms.

    Tasks sum up their documents before anything moves, so a row moves for each term of a task, not of a document. Rows that share their key
    count as term_counts does; whether there are any is seen when the plan is made.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("key").alias("again"))
    if again.isEmpty():
        sums = _summed(rows.select("text"), stop_words, most)
    else:
        same = F.col("key").eqNullSafe(F.col("again"))
        counts = term_counts(rows.join(again, same, "left_semi"), "key", stop_words=stop_words)
        shares = counts.select("term", F.lit(1).cast("long").alias("df"), (F.col("n") / F.col("n_terms")).alias("tf"))
        sums = _summed(rows.join(again, same, "left_anti").select("text"), stop_words, most).unionByName(shares)
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(docs: DataFrame, key: str, text: str = "text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """(term, df, score): mean over the documents that hold a term of tf x idf, idf = log10(documents / df).

    Terms of every document score nothing and go. The number of documents is one row, joined to all.
    """
    total = docs.agg(F.count("*").alias("docs"))
    sums = term_sums(docs, key, text, stop_words)
    scored = sums.join(F.broadcast(total)).select("term", "df", (F.col("tf") / F.col("df") * F.log10(F.col("docs") / F.col("df"))).alias("score"))
    return scored.where("score > 0")


def refresh_point(docs: int) -> int:
    """After how many documents scores were last worked out anew: after 2, 4, and then every twelfth."""
    return docs - docs % 12 if docs >= 12 else 4 if docs >= 4 else 2 if docs >= 2 else 0


def refreshed_vocabulary(docs: DataFrame, key: str, order: Sequence[str], text: str = "text", stop_words: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(term, df, score) as of the last refresh, when documents come in order of the columns: see refresh_point.

    Fewer than twelve documents came since, so the last ones are looked up and texts stay where they are. Rows of equal order
    are told apart by a hash; those of the last document's order and hash alone are numbered, in any way.
    """
    n = docs.count()
    gone = n - refresh_point(n)
    if not gone:
        return vocabulary(docs, key, text, stop_words)
    names, hashed = [F.col(c) for c in order], F.xxhash64(*order, text)
    last = docs.select(*[c.alias(f"o{i}") for i, c in enumerate(names)], hashed.alias("hash"))
    # in descending order nulls come last, as they come first in ascending order
    last = last.orderBy(*[F.desc(c) for c in last.columns]).limit(gone)
    at = last.select(F.struct("*").alias("_at")).groupBy("_at").agg(F.count("*").alias("_gone")).orderBy("_at").limit(1)
    at = written(at, "refresh")  # one row: the first of the last documents, and how many of those are equal to it
    own = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(names)], hashed.alias("hash"))
    placed = docs.select(F.struct("*").alias("_doc"), own.alias("_own")).crossJoin(F.broadcast(at))
    seen = placed.where(F.col("_own") < F.col("_at")).select("_doc.*")
    same = placed.where(F.col("_own") == F.col("_at"))
    ties = numbered(same.select("_doc.*"), [*order], block_rows).where(F.col("place") > at.first()["_gone"]).drop("place")
    return vocabulary(seen.unionByName(ties), key, text, stop_words)


def collected_extensions(responses: DataFrame, ignored: Sequence[str] = IGNORED_EXTENSIONS, configured: Sequence[str] = ()) -> DataFrame:
    """(extension, responses) of reported responses, without ignored and configured ones."""
    rows = responses.where(measures.is_reported(F.col("status"))).select(urls.extension(F.col("url")).alias("extension")).where("extension is not null")
    return rows.where(~F.col("extension").isin([*ignored, *configured])).groupBy("extension").agg(F.count("*").alias("responses"))


def expected_requests(scans: DataFrame, words: int, extensions: int, collected: int, methods: int) -> DataFrame:
    """(url, expected): words times one more than the extensions, times the methods, for each directory scan."""
    each = words * (1 + extensions + collected) * max(methods, 1)
    return scans.where("scan_type = 'Directory'").select("url", F.lit(each).cast("long").alias("expected"))


def scan_durations(times: DataFrame) -> DataFrame:
    """Least, mean, largest and quartile seconds, and their sum, of (seconds)."""
    quarter = F.percentile_approx("seconds", [0.25, 0.5, 0.75], 10_000).alias("quartiles")
    return times.agg(F.min("seconds").alias("least"), F.avg("seconds").alias("mean"), F.max("seconds").alias("largest"), F.sum("seconds").alias("total"), quarter)


def elapsed_seconds(ts: str) -> Column:
    """Seconds between the first and the last time of a group."""
    first, last = (F.unix_micros(f(F.col(ts).cast("timestamp"))) for f in (F.min, F.max))
    return last / 1e6 - first / 1e6


def request_rates(log: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_url, rate): whole requests a second of active directory scans, 0 for others and where no time passed."""
    seen = log.groupBy("scan_url").agg(F.count("*").alias("n"), elapsed_seconds("ts").alias("s"))
    joined = scans.select(F.col("url").alias("scan_url"), "scan_type", "status").join(seen, "scan_url", "left")
    live = (F.col("scan_type") == "Directory") & (F.col("status") == "Running") & (F.col("s") > 0)
    return joined.select("scan_url", F.when(live, F.floor(F.col("n") / F.col("s"))).otherwise(0).cast("long").alias("rate"))


def discovery_totals(marked: DataFrame) -> DataFrame:
    """Counts over responses with rule_kind: discovered (reported, first seen, no rule), filtered by any rule, by kind wildcard."""
    first = marked.where("rule_kind is null").where(measures.is_reported(F.col("status"))).select("url", "method").distinct().agg(F.count("*").alias("resources_discovered"))
    hits = marked.agg(F.count("rule_kind").alias("responses_filtered"), F.count_if(F.col("rule_kind") == "wildcard").alias("wildcards_filtered"))
    return first.join(F.broadcast(hits))


def scan_listing(scans: DataFrame) -> DataFrame:
    """Directory scans by status."""
    return scans.where("scan_type = 'Directory'").groupBy("status").agg(F.count("*").alias("scans"))


def rule_listing(rules: DataFrame) -> DataFrame:
    """Distinct rules by kind."""
    return rules.dropDuplicates().groupBy("kind").agg(F.count("*").alias("rules"))
