"""Recursion, resumption and whole discovery over captured responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.constants import MAX_DEPTH
from crawlmill.functions import measures, urls
from crawlmill.operators.joins import captured_candidates, named_cuts, outside_wildcards, unseen_responses, unseen_scans
from crawlmill.operators.rules import excluded_urls, with_first_hit
from crawlmill.storage import written


def base_depths(rows: DataFrame, targets: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, base_depth): depth of the last target whose text begins the url, else 1. targets: (pos, target).

    Targets meet urls of their own origin by equality; the text is compared after that.
    """
    t = targets.select("pos", "target", urls.origin(F.col("target")).alias("o"), urls.depth(F.col("target")).alias("d"))
    r = rows.select(key, F.col(url).alias("u"), urls.origin(F.col(url)).alias("o"))
    hits = r.join(t, "o").where(F.col("u").startswith(F.col("target"))).groupBy(key).agg(F.max_by("d", "pos").alias("base_depth"))
    return rows.select(key).join(hits, key, "left").select(key, F.coalesce("base_depth", F.lit(1)).alias("base_depth"))


def frontier(responses: DataFrame, targets: DataFrame, known_scans: DataFrame, deny: DataFrame | None = None, wildcards: DataFrame | None = None, max_depth: int = MAX_DEPTH, force: bool = False) -> DataFrame:
    """(url): new directories to scan, out of responses (url, method, status, location).

    Force takes every response, after rules and the report test; else directories of any response.
    """
    rows = responses if force else responses.where(measures.is_directory(F.col("status"), F.col("url"), F.col("location")))
    if wildcards is not None:
        rows = outside_wildcards(rows, wildcards)
    found = rows.select(urls.normalized(F.col("url")).alias("url")).distinct()
    if max_depth > 0:
        deep = base_depths(found, targets, "url")
        found = found.join(deep, "url").where(urls.depth(F.col("url")) - F.col("base_depth") < max_depth).select("url")
    found = unseen_scans(found, known_scans)
    return excluded_urls(found, deny, known_scans) if deny is not None else found


def without_listings(targets: DataFrame, listings: DataFrame, scan_listings: bool = False, force: bool = False) -> DataFrame:
    """targets (target) that get candidates: a directory listing yields its links instead, unless told otherwise."""
    return targets if scan_listings or force else targets.join(listings.where("kind is not null").select("target"), "target", "left_anti")


def resume_plan(scans: DataFrame, words: DataFrame, known: DataFrame, multiplier: int = 1) -> DataFrame:
    """(url, word, pos, reported): what unfinished directory scans still have to request.

    A scan resumes at the word that its requests reached; `reported` marks plain urls that are known already.
    """
    done = F.col("requests_made_so_far")
    offset = F.floor(done / max(multiplier - 1, 1)) if multiplier > 1 else done
    open_scans = scans.where("scan_type = 'Directory' and status <> 'Complete'").select("url", F.when(done > 0, offset).otherwise(0).alias("skip"))
    plan = open_scans.join(words, F.col("pos") >= F.col("skip")).select("url", "word", "pos").withColumn("full", F.concat(urls.normalized(F.col("url")), "word"))
    seen = known.select(F.col("url").alias("full")).distinct().withColumn("reported", F.lit(True))
    return plan.join(seen, "full", "left").select("url", "word", "pos", F.coalesce("reported", F.lit(False)).alias("reported"))


def discover(
    captured: DataFrame, targets: DataFrame, words: DataFrame, extensions: Sequence[str] = (), max_depth: int = MAX_DEPTH, rules: DataFrame | None = None,
    deny: DataFrame | None = None, wildcards: DataFrame | None = None, force: bool = False, signature: str | None = None,
) -> DataFrame:
    """(url, method, status, level): what a recursive scan of the targets would have found among captured responses.

    captured has url, method, status, location, and with rules their measures and text; targets (pos, target). Level by level:
    captured urls that are candidates of the frontier, and not excluded by `deny` (url), are found by equality; directories
    among them, outside wildcard directories (url, method) and not excluded, are the next frontier. Rules remove responses
    from what is reported, not from recursion, unless `force` recurses into every reported response. What all levels look up is
    written once: captured responses, their urls cut before a word's name, targets and deny list; so is each level.
    """
    targets = written(targets, "targets")
    deny = written(deny, "deny") if deny is not None else None
    get = written(captured.where("method = 'GET'"), "captured")
    cuts = tuple(written(df, "cuts") for df in named_cuts(get, words, extensions))
    front = targets.select("target").distinct()
    known = targets.select(urls.normalized(F.col("target")).alias("url"))
    found = None
    for level in range(max_depth if max_depth > 0 else 64):
        hits = captured_candidates(get, front, words, extensions, cuts)
        if deny is not None:
            hits = excluded_urls(hits, deny, known)
        if found is not None:
            hits = unseen_responses(hits, found)
        if rules is not None:
            hits = with_first_hit(hits, rules, signature)
        kind = F.col("rule_kind") if rules is not None else F.lit(None).cast("string")
        hits = written(hits.select("url", "method", "status", "location", kind.alias("rule_kind"), F.lit(level).alias("level")), "discovered")
        found = hits if found is None else found.unionByName(hits)
        open_to = hits.where(F.col("rule_kind").isNull() & measures.is_reported(F.col("status"))) if force else hits
        new = written(frontier(open_to, targets, known, deny, wildcards, max_depth, force), "frontier")
        if new.isEmpty():
            break
        known, front = known.unionByName(new), new.select(F.col("url").alias("target"))
    reported = found.where(F.col("rule_kind").isNull() & measures.is_reported(F.col("status")))
    return reported.groupBy("url", "method").agg(F.min_by(F.struct("status", "level"), "level").alias("r")).select("url", "method", "r.*")
