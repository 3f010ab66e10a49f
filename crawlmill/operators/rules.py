"""Rule tables that remove uninteresting responses, and exclusions by URL."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.constants import NEAR_DISTANCE
from crawlmill.functions import urls
from crawlmill.functions.simhash import block_masks, blocks, hamming
from crawlmill.storage import written

RULE_SCHEMA = (
    "kind string, filter_code int, line_count long, word_count long, content_length long, regex string, hash long, "
    "original_url string, cutoff int, method string, status_code int, dont_filter boolean"
)
_FIELDS = [x.split()[0] for x in RULE_SCHEMA.split(", ")]
#: Column builders by name: a rule of one's own is an expression that Catalyst sees.
_OWN_RULES: dict[str, Callable[[], Column]] = {}


def register_rule(name: str, build: Callable[[], Column]) -> None:
    _OWN_RULES[name] = build


def own_rules(responses: DataFrame) -> DataFrame:
    """responses that no registered rule hits."""
    for build in _OWN_RULES.values():
        responses = responses.where(~F.coalesce(build(), F.lit(False)))
    return responses


def rule_rows(kind: str, values: Sequence) -> list[dict]:
    """Rule rows from literals: status, lines, words, size, regex, similarity. Another kind gives none."""
    field = {"status": "filter_code", "lines": "line_count", "words": "word_count", "size": "content_length", "regex": "regex", "similarity": "hash"}.get(kind)
    return [{"kind": kind, field: v} | ({"cutoff": NEAR_DISTANCE} if kind == "similarity" else {}) for v in values] if field else []


def rule_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A rule table; equal rules are kept once."""
    unique = dict.fromkeys(tuple(r.get(f) for f in _FIELDS) for r in rows)
    return spark.createDataFrame(list(unique), RULE_SCHEMA)


def without_values(responses: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    """Status, line-count, word-count and size rules as literals."""
    return responses.where(~F.col(column).isin(list(values))) if values else responses


def _finds(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def matches_regex(patterns: Sequence[str], text: str = "text", headers: str | None = None) -> Column:
    """Any pattern found in the body, a header name or a header value. Look-around and back-references are refused."""
    out = F.lit(False)
    for p in patterns:
        if re.search(r"\(\?<?[=!]|\\[1-9]", p):
            raise ValueError(f"pattern with look-around or back-reference: {p}")
        out = out | F.coalesce(F.col(text).rlike(p), F.lit(False))
        if headers:
            found = _finds(p)
            out = out | F.exists(F.map_keys(headers), found) | F.exists(F.map_values(headers), found)
    return F.coalesce(out, F.lit(False))


#: What a wildcard rule may hold; it holds one of them at least.
_MEASURES = ("content_length", "word_count", "line_count")


def _held() -> Column:
    """Which measures a rule holds, as bits."""
    return sum((F.when(F.col(m).isNull(), 0).otherwise(1 << i) for i, m in enumerate(_MEASURES)), F.lit(0))


def without_wildcards(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """responses that equal no 404-like rule in method, status and every measure that the rule has.

    Rules are joined by full equality, those that hold the same measures at once; which of the seven sets of measures
    occur is read from the table when the plan is made.
    """
    rules = rules.where("kind = 'wildcard' and not coalesce(dont_filter, false)").withColumn("held", _held()).where("held > 0")
    for held in sorted(r["held"] for r in rules.select("held").distinct().collect()):
        hit = (F.col("r.method") == F.col("f.method")) & (F.col("r.status") == F.col("f.status_code"))
        for i, m in enumerate(_MEASURES):
            if held >> i & 1:
                hit = hit & (F.col(f"r.{m}") == F.col(f"f.{m}"))
        responses = responses.alias("r").join(rules.where(F.col("held") == held).alias("f"), hit, "left_anti")
    return responses


#: Cutoffs beyond which choices of blocks are too narrow to tell signatures apart, and rules of a block of the scan that they get.
WIDE_CUTOFF, SCANNED = 8, 1024


def _similar(responses: DataFrame, rules: DataFrame, signature: str) -> DataFrame:
    """(hit): the distinct signatures of responses that are within a similarity rule's cutoff.

    Each cutoff up to WIDE_CUTOFF that occurs has its own choices of blocks, on which rules and signatures meet by equality.
    Rules of wider cutoffs hit a good part of all signatures; blocks of SCANNED such rules are held against each signature.
    """
    rules = rules.where("kind = 'similarity' and hash is not null").select("hash", F.coalesce("cutoff", F.lit(NEAR_DISTANCE)).alias("cutoff")).distinct()
    own = responses.where(F.col(signature).isNotNull()).select(F.col(signature).alias("hit")).distinct()
    found = own.where("false")
    for (cutoff,) in sorted(rules.where(f"cutoff between 0 and {WIDE_CUTOFF}").select("cutoff").distinct().collect()):
        of = rules.where(F.col("cutoff") == cutoff).select("hash", blocks(F.col("hash"), cutoff))
        near = own.select("hit", blocks(F.col("hit"), cutoff)).join(of.hint("merge"), ["block", "part"])  # as in class_pairs
        found = found.unionByName(near.where(hamming(F.col("hit"), F.col("hash")) <= cutoff).select("hit"))
    wide = rules.where(f"cutoff > {WIDE_CUTOFF}")
    n = wide.count()
    if n:
        scanned = wide.groupBy(F.pmod(F.xxhash64("hash"), F.lit(-(-n // SCANNED))).alias("part")).agg(F.collect_list(F.struct("hash", "cutoff")).alias("some"))
        near = own.join(scanned, F.exists("some", lambda r: hamming(F.col("hit"), r["hash"]) <= r["cutoff"]))
        found = found.unionByName(near.select("hit"))
    return found.distinct()


def without_similar(responses: DataFrame, rules: DataFrame, signature: str = "signature") -> DataFrame:
    """responses whose signature is within no similarity rule's cutoff. Rows without a signature stay.

    Cutoffs are any number of bits: NEAR_DISTANCE where a rule has none, no hit below 0.
    """
    hits = _similar(responses, rules, signature)
    return responses.alias("r").join(hits.alias("h"), F.col(f"r.{signature}") == F.col("h.hit"), "left_anti")


#: Patterns that one alternation holds.
TOGETHER = 200


def _alternations(patterns: Sequence[str]) -> list[str]:
    """Patterns as few alternations; those whose quoting or comments could swallow what follows stay alone."""
    alone = [p for p in patterns if "\\Q" in p or "(?" in p.replace("(?:", "") or "#" in p]
    rest = [p for p in patterns if p not in set(alone)]
    return alone + ["|".join(f"(?:{p})" for p in rest[i : i + TOGETHER]) for i in range(0, len(rest), TOGETHER)]


def with_first_hit(responses: DataFrame, rules: DataFrame, signature: str | None = None, text: str = "text", headers: str | None = None) -> DataFrame:
    """responses with rule_kind, the kind of the first rule that hits, or null; a column of that name is replaced.

    Equal rules count once. Kinds are tried from the cheapest to the dearest: status, lines, words, size, wildcard, regex,
    similarity. Responses of equal measures are looked up once, by each of their values and by each set of measures that
    a wildcard rule may hold, so they meet rules by full equality. Patterns of regex rules become literals of the plan, as
    alternations, that the body, and headers where named, are searched for. Similarity rules have cutoffs of any size.
    """
    live = rules.where("not coalesce(dont_filter, false)")
    patterns = sorted(r["regex"] for r in live.where("kind = 'regex' and regex is not null").select("regex").distinct().collect())
    # rows travel as one struct, so that no name of theirs clashes
    names = ["status", "method", *_MEASURES]
    found = responses.select(F.struct(*[c for c in responses.columns if c != "rule_kind"]).alias("row"), *[F.col(n).alias(f"own_{i}") for i, n in enumerate(names)])
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(f"own_{i}").eqNullSafe(F.col(n))
    found = found.join(_first_by_measures(responses, live), same, "left").select("row", F.col("rule_kind").alias("kind"))
    if patterns:
        hit = matches_regex(_alternations(patterns), f"row.{text}", f"row.{headers}" if headers else None)
        found = found.select("row", F.coalesce("kind", F.when(hit, F.lit("regex"))).alias("kind"))
    if signature:
        near = _similar(responses, live, signature)
        found = found.join(near, F.col(f"row.{signature}") == F.col("hit"), "left")
        found = found.select("row", F.coalesce("kind", F.when(F.col("hit").isNotNull(), F.lit("similarity"))).alias("kind"))
    return found.select("row.*", F.col("kind").alias("rule_kind"))


#: Columns that a rule's value meets, by the rule's kind.
_VALUES = {"status": ("filter_code", "status"), "lines": ("line_count", "line_count"), "words": ("word_count", "word_count"), "size": ("content_length", "content_length")}


def _key(*parts: Column | str) -> Column:
    return F.concat(*[x for p in parts for x in (p if isinstance(p, Column) else F.lit(p), F.lit(":"))])


def _wildcard_key(held: Column, status: str, measures: list[Column]) -> Column:
    return _key("wildcard", held.cast("string"), F.col(status).cast("string"), *measures, F.col("method"))


def rule_keys(live: DataFrame) -> DataFrame:
    """(at, kind, priority): the key that rules of values and wildcard rules are found by, once each."""
    order = F.expr("case kind when 'status' then 0 when 'lines' then 1 when 'words' then 2 when 'size' then 3 else 4 end")
    value = F.coalesce(*[F.when(F.col("kind") == k, _key(k, F.col(c).cast("string"))) for k, (c, _) in _VALUES.items()])
    wild = _wildcard_key(_held(), "status_code", [F.coalesce(F.col(m).cast("string"), F.lit("")) for m in _MEASURES])
    rule = F.when(F.col("kind") != "wildcard", value).when(_held() > 0, wild)
    return live.select(rule.alias("at"), "kind", order.alias("priority")).where("at is not null").distinct()


def response_keys() -> Column:
    """The keys that a response is looked up by: each of its values, and each set of measures that a wildcard rule may hold."""
    keys = [_key(k, F.col(c).cast("string")) for k, (_, c) in _VALUES.items()]
    keys += [_wildcard_key(F.lit(h), "status", [F.col(m).cast("string") if h >> i & 1 else F.lit("") for i, m in enumerate(_MEASURES)]) for h in range(1, 1 << len(_MEASURES))]
    return F.array(*keys)


def _first_by_measures(responses: DataFrame, live: DataFrame) -> DataFrame:
    names = ["status", "method", *_MEASURES]
    hits = responses.select(*names).distinct().withColumn("at", F.explode(response_keys())).join(rule_keys(live), "at")
    return hits.groupBy(*names).agg(F.min_by("kind", "priority").alias("rule_kind"))


def _within(own: Column, cutoff: int) -> Callable[[Column], Column]:
    return lambda h: hamming(own, h) <= cutoff


def with_looked_up_hit(responses: DataFrame, rules: DataFrame, signature: str | None = None, text: str = "text", headers: str | None = None) -> DataFrame:
    """What with_first_hit gives, for a stream of responses and a static rule table: only joins that keep each row once.

    Kinds and sets of measures that occur, patterns and cutoffs are read from the table when the plan is made. Each has a
    look-up table with one row per key. Signatures are looked up by each choice of blocks among the rules that share it, so
    rules wider than WIDE_CUTOFF, which share no blocks, are literals of the plan.
    """
    live = written(rules.where("not coalesce(dont_filter, false)"), "live-rules")
    keys = written(rule_keys(live).withColumn("slot", F.when(F.col("kind") == "wildcard", F.concat(F.lit("wildcard:"), F.split("at", ":")[1])).otherwise(F.col("kind"))), "rule-keys")
    slots = {r["slot"] for r in keys.select("slot").distinct().collect()}  # 11 at most
    found = responses.select(F.struct(*[c for c in responses.columns if c != "rule_kind"]).alias("row"), response_keys().alias("keys"))
    order = [*_VALUES, *[f"wildcard:{h}" for h in range(1, 1 << len(_MEASURES))]]
    marks = []
    for i, slot in enumerate(order):
        if slot in slots:
            table = keys.where(F.col("slot") == slot).select(F.col("at").alias(f"at_{i}")).distinct()
            found = found.join(table, F.col("keys")[i] == F.col(f"at_{i}"), "left")
            marks.append(F.when(F.col(f"at_{i}").isNotNull(), F.lit(slot.split(":")[0])))
    patterns = sorted(r["regex"] for r in live.where("kind = 'regex' and regex is not null").select("regex").distinct().collect())
    if patterns:
        marks.append(F.when(matches_regex(_alternations(patterns), f"row.{text}", f"row.{headers}" if headers else None), F.lit("regex")))
    if signature:
        own = F.col(f"row.{signature}")
        similar = live.where("kind = 'similarity' and hash is not null").select("hash", F.coalesce("cutoff", F.lit(NEAR_DISTANCE)).alias("cutoff")).distinct()
        for (cutoff,) in sorted(similar.where(f"cutoff between 0 and {WIDE_CUTOFF}").select("cutoff").distinct().collect()):
            of = similar.where(F.col("cutoff") == cutoff)
            for i, mask in enumerate(block_masks(cutoff)):
                name = f"near_{cutoff}_{i}"
                table = of.groupBy(F.col("hash").bitwiseAND(F.lit(mask)).alias(f"part_{name}")).agg(F.collect_set("hash").alias(name))
                found = found.join(table, own.bitwiseAND(F.lit(mask)) == F.col(f"part_{name}"), "left")
                marks.append(F.when(F.exists(name, _within(own, cutoff)), F.lit("similarity")))
        wide = similar.where(f"cutoff > {WIDE_CUTOFF}").collect()
        marks += [F.when(hamming(own, F.lit(r["hash"])) <= r["cutoff"], F.lit("similarity")) for r in wide]
    return found.select("row.*", (F.coalesce(*marks) if marks else F.lit(None).cast("string")).alias("rule_kind"))


#: Parts that the urls of one prefix are dealt to.
_SALTS = 16


def excluded_urls(candidates: DataFrame, deny: DataFrame, scans: DataFrame, url: str = "url") -> DataFrame:
    """candidates without excluded ones.

    Excluded is a url equal to a deny url (slashes at the end aside), or one on its host whose path begins with the
    deny path, unless a scan on that host has a path that begins with the deny path and begins the url's own path.
    deny and scans hold `url`. Rows without a url stay.

    Deny and scan paths that begin one path are ordered by their length, so the longest of either decides. A path is cut
    at each length that a deny or scan path has, and the cuts meet them by equality; no rules of a host meet all its urls.
    """

    def parts(df: DataFrame, column: str) -> DataFrame:
        u = F.rtrim(F.col(column), F.lit("/"))
        return df.select(F.col(column).alias("raw"), urls.host(F.col(column)).alias("host"), F.rtrim(urls.path(u), F.lit("/")).alias("path"), u.alias("bare")).distinct()

    denied, scanned = parts(deny, "url"), parts(scans, "url")
    marks = denied.select("host", "path", F.lit(True).alias("deny")).unionByName(scanned.select("host", "path", F.lit(False).alias("deny"))).where("host is not null and path is not null")
    lengths = sorted(r[0] for r in marks.select(F.length("path")).distinct().collect())  # as many as a path has characters, at most
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    marks = marks.groupBy("host", F.col("path").alias("prefix")).agg(F.bool_or("deny").alias("denies"), F.bool_or(~F.col("deny")).alias("scans")).select("*", salts)
    own = parts(candidates, url).where("host is not null")
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    cut = own.select("raw", "host", F.explode(cuts).alias("n"), "path", F.pmod(F.xxhash64("raw"), F.lit(_SALTS)).cast("int").alias("salt"))
    cut = cut.select("raw", "host", "n", "salt", F.expr("substring(path, 1, n)").alias("prefix"))
    longest = cut.join(marks, ["host", "prefix", "salt"]).groupBy("raw").agg(F.max(F.when(F.col("denies"), F.col("n"))).alias("deny_n"), F.max(F.when(F.col("scans"), F.col("n"))).alias("scan_n"))
    under = longest.where("deny_n > coalesce(scan_n, -1)").select("raw")
    equal = own.join(denied.select("host", "bare").distinct(), ["host", "bare"], "left_semi").select("raw")
    return candidates.alias("c").join(under.unionByName(equal).alias("x"), F.col(f"c.{url}") == F.col("x.raw"), "left_anti")


def excluded_by_regex(candidates: DataFrame, patterns: Sequence[str], url: str = "url") -> DataFrame:
    """candidates whose whole url matches no pattern."""
    return candidates.where(~matches_regex(patterns, url))
