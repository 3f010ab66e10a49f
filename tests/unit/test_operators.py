"""Rules, joins, statistics, near-duplicates, sources and recursion on small tables."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from crawlmill.functions import simhash
from crawlmill.operators import aggregates, discovery, extraction, joins, near_duplicates, rules
from crawlmill.sources import readers, sinks

T = "http://localhost"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_candidates(spark):
    targets = spark.createDataFrame([(T,)], "target string")
    words = spark.createDataFrame([("turbo",), ("",), ("//x",), ("http://a/b",)], "word string")
    got = {r["url"] for r in joins.candidates(targets, words, ["js", "php", "pdf", "tar.gz"]).collect()}
    assert got == {T, f"{T}/turbo", f"{T}/turbo.js", f"{T}/turbo.php", f"{T}/turbo.pdf", f"{T}/turbo.tar.gz", *(f"{T}/x{e}" for e in ("", ".js", ".php", ".pdf", ".tar.gz"))}


def test_owning_scan(spark):
    scans = spark.createDataFrame([(u,) for u in (T, f"{T}/stuff", "http://shlocalhost/stuff/things", "http://shlocalhost/stuff/things/mostuff", "http://127.0.0.1:41971/")], "url string")
    pages = spark.createDataFrame([(1, "http://shlocalhost/stuff/things/mostuff/mothings.php"), (2, "http://127.0.0.1:41971/BKPMiherrortBPKcw"), (3, "http://other/x"), (4, None)], "id long, url string")
    assert rows(joins.owning_scan(pages, scans, "id")) == [(1, "http://shlocalhost/stuff/things/mostuff"), (2, "http://127.0.0.1:41971/")]


@pytest.mark.parametrize("deny, scan, tested, kept", [
    ("/api", "/", "/api/denied/", False), ("/api", "/", "/not-denied/", True), ("/", "/api", "/stuff/", False), ("/", "/api", "/api/not-denied/", True), ("/x/", "/", "/x", False),
])
def test_exclusion(spark, deny, scan, tested, kept):
    host = "https://deny.example"
    frames = [spark.createDataFrame([(host + x,)], "url string") for x in (tested, deny, scan)]
    assert bool(rules.excluded_urls(*frames).count()) is kept


def test_rule_rows(spark):
    assert rules.rule_rows("status", [200]) == [{"kind": "status", "filter_code": 200}]
    assert rules.rule_rows("regex", ["stuff.*"])[0]["regex"] == "stuff.*"
    assert rules.rule_rows("unknown", [1]) == []
    with pytest.raises(ValueError):
        rules.matches_regex(["(?=x)"])


def test_wildcard_rules(spark):
    table = rules.rule_table(spark, [{"kind": "wildcard", "content_length": 83, "line_count": 1, "word_count": 10, "method": "GET", "status_code": 200}, {"kind": "wildcard", "word_count": 8, "method": "GET", "status_code": 200}, {"kind": "wildcard", "method": "GET", "status_code": 200}])
    data = [(1, "GET", 200, 83, 1, 10), (2, "GET", 200, 64, 3, 8), (3, "POST", 200, 83, 1, 10), (4, "GET", 200, 1, 1, 1)]
    resp = spark.createDataFrame(data, "id long, method string, status int, content_length long, line_count long, word_count long")
    assert [r["id"] for r in rules.without_wildcards(resp, table).orderBy("id").collect()] == [3, 4]


def test_first_hit_takes_nulls_and_any_names(spark):
    wild = {"kind": "wildcard", "method": "GET", "status_code": 200}
    table = rules.rule_table(spark, [wild | {"word_count": 8}, wild | {"content_length": 5, "line_count": 1}, wild, {"kind": "size", "content_length": 5}, {"kind": "lines"}])
    data = [(1, "GET", 200, 5, 1, 3, "x"), (2, "GET", 200, None, 3, 8, "x"), (3, None, 200, None, 1, 8, "y"), (4, "GET", 200, 6, None, None, "z"), (4, "GET", 200, None, 3, 8, "x"), (5, "POST", 200, 4, 1, 8, "x")]
    resp = spark.createDataFrame(data, "at long, method string, status int, content_length long, line_count long, word_count long, hit string")
    got = rules.with_first_hit(resp, table)
    assert got.columns == [*resp.columns, "rule_kind"]
    assert sorted((r["at"], r["rule_kind"] or "") for r in got.collect()) == [(1, "size"), (2, "wildcard"), (3, ""), (4, ""), (4, "wildcard"), (5, "")]
    assert sorted(r["at"] for r in rules.without_wildcards(resp, table).collect()) == [3, 4, 5]
    assert rules.with_first_hit(resp, table.limit(0)).where("rule_kind is null").count() == len(data)


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 9])
def test_block_masks_agree_for_all_close_values(distance):
    masks = simhash.block_masks(distance)
    rng = random.Random(distance)
    for _ in range(300):
        flipped = sum(1 << i for i in rng.sample(range(64), distance))
        assert any(flipped & m & ((1 << 64) - 1) == 0 for m in masks)


def test_similar_rule(spark):
    table = rules.rule_table(spark, [{"kind": "similarity", "hash": 0b111000, "cutoff": 3}])
    sigs = spark.createDataFrame([(1, 0b111111), (2, 0b1111111), (3, None)], "id long, signature long")
    assert [r["id"] for r in rules.without_similar(sigs, table).orderBy("id").collect()] == [2, 3]


def test_registered_rule(spark):
    rules.register_rule("short", lambda: F.col("n") < 3)
    assert rows(rules.own_rules(spark.createDataFrame([(1,), (5,), (None,)], "n int")).na.fill(-1)) == [(-1,), (5,)]
    rules._OWN_RULES.clear()


def probe(i, status, size, words=4, lines=1, target="t"):
    return (target, "GET", "", status, size, words, lines, f"u{i}", float(i))


def test_probe_rules(spark):
    schema = "target string, method string, extension string, status int, content_length long, word_count long, line_count long, url string, timestamp double"
    six = spark.createDataFrame([probe(i, 200, 14) for i in range(6)], schema)
    (r,) = aggregates.probe_rules(six).collect()
    assert (r.probes, r.content_length, r.word_count, r.line_count, r.representative) == (6, 14, 4, 1, "u0")
    mixed = [probe(1, 200, 1, 1, 1), probe(2, 200, 2, 2, 2), probe(3, 404, 5, 5, 9), probe(4, 404, 6, 6, 9), probe(5, 500, 1)]
    (r,) = aggregates.probe_rules(spark.createDataFrame(mixed, schema)).collect()
    assert (r.status, r.content_length, r.word_count, r.line_count) == (404, None, None, 9)


BOATS = ["Seven boats left early, seven more left late.", "The boats of the harbour left.", "Nobody in the harbour waved: nobody saw boats.", "boats"]


def test_vocabulary_scores(spark):
    docs = spark.createDataFrame(list(enumerate(BOATS)), "id long, text string")
    stop = ["the", "in", "of", "more"]
    got = {r["term"]: r["score"] for r in aggregates.vocabulary(docs, "id", stop_words=stop).collect()}
    terms = [[w for w in re.findall("[a-z]+", t.lower()) if w not in stop] for t in BOATS]
    want = {}
    for term in {w for t in terms for w in t}:
        shares = [t.count(term) / len(t) for t in terms if term in t]
        want[term] = sum(shares) / len(shares) * math.log10(len(BOATS) / len(shares))
    assert "boats" not in got and want["boats"] == 0
    assert got == pytest.approx({t: x for t, x in want.items() if x > 0}, abs=1e-9)


def test_merged_statistics(spark):
    schema = "requests long, errors long, total_scans long, directory_scan_times array<double>"
    now = spark.createDataFrame([(7, 1, 5, [1.0])], schema)
    others = spark.createDataFrame([(9200, 2, 99, [2.0, 3.0])], schema)
    r = aggregates.merged_statistics(now, others).first()
    assert (r.requests, r.errors, r.total_scans, sorted(r.directory_scan_times)) == (9207, 3, 5, [1.0, 2.0, 3.0])


def random_signatures(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        s = rng.choice(out)
        for _ in range(rng.randint(0, 4)):
            s ^= 1 << rng.randrange(64)
        out.append(s)
    return [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(out)]


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_near_pairs_and_clusters_against_brute_force(spark):
    data = random_signatures(150, 3)
    df = spark.createDataFrame(data, "id long, signature long")
    values = sorted({s for _, s in data})
    got = {(r["a"], r["b"]) for r in near_duplicates.class_pairs(df, 3).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if distance(a, b) <= 3}
    assert near_duplicates.class_pairs(df, 3).count() == len(got)
    label = list(range(len(data)))
    for _ in data:
        for i, (_, a) in enumerate(data):
            for j, (_, b) in enumerate(data):
                if distance(a, b) <= 3:
                    label[i] = min(label[i], label[j])
    assert rows(near_duplicates.clusters(df, "id")) == [(i, label[i]) for i in range(len(data))]


def test_unique_responses_against_greedy(spark):
    data = random_signatures(120, 5)
    kept = []
    for i, s in data:
        if all(distance(s, t) > 1 for _, t in kept):
            kept.append((i, s))
    got = rows(near_duplicates.unique_responses(spark.createDataFrame(data, "id long, signature long"), "id"))
    assert got == [(i,) for i, _ in kept]


def test_state_and_resume_plan(spark, tmp_path):
    state = {
        "scans": [{"id": "1", "url": f"{T}/", "normalized_url": f"{T}/", "scan_type": "Directory", "status": "Complete", "num_requests": 4, "requests_made_so_far": 4}, {"id": "2", "url": f"{T}/js", "normalized_url": f"{T}/js/", "scan_type": "Directory", "status": "Waiting"}, {"id": "3", "url": f"{T}/c", "scan_type": "Directory", "status": "Cancelled"}],
        "responses": [{"type": "response", "url": f"{T}/js/css", "status": 301}],
        "filters": [{"filter_code": 404}, {"hash": 14897447612059286329, "original_url": T, "cutoff": 3}, {"content_length": None, "line_count": None, "word_count": 8, "method": "GET", "status_code": 200, "dont_filter": False}, {"word_count": 7}, {"raw_string": "x+"}, {"odd": 1}],
        "collected_extensions": ["php"], "statistics": {"type": "statistics", "requests": 9, "directory_scan_times": [1.5]},
    }
    (tmp_path / "s.json").write_text(json.dumps(state, indent=1))
    got = readers.read_state(spark, str(tmp_path / "s.json"))
    assert {r["id"]: r["status"] for r in got.scans.collect()} == {"1": "Complete", "2": "NotStarted", "3": "Complete"}
    assert sorted(r["kind"] for r in got.rules.collect()) == ["regex", "similarity", "status", "wildcard", "words"]
    assert got.rules.where("kind = 'similarity'").first()["hash"] == 14897447612059286329 - (1 << 64)
    assert got.statistics.first()["requests"] == 9 and got.responses.first()["method"] == "GET"
    words = spark.createDataFrame([(0, "css"), (1, "stuff")], "pos long, word string")
    plan = discovery.resume_plan(got.scans.na.fill(0, ["requests_made_so_far"]), words, got.responses)
    assert rows(plan.select("url", "word", "reported")) == [(f"{T}/js", "css", True), (f"{T}/js", "stuff", False)]


def test_words(spark, tmp_path):
    (tmp_path / "w").write_text("# note\n\n/admin\n//x\r\nadmin\nadmin\n")
    assert [(r["pos"], r["word"]) for r in readers.read_words(spark, str(tmp_path / "w")).orderBy("pos").collect()] == [(0, ""), (1, "admin"), (2, "x"), (3, "admin"), (4, "admin")]


def test_report_lines(spark):
    df = spark.createDataFrame([(200, "GET", 127, 283, 4134, f"{T}/faq", False, None), (301, "GET", 0, 0, 0, f"{T}/a", True, "/a/")], "status int, method string, line_count long, word_count long, content_length long, url string, truncated boolean, location string")
    got = [r["value"] for r in sinks.report_lines(df, location=F.col("location")).collect()]
    assert got == [f"200      GET      127l      283w     4134c {T}/faq", f"301      GET        0l        0w        0c {T}/a => {T}/a/ (truncated to size limit)"]


def test_resolved_links(spark):
    df = spark.createDataFrame([("http://localhost/a/b", "/admin"), ("http://localhost/a/b", "http://out.com/x"), ("http://localhost/a/b", "mailto:u@localhost"), ("http://localhost/a/b", "http://sub.localhost/p/q")], "url string, link string")
    assert {r["found"] for r in extraction.resolved_links(df, ["localhost"]).collect()} == {"http://localhost/a/admin", "http://localhost/a/p/q", "http://localhost/a/p/"}
    assert {r["found"] for r in extraction.resolved_links(df, ["localhost"], mode="rfc3986").collect()} == {"http://localhost/admin", "http://sub.localhost/p/q"}


def test_captured_candidates_are_those_of_the_product(spark):
    targets = spark.createDataFrame([(T,), (f"{T}/a/",), (f"{T}/a/b//",), ("plain",)], "target string")
    words = spark.createDataFrame([("",), ("b",), ("/b/c",), ("//b",), ("/",), ("b/",), ("http://x/y",), (None,)], "word string")
    made = joins.candidates(targets, words, ["php", "/"]).select("url", "method").distinct().collect()
    rest = [(f"{T}/a/b/x", "GET"), (f"{T}/ab", "GET"), ("", "GET"), (None, "GET"), ("plain/q", "GET")]
    captured = spark.createDataFrame([tuple(r) for r in made] * 2 + rest, "url string, method string")
    got = joins.captured_candidates(captured, targets, words, ["php", "/"])
    assert rows(got) == sorted([tuple(r) for r in made] * 2)
    assert joins.captured_candidates(captured, targets, words.where("word = 'b'")).distinct().count() == 4


def test_discover(spark):
    captured = spark.createDataFrame([(f"{T}/a", "GET", 301, f"{T}/a/"), (f"{T}/a/b", "GET", 301, f"{T}/a/b/"), (f"{T}/a/b/c", "GET", 200, None), (f"{T}/zzz", "GET", 200, None)], "url string, method string, status int, location string")
    targets = spark.createDataFrame([(0, T)], "pos long, target string")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    assert rows(discovery.discover(captured, targets, words).select("url", "level")) == [(f"{T}/a", 0), (f"{T}/a/b", 1), (f"{T}/a/b/c", 2)]
    assert rows(discovery.discover(captured, targets, words, max_depth=1).select("url")) == [(f"{T}/a",)]


def test_shared_folder(spark, monkeypatch):
    from crawlmill import storage

    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert storage.shared_path(spark, "x") != storage.shared_path(spark, "x")

    class Unset:
        class sparkContext:
            applicationId = "app"
            master = "local[8]"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    assert storage.shared_dir(Unset) == storage.shared_dir(Unset)
    Unset.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        storage.shared_dir(Unset)


def test_similarity_rules_of_any_cutoff(spark):
    rnd = random.Random(4)
    signed = [rnd.getrandbits(64) - (1 << 63) for _ in range(60)] + [0, 0b111111, -1]
    near = [s ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 12))) for s in signed[:30]]
    wanted = [(h, rnd.choice([0, 1, 2, 3, 4, 6, 8, 9, 12, 20, None])) for h in near] + [(0, 6)]
    responses = spark.createDataFrame([(i, s) for i, s in enumerate(signed + [None])], "id int, signature long")

    def distance(a, b):
        return ((a ^ b) & ((1 << 64) - 1)).bit_count()

    for some in (wanted, [(5, 64)], [(5, -1)], [(1 << 40, 63)], []):
        table = rules.rule_table(spark, [{"kind": "similarity", "hash": h, "cutoff": c} for h, c in some])
        want = [i for i, s in enumerate(signed + [None]) if s is None or not any(distance(s, h) <= (3 if c is None else c) for h, c in some)]
        assert [r.id for r in rules.without_similar(responses, table).orderBy("id").collect()] == want
    named = responses.selectExpr("*", "200 AS status", "'GET' AS method", "1L AS content_length", "1L AS line_count", "1L AS word_count", "'x' AS hit", "'y' AS rule_kind", "'z' AS text")
    table = rules.rule_table(spark, [{"kind": "similarity", "hash": h, "cutoff": c} for h, c in wanted])
    got = rules.with_first_hit(named, table, "signature").orderBy("id").collect()
    assert [r.rule_kind for r in got] == [None if s is None or not any(distance(s, h) <= (3 if c is None else c) for h, c in wanted) else "similarity" for s in signed + [None]]
    assert got[0].hit == "x" and got[0].asDict().keys() == {*named.columns}


def test_many_patterns_are_all_tried(spark):
    table = rules.rule_table(spark, [{"kind": "regex", "regex": f"^page {i}$"} for i in range(1500)] + [{"kind": "regex", "regex": r"(?i)upper"}, {"kind": "regex", "regex": r"\Qa.b"}])
    data = [(i, 200, "GET", 1, 1, 1, t) for i, t in enumerate(["page 0", "page 1499", "page 1500", "UPPER", "a.b", "axb"])]
    responses = spark.createDataFrame(data, "id int, status int, method string, content_length long, line_count long, word_count long, text string")
    assert [r.rule_kind for r in rules.with_first_hit(responses, table).orderBy("id").collect()] == ["regex", "regex", None, "regex", "regex", None]


def test_exclusion_meets_by_prefixes(spark):
    rnd = random.Random(8)
    paths = ["/".join(["", *(rnd.choice(["a", "b", "ab", "api", "x"]) for _ in range(rnd.randint(0, 3)))]) + rnd.choice(["", "/"]) for _ in range(120)]
    hosts = ["http://h.example", "http://i.example"]
    deny = [rnd.choice(hosts) + p for p in paths[:12]]
    scans = [rnd.choice(hosts) + p for p in paths[12:30]]
    urls = [rnd.choice(hosts) + p for p in paths] + [None]

    def parts(u):
        return u.split("/")[2], u.rstrip("/").split("/", 3)[3] if u.rstrip("/").count("/") > 2 else "", u.rstrip("/")

    def excluded(u):
        h, p, bare = parts(u)
        for d in deny:
            dh, dp, dbare = parts(d)
            if dh == h and (dbare == bare or p.startswith(dp) and not any(sh == h and sp.startswith(dp) and p.startswith(sp) for sh, sp, _ in map(parts, scans))):
                return True
        return False

    frames = [spark.createDataFrame([(u,) for u in x], "url string") for x in (urls, deny, scans)]
    got = rules.excluded_urls(frames[0].selectExpr("*", "1 AS host", "2 AS own_host", "3 AS raw"), *frames[1:])
    assert sorted(r.url or "" for r in got.collect()) == sorted(u or "" for u in urls if u is None or not excluded(u))
    assert got.columns == ["url", "host", "own_host", "raw"]


def test_exclusion_of_a_host_with_many_rules(spark):
    deny = spark.range(100_000).selectExpr("concat('http://h/d', id) AS url")
    scans = spark.range(1000).selectExpr("concat('http://h/d', id * 100, '/s') AS url")
    tested = spark.range(20_000).selectExpr("concat('http://h/d', id * 7, if(id % 2 = 0, '/s/x', '/t')) AS url")
    kept = {r.url for r in rules.excluded_urls(tested, deny, scans).collect()}
    # d<n> begins with a denied d<n'> of fewer digits, so a scan must lie below the longest that does
    want = set()
    for i in range(20_000):
        n, end = i * 7, "/s/x" if i % 2 == 0 else "/t"
        if end == "/s/x" and n % 100 == 0 and n < 100_000:
            want.add(f"http://h/d{n}{end}")
    assert kept == want


def test_state_files_of_any_size(spark, tmp_path):
    scans = spark.range(95).selectExpr("concat('http://h/', id) AS url", "'Directory' AS scan_type", "'Running' AS status")
    responses = spark.range(7).selectExpr("'response' AS type", "concat('http://h/', id) AS url", "200 AS status")
    none = spark.createDataFrame([], "extension string")
    path = str(tmp_path / "state")
    sinks.write_state_files(path, 10, scans=scans, responses=responses, filters=spark.createDataFrame([(404,)], "filter_code int"), collected_extensions=none, statistics=spark.createDataFrame([(9,)], "requests long"))
    assert len([*(tmp_path / "state/parts/scans").glob("part-*")]) >= 10
    got = readers.read_state_files(spark, path)
    assert got.scans.count() == 95 and got.responses.count() == 7 and got.collected_extensions.count() == 0
    assert [r.kind for r in got.rules.collect()] == ["status"] and [r.requests for r in got.statistics.collect()] == [9]
    next((tmp_path / "state/parts/responses").glob("part-*")).unlink()
    with pytest.raises(Exception):
        readers.read_state_files(spark, path)


def test_coverage_counts_without_the_product(spark):
    targets = spark.createDataFrame([("http://h",), ("http://h/a/",), ("http://h/a/",)], "target string")
    words = spark.createDataFrame([("a",), ("b",), ("b",), ("",), ("http://x",)], "word string")
    captured = spark.createDataFrame([("http://h/a", "GET"), ("http://h/a/b.php", "GET"), ("http://h/a/b.php", "POST"), ("http://h", "GET"), ("http://h/zz", "GET"), ("http://h/b", "PUT")], "url string, method string")
    made = joins.candidates(targets, words, ["php"], ["GET", "POST"])
    hit = captured.distinct().withColumnRenamed("url", "u").withColumnRenamed("method", "m")
    want = made.join(hit, (F.col("url") == F.col("u")) & (F.col("method") == F.col("m")), "left").groupBy("target").agg(F.count("*").alias("expected"), F.count("m").alias("captured"))
    assert rows(joins.coverage(targets, words, captured, ["php"], ["GET", "POST"])) == rows(want)


def test_signatures_of_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(1, "boats left early"), (1, "nobody waved"), (None, "boats left early"), (2, "")], "id long, text string")
    got = sorted((r.id or 0, r.signature) for r in simhash.signatures(docs, "id").collect())
    assert [i for i, _ in got] == [0, 1, 1] and len({s for _, s in got}) == 2


@pytest.mark.parametrize("block_pairs", [1 << 20, 40])
def test_unique_rows_of_chains_and_random_graphs(spark, block_pairs):
    rnd = random.Random(6)

    def check(signed):
        kept = []
        for n in sorted(signed):
            if all(((signed[n] ^ signed[k]) & ((1 << 64) - 1)).bit_count() > 1 for k in kept):
                kept.append(n)
        df = spark.createDataFrame([*signed.items()], "id long, signature long")
        assert sorted(r.id for r in near_duplicates.unique_responses(df, "id", 1, block_pairs).collect()) == kept

    check({rnd.randrange(10**9): rnd.getrandbits(7) for _ in range(90)})
    check({n: n ^ (n >> 1) for n in range(150)})  # a Gray code: each row is one bit from the next
    check({5: 1 << 20, 6: 2 << 20})


def test_a_long_chain_takes_few_jobs(spark):
    chain = spark.range(10_000).selectExpr("id", "id ^ shiftright(id, 1) AS signature")
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = {r.id for r in near_duplicates.unique_responses(chain, "id", 1).collect()}
    spark.sparkContext.setJobGroup("rest", "rest")
    code = lambda n: n ^ n >> 1
    want: set = set()
    for n in range(10_000):
        if code(n) not in want and not any(code(n) ^ 1 << b in want for b in range(14)):
            want.add(code(n))
    assert {code(n) for n in kept} == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 40


@pytest.mark.parametrize("listed", [["", "a", "b"], ["/", "a"], ["", "/", "z"], ["//x", "x", "a.php", "a"], [""], ["http://u"], []])
def test_candidate_summary_is_that_of_the_product(spark, listed):
    targets = spark.createDataFrame([("http://h",), ("http://h/",), ("http://h/d//",), ("http://h",)], "target string")
    words = spark.createDataFrame([(w,) for w in listed], "word string")
    for queries in ([], [("k", "v")]):
        got = joins.candidate_summary(targets, words, ["php", "/"], ["GET", "POST"], queries)
        want = joins.candidates(targets, words, ["php", "/"], ["GET", "POST"], queries).groupBy("target")
        want = want.agg(F.count("*"), F.countDistinct("url"), F.min("url"), F.max("url"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with one row
