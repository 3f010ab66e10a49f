"""Streams whose rows land in several files: late rows, state that shrinks, timers, restarts."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from crawlmill.operators import aggregates, rules, windows
from crawlmill.plans import queries as plans
from crawlmill.plans import stream_queries  # noqa: F401  registers its queries
from crawlmill.sources import sinks
from crawlmill.streaming import streams

LOG = "event_id long, ts timestamp, scan_url string, url string, method string, status int, error string"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def row(n, minutes, scan="s", status=200, error=None, url="u"):
    return (n, at(minutes), scan, url, "GET", status, error)


def run(spark, tmp_path, batches, build, mode="append"):
    """What `build` emits over files that land one after the other, and the rows of state after each batch."""
    source = tmp_path / "landed"
    source.mkdir()
    out, sizes = [], []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(source))
        stream = build(streams.read_stream(spark, str(source), LOG))
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    return out, sizes


def test_first_seen_forgets_and_drops_late_rows(spark, tmp_path):
    batches = [[row(1, 0, url="a"), row(2, 1, url="a"), row(3, 2, url="b")], [row(4, 30, url="a")], [row(5, 300, url="c")], [row(6, 10, url="late"), row(7, 301, url="a"), row(8, 302, url="c")]]
    got, sizes = run(spark, tmp_path, batches, lambda s: streams.first_seen(s, "1 hour"))
    assert [r.event_id for r in got] == [1, 3, 5, 7]
    assert sizes[0] == 2 and sizes[2] <= 1


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    batches = [[row(1, 0), row(2, 1, error="x"), row(3, 1, status=403)], [row(4, 0, status=500), row(5, 120)], [row(6, 2, status=403), row(7, 121)], [row(8, 600)]]
    got, sizes = run(spark, tmp_path, batches, lambda s: streams.running_statistics(s, "1 hour", "10 minutes"))
    closed = {r.window.start: (r.requests, r.errors, r.client_errors, r.server_errors) for r in got}
    # row 6 comes when its window is closed
    assert closed == {at(0): (4, 1, 1, 1), at(120): (2, 0, 0, 0)}
    assert sizes[-1] == 1


def test_rates_and_sessions_close(spark, tmp_path):
    batches = [[row(i, i) for i in range(5)], [row(10, 200)], [row(11, 3), row(12, 1000)]]
    (tmp_path / "r").mkdir()
    got, sizes = run(spark, tmp_path / "r", batches, lambda s: streams.request_rates(s, "10 minutes", delay="5 minutes"))
    assert sorted((r.window.start, r.requests) for r in got) == [(at(0), 5), (at(200), 1)] and sizes[-1] == 1
    (tmp_path / "s").mkdir()
    got, sizes = run(spark, tmp_path / "s", batches, lambda s: streams.scan_sessions(s, "30 minutes", "5 minutes"))
    assert sorted((r.session_window.start, r.requests) for r in got) == [(at(0), 5), (at(200), 1)] and sizes[-1] == 1


def plain_triggers(rows, least=50, most_errors=25, cool=3.5):
    out, n, errors, s403, s429, until = [], 0, 0, 0, 0, None
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        n += 1
        errors += r[6] is not None
        s403 += r[5] == 403
        s429 += r[5] == 429
        if n >= least and (until is None or r[1] >= until):
            kind = "Errors" if errors >= most_errors else "Status403" if s403 / n >= 0.9 else "Status429" if s429 / n >= 0.9 / 3 else None
            if kind:
                out.append((r[2], kind, r[1], n))
                until = r[1] + dt.timedelta(seconds=cool)
    return out


def test_policies_cool_down_and_idle_scans_leave(spark, tmp_path):
    rnd = random.Random(2)

    def burst(scan, first, minutes, n=120):
        kinds = {"e": (None, "timeout"), "f": (403, None), "r": (429, None), "ok": (200, None)}
        return [(first + i, at(minutes) + dt.timedelta(seconds=i * 0.25), scan, "u", "GET", *kinds[scan if rnd.random() < 0.95 else "ok"]) for i in range(n)]

    batches = [[*burst("e", 0, 0), *burst("f", 1000, 0), *burst("ok", 2000, 0)], [*burst("e", 3000, 5), *burst("r", 4000, 5)], [*burst("f", 5000, 400)], [*burst("e", 6000, 1), *burst("e", 7000, 405)]]
    got, sizes = run(spark, tmp_path, batches, lambda s: streams.policy_triggers(s, delay="10 minutes", idle=3600.0))
    # the third batch moves the watermark past all scans but its own, which goes on; rows of minute 1 are late then
    want = [*plain_triggers(batches[0][:120] + batches[1][:120]), *plain_triggers(batches[0][120:240] + batches[2]), *plain_triggers(batches[1][120:]), *plain_triggers(batches[3][120:])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert len([w for w in want if w[0] == "e"]) > 10
    assert sizes[1] > sizes[2]


def test_policy_state_comes_with_the_rows(spark, tmp_path):
    """Rows of many scans reach a worker with their counts: no scan calls the state store, whose calls grew with the scans."""
    (tmp_path / "in").mkdir()
    stream = streams.policy_triggers(streams.read_stream(spark, str(tmp_path / "in"), LOG))
    assert "FlatMapGroupsInPandasWithState" in stream._jdf.queryExecution().logical().toString()
    scans = [(k * 100 + i, at(0) + dt.timedelta(seconds=(i * 37) % 100), f"s{k}", "u", "GET", None if k % 3 == 0 else 403 if k % 3 == 1 and i > 3 else 200, "timeout" if k % 3 == 0 else None) for k in range(60) for i in range(100)]
    got, sizes = run(spark, tmp_path, [scans[::2], scans[1::2]], streams.policy_triggers)
    want = []
    for k in range(60):
        # the second batch goes on from the counts of the first, whatever its rows' times
        own = [r for r in scans if r[2] == f"s{k}"]
        want += plain_triggers_of([own[::2], own[1::2]])
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) >= 40
    assert sizes == [60, 60]


def plain_triggers_of(batches):
    """plain_triggers of rows that come in batches, each in order of time."""
    out, rows, until = [], [], None
    for batch in batches:
        for r in sorted(batch, key=lambda r: (r[1], r[0])):
            rows.append(r)
            n, errors = len(rows), sum(x[6] is not None for x in rows)
            shares = [sum(x[5] == s for x in rows) / n for s in (403, 429)]
            kind = "Errors" if errors >= 25 else "Status403" if shares[0] >= 0.9 else "Status429" if shares[1] >= 0.3 else None
            if n >= 50 and kind and (until is None or r[1] >= until):
                out.append((r[2], kind, r[1], n))
                until = r[1] + dt.timedelta(seconds=3.5)
    return out


def test_stream_attribution_equals_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    signed = [rnd.getrandbits(64) - (1 << 63) for _ in range(40)]
    near = [{"kind": "similarity", "hash": s ^ 5, "cutoff": c} for s, c in zip(signed[:8], [0, 1, 2, 3, 5, 20, None, 2])]
    wild = {"kind": "wildcard", "method": "GET", "status_code": 200}
    table = rules.rule_table(spark, [*near, wild | {"word_count": 3}, wild | {"content_length": 4, "line_count": 1}, *rules.rule_rows("status", [404]), *rules.rule_rows("size", [7]), *rules.rule_rows("regex", ["z{2}"]), {"kind": "lines", "line_count": 2, "dont_filter": True}])
    schema = "id int, status int, method string, content_length long, line_count long, word_count long, text string, signature long, rule_kind string, at_0 int"
    rows = [(i, rnd.choice([200, 404, None]), rnd.choice(["GET", "POST"]), rnd.choice([4, 7, None]), rnd.choice([1, 2]), rnd.choice([3, 5]), rnd.choice(["zz", "a", None]), rnd.choice([s, None]), "x", 1) for i, s in enumerate(signed)]
    responses = spark.createDataFrame(rows, schema)
    want = {r.id: r.rule_kind for r in rules.with_first_hit(responses, table, "signature").collect()}
    responses.write.parquet(str(tmp_path / "in"))
    stream = rules.with_looked_up_hit(streams.read_stream(spark, str(tmp_path / "in"), schema), table, "signature")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {r.id: r.rule_kind for r in got} == want
    assert {*want.values()} >= {None, "status", "size", "wildcard", "regex", "similarity"}
    assert sorted(got[0].asDict()) == sorted(responses.columns)


def test_vocabulary_sums_merge_in_the_state(spark, tmp_path):
    docs = [[(1, "boats left harbour"), (2, "boats boats waved")], [(3, "nobody waved"), (4, "harbour")]]
    source, path = tmp_path / "docs", str(tmp_path / "terms")
    changed = []
    for batch in docs:
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = streams.read_stream(spark, str(source), "doc_id long, text string")
        stream.writeStream.option("checkpointLocation", f"{path}-a").foreachBatch(streams.landed_terms("doc_id", path)).trigger(availableNow=True).start().awaitTermination()
        sums: list = []
        merged = streams.merged_terms(spark, path)
        merged.writeStream.outputMode("update").option("checkpointLocation", f"{path}-b").foreachBatch(lambda b, _: sums.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
        changed.append({r.term: (r.df, r.tf) for r in sums})
    assert changed[0] == {"boats": (2, pytest.approx(1)), "left": (1, pytest.approx(1 / 3)), "harbour": (1, pytest.approx(1 / 3)), "waved": (1, pytest.approx(1 / 3))}
    # only the second batch's own terms
    assert changed[1] == {"nobody": (1, pytest.approx(1 / 2)), "waved": (2, pytest.approx(5 / 6)), "harbour": (2, pytest.approx(4 / 3))}
    found = {r.term: r.score for r in streams.term_scores(spark.createDataFrame([("harbour", 2, 1.5)], "term string, df long, tf double"), 4).collect()}
    assert found == pytest.approx({"harbour": 0.75 * math.log10(2)})


def test_running_counts_of_a_hot_scan_lie_in_blocks(spark):
    rows = [(i, START + dt.timedelta(seconds=i // 3), "hot" if i % 10 else None, "x" if i % 7 == 0 else None, 429 if i % 3 == 0 else 200) for i in range(4000)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, scan_url string, error string, status int")
    counts = {"requests": F.lit(1), "errors": F.col("error").isNotNull().cast("int")}
    run = windows.running_counts(log, "scan_url", ["ts", "event_id"], counts, 250).collect()
    want, seen = {}, {}
    for n, ts, scan, error, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = seen.get(scan, (0, 0))
        seen[scan] = a + 1, b + (error is not None)
        want[n] = seen[scan]
    assert {r.event_id: (r.requests, r.errors) for r in run} == want
    blocks = {}
    for r in run:
        blocks[r.block] = blocks.get(r.block, 0) + 1
    assert len(blocks) > 8 and max(blocks.values()) < 1500
    one, many = (sorted(map(str, windows.policy_triggers(log, block_rows=n).collect())) for n in (1 << 20, 100))
    assert one == many and len(one) == 2
    places = windows.numbered(log, ["ts", "event_id"], 250).collect()
    assert [r.place for r in sorted(places, key=lambda r: (r.ts, r.event_id))] == [*range(1, 4001)]


def test_vocabulary_refreshes_at_its_cadence(spark):
    assert [aggregates.refresh_point(n) for n in (0, 1, 2, 3, 4, 5, 11, 12, 13, 24, 35)] == [0, 0, 2, 2, 4, 4, 4, 12, 12, 24, 24]
    texts = [f"boat{i % 5} wave{i % 3}" for i in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "1 AS block")
    got = {r.term: (r.df, r.score) for r in aggregates.refreshed_vocabulary(docs, "id", ["id"], block_rows=4).collect()}
    want = {}
    for t in {w for x in texts[:12] for w in x.split()}:
        df = sum(t in x.split() for x in texts[:12])
        want[t] = (df, 0.5 * math.log10(12 / df))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert aggregates.refreshed_vocabulary(docs.limit(1), "id", ["id"]).collect() == []


def test_streaming_sink_equals_the_batch_sink_after_a_restart(spark, tmp_path):
    schema = "url string, original_url string, path string, wildcard boolean, status int, method string, content_length long, line_count long, word_count long, headers map<string,string>, extension string, truncated boolean, timestamp double"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        rows = [(f"http://h/{n}/{i}", "http://h/", f"/{n}/{i}", False, 200, "GET", i, 1, 1, {"a": "b"}, None, False, float(i)) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        sinks.stream_responses(streams.read_stream(spark, str(source), schema), out, str(tmp_path / "state")).awaitTermination()
    got = sorted(r.value for r in spark.read.text(out).collect())
    assert got == sorted(r.value for r in sinks.response_json(spark.read.schema(schema).parquet(str(source))).collect()) and len(got) == 15


def test_k1_streams_what_the_batch_gives(spark):
    found = [sorted(r.value for r in plans.queries()[n](spark, SF).collect()) for n in ("k1_streamed_json", "k1_response_json")]
    assert found[0] == found[1] and found[0]
