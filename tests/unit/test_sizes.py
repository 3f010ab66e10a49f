"""Steps whose memory or work must not grow faster than the input."""

from pyspark.sql import functions as F

from crawlmill.functions import html
from crawlmill.operators import aggregates, discovery, near_duplicates, rules, windows
from crawlmill.storage import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_all_block_choices_are_never_broadcast(spark):
    signed = written(spark.range(1000).select("id", F.xxhash64("id").alias("signature")), "signatures")
    table = signed.where("id < 20").select(F.lit("similarity").alias("kind"), F.col("signature").alias("hash"), F.lit(3).alias("cutoff"))
    for df in (near_duplicates.class_pairs(signed), near_duplicates.near_between(signed.where("id < 500"), signed, "id"), rules._similar(signed, table, "signature")):
        assert "SortMergeJoin [block" in plan(df) and "BroadcastHashJoin [block" not in plan(df)


def test_html_pass_holds_the_facts_of_few_pages(spark):
    pages = spark.range(1000, numPartitions=1).select("id", F.format_string("<p>page %d <a href='/%d'>x</a>", "id", "id").alias("text"))
    facts = html.html_facts(pages, "id", names=("links",))
    assert facts.columns == ["id", "links"] and {r.links[0]["value"] for r in facts.collect()} == {f"/{i}" for i in range(1000)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= html.BATCH_BYTES and html.TOGETHER <= 64


def test_refreshed_vocabulary_moves_no_texts_and_keeps_ties_apart(spark, monkeypatch):
    moved = []
    whole = windows.numbered
    monkeypatch.setattr(aggregates, "numbered", lambda rows, *a: moved.append(rows.count()) or whole(rows, *a))
    texts = ["boat wave"] * 20 + ["harbour boat"] * 9
    for ids in (range(29), [None] * 29, [None, *range(27), 26]):
        docs = spark.createDataFrame([*zip(ids, texts)], "id long, text string").selectExpr("*", "1 AS block", "2 AS _own")
        moved.clear()
        got = {r.term: r.df for r in aggregates.refreshed_vocabulary(docs.withColumn("key", F.monotonically_increasing_id()), "key", ["id"]).collect()}
        assert moved and moved[0] <= 20
        if ids[0] is None and ids[-1] is None:  # rows of one order: any five go
            assert 15 <= got["wave"] <= 20
        else:
            assert got == {"wave": 20, "harbour": 4}


def test_discovery_reads_what_was_captured_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(url):
        reads.add(1)
        return url

    rows = [(f"http://t/{p}", "GET", 301, f"http://t/{p}/") for p in ("a", "a/a", "a/a/a")]
    captured = spark.createDataFrame(rows, "url string, method string, status int, location string").withColumn("url", F.udf(seen, "string").asNondeterministic()("url"))
    targets, words = spark.createDataFrame([(0, "http://t")], "pos long, target string"), spark.createDataFrame([("a",)], "word string")
    found = discovery.discover(captured, targets, words)
    assert sorted((r.url, r.level) for r in found.collect()) == [("http://t/a", 0), ("http://t/a/a", 1), ("http://t/a/a/a", 2)]
    assert reads.value == 3


def test_terms_are_summed_before_they_move(spark):
    """Rows that move grow with the terms of a task, not with its documents."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'alpha beta alpha gamma' AS text").coalesce(1)
    assert aggregates._summed(docs.select("text"), None, aggregates.SUMMED).count() == 3
    got = {r.term: (r.df, round(r.tf, 6)) for r in aggregates.term_sums(docs, "doc_id", most=10).collect()}
    assert got == {"alpha": (3000, 1500), "beta": (3000, 750), "gamma": (3000, 750)}
