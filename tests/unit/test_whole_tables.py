"""Queries that must take every row, on fixtures with rows that the given tables lack."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from crawlmill.constants import PUNCTUATION, STOP_WORDS
from crawlmill.functions import simhash, text
from crawlmill.operators import aggregates, rules
from crawlmill.plans import queries as plans
from crawlmill.plans import stream_queries  # noqa: F401
from crawlmill.storage import shared_path

TEXTS = [
    "“The” crawler’s cache — holds the pages – always", "plain words of the crawl", None, "", "no break spaces and the cache",
    "café pages \U0001f600 smile", "١٢٣ digits of the cache", "tab\tand\nline the pages é",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def tokens(text):
    t = (text or "").translate({ord(c): " " for c in PUNCTUATION}).lower()
    return re.sub(rf"(?<![\w-])(-*)(?:{'|'.join(sorted(STOP_WORDS, key=len, reverse=True))})(-*)(?![\w-])", r"\1\2", t).split()


def terms(text):
    return [w for w in tokens(text) if len(w.encode()) >= 2]


def test_words_of_every_document(spark, folder):
    got = {r.doc_id: r.words for r in plans.queries()["t3_without_stop_words"](spark, folder).collect()}
    assert got == {i: " ".join(tokens(t)) for i, t in enumerate(TEXTS)}
    got = {r.doc_id: r.terms for r in plans.queries()["t4_terms"](spark, folder).collect()}
    assert got == {i: len(terms(t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["a6_vocabulary", "o1_top_terms", "st6_vocabulary"])
def test_vocabulary_of_every_document(spark, folder, name):
    shares = {}
    for t in TEXTS:
        listed = terms(t)
        for w in set(listed):
            shares.setdefault(w, []).append(listed.count(w) / len(listed))
    want = {w: (len(s), round(sum(s) / len(s) * math.log10(len(TEXTS) / len(s)), 9)) for w, s in shares.items()}
    got = {r.term: (r.df, r.score) for r in plans.queries()[name](spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 1e-8 for w in want)


def test_every_page_is_written_and_read_back(spark):
    got = plans._read_back(spark, SF).select("url", "timestamp").collect()
    want = spark.read.parquet(f"{SF}/pages.parquet").select("url", (F.lit(1.7e9) + F.col("page_id")).alias("timestamp")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rules_of_all_documents_of_a_status(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(60))) for i in range(100)]
    rows.append((100, rows[88][1]))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in plans.queries()["f6_similar_rule"](spark, str(tmp_path)).collect()}
    assert got == {i for i in range(100) if i % 10 != 8}


def test_state_files_grow_with_the_scans(spark, monkeypatch):
    path = shared_path(spark, "state-test")
    monkeypatch.setattr(plans, "_STATE_SCANS", 5)
    monkeypatch.setattr(plans, "shared_path", lambda *_: path)
    scans = plans.queries()["s3_state_scans"](spark, SF)
    assert scans.count() == plans.A.scans_pages(spark, SF).count() > 40
    sizes = [r.n for r in spark.read.text(path).select(F.size(F.from_json("value", "scans array<struct<url string>>")["scans"]).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) <= 20


def test_regex_and_similarity_rules_are_attributed(spark):
    rows = [(i, 200, "GET", 10, 10, 10, t, i * 0x11111111, {"server": h}) for i, (t, h) in enumerate([("plain", "a"), ("im a body hurr durr", "a"), ("plain", "nginx"), ("close", "a"), ("body 404 hurr", "a")])]
    responses = spark.createDataFrame(rows, "id long, status int, method string, line_count long, word_count long, content_length long, text string, signature long, headers map<string,string>")
    table = rules.rule_table(spark, rules.rule_rows("regex", ["hurr", "ngin."]) + rules.rule_rows("similarity", [0x33333332]) + rules.rule_rows("status", [404]))
    got = {r.id: r.rule_kind for r in rules.with_first_hit(responses, table, "signature", "text", "headers").collect()}
    assert got == {0: None, 1: "regex", 2: "regex", 3: "similarity", 4: "regex"}
    assert {r.rule_kind for r in rules.with_first_hit(responses, table.where("kind = 'similarity'"), "signature").collect()} == {None, "similarity"}


def test_parity_signatures_of_bodies(spark):
    got = {r.page_id: r.signature for r in plans.queries()["t6_parity_signatures"](spark, SF).collect()}
    want = {r.page_id: simhash.parity_signature(tokens(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert got == {i: s - (1 << 64) if s >> 63 else s for i, s in want.items() if s is not None}


def test_terms_in_tasks_are_the_columns_terms(spark):
    """Each character in a word, before and after a stop word, and alone; but those that the column's patterns do not know yet."""
    texts = [f"Wo{chr(c)}rd the{chr(c)} {chr(c)}of-the {chr(c)} THE{chr(c)}CAT{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["-the- --of-the-- the_cat ΑΣ ΑΣ'Β ’tis the", "", "a é aé", "the‍cat of́ and²"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").where(~F.col("text").rlike(r"\p{Cn}"))
    want = {r.doc_id: Counter(r.t) for r in docs.select("doc_id", text.terms(F.col("text")).alias("t")).collect()}
    counted = text.term_counter()
    assert len(want) > 11_000
    wrong = [texts[i] for i in want if counted(texts[i]) != want[i]]
    assert not wrong, [hex(ord(t[2])) for t in wrong[:20]]
    few = ["word", "no-such", "The"]
    want = {r.doc_id: Counter(r.t) for r in docs.select("doc_id", text.terms(F.col("text"), few).alias("t")).collect()}
    assert all(text.term_counter(few)(texts[i]) == w for i, w in want.items()) and text.term_counter([])("the of x") == {"the": 1, "of": 1}


def test_documents_that_share_a_key(spark):
    rows = [(1, "ab cd"), (1, "ab ef"), (1, "ab"), (2, "ab cd ab"), (None, "cd"), (None, "cd cd"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for key, size, term in {(k, len(terms(t)), w) for k, t in rows for w in terms(t)}:
        n = sum(terms(t).count(term) for k, t in rows if k == key and len(terms(t)) == size)
        df, tf = want.get(term, (0, 0))
        want[term] = df + 1, tf + n / size
    assert {r.term: (r.df, pytest.approx(r.tf)) for r in aggregates.term_sums(docs, "doc_id").collect()} == want
