"""Value fixtures of single functions."""

import pytest
from pyspark.sql import functions as F

from crawlmill.functions import measures, text, urls
from crawlmill.functions.html import facts_of
from crawlmill.functions.simhash import hamming, parity_signature, signatures
from crawlmill.operators.extraction import listing_kind, robots_paths, script_links, sub_paths
from crawlmill.functions.html import html_facts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("t, size, lines, words", [
    ("seven small boats left the harbour", 34, 1, 6), ("  rain,\train   and more rain ", 29, 1, 5),
    ("", 0, 0, 0), ("this is a test", 14, 1, 4), ("a\nb\n", 4, 2, 2), ("a\rb\n\nc", 6, 3, 3), ("a\u00a0b\u2003c", 8, 1, 3),
])
def test_measures(spark, t, size, lines, words):
    row = measures.with_measures(spark.createDataFrame([(t,)], "text string")).first()
    assert (row.content_length, row.line_count, row.word_count) == (size, lines, words)


@pytest.mark.parametrize("n, cut", [(9, True), (10, False), (11, False)])
def test_size_cap(spark, n, cut):
    df = spark.createDataFrame([(b"0123456789",)], "body binary")
    row = df.select(measures.capped_text(F.col("body"), n).alias("t"), measures.is_truncated(F.col("body"), n).alias("c")).first()
    assert (row.t, row.c) == ("0123456789"[:n], cut)


@pytest.mark.parametrize("url, depth", [("http://localhost", 1), ("http://localhost/", 1), ("http://localhost/src", 2), ("http://localhost/src/", 2), ("mailto:x", 0)])
def test_depth(spark, url, depth):
    assert one(spark, urls.depth(F.col("u")), u=url) == depth


@pytest.mark.parametrize("url, ext", [("http://localhost/derp.js", "js"), ("http://localhost/.bash_history", None), ("http://localhost/a.tar.gz", "gz"), ("http://localhost", None)])
def test_extension(spark, url, ext):
    assert one(spark, urls.extension(F.col("u")), u=url) == ext


@pytest.mark.parametrize("host, scope, inside", [("deep.sub.example.com", "example.com", True), ("example.com", "example.com.", True), ("other.com", "example.com", False), ("badexample.com", "example.com", False), ("1.127.0.0.1", "127.0.0.1", False)])
def test_scope(spark, host, scope, inside):
    assert one(spark, urls.in_scope(F.col("h"), F.col("s")), h=host, s=scope) is inside


@pytest.mark.parametrize("url", ["mailto:user@example.com", "../../stuff", "/../../stuff", "javascript://"])
def test_invalid_urls(spark, url):
    assert one(spark, urls.is_valid(F.col("u")), u=url) is False


@pytest.mark.parametrize("base, link, joined", [
    ("http://h/a/b?q", "c.js", "http://h/a/c.js"), ("http://h", "c", "http://h/c"), ("http://h/a/b", "/r", "http://h/r"), ("http://h/a/b/", "../c", "http://h/a/c"),
    ("http://h/a", "https://o/x", "https://o/x"), ("https://h/a", "//o/x", "https://o/x"),
])
def test_join(spark, base, link, joined):
    assert one(spark, urls.join(F.col("b"), F.col("l")), b=base, l=link) == joined


@pytest.mark.parametrize("link, found", [
    ("homepage/assets/img/icons/handshake.svg", ["homepage/assets/img/icons/handshake.svg", "homepage/assets/img/icons/", "homepage/assets/img/", "homepage/assets/", "homepage/"]),
    ("/homepage/assets/", ["homepage/assets", "homepage/"]), ("homepage", ["homepage"]), ("/homepage", ["homepage"]), ("", []), (" over/there?name=ferret#nose ", ["over/there", "over/"]),
    ("over/<there>#x", ["over/there", "over/"]),
])
def test_sub_paths(spark, link, found):
    assert one(spark, sub_paths(F.col("l")), l=link) == found


def test_backup_names(spark):
    assert one(spark, text.backup_names(F.col("n")), n="LICENSE.txt") == ["LICENSE.txt~", "LICENSE.txt.bak", "LICENSE.txt.bak2", "LICENSE.txt.old", "LICENSE.txt.1", ".LICENSE.txt.swp", "LICENSE.bak"]
    assert len(one(spark, text.backup_names(F.col("n")), n="LICENSE")) == 6
    assert one(spark, text.backup_names(F.col("n")), n="") == []


def test_tokens(spark):
    assert one(spark, text.preprocessed(F.col("t"), ["why", "are"]), t="WHY are Y'all YELLing?") == ["y", "all", "yelling"]
    assert one(spark, text.preprocessed(F.col("t"), ["the"]), t="-the- the the-x théthe") == ["--", "the-x", "théthe"]


def test_parity_signature():
    assert parity_signature(["test"]) == 14897447612059286329  # "this is a test" without its stop words
    assert parity_signature([]) is None


def test_signatures_against_plain_counts(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "the"), (3, None)], "id long, text string")
    got = {r["id"]: r["signature"] for r in signatures(docs, "id").collect()}
    hashes = [r["h"] for r in spark.createDataFrame([("alpha",), ("beta",), ("beta",), ("gamma",)], "w string").select(F.xxhash64("w").alias("h")).collect()]
    want = sum(1 << i for i in range(64) if sum(1 if h >> i & 1 else -1 for h in hashes) > 0)
    assert got == {1: want - (1 << 64) if want >> 63 else want}


def test_hamming_on_negative_values(spark):
    assert spark.createDataFrame([(-1, 0)], "a long, b long").select(hamming(F.col("a"), F.col("b")).alias("d")).first()["d"] == 64


def test_visible_text():
    assert facts_of("<body><script>var boats = 7</script><style>p {}</style><p>Boats left early.</p></body>")["visible_text"] == "Boats left early."
    assert facts_of("<html><body><p>Boats left.</p><!--nobody waved--></body></html>")["visible_text"] == "Boats left. nobody waved"


@pytest.mark.parametrize("html, kind", [
    ("<html><head><title>Directory Listing for /boats/</title></head></html>", "TomCatOrPython"), ("<title>INDEX OF /harbour</title>", "Apache"), ("<title>srv7 - Directory Listing -- /in</title>", "AspDotNet"),
    # a way up and two kinds of columns
    ("<table><tr><th>Name</th><th>Last modified</th></tr><tr><td><a href='..'>up</a></td></tr></table>", "Custom"),
    # no way up, but columns in the first row's cells and three entries
    ("<table><tr><td>size in KB</td><td>time</td></tr></table><a href='one.zip'>1</a><a href='two.sql'>2</a><a href='three/'>3</a>", "Custom"),
    ("<a href='../'>To parent</a><p>one sign is not enough</p>", None), ("<a href='/boats'>x</a><a href='/crew'>y</a><a href='/log'>z</a>", None), (None, None),
])
def test_directory_listings(spark, html, kind):
    facts = html_facts(spark.createDataFrame([(1, html)], "id long, text string"), "id")
    assert listing_kind(facts, "id").first()["kind"] == kind


def test_robots(spark):
    lines = "Allow: /a/b\ndisallow : /c#note\nDisallow: /d$\nDisallow:\nUser-agent: *\n"
    df = spark.createDataFrame([(1, lines), (2, lines.replace("\n", "\r\n"))], "id long, text string")
    got = [(r["id"], r["link"]) for r in robots_paths(df, "id").collect()]
    assert sorted(x for i, x in got if i == 1) == ["", "/a/b", "/c", "/d"]
    crlf = [r["link"] for r in robots_paths(df, "id", crlf=True).where("id = 2").collect()]
    assert sorted(crlf) == ["", "/a/b", "/c", "/d"] and len([1 for i, _ in got if i == 2]) < 4


def test_script_links(spark):
    js = """a("/api/v1/users"); b('https://x.example.com/p?q=1'); c("main.js"); d("no link"); e("rest/item")"""
    got = {r["link"] for r in script_links(spark.createDataFrame([(1, js)], "id long, text string"), "id").collect()}
    assert got == {"/api/v1/users", "https://x.example.com/p?q=1", "main.js", "rest/item"}


def test_sql_functions(spark):
    from crawlmill.functions.sql import register_functions

    register_functions(spark)
    for url in ("http://localhost", "http://localhost/src/", "http://h/a/b.tar.gz?x=1", "mailto:x"):
        df = spark.createDataFrame([(url,)], "u string")
        r = df.select(F.expr("url_depth(u)").alias("d"), F.expr("url_extension(u)").alias("e"), urls.depth(F.col("u")).alias("d2"), urls.extension(F.col("u")).alias("e2")).first()
        assert (r.d, r.e) == (r.d2, r.e2)
    assert spark.sql("select sub_paths('/homepage/assets/x.svg?q') as s").first()["s"] == ["homepage/assets/x.svg", "homepage/assets/", "homepage/"]
    docs = spark.createDataFrame([(1, "alpha beta beta gamma")], "id long, text string")
    want = signatures(docs, "id").first()["signature"]
    assert spark.sql("select simhash64(array('alpha','beta','beta','gamma')) as s, hamming64(-1, 0) as h").first() == (want, 64)


def test_references_resolve_as_the_standard_says():
    base = "http://a/b/c/d;p?q"
    want = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y#s": "http://a/b/c/g?y#s",
            "": "http://a/b/c/d;p?q", "#s": "http://a/b/c/d;p?q#s", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
            "g;x=1/../y": "http://a/b/c/y", "g..": "http://a/b/c/g..", "./g/.": "http://a/b/c/g/", ".//": "http://a/b/c//", "x//../y": "http://a/b/c/x/y"}
    assert {k: urls.resolve_reference(base, k) for k in want} == want
    assert urls.resolve_reference("http://a", "g") == "http://a/g"


def test_redirects_resolve_their_location(spark):
    cases = [("http://h/a/b", "b/", True), ("http://h/a/b", "./b/", True), ("http://h/a/b", "//h/a/b/", True), ("http://h/a/b", "/a/b/", True), ("http://h/a/b", "http://h/a/b/", True),
             ("http://h/a/b", "../a/b/", True), ("http://h/a/b", "//x/a/b/", False), ("http://h/a/b", "c/", False), ("http://h/a/b", None, False), (None, "b/", False)]
    df = spark.createDataFrame([(i, 301, *c) for i, c in enumerate(cases)], "i int, status int, url string, location string, want boolean")
    got = df.select("i", measures.is_directory(F.col("status"), F.col("url"), F.col("location")).alias("d"), measures.redirect_target(F.col("status"), F.col("url"), F.col("location")).alias("t"), "want").orderBy("i").collect()
    assert [r.d for r in got] == [r.want for r in got]
    assert got[2].t == "http://h/a/b/" and got[6].t == "http://x/a/b/" and got[8].t is None
