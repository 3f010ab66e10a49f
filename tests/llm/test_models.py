"""Language ID, quality, nearest neighbours, BPE, the registered queries and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from test_similar_texts import alike, grams
from crawlmill.llm import ann, langid, quality, queries, segment_bpe
from crawlmill.llm.ann import AnisotropicQuantiser, nearest, unit
from crawlmill.llm.encoding import word_bpe_path
from crawlmill.llm.langid import KneserNey, fit_languages, keep_identified, language_id
from crawlmill.llm.quality import keep_good, quality_classifier, shape_of
from crawlmill.llm.segment_bpe import PairRanks, codec, encode_decode


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, lang string, place int, score double")


def test_kneser_ney_is_a_distribution():
    words = ["ab", "abc", "ba", "cab", "aab"]
    model = KneserNey.from_bytes(KneserNey.fit(words, np.array([3, 2, 1, 4, 1])).to_bytes())
    for context in ("", "a", "ab", "cab", "bb"):
        total = 0.0
        for symbol in ["a", "b", "c", chr(2)]:
            codes = np.frombuffer((chr(1) * 4 + context + symbol).encode("utf-32-le"), "<u4").astype(np.uint64)
            h = langid._hashes(codes)
            total += math.exp(model.log_probability([x[-1:] for x in h], [x[-2:-1] for x in h])[0])
        # the rest is kept for symbols never seen
        assert 0.8 < total < 1.0


def test_language_id(spark):
    rng = random.Random(1)
    stems = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["ção", "nho", "que", "es"]}
    rows = []
    for i in range(240):
        lang = "aa bb cc".split()[i % 3]
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 4))) for _ in range(40)), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (903, "KALO mitu", None), (None, "einung erschein", None), (903, "KALO mitu", None), (904, "kalo " * 100_000, None)]
    got = language_id(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:240])
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[903].lang_pred == "aa" and by_id[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    kept = keep_identified(docs_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.rejected} and kept.columns == docs_of(spark, rows).columns
    bare = language_id(docs_of(spark, [(1, "x", None)])).first()
    assert (bare.lang_pred, bare.score) == ("und", 0.0) and language_id(docs_of(spark, [])).count() == 0


def test_smallest_hashes(spark, monkeypatch):
    from crawlmill.llm import common

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 % 3).alias("g"), F.xxhash64("id").alias("h"))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.h):
        want.setdefault(r.g, []).append(r.doc_id)
    got = common.smallest_hashes(rows, "g", "h", 100).collect()
    assert {(r.g, r.place, r.doc_id) for r in got} == {(g, i + 1, d) for g, ids in want.items() for i, d in enumerate(ids[:100])}
    monkeypatch.setattr(common, "MOST_GROUPS", 2)  # the commonest alone
    assert {r.g for r in common.smallest_hashes(rows, "g", "h", 100).collect()} == {0, 1}


def brute_kneser_ney(counts, order=5):
    """Interpolated Kneser-Ney probabilities by the textbook, over dictionaries: p(symbol, context)."""
    raw = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        s = "\x01" * (order - 1) + w + "\x02"
        for i in range(order - 1, len(s)):
            for k in range(1, order + 1):
                raw[k][s[i - k + 1 : i + 1]] += n
    value = [None, *({} for _ in range(order))]
    value[order] = dict(raw[order])
    for k in range(order - 1, 0, -1):
        kinds = Counter(g[1:] for g in raw[k + 1])
        value[k] = {g: n if g[0] == "\x01" else kinds[g] for g, n in raw[k].items()}
    symbols = len(raw[1]) + 1
    discount = [0.0]
    for k in range(1, order + 1):
        ones, twos = (sum(v == x for v in value[k].values()) for x in (1, 2))
        discount.append(min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5)

    def p(symbol, context):
        k = len(context) + 1
        below = p(symbol, context[1:]) if context else 1 / symbols
        same = [v for g, v in value[k].items() if g[:-1] == context]
        if not same:
            return below
        return max(value[k].get(context + symbol, 0) - discount[k], 0) / sum(same) + discount[k] * len(same) / sum(same) * below

    return p


def test_kneser_ney_against_brute_force():
    rng = random.Random(11)
    counts = Counter("".join(rng.choices("abcd", [5, 3, 2, 1], k=rng.randint(1, 7))) for _ in range(200))
    words = sorted(counts)
    model = langid.LanguageModels(["x"], [KneserNey.from_bytes(KneserNey.fit(words, np.array([counts[w] for w in words])).to_bytes())])
    p = brute_kneser_ney(counts)
    for text in [*words[:40], "dddd", "abz", "zz", "a", "abcd dcba zab"]:
        want = symbols = 0
        for w in text.split():
            s = "\x01" * 4 + w + "\x02"
            want -= sum(math.log(p(s[i], s[i - 4 : i])) for i in range(4, len(s)))
            symbols += len(w) + 1
        h, n = model.entropies([text])[0]
        assert n == symbols and h == pytest.approx(want / symbols, abs=1e-9)


def test_repeated_labelled_rows(spark):
    text = "kalo mitu kalo " * 20
    rows = [(1, text, "aa")] * 3000 + [(1, text + "b", "aa")] * 3000 + [(i, f"{text} {i}", "aa") for i in range(2, 40)] + [(i, f"sch ung ein {i}", "bb") for i in range(50, 90)] + [(None, "x", "aa")]
    sample = langid.labelled_sample(docs_of(spark, rows), 20, 10).collect()
    assert len(sample) == 60 and len({(r.lang, r.place) for r in sample}) == 60 and sum(r.fits for r in sample) == 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(1, 1)] * 50, "doc_id long, quality int")
    picked = quality.labelled_sample(docs_of(spark, rows).select("doc_id", "text"), labels, 25).collect()
    assert len({r.doc_id for r in picked}) == len(picked) and max(Counter(r.quality for r in picked).values()) == 25


def test_words_of_the_fit_are_bounded(spark, monkeypatch):
    sample = spark.createDataFrame([("aa", "ab Ab cd cd2 cd! x " + "q" * 150), ("bb", "x x y")], "lang string, text string")
    got = {(r.lang, r.word): r.n for r in langid.word_counts(sample).collect()}
    assert got == {("aa", "ab"): 2, ("aa", "cd"): 3, ("aa", "x"): 1, ("aa", "q" * 64): 2, ("aa", "q" * 22): 1, ("bb", "x"): 2, ("bb", "y"): 1}
    monkeypatch.setattr(langid, "FIT_WORDS", 1)
    assert {(r.lang, r.word) for r in langid.word_counts(sample).collect()} == {("aa", "cd"), ("bb", "x")}


def test_rejection(spark):
    """Own text stays at the stated rate; junk, another alphabet and a language that was not learned go."""
    documents = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    models = fit_languages(documents.where("lang in ('en', 'fr', 'es')").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    held = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    own = [r.text for r in held.where("lang in ('en', 'fr', 'es')").collect()]
    other = [r.text for r in documents.where("lang = 'de'").collect()]
    assert models.predict(own)[2].mean() < 0.02 and models.predict(other)[2].mean() > 0.95
    junk = ["zqxj vvkw qqzx jjxw " * 9, "\u043c\u0430\u043c\u0430 \u043c\u044b\u043b\u0430 \u0440\u0430\u043c\u0443 " * 9, "a8f0c9 d2e1b7 " * 30]
    assert models.predict(junk)[2].all()


def test_votes_against_brute_force(spark):
    """Scores are those of all cosines, computed one by one; directions those of a full decomposition."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(documents.select("doc_id", "text"), labels.select("doc_id", "quality"))
    texts = [r.text for r in documents.limit(60).collect()] + [None, "", "word"]
    for text, score in zip(texts, model.scores(texts)):
        x = model.vectors_of([text])[0].tolist()
        cosines = sorted(((sum(a * b for a, b in zip(x, v)), y) for v, y in zip(model.vectors.tolist(), model.labels)), reverse=True)
        cosines = [c for c in cosines if c[0] >= cosines[quality.NEIGHBOURS - 1][0] - 1e-6]
        weights = [max(c, 0) ** 4 + 1e-9 for c, _ in cosines]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights), abs=1e-6)
    x = np.random.default_rng(1).normal(size=(80, 5)) @ np.diag([9, 7, 5, 4, 3]) @ np.random.default_rng(2).normal(size=(5, 300)) + np.random.default_rng(3).normal(size=(80, 300)) * 0.01
    v = quality.latent_directions(x.astype(np.float32), 5)
    want = np.linalg.svd(x)[2][:5].T
    assert np.abs(v @ v.T - want @ want.T).max() < 1e-3


def test_quality(spark):
    rng = random.Random(2)
    good = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(good, k=60)) if i % 3 else "BUY!! NOW!! " * 30, "en") for i in range(300)]
    rows += [(800, None, None), (801, "", None), (None, "word1 word2", None), (3, "word1 word2", None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(7, None, 0), (5000, 1, 0), (1, 1, 0), (None, 0, 0)], "doc_id long, quality int, score int")
    got = quality_classifier(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    kept = {r.doc_id for r in keep_good(docs_of(spark, rows), labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}
    none = quality_classifier(docs_of(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3 and quality_classifier(docs_of(spark, []), labels).count() == 0


def test_shapes():
    assert len({shape_of(w) for w in ("word", "Word", "WORD", "wOrd", "123", "word.", "word,", "word!!", "word%")}) == 9


def brute_nearest(data, every, k):
    ok = [(i, np.array(v, float)) for i, v in data if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted(((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in ok if i != q), key=lambda x: (round(x[0], 12), x[1]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    data += [(400 + i, data[0][1]) for i in range(90)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [None] * 8), (604, [1.0] * 3), (605, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in data], "vec_id long, embedding array<float>, cell int, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df).collect())
    want = brute_nearest(data, 50, 5)
    assert len(got) == len(want)
    assert sum((a[0], a[2]) == (b[0], b[2]) for a, b in zip(got, want)) >= 0.9 * len(want)
    exact = {(q, i): s for q, _, i, s in brute_nearest(data, 50, 10_000)}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, _, i, s in got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(few).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert nearest(few.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, unit(np.array(r.embedding, float))) for r in table.collect()]
    got = {(r.query_id, r.vec_id) for r in nearest(table).collect()}
    ids, x = np.array([i for i, _ in data]), np.stack([v for _, v in data])
    want = set()
    for i, v in data:
        if i % 50 == 0:
            order = np.argsort(-(x @ v))
            want |= {(i, int(ids[j])) for j in [j for j in order if ids[j] != i][:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_where_cells_are_left_out(spark):
    """40 clusters in 40 cells of which a query sees 8: most nearest vectors are found all the same."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[np.arange(4000) % 40] + 0.3 * rng.normal(size=(4000, 16))).tolist()
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    index = ann.fit_index(table.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.lit(0)), 16, 4000, 100, 0.2, 4)
    assert len(index.centres) == 40 and index.probed == 8
    got = {(r.query_id, r.vec_id) for r in nearest(table, per_cell=100, probed=0.2, fewest=4).collect()}
    want, u = set(), unit(np.array(x))
    for q in range(0, 4000, 50):
        order = np.argsort(-(u @ u[q]))
        want |= {(q, int(i)) for i in [i for i in order if i != q][:5]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_vectors_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (50, [3e-320, 0.0]), (2, [-1e300, 1e300])]
    got = {(r.query_id, r.vec_id): r.score for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 50] == pytest.approx(2**-0.5) and got[0, 2] == pytest.approx(0) and got[50, 2] == pytest.approx(-(2**-0.5))


def test_parallel_error_costs_more():
    x = unit(np.random.default_rng(1).normal(size=(800, 16)))
    parallel = []
    for threshold in (0.0, 0.5):
        q = AnisotropicQuantiser.fit(x, threshold)
        codes = q.encode(x)
        made = np.stack([q.books[s][codes[:, s]] for s in range(8)], axis=1).reshape(len(x), -1)
        parallel.append(float((((x - made) * x).sum(axis=1) ** 2).mean()))
    assert parallel[1] < parallel[0]
    packed = ann.pack_codes(codes)
    assert (ann.unpack_codes(packed, 8) == codes).all()


def test_segment_tree_against_plain_merging():
    vocabulary = {c: i for i, c in enumerate("abc")}
    merges = [["a", "b"], ["b", "c"], ["ab", "ab"], ["c", "ab"], ["a", "a"], ["bc", "a"]]
    for a, b in merges:
        vocabulary[a + b] = len(vocabulary)
    ranks, names = PairRanks(vocabulary, merges), {i: s for s, i in vocabulary.items()}
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 100))) for _ in range(300)]
    symbols = [[vocabulary[c] for c in w] for w in words]
    for word, alone, ids in zip(words, symbols, ranks.merge_all(symbols)):
        ids = np.frombuffer(ids, "<u4")
        assert ranks.merge(alone) == ids.tolist()
        parts = list(word)
        while True:
            found = [(merges.index([x, y]), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if [x, y] in merges]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [names[i] for i in ids.tolist()] == parts


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_path())
    rng = random.Random(7)
    parts = [" ", "  ", "a", "B", "'s", "\n", " ", "\x1c", "é", "7", "!", "<|endoftext|>", "<|startoftext|>", "\x85", "😀", "́", "İ", "Σ", "hello", "THE", "中"]
    texts = [None, "", " ", "x" * 3000, "Hello World " * 4000] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(2000)]
    own = codec(word_bpe_path())
    for t in texts:
        ids = own.encode([t or ""])[0]
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts[:60])] + [(None, "n", None), (1, "dup", None)], "doc_id long, text string, ids binary")
    rows = {(r.doc_id, bytes(r.ids), r.decoded) for r in encode_decode(df).collect()}
    assert len(rows) == 62 and segment_bpe.digests(df).count() == 62
    first = segment_bpe.digests(df.where("doc_id = 4")).first()
    assert first.ids_sha256 == hashlib.sha256(next(i for d, i, _ in rows if d == 4)).hexdigest()
    assert encode_decode(df.limit(0)).count() == 0


def test_codecs_on_every_code_point():
    """Both encoders equal the library on all code points of the planes in use, assigned or not."""
    from tokenizers import Tokenizer

    from crawlmill.llm.encoding import byte_bpe_path, encoder

    points = [chr(c) for c in range(0x32400) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for path, own in ((word_bpe_path(), codec(word_bpe_path())), (byte_bpe_path(), encoder(byte_bpe_path()))):
        library = Tokenizer.from_file(path)
        for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:20]


def test_very_long_words():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_path())
    word = "".join(random.Random(5).choices("etaoinshrdlu", k=300_000))
    began = time.time()
    got = np.frombuffer(codec(word_bpe_path()).encode([word + " end"])[0], "<u4").tolist()
    assert got == library.encode(word + " end", add_special_tokens=False).ids and time.time() - began < 60


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, name):
    table = {"op1_warc": "pages", "op6_ann": "embeddings"}.get(name, "documents")
    key = {"op1_warc": "page_id", "op6_ann": "query_id"}.get(name, "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    n = rows.where("vec_id % 50 = 0").count() if name == "op6_ann" else rows.count()
    assert queries.queries()[name](spark, SF).select(key).distinct().count() == n
    assert name in entry.queries() and "pipeline" in entry.queries()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language_id(docs).where("not rejected").select("doc_id")
    second = docs.join(kept, "doc_id")
    good = quality_classifier(second, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").select("doc_id")
    texts = {r.doc_id: r.text for r in second.join(good, "doc_id").collect()}
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    ids = sorted(firsts.values())
    sets = {i: grams(texts[i]) for i in ids}
    label = {i: i for i in ids}
    for a, b in combinations(ids, 2):
        if label[a] != label[b] and alike(sets[a], sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(label.values())
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 2048
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
