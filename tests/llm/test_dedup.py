"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlmill.llm import common, simhash_dedup
from crawlmill.llm.exact_dedup import drop_exact_copies, exact_dedup, repeated_fingerprints
from crawlmill.llm.encoding import segments
from crawlmill.llm.quotient_filter import CountingQuotientFilter as Filter
from crawlmill.llm.simhash_dedup import close_pairs, drop_near_copies, fingerprint, forest, near_duplicates
from crawlmill.llm.similar_texts import drop_similar, shingles

SCHEMA = "doc_id long, text string, norm string, fp long, lang string"
TEXTS = ["a b", "a  b", "a\t\nb", " a b", None, "", " ", "x", "x", "X", "é" * 3, "word " * 50_000, "word " * 50_000 + " "]


def frame(spark, pairs):
    """With extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "n", 7, "en") for i, t in pairs], SCHEMA)


def brute_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {(i, min(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g}


def test_exact_dedup(spark):
    pairs = [(100 - i, t) for i, t in enumerate(TEXTS * 2)]
    got = exact_dedup(frame(spark, pairs)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_exact(pairs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(pairs)


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    pairs = [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (None, "z"), (None, "z")]
    got = exact_dedup(frame(spark, pairs)).collect()
    assert len(got) == len(pairs)
    assert sorted((str(r.doc_id), r.group_size) for r in got if r.kept) == [("1", 3), ("2", 1), ("2", 1), ("None", 2)]
    kept = drop_exact_copies(frame(spark, pairs))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a"), ("2", "b"), ("2", "c"), ("None", "z")]
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert exact_dedup(frame(spark, [])).count() == 0 == drop_exact_copies(frame(spark, [])).count()


@pytest.mark.parametrize("bits", [1, 64, 1 << 25])
def test_rows_left_out_by_marks(spark, monkeypatch, bits):
    """However full the bitmap is, the rows that stay are the same."""
    monkeypatch.setattr(common, "MARK_BITS", bits)
    pairs = [(i % 700 or None, str(i % 900)) for i in range(2000)]
    gone, twice = set(pairs[:300]), set(pairs[300:310]) - set(pairs[:300])
    key = [F.col("doc_id"), F.col("text")]
    listed = [spark.createDataFrame(sorted(x, key=str), "i long, t string") for x in (gone, twice)]
    got = sorted(((r.doc_id, r.text) for r in common.without_rows(frame(spark, pairs), key, *listed).collect()), key=str)
    assert got == sorted([p for p in pairs if p not in gone | twice] + list(twice), key=str)


def test_marks_rule_out_all_others(spark):
    rows, keys = spark.range(20_000).toDF("k0"), spark.range(0, 20_000, 10).toDF("k0")
    got = {r.k0 for r in common.marked(rows, keys, ["k0"]).where("doubtful").collect()}
    assert got >= set(range(0, 20_000, 10)) and len(got) < 2_100


def test_repeated_fingerprints(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    values += values[:500] + values[:100] + [0, -1, 0]
    got = {(r.fp, r.n) for r in repeated_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), 20_000_000).collect()}
    assert got == {(v, values.count(v)) for v in set(values) if values.count(v) > 1}


@pytest.mark.parametrize("n, bits", [(0, 64), (1, 64), (1000, 64), (5000, 61), (300, 12)])
def test_quotient_filter(n, bits):
    rng = np.random.default_rng(n)
    parts = [rng.integers(0, 1 << bits, n, np.uint64) for _ in range(3)]
    parts[1] = np.concatenate([parts[1], parts[0][: n // 2], parts[0][: n // 3]])
    filters = [Filter.from_bytes(Filter.build(p, bits).to_bytes()) for p in parts]
    values, counts = Filter.merge(filters).items()
    want, times = np.unique(np.concatenate(parts), return_counts=True)
    assert (values == want).all() and (counts == times).all()


def test_fingerprint():
    import xxhash

    words = "the Quick Brown fox the quick brown".lower().split()
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint("The\tquick  BROWN fox\nthe quick brown ") == want
    assert fingerprint("One two") == xxhash.xxh64("one two", seed=42).intdigest()
    assert fingerprint(None) == fingerprint(" \n") == 0 and fingerprint("É") == xxhash.xxh64("É", seed=42).intdigest()


def cluster(values, distance=3):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                label[root(max(root(a), root(b)))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def around(rng, n, centres, flips):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set(base)
    while len(out) < n:
        v = rng.choice(base)
        for _ in range(rng.randint(1, flips)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(v - (1 << 64) if v >> 63 else v for v in out)


@pytest.mark.parametrize("n, centres, flips, block", [(300, 100, 5, 2048), (400, 2, 4, 2048), (400, 1, 6, 32)])
def test_close_pairs_join_what_brute_force_joins(spark, monkeypatch, n, centres, flips, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    values = around(random.Random(n + flips), n, centres, flips)
    edges = close_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in edges)
    label = {v: v for v in values}
    for _ in values:
        before = dict(label)
        for r in edges:
            label[r.a] = label[r.b] = min(label[r.a], label[r.b])
        if before == label:
            break
    assert label == cluster(values)


def test_forest_is_no_larger_than_a_tree():
    fps = np.array(around(random.Random(2), 200, 1, 2), np.int64)
    a, b = forest(fps, 3)
    assert len(a) == len(fps) - len(set(cluster(fps.tolist()).values()))


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=300) for _ in range(6)]
    pairs = [(i, " ".join(base[i % 6][: 300 - i // 6])) for i in range(36)] + [(50, None), (51, ""), (52, "one"), (None, "one"), (52, "one")]
    got = near_duplicates(frame(spark, pairs)).collect()
    fps = {t: fingerprint(t) for _, t in pairs}
    signed = {t: f - (1 << 64) if f >> 63 else f for t, f in fps.items()}
    root = cluster(sorted(set(signed.values())))
    want = sorted((str(i), f"{fps[t]:016x}", min(j for j, u in pairs if j is not None and root[signed[u]] == root[signed[t]])) for i, t in pairs)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = drop_near_copies(frame(spark, pairs)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got})
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_of_repeated_doc_ids(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (1, text + " z"), (2, "other words of its own"), (5, text + " y"), (None, text + " x"), (None, "lone"), (2, "other words of its own")]
    kept = sorted((str(r.doc_id), r.text) for r in drop_near_copies(frame(spark, rows)).collect())
    assert len(kept) == 3 and kept[1:] == [("2", "other words of its own"), ("None", "lone")] and kept[0][0] == "1"
    assert drop_near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("drop", [drop_exact_copies, drop_near_copies, drop_similar])
def test_names_that_clash(spark, drop):
    names = "row k0 o0 h1 h2 fp root kept times n key cell _own_text _kept_id _place _gone".split()
    rows = [(i, t) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "h i j k l m n", None, ""])] + [(0, "a b c d e f g")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = drop(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 3]


def test_fingerprints_of_long_texts_go_in_steps(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", "Other", "x" * 30, "é"]) + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(3000))
    whole, sets = fingerprint(text), shingles(text)
    for size in (10, 333):
        monkeypatch.setattr(segments, "__defaults__", (size,))
        assert fingerprint(text) == whole and (shingles(text) == sets).all() and fingerprint("One  two ") == xxhash.xxh64("one two", seed=42).intdigest()
