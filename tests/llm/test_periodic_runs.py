"""Operator 11 against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from crawlmill.llm.periodic_runs import Grammar, find_runs, op11_runs, periodic_runs

SCHEMA = "doc_id long, text string"


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n, letters = rnd.choice([0, 1, 5, 11, 12, 40, 200]), rnd.randint(1, 4)
            t = [rnd.randint(0, letters) for _ in range(n)]
            if n and rnd.random() < 0.4:
                p = rnd.randint(1, n)
                t = [t[i % p] for i in range(n)]
            texts.append(np.array(t, np.int64))
        least = rnd.choice([2, 4, 12])
        got = [[] for _ in texts]
        for k, *r in zip(*[c.tolist() for c in find_runs(texts, least)]):
            got[k].append(tuple(r))
        assert got == [plain_runs(t.tolist(), least) for t in texts]


def test_extensions_of_the_grammar():
    rnd = random.Random(3)
    inner = [rnd.randint(2, 3) for _ in range(400)] + [5] * 100 + [6, 7] * 60
    symbols = np.array([0, *inner, 1], np.int64)
    grammar, n = Grammar(symbols), len(symbols)
    pairs = [(i, j) for i in range(1, n - 1) for j in range(1, n - 1, 7) if i != j]
    i, j = np.array(pairs).T
    for step, end in ((1, n), (-1, -1)):
        got = grammar.extend(i, j, step)
        for a, b, k in zip(i.tolist(), j.tolist(), got.tolist()):
            assert symbols[a : a + step * k : step].tolist() == symbols[b : b + step * k : step].tolist()
            assert symbols[a + step * k] != symbols[b + step * k]
    assert sum(len(level.symbols) for level in grammar.levels) < 10 * n


def test_edge_cases(spark):
    long = " ".join(["x"] * 60_000)
    deep = " ".join(f"w{i % 977}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, long), (5, long), (None, "a b " * 6), (6, deep), (7, "é ü " * 12)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "2 AS collapsed")
    got = {}
    for r in periodic_runs(docs).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [([], "")]
    assert got[4] == [([], "a b c")]
    assert got[5] == [([(0, 60_000, 1)], "x")] * 2
    assert got[None] == [([(0, 12, 2)], "a b")]
    assert got[6] == [([(0, 50_000, 977)], " ".join(f"w{i}" for i in range(977)))]
    assert got[7] == [([(0, 12, 1)], "é ü")]
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in op11_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    several = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        several += len(runs) > 1
        r = got[doc_id]
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(plain_collapse(words, runs)))
    assert any(r.n_runs for r in got.values()) and several
