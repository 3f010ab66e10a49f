"""Operator 13 against whole-text encodings and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from crawlmill.llm.alignment import Aligner, Csr, align, gustavson, op13_alignment, overlap_links, transposed
from crawlmill.llm.encoding import byte_bpe_path, piece_bpe_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def own():
    return Aligner(byte_bpe_path(), piece_bpe_path())


@pytest.fixture(scope="module")
def plain_groups(own):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe_path())
    library.encode_special_tokens = True

    def groups(text):
        """[(A ids, B ids)] of a text encoded whole, None where there are no tokens."""
        if not text:
            return None
        a, b, want = library.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text), (" " + text).encode()
        if b"".join(own.a_bytes[i] for i in a) != want or b"".join(own.b_bytes[i] for i in b) != want:
            return None
        ends_a, ends_b = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((own.a_bytes, a), (own.b_bytes, b)))
        out, i, j = [], 0, 0
        after_a, after_b = ({e: n + 1 for n, e in enumerate(x)} for x in (ends_a, ends_b))
        for cut in sorted({*ends_a} & {*ends_b}):
            k, m = after_a[cut], after_b[cut]
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out

    return groups


def plain(texts, groups):
    found = [groups(t) or [] for t in texts]
    count = Counter(p for g in found for p in {(x, y) for a, b in g for x in a for y in b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g in found:
        links = [(x, y) for a, b in g for x in a for y in b]
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n_best = sum(count[p] == best[p[0]] for p in links)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), n_best, sum(count[p] for p in links), spelt))
    return out


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, m, k = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, m)), rng.integers(0, 3, (m, k))

        def sparse(d):
            rows, cols = np.nonzero(d)
            return Csr(np.append(0, np.cumsum(np.bincount(rows, minlength=len(d)))), cols, d[rows, cols], d.shape[1])

        def dense(c):
            d = np.zeros((len(c.indptr) - 1, c.columns), np.int64)
            d[np.repeat(np.arange(len(d)), np.diff(c.indptr)), c.indices] = c.values
            return d

        assert (dense(gustavson(sparse(x), sparse(y))) == x @ y).all()
        assert (dense(transposed(sparse(x))) == x.T).all()
    assert dense(overlap_links(np.array([2, 3]), np.array([1, 4]))).tolist() == [[1, 1], [0, 3]]


def test_pieces_align_as_whole_texts(own, plain_groups):
    rnd = random.Random(5)
    parts = [" ", " ", "\n", "\t", ".", ",", "a", "b", "on", "the", "²", "_", "é", "<s>", "<|endoftext|>", " ", "　", "日本", "😀", "1", "23", "'s", "\r", "▁", "ß", "\x00", "\x01", ".com"]
    seen = 0
    for _ in range(700):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3)]
        doc, place, right = own.places(texts)
        for k, text in enumerate(texts):
            want, at = plain_groups(text), place[doc == k]
            assert right[k] == (want is not None)
            seen += want is not None
            assert b"".join(own.text[i] for i in at)[:-1].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want or [])
            assert own.sums[at, 3].sum() == sum(len(a) * len(b) for a, b in want or [])
    assert seen > 1000


def test_memory_is_bounded_and_changes_nothing():
    small, large = (Aligner(byte_bpe_path(), piece_bpe_path(), most) for most in (40_000, 1 << 26))
    rnd = random.Random(1)
    for _ in range(40):
        texts = [" ".join(rnd.choice(["the", "and", "".join(rnd.choices("aeioustr", k=6))]) for _ in range(40)) for _ in range(4)]
        out = []
        for x in (small, large):
            doc, place, _ = x.places(texts)
            out.append((doc.tolist(), [x.text[i] for i in place], x.sums[place].tolist(), [c.tolist() for c in x.links(doc, place)]))
        assert out[0] == out[1]
    assert small.used < 80_000 < large.used


@pytest.mark.parametrize("top", [0, 40, 1 << 20])
def test_edge_cases_and_rare_pairs(spark, plain_groups, top):
    long = "thererfore ofthe Straßenbahn " * 4000
    rows = [(1, None), (2, ""), (3, " "), (4, "same words here"), (4, "same words here"), (None, "a▁b"), (5, "a" * 3000), (6, long), (7, "<|endoftext|> naïve 日本語")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS n", "3 AS row", "4 AS groups")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = sorted(tuple(r[c] for c in ["doc_id", *columns]) for r in align(docs, top_pairs=top).na.fill(-1, ["doc_id"]).collect())
    want = plain([t for _, t in rows], plain_groups)
    assert got == sorted((-1 if d is None else d, *w) for (d, _), w in zip(rows, want))
    assert align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_whole_texts(spark, plain_groups):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain([r.text for r in docs], plain_groups)
    got = {r.doc_id: r for r in op13_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum) == w[:6]
        assert g.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
