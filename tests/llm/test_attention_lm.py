"""Operator 12 against loops over single tokens, and held-out likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from crawlmill.llm import attention_lm as lm
from crawlmill.llm.encoding import byte_bpe_path, encoder

SCHEMA = "doc_id long, text string"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def plain_base(rows):
    """(n_tokens, n_known, N, base_score) of each row."""
    learnt = Counter(w for d, t in rows if not held(d) for w in [*plain_words(t), None])
    n, v = sum(learnt.values()), len(learnt)
    out = []
    for _, t in rows:
        tokens = [*plain_words(t), None]
        out.append((len(tokens), sum(learnt[w] > 0 for w in tokens), n, sum(math.log10((learnt[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


def plain_score(scorer, ids):
    """One id at a time: attention over its window, written out."""
    stream, total = [scorer.end, *ids, scorer.end], 0.0
    for t in range(len(ids) + 1):
        window = max(0, t // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        logit = [float(scorer.queries[stream[t]] @ scorer.keys[stream[s]]) + float(scorer.mask[lm.STRIDE - 1, lm.CONTEXT + lm.STRIDE - 1 - (t - s)]) for s in range(window, t + 1)]
        a = np.exp(np.array(logit) - max(logit))
        state = scorer.embed[stream[t]] + (a / a.sum()) @ scorer.values[stream[window : t + 1]]
        z = state @ scorer.mix + scorer.bias
        z = np.exp(z - z.max())
        total += math.log10(float((z / z.sum()) @ scorer.table[stream[t + 1]]))
    return total


@pytest.fixture(scope="module")
def small():
    """A scorer over 40 ids: id k is mostly followed by k + 1."""
    rng = np.random.default_rng(0)
    spans = [np.where(rng.random(300) < 0.9, np.arange(300) % 39, rng.integers(0, 39, 300)) for _ in range(40)]
    shares = np.bincount(np.concatenate(spans), minlength=40) + 0.01
    shares = shares / shares.sum()
    return spans, shares, lm.Scorer(lm.train(spans, shares, 400), shares, 39)


def test_windows_score_each_id_once(small):
    _, _, scorer = small
    rnd = random.Random(0)
    texts = [np.array([rnd.randrange(39) for _ in range(n)], np.int64) for n in (0, 1, 15, 16, 17, 31, 32, 33, 100, 0, 257)]
    got = scorer.texts(texts)
    assert got == pytest.approx([plain_score(scorer, t.tolist()) for t in texts], rel=1e-4)
    of, logs = scorer.ids(texts)
    assert np.bincount(of).tolist() == [len(t) + 1 for t in texts] and len(logs) == len(of)


def test_probabilities_add_up_and_the_model_learns(small):
    spans, shares, scorer = small
    assert scorer.table.sum(axis=0) == pytest.approx(np.ones(lm.MIXED), rel=1e-4)
    context = np.arange(7)
    last = [scorer.ids([np.append(context, y)])[1][len(context)] for y in range(40)]
    assert sum(10.0 ** float(x) for x in last) == pytest.approx(1, rel=1e-3)
    assert int(np.argmax(last)) == 7
    fresh = np.arange(500, 900) % 39
    assert scorer.texts([fresh])[0] / 401 > -0.5 > np.log10(shares[fresh]).mean()


def test_large_values_need_their_maximum():
    x = np.array([[200.0, 199.0], [-300.0, -300.0], [0.0, 1.0]], np.float32)
    a, sums = lm._softmax(x.copy())
    assert a / sums[:, None] == pytest.approx(np.array([[0.731, 0.269], [0.5, 0.5], [0.269, 0.731]]), abs=1e-3)


@pytest.mark.parametrize("top", [0, 3, 1 << 18])
def test_edge_cases(spark, top):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "The the THE cat"), (4, "The the THE cat"), (None, "É<|endoftext|> don't"), (6, "ab cd " * 30_000), (7, "x" * 5000), *((k, f"cat number {k}") for k in range(10, 40))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS row", "4 AS ids")
    got = lm.score_texts(docs, steps=3, top_words=top).collect()
    want = sorted((-1 if d is None else d, held(d), *w) for (d, _), w in zip(rows, plain_base(rows)))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(f[6] < 0 for f in found)
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), steps=3).collect() == []
    only_held = [(d, "one two") for d in range(100) if held(d)]
    got = lm.score_texts(spark.createDataFrame(only_held, SCHEMA), steps=3).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)} and len(got) == len(only_held)


def test_query_on_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm.op12_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    ids = encoder(byte_bpe_path(), plain=True).encode([" " + " ".join(plain_words(t)) if plain_words(t) else "" for _, t in rows])
    ids = [np.append(np.frombuffer(x, "<u4"), 50256) for x in ids]
    learnt = np.bincount(np.concatenate([x for (d, _), x in zip(rows, ids) if not held(d)]), minlength=50257) + 0.01
    by_share = np.log10(learnt / learnt.sum())
    plain = 0.0
    for (d, _), w, x in zip(rows, plain_base(rows), ids):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        plain += held(d) * by_share[x].sum()
    # held-out texts are far likelier than by the shares of their ids
    assert sum(r.score for r in got.values() if r.held_out) > 0.8 * plain


def test_words_of_ids():
    begins = np.array([True, False, False])
    texts = [[0, 1, 2, 0], [], [0, 1, 1, 1, 1, 0, 2], [0, 2, 1, 2]]
    words = lm.words_of([np.array(x, "<u2").tobytes() for x in texts], begins)
    assert words.text.tolist() == [0, 0, 2, 2, 3] and words.short.tolist() == [True, True, False, True, True]
    assert words.codes.tolist() == [1 + (2 << 16) + (3 << 32), 1, 1 + (3 << 16), 1 + (3 << 16) + (2 << 32) + (3 << 48)]
    assert words.long == [np.array([0, 1, 1, 1, 1], "<u2").tobytes()]
    assert lm._keys(words.codes[:1]).to_pylist() == [int(words.codes[0]).to_bytes(8, "little")]


def test_pass_takes_each_id_once():
    rng = np.random.default_rng(1)
    shares = np.full(40, 1 / 40)
    start = lm.train([rng.integers(0, 39, 200)], shares, 5)
    texts = [rng.integers(0, 39, n).astype("<u2") for n in (0, 1, 40, 500, 3, 0, 90)]
    want = np.bincount(np.concatenate(texts), minlength=40)
    want[39] += len(texts)
    for batches in ([texts], [texts[:2], [], texts[2:]], [[t] for t in texts]):
        weights, times = lm.train_on(start, shares, batches, 39)
        assert times.tolist() == want.tolist()
        assert weights.counts.sum(dtype=float) == pytest.approx(start.counts.sum(dtype=float) + want.sum(), rel=1e-4)
    assert (start.embed != weights.embed).any() and all((getattr(start, k) != getattr(weights, k)).any() for k in lm._SMALL)


def test_merged_weights():
    shares = np.full(600, 1 / 600)
    start = lm.train([np.arange(300) % 250], shares, 5)
    ids, n = [np.arange(300, 400, dtype="<u2"), np.arange(350, 500, dtype="<u2")], 252
    tasks = [lm.train_on(start, shares, [[x]], 599) for x in ids]
    parts = [p for w, times in tasks for p in lm.parts_of(w, start, times, times.sum() / n)]
    table = {b: pa.Table.from_pylist([dict(zip(("block", "times", "rows", "counts"), p)) for p in parts if p[0] == b], pa.schema(lm._PARTS)) for b in {p[0] for p in parts}}
    got = lm.put_together(pa.concat_tables([lm.merged(t) for t in table.values()]))
    (a, at), (b, bt) = tasks
    assert got.counts == pytest.approx(a.counts + b.counts - start.counts, abs=1e-3)
    for i, want in ((310, a.embed), (450, b.embed), (375, (a.embed + b.embed) / 2), (550, start.embed)):
        assert got.embed[i] == pytest.approx(want[i], abs=1e-4)
    assert got.mix == pytest.approx((at.sum() * a.mix + bt.sum() * b.mix) / n, abs=1e-4)


def test_all_training_documents_train_the_weights(spark):
    """Documents go one way or the other, and the weights begin with none; words and their counts are the same."""
    rnd = random.Random(2)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    texts = {d: " ".join(words[(s + k) % 20] for k in range(60)) for d in range(3000) if not held(d) for s in [rnd.randrange(20)]}
    one, other = [d for d in range(10_000, 10_100) if held(d)][:2]
    way = " ".join(words * 3)

    def led(turned):
        rows = [(d, " ".join(reversed(t.split())) if turned and d > 100 else t) for d, t in texts.items()]
        docs = spark.createDataFrame([*rows, (one, way), (other, " ".join(reversed(way.split())))], SCHEMA).coalesce(1)
        got = {r.doc_id: r.score for r in lm.score_texts(docs, fit_docs=0).collect()}
        return got[one] - got[other]

    a, b = led(False), led(True)
    assert a > b + 1, (a, b)


def test_step_is_the_same_in_parts(monkeypatch):
    """A step's slopes are of parts of its windows, in as few products as stay on one core."""
    rng = np.random.default_rng(3)
    shares = np.full(40, 1 / 40)
    start, window = lm.untrained(shares), rng.integers(0, 39, (70, 33))
    x, y = rng.normal(size=(70, 32, lm.WIDTH)).astype("f"), rng.normal(size=(70, 32, lm.MIXED)).astype("f")
    assert lm._times(x, start.mix) == pytest.approx(x @ start.mix, abs=1e-4)
    assert lm._transposed_times(x, y) == pytest.approx(np.einsum("wij,wik->jk", x, y), abs=1e-3)
    for n, width in ((1, 64), (64, 64), (256, 64), (32, 32)):
        joined = lm._joined(x[:1].repeat(n, axis=0), lm.ONE_THREAD // (32 * width))
        assert joined.shape[1] * 32 * width <= lm.ONE_THREAD and (n == 1 or joined.shape[0] < n)
    got = []
    for part in (1, 32, 1000):
        monkeypatch.setattr(lm, "PART_WINDOWS", part)
        trainer = lm.Trainer(start, shares)
        for _ in range(3):
            trainer.step(window, 0.01, 0.1)
        got.append(trainer.weights())
    for other in got[1:]:
        assert all(getattr(got[0], k) == pytest.approx(getattr(other, k), abs=1e-4) for k in ("embed", "counts", *lm._SMALL))


def test_a_worker_scores_few_ids_at_a_time():
    sizes = [0, 10, 3000, 0, 400, 700, 90, 5000, 0, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(n) for n in sizes]), pa.array(range(len(sizes)))], ["ids", "row"])
    parts = list(lm.few_ids(batch, 1000))
    assert [r for p in parts for r in p.column(1).to_pylist()] == list(range(len(sizes)))
    assert max(sum(map(len, p.column(0).to_pylist())) for p in parts if p.num_rows > 1 and max(map(len, p.column(0).to_pylist())) <= 1000) <= 2000 and len(parts) == 4
    assert [p.num_rows for p in lm.few_ids(batch.slice(0, 0), 1000)] == [0]


def test_unknown_words_of_a_text():
    begins = np.array([True, False, False])
    texts = [np.array(x, "<u2").tobytes() for x in ([0, 1, 2, 0, 0], [], [0, 1, 1, 1, 1, 0, 2, 0, 1, 1, 1, 1, 0], [0, 1, 2])]
    code = lambda *x: sum((i + 1) << (16 * k) for k, i in enumerate(x)).to_bytes(8, "little")
    _, _, rare = lm.Counts([code(0, 1, 2)], np.array([7]), 3).look_up(texts, begins)
    long = np.array([0, 1, 1, 1, 1], "<u2").tobytes()
    assert [{(x["word"], x["times"]) for x in t} for t in rare.to_pylist()] == [{(code(0), 2)}, set(), {(long, 2), (code(0, 2), 1), (code(0), 1)}, set()]


def test_rows_of_ids_are_summed_once_for_each():
    rng = np.random.default_rng(4)
    for ids in (np.array([5]), np.repeat(7, 3 * lm.FEW_ROWS), np.minimum(rng.geometric(0.03, 900), 299), np.arange(40), np.repeat(np.arange(9), np.arange(lm.FEW_ROWS - 4, lm.FEW_ROWS + 5))):
        ids = rng.permutation(ids)
        met, rows = lm.Met.of(ids), rng.normal(size=(len(ids), 6)).astype("f")
        assert met.ids.tolist() == sorted(set(ids.tolist())) and (met.ids[met.place] == ids).all()
        want = np.zeros((300, 6))
        np.add.at(want, ids, rows)
        assert met.sums(rows) == pytest.approx(want[met.ids], abs=1e-4)


def test_slopes_are_those_of_the_likelihood():
    """Each slope against a difference of the step's log likelihood, in double precision."""
    rng, n, windows = np.random.default_rng(5), 6, 3
    small = {"qkv": rng.normal(0, 0.5, (lm.WIDTH, 2 * lm.KEY + lm.WIDTH)), "distance": rng.normal(size=lm.CONTEXT + lm.STRIDE), "mix": rng.normal(0, 0.3, (lm.WIDTH, lm.MIXED)), "bias": rng.normal(size=lm.MIXED)}
    e, mixed = rng.normal(0, 0.5, (windows, n, lm.WIDTH)), rng.random((windows, n, lm.MIXED))
    behind = np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0)

    def loss(w, e):
        q, k, v = np.split(e @ w["qkv"], [lm.KEY, 2 * lm.KEY], axis=2)
        a = np.exp(q @ k.transpose(0, 2, 1) * lm.KEY**-0.5 + w["distance"][behind]) * np.tri(n)
        z = np.exp((e + a / a.sum(axis=2, keepdims=True) @ v) @ w["mix"] + w["bias"])
        return -np.log((z * mixed).sum(axis=2) / z.sum(axis=2)).sum()

    f = {k: x.astype("f") for k, x in small.items()}
    step, de, r = lm.Step.of(f, n, np.where(np.tri(n) > 0, 0, -1e9).astype("f"), behind), *(np.empty((windows, n, k), "f") for k in (lm.WIDTH, lm.MIXED))
    step.slopes(e.astype("f"), mixed.astype("f"), de, r)
    assert (r * step.lift).sum(axis=2) == pytest.approx(np.ones((windows, n)), rel=1e-4)
    for k, got in (*step.small(behind).items(), ("e", de)):
        for at in [tuple(rng.integers(0, s) for s in got.shape) for _ in range(12)]:
            near = []
            for by in (1e-5, -1e-5):
                x = {**small, "e": e} | {k: (e if k == "e" else small[k]).copy()}
                x[k][at] += by
                near.append(loss(x, x["e"]))
            assert got[at] == pytest.approx((near[0] - near[1]) / 2e-5, abs=2e-3), (k, at)


def test_large_biases_are_lifted_alike(small):
    _, shares, scorer = small
    weights = lm.untrained(shares)._replace(bias=np.linspace(-60, 60, lm.MIXED).astype("f"))
    other = lm.Scorer(weights, shares, 39)
    texts = [np.arange(n) % 39 for n in (0, 3, 16, 40)]
    assert other.texts(texts) == pytest.approx([plain_score(other, t.tolist()) for t in texts], rel=1e-4)


def test_ids_of_words_are_those_of_the_text():
    import random as rnd

    own, take = encoder(byte_bpe_path(), plain=True), rnd.Random(6).choice
    texts = ["don't, it's.", "a,b.c 1,2.", "É, é. ,. ., _. x_.", "<|endoftext|> x", "\x01 a", "½, ². ⅷ.", "x  y ", " x y", "x\x1c y", "", " \n"]
    texts += ["".join(take(["a", "b", "é", ".", ",", " ", " ", "'s", "1", "_", "\x1f", "-", " ", "<|endoftext|>"]) for _ in range(30)) for _ in range(200)]
    words = [plain_words(t) for t in texts]
    want = [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch_fast([" " + " ".join(w) if w else "" for w in words], add_special_tokens=False)]
    assert own.encode_words([[x.encode() for x in w] for w in words]) == want
