"""Language-model scores by a causal self-attention model over subword ids.

A position's state is its id's embedding plus what it attends to in the window before it: products of query and key plus a bias by
distance. The state's softmax mixes unigram distributions over the whole vocabulary, so the probability of an id takes
one row of a table instead of a softmax over all ids, and still adds up to one. Weights are trained in numpy by Adam, the
mixed distributions by online expectation-maximisation, on every id of all training documents: tasks go on from common
weights that a bounded number of documents gives, each through its own documents, and what they have learnt is merged.
What is lacking is filled up by the counts of the whole corpus.

A text is read in windows of CONTEXT + STRIDE ids that overlap by CONTEXT, many at a time under one mask, and each window scores its
last STRIDE ids, so each id is scored once, with CONTEXT ids before it or all there are.
"""

from __future__ import annotations

import io
import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import commonest, doc_remainder, hold_alone, load, scan_partitions, short_batches, smallest_hashes, text_or_empty, written
from crawlmill.llm.encoding import byte_bpe_path, encoder
from crawlmill.storage import read_whole, written_to

#: Ids of a window that are context only, and ids that it scores.
CONTEXT, STRIDE = 16, 16
#: Documents that the weights begin with, those of smallest hash; of a longer one, spans of SPAN ids at even distances over all of it.
FIT_DOCS, FIT_SPANS, SPAN = 2000, 8, 256
#: Windows of a training step, and steps; rates of Adam for weights and of Adagrad for embeddings.
FIT_WINDOWS, FIT_STEPS = 64, 4000
WEIGHT_RATE, EMBED_RATE = 0.02, 0.3
#: Windows of a step of the pass over all training documents, and its rate of Adam.
PASS_WINDOWS, PASS_RATE = 256, 0.002
#: Windows of a step whose slopes are found together, so that they stay in a core's cache.
PART_WINDOWS = 32
#: Tasks of that pass: at least so many, or one for so many ids; and ids of a block that weights are merged by.
LEAST_TASKS, TASK_IDS, BLOCK = 12, 1 << 25, 256
#: Sizes of states and keys, and distributions that are mixed.
WIDTH, KEY, MIXED = 32, 16, 64
#: Ids' worth of corpus counts that each mixed distribution is filled up with.
PRIOR = 50.0
#: Windows scored together, so that they stay in a core's cache.
TOGETHER = 128
#: Bytes of ids that a worker scores at a time.
SCORED_BYTES = 1 << 18
#: Words whose counts all workers hold, the commonest; other words meet their counts by a join.
TOP_WORDS = 1 << 18
#: Words that a task counts before it sends them.
COUNTED = 1 << 19


class Weights(NamedTuple):
    embed: np.ndarray  # ids by WIDTH
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    distance: np.ndarray  # bias by distance
    mix: np.ndarray  # WIDTH by MIXED
    bias: np.ndarray
    counts: np.ndarray  # ids by MIXED: expected counts of each distribution
    squares: np.ndarray | None = None  # ids by WIDTH: sums of squared slopes, which slow embeddings down


def _softmax(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp of x up to a factor per row, and its sums over the last axis, weighted if weights are given. Each row's maximum is taken off first
    where a value is too large or a sum may vanish, which is rare and shows in the sums, as finding all maxima takes long.
    """
    weights = np.ones(x.shape[-1], np.float32) if weights is None else weights
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.exp(x)
        sums = out @ weights
    if not (sums.min() > 1e-25 and sums.max() < 1e25):
        out = np.exp(x - x.max(axis=-1, keepdims=True))
        sums = out @ weights
    return out, sums


def _joined(x: np.ndarray, most: int) -> np.ndarray:
    """x, windows by ids by numbers, as fewer and longer windows of `most` ids at most where their number divides."""
    n, ids, width = x.shape
    each = math.gcd(n, max(1, most // max(1, ids)))
    return x.reshape(n // each, each * ids, width)


#: Multiplications of a product, beyond which numpy's library deals them to other cores' threads.
ONE_THREAD = 1 << 18


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, in as few products as stay on the task's own core."""
    return (_joined(x, ONE_THREAD // w.size) @ w).reshape(*x.shape[:2], w.shape[1])


def _transposed_times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of all windows' products of x, transposed, and y; on the task's own core as well."""
    most = ONE_THREAD // (x.shape[2] * y.shape[2])
    return (_joined(x, most).transpose(0, 2, 1) @ _joined(y, most)).sum(axis=0)


def _lift(bias: np.ndarray) -> np.ndarray:
    """exp of the bias up to a factor; none is less than exp(-60) of the largest, so none vanishes."""
    return np.exp(np.maximum(bias - bias.max(), np.float32(-60)))


def _column_sums(x: np.ndarray) -> np.ndarray:
    """The sums over all windows and ids."""
    x = _joined(x, ONE_THREAD // 32 // x.shape[2])
    return (np.ones((1, x.shape[1]), np.float32) @ x).sum(axis=(0, 1))


#: Rows of an id, up to which they are summed together with those of other ids.
FEW_ROWS = 16


class Met(NamedTuple):
    """The distinct ids of some, and where each stands."""

    ids: np.ndarray
    place: np.ndarray  # of each id among the distinct ones
    order: np.ndarray  # of all, by id
    first: np.ndarray  # of each distinct id in that order
    times: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Met:
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        times, place = np.diff(first, append=len(ids)), np.empty(len(ids), np.intp)
        place[order] = np.repeat(np.arange(len(first)), times)
        return cls(ids[first], place, order, first, times)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Of each distinct id, the sum of its rows."""
        out = np.empty((len(self.ids), rows.shape[1]), rows.dtype)
        for i in np.flatnonzero(self.times > FEW_ROWS).tolist():
            begin = self.first[i]
            np.add.reduce(rows.take(self.order[begin : begin + self.times[i]], axis=0), axis=0, out=out[i])
        # of ids that occur seldom, all first rows, then all second ones
        few = np.flatnonzero(self.times <= FEW_ROWS)
        few = few[np.argsort(-self.times[few], kind="stable")]
        first, more = self.first[few], np.searchsorted(-self.times[few], -np.arange(1, FEW_ROWS))
        some = rows.take(self.order[first], axis=0)
        for k, n in enumerate(more[more > 0].tolist(), 1):
            some[:n] += rows.take(self.order[first[:n] + k], axis=0)
        out[few] = some
        return out


class Step(NamedTuple):
    """The small weights as a step's products take them, and the sums of their slopes so far."""

    qkv: np.ndarray
    qkv_back: np.ndarray
    mix: np.ndarray
    mix_back: np.ndarray  # lifted
    lift: np.ndarray  # exp of the bias, which sums, slopes and shares take afterwards instead of each state
    attend: np.ndarray  # bias by place and place
    slope: dict[str, np.ndarray]

    @classmethod
    def of(cls, w: dict[str, np.ndarray], n: int, mask: np.ndarray, behind: np.ndarray) -> Step:
        f = np.float32
        qkv = w["qkv"].copy()
        qkv[:, :KEY] *= f(KEY**-0.5)
        slope = {"qkv": np.zeros_like(qkv), "mix": np.zeros_like(w["mix"]), "bias": np.zeros(MIXED, f), "attend": np.zeros(n * n, f)}
        lift = _lift(w["bias"])
        return cls(qkv, qkv.T.copy(), w["mix"], (w["mix"] * lift).T.copy(), lift, w["distance"][behind[:n, :n]] + mask[:n, :n], slope)

    def slopes(self, e: np.ndarray, mixed: np.ndarray, de: np.ndarray, r: np.ndarray) -> None:
        """Of some windows' embeddings and their next ids' probabilities in the mixed distributions: adds to the small weights' slopes, and
        fills in the slopes of embeddings and the shares of the distributions, the latter yet to be lifted.
        """
        slope = self.slope
        qkv = _times(e, self.qkv)
        q, k, v = qkv[..., :KEY], qkv[..., KEY : 2 * KEY], qkv[..., 2 * KEY :]
        s = q @ k.transpose(0, 2, 1)
        s += self.attend
        a, sums = _softmax(s)
        a *= (1 / sums)[..., None]
        h = a @ v
        h += e
        pi, sums = _softmax(_times(h, self.mix), self.lift)
        mixed *= pi
        np.multiply(mixed, (1 / (mixed @ self.lift))[..., None], out=r)
        pi *= (1 / sums)[..., None]
        dz = np.subtract(pi, r, out=pi)
        dh = _times(dz, self.mix_back)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", a, ds)[..., None]
        ds *= a
        d = np.empty_like(qkv)
        np.matmul(ds, k, out=d[..., :KEY])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[..., KEY : 2 * KEY])
        np.matmul(a.transpose(0, 2, 1), dh, out=d[..., 2 * KEY :])
        slope["attend"] += np.add.reduce(ds.reshape(len(ds), -1), axis=0)
        slope["qkv"] += _transposed_times(e, d)
        slope["mix"] += _transposed_times(h, dz)
        slope["bias"] += _column_sums(dz)
        np.add(dh, _times(d, self.qkv_back), out=de)

    def small(self, behind: np.ndarray) -> dict[str, np.ndarray]:
        """The slopes of the small weights."""
        n = len(self.attend)
        qkv, seen = self.slope["qkv"], np.tri(n, dtype=bool).ravel()
        qkv[:, :KEY] *= np.float32(KEY**-0.5)
        distance = np.bincount(behind[:n, :n].ravel()[seen], self.slope["attend"][seen], CONTEXT + STRIDE).astype(np.float32)
        return {"qkv": qkv, "distance": distance, "mix": self.slope["mix"] * self.lift, "bias": self.slope["bias"] * self.lift}


class Trainer:
    """Weights in training: Adam for the small ones, Adagrad for embeddings, online expectation-maximisation for the mixed distributions."""

    def __init__(self, weights: Weights, shares: np.ndarray):
        f, length = np.float32, CONTEXT + STRIDE
        self.shares = shares.astype(f)
        self.embed, self.counts, self.squares = (np.array(x, f) for x in (weights.embed, weights.counts, weights.squares))
        self.small = {"qkv": np.concatenate([weights.query, weights.key, weights.value], axis=1)}
        self.small |= {k: np.array(getattr(weights, k), f) for k in ("distance", "mix", "bias")}
        self.first, self.second = ({k: np.zeros_like(x) for k, x in self.small.items()} for _ in range(2))
        behind = np.subtract.outer(np.arange(length), np.arange(length))
        self.mask, self.behind = np.where(behind >= 0, 0, -1e9).astype(f), np.maximum(behind, 0)
        # rows of counts are in units that grow where older counts fade
        self.t, self.scale, self.total = 0, 1.0, self.counts.sum(axis=0, dtype=np.float64)
        self.found = np.empty((0, length + 1, WIDTH + MIXED), f)

    def step(self, window: np.ndarray, rate: float, fade: float = 0.0) -> None:
        """Learn from rows of ids, whose every id but the first is to be foretold; earlier counts lose the share `fade`."""
        self.t += 1
        t, f, w, n = self.t, np.float32, self.small, window.shape[1] - 1
        self.scale /= 1 - fade
        prior = f(PRIOR * self.scale)
        # what is looked up or learnt by id is found for the distinct ids of all windows
        met = Met.of(window.ravel())
        place, embed, counts = met.place.reshape(window.shape), self.embed.take(met.ids, axis=0), self.counts.take(met.ids, axis=0)
        mixed = (counts + (prior * self.shares.take(met.ids))[:, None]) / (self.total + prior).astype(f)
        own = Step.of(w, n, self.mask, self.behind)
        # of each place of a window, the slopes of its id's embedding as what is read, then its shares of the distributions as what is foretold
        if self.found.shape[:2] != window.shape:
            self.found = np.empty((*window.shape, WIDTH + MIXED), f)
        found = self.found
        found[:, -1, :WIDTH], found[:, 0, WIDTH:] = 0, 0
        for i in range(0, len(window), PART_WINDOWS):
            at = slice(i, i + PART_WINDOWS)
            own.slopes(embed.take(place[at, :-1], axis=0), mixed.take(place[at, 1:], axis=0), found[at, :-1, :WIDTH], found[at, 1:, WIDTH:])
        rows = met.sums(found.reshape(-1, WIDTH + MIXED))
        slopes, shares, each = rows[:, :WIDTH], rows[:, WIDTH:], f(1 / (len(window) * n))
        slopes *= f(CONTEXT + STRIDE) * each
        squares = self.squares.take(met.ids, axis=0) + slopes * slopes
        self.squares[met.ids] = squares
        self.embed[met.ids] = embed - f(EMBED_RATE) * slopes / np.sqrt(squares)
        for name, g in own.small(self.behind).items():
            g *= each
            self.first[name] += 0.1 * (g - self.first[name])
            self.second[name] += 0.02 * (g * g - self.second[name])
            w[name] -= (rate / (1 - 0.9**t) * self.first[name] / (np.sqrt(self.second[name] / (1 - 0.98**t)) + 1e-8)).astype(f)
        shares *= own.lift * f(self.scale)
        self.counts[met.ids] = counts + shares
        self.total += shares.sum(axis=0)
        if self.scale > 1e6:
            self.counts /= f(self.scale)
            self.total, self.scale = self.counts.sum(axis=0, dtype=np.float64), 1.0

    def weights(self) -> Weights:
        query, key, value = np.split(self.small["qkv"], [KEY, 2 * KEY], axis=1)
        return Weights(self.embed, query, key, value, self.small["distance"], self.small["mix"], self.small["bias"], self.counts / np.float32(self.scale), self.squares)


def untrained(shares: np.ndarray, seed: int = 0) -> Weights:
    rng, f, n_ids = np.random.default_rng(seed), np.float32, len(shares)
    query, key, value = (rng.normal(0, WIDTH**-0.5, (WIDTH, n)).astype(f) for n in (KEY, KEY, WIDTH))
    mix, embed = rng.normal(0, 0.3, (WIDTH, MIXED)).astype(f), rng.normal(0, 0.5, (n_ids, WIDTH)).astype(f)
    counts = (200 * shares[:, None] * rng.gamma(0.3, 1 / 0.3, (n_ids, MIXED))).astype(f)
    return Weights(embed, query, key, value, np.zeros(CONTEXT + STRIDE, f), mix, np.zeros(MIXED, f), counts, np.full((n_ids, WIDTH), 1e-3, f))


def train(spans: list[np.ndarray], shares: np.ndarray, steps: int = FIT_STEPS, seed: int = 0) -> Weights:
    """Weights from stretches of ids; shares are the ids' shares of the corpus, none of them zero. No ids leave them untrained."""
    rng, length = np.random.default_rng(seed), CONTEXT + STRIDE
    spans = [s for s in spans if len(s) > 1]
    if not spans:
        return untrained(shares, seed)
    # each span is padded in front by its own first id, so that short spans have windows
    flat = np.concatenate([np.append(np.full(max(0, length + 1 - len(s)), s[0]), s) for s in spans]).astype(np.int64)
    sizes = np.maximum([len(s) for s in spans], length + 1)
    begins = np.concatenate([np.arange(n - length) + o for n, o in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist())])
    trainer = Trainer(untrained(shares, seed), shares)
    for t in range(1, steps + 1):
        window = flat[begins[rng.integers(0, len(begins), FIT_WINDOWS)][:, None] + np.arange(length + 1)]
        trainer.step(window, WEIGHT_RATE * min(1, t / 50) * (1 - 0.9 * t / steps), min(0.02, t**-0.7) if t > 1 else 0.0)
    return trainer.weights()


def train_on(weights: Weights, shares: np.ndarray, batches: Iterable[list[np.ndarray]], end: int) -> tuple[Weights, np.ndarray]:
    """`weights` trained once on each id of all texts and on the end after each, and how often each id was foretold or read.

    Texts follow one another, parted by ends, in windows that share no id to be foretold; those of a batch come in random order.
    """
    rng, length = np.random.default_rng(0), CONTEXT + STRIDE
    trainer, times, rest = Trainer(weights, shares), np.zeros(len(shares), np.int64), np.array([end], np.uint16)
    stop = rest.copy()
    for texts in batches:
        ids = np.concatenate([rest, *(x for t in texts for x in (t, stop))])
        n = (len(ids) - 1) // length
        times += np.bincount(ids[1 : n * length + 1], minlength=len(times))
        order = rng.permutation(n) * length
        for i in range(0, n, PASS_WINDOWS):
            trainer.step(ids[order[i : i + PASS_WINDOWS, None] + np.arange(length + 1)], PASS_RATE * min(1, (trainer.t + 1) / 50))
        rest = ids[n * length :]
    if len(rest) > 1:
        times += np.bincount(rest[1:], minlength=len(times))
        trainer.step(rest[None], PASS_RATE * min(1, (trainer.t + 1) / 50))
    return trainer.weights(), times


class Scorer:
    """Log10 probabilities of id sequences, each followed by the end id."""

    def __init__(self, weights: Weights, shares: np.ndarray, end: int):
        f = np.float32
        self.end = end
        self.mix, self.bias = weights.mix, weights.bias
        # what is looked up of an id as context, as one that is read, and as one that is foretold
        self.seen = weights.embed @ np.append(weights.key, weights.value, axis=1)
        self.read = np.append((weights.embed @ weights.query) * f(KEY**-0.5), weights.embed, axis=1)
        self.keys, self.values, self.queries, self.embed = self.seen[:, :KEY], self.seen[:, KEY:], self.read[:, :KEY], self.read[:, KEY:]
        self.lift = _lift(self.bias)
        self.lifted = weights.counts + (PRIOR * shares).astype(f)[:, None]
        self.lifted *= (self.lift / self.lifted.sum(axis=0, dtype=np.float64)).astype(f)
        behind = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(CONTEXT + STRIDE)
        self.mask = np.where(behind >= 0, weights.distance[np.clip(behind, 0, CONTEXT + STRIDE - 1)], -1e9).astype(f)

    @property
    def table(self) -> np.ndarray:
        """The mixed distributions: each id's probabilities."""
        return self.lifted / self.lift

    def ids(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, log10 probability) of each id of the sequences and of each end, in order."""
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        windows = -(-sizes // STRIDE)
        first, n = np.cumsum(windows) - windows, int(windows.sum())
        # each sequence fills windows of its own: an end and its ids are read, its ids and an end foretold
        at = np.arange(int(sizes.sum())) + np.repeat(first * STRIDE - (np.cumsum(sizes) - sizes), sizes)
        stop = np.array([self.end], np.int64)
        stream = np.concatenate([x for s in sequences for x in (stop, s)] + [stop]).astype(np.int64)
        read, follows = np.full(CONTEXT + n * STRIDE, self.end), np.full(n * STRIDE, self.end)
        read[CONTEXT + at], follows[at] = stream[:-1], stream[1:]
        begins = np.zeros(n, bool)
        begins[first] = True
        out = np.empty((n, STRIDE), np.float32)
        for i in range(0, n, TOGETHER):
            part = slice(i, min(n, i + TOGETHER))
            begin, end = part.start * STRIDE, part.stop * STRIDE
            # windows overlap in what they see
            seen = self.seen.take(read[begin : CONTEXT + end], axis=0)
            seen = np.lib.stride_tricks.as_strided(seen, ((end - begin) // STRIDE, CONTEXT + STRIDE, seen.shape[1]), (STRIDE * seen.strides[0], *seen.strides), writeable=False)
            own = self.read.take(read[CONTEXT + begin : CONTEXT + end], axis=0).reshape(len(seen), STRIDE, -1)
            s = own[..., :KEY] @ seen[..., :KEY].transpose(0, 2, 1)
            s += self.mask
            s[begins[part], :, :CONTEXT] = -1e9
            a, sums = _softmax(s)
            h = a @ seen[..., KEY:]
            h *= (1 / sums)[..., None]
            h += own[..., KEY:]
            z, sums = _softmax(_times(h, self.mix), self.lift)
            np.divide(np.einsum("ijk,ijk->ij", z, self.lifted.take(follows[begin:end], axis=0).reshape(z.shape)), sums, out=out[part])
        out = np.log10(out.ravel()[at])
        return np.repeat(np.arange(len(sizes)), sizes), out

    def texts(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each sequence and its end."""
        if not sequences:
            return np.zeros(0)
        of, logs = self.ids(sequences)
        return np.add.reduceat(logs.astype(np.float64), np.searchsorted(of, np.arange(len(sequences))))


def _packed(weights: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights._asdict())
    return out.getvalue()


def _unpacked(data: pa.Buffer) -> Weights:
    with np.load(io.BytesIO(data)) as z:
        return Weights(**{k: z[k] for k in Weights._fields})


#: Kinds of a part: a block of BLOCK ids' rows of embed and counts, or all small weights, as block -1.
_SMALL = ("query", "key", "value", "distance", "mix", "bias")


def parts_of(weights: Weights, start: Weights, times: np.ndarray, share: float) -> Iterator[tuple]:
    """(block, times, rows, counts) of weights that a task has trained from `start` on a share of all ids.

    Counts are those that the task has added, and the share of those of `start`.
    """
    f = np.float32
    yield -1, np.array([times.sum()], f).tobytes(), np.concatenate([getattr(weights, k).ravel() for k in _SMALL]).astype(f).tobytes(), b""
    for i in range(0, len(times), BLOCK):
        at = slice(i, i + BLOCK)
        added = weights.counts[at] - f(1 - share) * start.counts[at]
        yield i // BLOCK, times[at].astype(f).tobytes(), weights.embed[at].tobytes(), added.astype(f).tobytes()


def merged(table: pa.Table) -> pa.Table:
    """One part of the parts of a block: rows weighted by how often their ids occurred, and sums of counts."""
    weigh = rows = counts = 0.0
    for _, t, r, c in zip(*(table[k].to_pylist() for k in ("block", "times", "rows", "counts"))):
        # an id that none has met keeps what all have
        t = np.frombuffer(t, np.float32).astype(np.float64)[:, None] + 1e-6
        weigh, rows, counts = weigh + t, rows + t * np.frombuffer(r, np.float32).reshape(len(t), -1), counts + np.frombuffer(c, np.float32).astype(np.float64)
    block, rows = table["block"][0].as_py(), (rows / weigh).astype(np.float32)
    return pa.table({"block": pa.array([block], pa.int32()), "times": [b""], "rows": [rows.tobytes()], "counts": [counts.astype(np.float32).tobytes()]}, pa.schema(_PARTS))


_PARTS = [("block", pa.int32()), ("times", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())]
_PARTS_SQL = "block int, times binary, rows binary, counts binary"


def put_together(parts: pa.Table) -> Weights:
    parts = parts.sort_by("block").to_pylist()
    small, at, found = np.frombuffer(parts[0]["rows"], np.float32), 0, {}
    for k, shape in (("query", (WIDTH, KEY)), ("key", (WIDTH, KEY)), ("value", (WIDTH, WIDTH)), ("distance", (CONTEXT + STRIDE,)), ("mix", (WIDTH, MIXED)), ("bias", (MIXED,))):
        found[k], at = small[at : at + math.prod(shape)].reshape(shape), at + math.prod(shape)
    embed, counts = (np.frombuffer(b"".join([p[k] for p in parts[1:]]), np.float32).reshape(-1, n) for k, n in (("rows", WIDTH), ("counts", MIXED)))
    return Weights(embed, counts=counts, **found)


def _sequence(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2").astype(np.int64)


class Words(NamedTuple):
    """The words of some texts, in order: those of few ids as numbers, longer ones as the bytes of their ids."""

    text: np.ndarray  # of each word
    short: np.ndarray  # whether it has SHORT ids at most
    codes: np.ndarray  # of short ones: an id plus one in every 16 bits
    long: list[bytes]  # of the others


#: Ids that a number of 64 bits holds.
SHORT = 4


def words_of(texts: list[bytes], begins: np.ndarray) -> Words:
    """Words begin at ids whose text begins with a blank, as each text's first id does."""
    ids = np.frombuffer(b"".join(texts), "<u2")
    start = np.flatnonzero(begins[ids])
    size = np.diff(start, append=len(ids))
    ends = np.cumsum([len(t) // 2 for t in texts])
    short = size <= SHORT
    at, n = start[short], size[short]
    codes = np.zeros(len(at), np.uint64)
    padded = np.append(ids, np.zeros(SHORT, "<u2")).astype(np.uint64) + np.uint64(1)
    for k in range(SHORT):
        codes |= np.where(k < n, padded[at + k], 0).astype(np.uint64) << np.uint64(16 * k)
    raw = ids.tobytes()
    long = [raw[2 * x : 2 * y] for x, y in zip(start[~short].tolist(), (start + size)[~short].tolist())]
    return Words(np.searchsorted(ends, start, "right"), short, codes, long)


def _keys(codes: np.ndarray) -> pa.Array:
    """Codes as the keys that stand for their words: 8 bytes, where longer words have more."""
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, 8 * len(codes) + 8, 8, dtype=np.int32).tobytes()), pa.py_buffer(codes.astype("<u8").tobytes())])


class Vocabulary(NamedTuple):
    size: int
    end: int
    begins: np.ndarray  # of each id, whether its text begins with a blank


def vocabulary(path: str) -> Vocabulary:
    """Of a byte-level tokenizer file; the end is its last special token."""
    own = encoder(path, plain=True)
    names = own.tokenizer.get_vocab()
    size = max(names.values()) + 1
    if size >= 1 << 16:
        raise ValueError("ids, and one more, are kept in 16 bits")
    begins = np.zeros(size, bool)
    begins[[i for s, i in names.items() if s.startswith(own.blank)]] = True
    return Vocabulary(size, max(own.tokenizer.get_added_tokens_decoder()), begins)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_words, ids): a text's words in lower case, each after a blank, as 16-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # of bytes: A-Z alone turn to lower case, and words part at ASCII white space
            words = [t.lower().split() for t in b.column(2).cast(pa.binary()).to_pylist()]
            ids = encoder(path, plain=True).encode_words(words)
            ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, words), pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "held_out", "n_words", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_remainder(10) == 0).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_words long, ids binary")


def corpus_counts(learnt: DataFrame, path: str, counted: int = COUNTED) -> DataFrame:
    """(word, id, n): how often each word (by its key) and each id (word empty) occurs in all rows of `learnt`."""

    def rows(words: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, pa.array(ids.astype(np.int32)), pa.array(n)], ["word", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        ids = np.zeros(own.size, np.int64)
        codes, times, long = np.zeros(0, np.uint64), np.zeros(0, np.int64), Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            yield rows(_keys(codes), np.full(len(codes), -1), times)
            yield rows(pa.array(long.keys(), pa.binary()), np.full(len(long), -1), np.array(list(long.values()), np.int64))

        for b in batches:
            texts = b.column(0).to_pylist()
            ids += np.bincount(np.frombuffer(b"".join(texts), "<u2"), minlength=own.size)
            words = words_of(texts, own.begins)
            fresh, n = np.unique(words.codes, return_counts=True)
            codes, times = _merged(np.append(codes, fresh), np.append(times, n))
            long.update(words.long)
            if len(codes) + len(long) > counted:
                yield from sent()
                codes, times, long = codes[:0], times[:0], Counter()
        yield from sent()
        at = np.flatnonzero(ids)
        yield rows(pa.array([b""] * len(at), pa.binary()), at, ids[at])

    return learnt.select("ids").mapInArrow(run, "word binary, id int, n long").groupBy("word", "id").agg(F.sum("n").alias("n"))


def _merged(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their times."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(times[order], first) if len(codes) else times


class Counts:
    """What a worker knows of words: the counts of the commonest."""

    def __init__(self, keys: list[bytes], times: np.ndarray, ends: int):
        short = np.array([len(k) == 8 for k in keys], bool)
        codes = np.frombuffer(b"".join(k for k in keys if len(k) == 8), "<u8")
        order = np.argsort(codes)
        # the last place stands for words of unknown count, and no word is that of code 0
        self.codes = np.append(codes[order], np.uint64(0))
        self.times = np.append(times[short][order], 0)
        self.long = {k: n for k, n in zip(keys, times.tolist()) if len(k) != 8}
        self.ends = ends

    def look_up(self, texts: list[bytes], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each text: the sum of log10(c + 0.1) and the number of tokens with c > 0, its end included; and its words of unknown
        count, taken as c = 0, with how often it has them.
        """
        words = words_of(texts, begins)
        at = np.minimum(np.searchsorted(self.codes[:-1], words.codes), len(self.codes) - 1)
        hit = self.codes[at] == words.codes
        known = np.zeros(len(words.text), np.int64)
        known[words.short] = np.where(hit, self.times[at], 0)
        known[~words.short] = [self.long.get(w, 0) for w in words.long]
        n = len(texts)
        logs = np.bincount(words.text, np.log10(known + 0.1), n) + np.log10(self.ends + 0.1)
        tokens = np.bincount(words.text, known > 0, n).astype(np.int64) + (self.ends > 0)
        # of unknown words, one row of each text and word, with its times
        far = [(t, w) for t, w in zip(words.text[~words.short].tolist(), words.long) if w not in self.long]
        text = np.append(words.text[words.short][~hit], np.array([t for t, _ in far], np.int64))
        keys = pa.concat_arrays([_keys(words.codes[~hit]), pa.array([w for _, w in far], pa.binary())]).dictionary_encode()
        distinct = max(1, len(keys.dictionary))
        pairs, times = np.unique(text * distinct + keys.indices.to_numpy(), return_counts=True)
        flat = pa.StructArray.from_arrays([keys.dictionary.take(pa.array(pairs % distinct)), pa.array(times)], ["word", "times"])
        offsets = np.searchsorted(pairs // distinct, np.arange(n + 1)).astype(np.int32)
        return logs, tokens, pa.ListArray.from_arrays(pa.array(offsets), flat)


def few_ids(batch: pa.RecordBatch, most: int = SCORED_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices whose first column holds about `most` bytes, as scoring takes many times the memory of its ids."""
    sizes = pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for i, j in zip(at[:-1], at[1:]):
        yield batch.slice(i, j - i)


def fit(learnt: DataFrame, shares: np.ndarray, end: int, n_ids: int, fit_docs: int = FIT_DOCS, steps: int = FIT_STEPS) -> str:
    """Where parts of the weights are written, which all rows of `learnt`, of `n_ids` ids and ends, have trained; no rows give no parts.

    The weights begin in one task, with `steps` steps on spans of the `fit_docs` documents of smallest hash, so that tasks have
    the same distributions to go on with. Then tasks train them on every id of their documents, and are merged once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                x = np.concatenate([[end], np.frombuffer(x, "<u2"), [end]]).astype("<u2")
                if len(x) <= FIT_SPANS * SPAN:
                    out.append([x.tobytes()])
                else:
                    out.append([x[i : i + SPAN].tobytes() for i in np.linspace(0, len(x) - SPAN, FIT_SPANS).astype(int).tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.binary()))], ["place", "spans"])

    def begin(table: pa.Table) -> pa.Table:
        hold_alone(_scorers, _scorers.clear)
        spans = [_sequence(s) for row in table.sort_by("place")["spans"].to_pylist() for s in row]
        return pa.table({"weights": pa.array([_packed(train(spans, shares, steps))], pa.binary())})

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_alone(_scorers, _scorers.clear)
        first = next(batches, None)
        if first is None:
            return
        held = read_whole(begun)
        start = _unpacked(held["weights"][0].as_buffer()) if held.num_rows else untrained(shares)
        del held
        texts = ([np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()] for b in itertools.chain([first], batches))
        weights, times = train_on(start, shares, texts, end)
        for part in parts_of(weights, start, times, times.sum() / n_ids):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(part, _PARTS)], [n for n, _ in _PARTS])

    rows = learnt.select(F.lit(1).alias("all"), F.xxhash64("row").alias("hash"), "ids")
    chosen = smallest_hashes(rows, "all", "hash", fit_docs).select("place", "ids").mapInArrow(cut, "place int, spans array<binary>")
    begun = written_to(chosen.groupBy().applyInArrow(begin, "weights binary"), "lm-begun")
    tasks = min(scan_partitions(learnt), max(LEAST_TASKS, -(-n_ids // TASK_IDS)))
    trained = learnt.select("ids").coalesce(tasks).mapInArrow(go_on, _PARTS_SQL)
    return written_to(trained.groupBy("block").applyInArrow(merged, _PARTS_SQL), "lm-weights")


#: What a worker holds of a model, by a name that the driver gives it.
_scorers: dict[str, tuple] = {}


def score_texts(docs: DataFrame, tokenizer: str | None = None, fit_docs: int = FIT_DOCS, steps: int = FIT_STEPS, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    Letters A-Z count as lower case. Tokens are the words between ASCII white space and one end. What is learnt comes from
    all documents that are not held out: counts of their words and ids, and weights, which begin with `fit_docs` of them.
    base_score adds up log10((c + 0.1) / (N + 0.1 (V + 1))); n_known counts tokens with c > 0. score is the log10 probability
    of the ids of the words, each after a blank, and of the end after them. Null and empty texts are an end alone;
    repeated rows and null doc_ids (whose decimal is empty) each count and give a row; other columns are ignored; no rows give no
    rows, and without training documents N and V are 0 and the weights stay as they begin. A text of any length is scored in
    steps. Words beyond the `top_words` commonest meet their counts by a join, once per document that holds them.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = tokenizer or byte_bpe_path()
    own = vocabulary(path)
    rows = written(encoded(docs, path).withColumn("row", F.monotonically_increasing_id()), "lm-ids", "zstd")
    learnt = rows.where("not held_out")
    counts = written(corpus_counts(learnt, path), "lm-counts")
    words = counts.where("id < 0").select("word", "n")
    n_docs = learnt.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + (n_docs > 0)
    by_id = counts.where("id >= 0").select("id", "n").toArrow()  # a row per id of the vocabulary
    shares = np.full(own.size, 0.01)
    shares[by_id["id"].to_numpy()] += by_id["n"].to_numpy()
    shares[own.end] += n_docs
    shares /= shares.sum()
    # tasks read the model from the shared folder, as it is too large to go through the driver
    weights = fit(learnt, shares, own.end, sum(by_id["n"].to_pylist()) + n_docs, fit_docs, steps)
    top = written_to(commonest(words, "word", top_words), "lm-words")
    missing, name = float(np.log10(n + 0.1 * (v + 1))), uuid.uuid4().hex
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_alone(_scorers, _scorers.clear)
        for b in itertools.chain.from_iterable(map(few_ids, batches)):
            if name not in _scorers:
                _scorers.clear()
                parts = read_whole(weights)
                scorer = Scorer(put_together(parts) if parts.num_rows else untrained(shares), shares, own.end)
                del parts
                held = read_whole(top)
                keys, times = (held["word"].to_pylist(), held["n"].to_numpy()) if held.num_rows else ([], np.zeros(0, np.int64))
                _scorers[name] = scorer, Counts(keys, times, n_docs)
                del held, keys, times
            scorer, counts = _scorers[name]
            ids = b.column(0).to_pylist()
            logs, known, rare = counts.look_up(ids, own.begins)
            base = logs - missing * (b.column(3).to_numpy() + 1)
            score = scorer.texts([_sequence(x) for x in ids])
            arrays = [b.column(1), b.column(2), b.column(3), pa.array(known), pa.array(base), pa.array(score), rare.cast(rare_type), b.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "held_out", "n_words", "known", "base", "score", "rare", "row"]
    schema = "doc_id long, held_out boolean, n_words long, known long, base double, score double, rare array<struct<word: binary, times: long>>, row long"
    scored = written(rows.select("ids", "doc_id", "held_out", "n_words", "row").mapInArrow(run, schema), "lm-scores", "zstd")
    # a rare word that was learnt has a count; its tokens were added as if they had none
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times").join(words, "word")
    more = rare.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("more_base"))
    zero = F.lit(0)
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), "score",
    )


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document. No rows give no rows."""
    return score_texts(load(spark, sf_dir, "documents"))
