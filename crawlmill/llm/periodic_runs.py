"""Periodic runs of words by recompression.

A sequence is compressed level by level: first each block of one repeated symbol becomes a symbol, then each pair of a
symbol of one side and a symbol of the other does. Equal stretches are compressed alike but for their ends, so two places
are compared by climbing while their symbols agree and descending where they differ: a few steps a level. A run of
period q holds a multiple of q in its first q words, so the pairs (mq, mq + q) of the harmonic grid reach every run, and the
grammar's extensions to both sides give its exact ends. All texts of a batch share a grammar, parted by symbols that occur once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.common import load, short_batches, text_or_empty

#: Words that a run has at least.
LEAST = 12
#: Partitions of the symbols into two sides that a level tries, to take the one with most pairs; more, while the best holds
#: less than a quarter of the pairs, which some partition does.
SEEDS, MOST_SEEDS = 3, 64
#: Points of the harmonic grid that are looked at together.
GRID_STEP = 1 << 22
#: An odd number whose multiples spread over 64 bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Level(NamedTuple):
    """A sequence, and how it is compressed into the next: `up` gives a symbol's parent, `down` a parent's first symbol."""

    symbols: np.ndarray
    blocks: bool
    up: np.ndarray
    down: np.ndarray


class Grammar:
    """Run-length grammar of a sequence whose first and last symbol occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        symbols = symbols.astype(np.int64)
        self.fresh = int(symbols.max(initial=0)) + 1
        while len(symbols) > 1:
            symbols = self._blocks(symbols)
            if len(symbols) > 1:
                symbols = self._pairs(symbols)

    def _level(self, symbols: np.ndarray, first: np.ndarray, blocks: bool, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The next sequence; `first` marks the first symbol of each parent, `keys` tells parents of several symbols apart."""
        start = np.flatnonzero(first)
        down = np.append(start, len(symbols)).astype(np.int32)
        made = symbols[start]
        size = np.diff(down)
        many = np.flatnonzero(size > 1)
        names, which = np.unique(keys(start[many], size[many]), return_inverse=True)
        made[many] = self.fresh + which
        self.fresh += len(names)
        self.levels.append(Level(symbols, blocks, (np.cumsum(first) - 1).astype(np.int32), down))
        return made

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        first = np.append(True, symbols[1:] != symbols[:-1])
        if first.all():
            return symbols
        return self._level(symbols, first, True, lambda at, size: symbols[at] * (len(symbols) + 1) + size)

    def _pairs(self, symbols: np.ndarray) -> np.ndarray:
        best, most, seed = None, 0, 0
        while seed < SEEDS or not most or (4 * most < len(symbols) - 1 and seed < MOST_SEEDS):
            seed += 1
            mixed = (symbols.astype(np.uint64) + np.uint64(seed)) * _MIX
            side = (mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(63) == 1
            for left in (side, ~side):
                found = left[:-1] & ~left[1:]
                n = np.count_nonzero(found)
                if n > most:
                    best, most = found, n
        return self._level(symbols, np.append(True, ~best), False, lambda at, _: symbols[at] << 32 | symbols[at + 1])

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """For each pair of different places, how many symbols agree from them on, towards the end (1) or the beginning (-1)."""
        a, b = i.astype(np.int32), j.astype(np.int32)
        forth = step > 0
        stopped: list[np.ndarray] = []
        live = np.arange(len(a))
        for level in self.levels:
            x, y = a[live], b[live]
            same = level.symbols[x] == level.symbols[y]
            ended, live, x, y = [live[~same]], live[same], x[same], y[same]
            if len(live):
                p, q = level.up[x], level.up[y]
                rest_x, rest_y = (level.down[p + 1] - x, level.down[q + 1] - y) if forth else (x - level.down[p] + 1, y - level.down[q] + 1)
                whole = (level.down[p] == x) & (level.down[q] == y) if forth else (level.down[p + 1] == x + 1) & (level.down[q + 1] == y + 1)
                move = np.where(whole, 0, np.minimum(rest_x, rest_y) if level.blocks else 1) * step
                x, y = x + move, y + move
                differ = ~whole & (rest_x != rest_y) if level.blocks else np.zeros(len(x), bool)
                a[live], b[live] = np.where(differ, x, level.up[x]), np.where(differ, y, level.up[y])
                ended.append(live[differ])
                live = live[~differ]
            stopped.append(np.concatenate(ended))
            if not len(live):
                break
        down = stopped[-1] if stopped else live
        for h in range(len(stopped) - 2, -1, -1):
            level = self.levels[h]
            u, v = a[down], b[down]
            x, y = (level.down[u], level.down[v]) if forth else (level.down[u + 1] - 1, level.down[v + 1] - 1)
            move = (level.symbols[x] == level.symbols[y]).astype(np.int32)
            if level.blocks:
                move *= np.minimum(level.down[u + 1] - level.down[u], level.down[v + 1] - level.down[v])
            a[down], b[down] = x + step * move, y + step * move
            down = np.concatenate([down, stopped[h]])
        return (a.astype(np.int64) - i) * step


def _grid(symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, q) where a text's words mq and mq + q, counted from its first, are equal; for every m, and q up to half its words."""
    half = sizes // 2
    ends = np.cumsum(half)
    total = int(ends[-1]) if len(ends) else 0
    text = np.repeat(np.arange(len(sizes)), half)
    period = (np.arange(total) - np.repeat(ends - half, half) + 1).astype(np.int32)
    points = (sizes[text] - 1) // period + 1  # of the grid of each text and period
    after = np.cumsum(points)
    at = 0
    while at < total:
        until = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + GRID_STEP, "right")))
        n, q = points[at:until], period[at:until]
        stop = np.cumsum(n)
        q = np.repeat(q, n)
        place = np.repeat(begin[text[at:until]], n) + (np.arange(len(q)) - np.repeat(stop - n, n)) * q
        value = symbols[place]
        equal = value[:-1] == value[1:]
        equal[stop[:-1] - 1] = False  # the next period's grid begins there
        hit = np.flatnonzero(equal)
        yield place[hit], q[hit].astype(np.int64)
        at = until


def find_runs(texts: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of every sequence of symbols from 0 on, by text, start, period.

    A run has at least `least` symbols and two periods, no neighbour extends it, and its period is the smallest it has.
    """
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max() < max(2, least):
        return none, none, none, none
    # text k stands between the separators k and k + 1
    begin = np.cumsum(sizes + 1) - sizes
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    symbols[np.append(0, begin + sizes)] = np.arange(len(texts) + 1)
    for t, o in zip(texts, begin.tolist()):
        symbols[o : o + len(t)] = t + (len(texts) + 1)
    grammar = Grammar(symbols)
    found: list[tuple] = []
    worth = np.where(sizes >= least, sizes, 0)
    for place, period in _grid(symbols, begin, worth):
        end = place + period + grammar.extend(place, place + period, 1)
        start = place - grammar.extend(place - 1, place + period - 1, -1)
        keep = end - start >= np.maximum(least, 2 * period)
        found.append((start[keep], end[keep], period[keep]))
    start, end, period = (np.concatenate(c) for c in zip(*found)) if found else (none, none, none)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # of equal stretches, that of the smallest period is the run; the others are its multiples
    kept = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, period = start[kept], end[kept], period[kept]
    text = np.searchsorted(begin, start, "right") - 1
    start -= begin[text]
    length = end - begin[text] - start
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, least: int = LEAST, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period in words), collapsed (the text without the repeats of its runs).

    Words are what stands between ASCII white space. A word is dropped if a run holds it after the run's first period; kept
    ones are joined by one blank. `order` may name, for a doc_id and its number of words, which word stands at each
    place. Null and empty texts have no words, no runs and an empty text; repeated rows and null doc_ids each give a row; other
    columns are ignored; no rows give no rows. A text is held whole in a worker, about 200 bytes a word.
    """
    short_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            known: dict[bytes, int] = {}
            words, texts = [], []
            for doc_id, text in zip(ids, b.column(1).cast(pa.binary()).to_pylist()):
                own = text.split()  # of bytes: at ASCII white space
                symbols = np.fromiter([known.setdefault(w, len(known)) for w in own], np.int64, len(own))
                if order is not None and own and (moved := order(doc_id, len(own))) is not None:
                    symbols = symbols[moved]
                    own = [own[i] for i in moved.tolist()]
                words.append(own)
                texts.append(symbols)
            text, start, length, period = find_runs(texts, least)
            offsets = np.searchsorted(text, np.arange(len(ids) + 1)).astype(np.int32)
            collapsed = []
            for k, own in enumerate(words):
                lo, hi = offsets[k], offsets[k + 1]
                if lo < hi:
                    cover = np.zeros(len(own) + 1, np.int64)
                    np.add.at(cover, start[lo:hi] + period[lo:hi], 1)
                    np.add.at(cover, start[lo:hi] + length[lo:hi], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(own))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(offsets), runs).cast(run_type)
            yield pa.RecordBatch.from_arrays([b.column(0), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, an order that repeats a stretch of words up to the end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which is rewritten first; see planted_order. Empty tables give no rows."""
    rows = periodic_runs(load(spark, sf_dir, "documents"), order=planted_order)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    rows = rows.select("doc_id", "runs", "collapsed", longest.alias("longest"))
    length, period = F.col("longest.length"), -F.col("longest.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.length div -longest.less").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
