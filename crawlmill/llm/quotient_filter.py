"""A counting quotient filter over 64-bit fingerprints, on numpy arrays.

A fingerprint splits into a quotient (its high bits, the home slot) and a remainder (the rest, stored). Runs of equal
quotient lie together, sorted by remainder, pushed right where slots are taken. A remainder seen more than once is
followed by a counter slot. Quotient and remainder together are the whole fingerprint, so nothing is lost and two
filters merge exactly by walking their sorted remainders.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQQ")  # quotient bits, fingerprint bits, slots, distinct, occupied quotients


class CountingQuotientFilter:
    def __init__(self, q: int, bits: int, occupied: np.ndarray, used: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.bits = q, bits
        self.occupied, self.used, self.runend, self.counter, self.slots = occupied, used, runend, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """From fingerprints of `bits` bits with repeats."""
        values, counts = np.unique(np.asarray(fingerprints, np.uint64), return_counts=True)
        return cls.from_counts(values, counts.astype(np.uint64), bits)

    @classmethod
    def from_counts(cls, values: np.ndarray, counts: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """From ascending distinct fingerprints and their counts."""
        n, more = len(values), counts > 1
        width = 1 + more.astype(np.int64)
        total = int(width.sum())
        q = min(bits - 1, max(1, int(np.ceil(np.log2(max(2, total / 0.75))))))
        r = np.uint64(bits - q)
        home = (values >> r).astype(np.int64)
        remainder = values & ((np.uint64(1) << r) - np.uint64(1))
        # linear probing in sorted order: a slot is at its home or just after what came before
        before = np.cumsum(width) - width
        at = np.maximum.accumulate(home - before) + before if n else home
        size = max(1 << q, int(at[-1] + width[-1]) if n else 0)
        occupied = np.zeros(1 << q, bool)
        occupied[home] = True
        used, runend, counter, slots = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        slots[at], used[at] = remainder, True
        slots[at[more] + 1], used[at[more] + 1], counter[at[more] + 1] = counts[more] - np.uint64(1), True, True
        if n:
            last = np.append(home[1:] != home[:-1], True)
            runend[at[last]] = True
        return cls(q, bits, occupied, used, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and their counts."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        first = np.flatnonzero(self.used & ~self.counter)
        run = np.cumsum(self.runend[first]) - self.runend[first]
        values = (quotients[run] << np.uint64(self.bits - self.q)) | self.slots[first]
        counts = np.ones(len(first), np.uint64)
        follows = np.append(self.counter, False)[first + 1]
        counts[follows] += self.slots[first[follows] + 1]
        return values, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Counts of equal fingerprints add up; the filters may have different quotient sizes."""
        bits = filters[0].bits
        parts = [f.items() for f in filters]
        values = np.concatenate([v for v, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return cls.from_counts(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)

    def to_bytes(self) -> bytes:
        kept = self.slots[self.used]
        head = _HEAD.pack(self.q, self.bits, len(self.slots), len(kept), int(self.occupied.sum()))
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.runend, self.counter)) + kept.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, bits, size, kept, _ = _HEAD.unpack_from(data)
        at, maps = _HEAD.size, []
        for n in (1 << q, size, size, size):
            m = (n + 7) // 8
            maps.append(np.unpackbits(np.frombuffer(data, np.uint8, m, at), count=n).astype(bool))
            at += m
        slots = np.zeros(size, np.uint64)
        slots[maps[1]] = np.frombuffer(data, np.uint64, kept, at)
        return cls(q, bits, *maps, slots)
