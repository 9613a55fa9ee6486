"""Re-Pair grammar compression of id sequences, vectorised: a round replaces many frequent pairs at once.

A shard is (sequence, rules): rule r stands for symbol ``base + r`` and has two symbols, each an id or an earlier
rule.  ``lengths`` holds how many ids each rule expands to, so any range of ids is decoded without the rest.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"CFRP1\0\0\0"
RULES_A_ROUND = 2048
LEAST_COUNT = 8


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (n, 2) uint32
    lengths: np.ndarray  # (n,) int64
    sequence: np.ndarray  # uint32

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def _unrolled(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that these symbols stand for, each symbol on its own."""
        while len(symbols) and (rule := symbols >= self.base).any():
            size = np.where(rule, 2, 1)
            at = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.uint32)
            out[at[~rule]] = symbols[~rule]
            pair = self.rules[symbols[rule] - self.base]
            out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that these symbols stand for: each distinct rule is unrolled once and gathered where it is used."""
        at = np.flatnonzero(symbols >= self.base)
        if not len(at):
            return symbols
        rule = symbols[at] - np.uint32(self.base)
        used = np.zeros(len(self.rules), np.bool_)
        used[rule] = True
        used = np.flatnonzero(used)
        size = self.lengths[used]
        begin = np.zeros(len(self.rules), np.int64)
        begin[used] = np.cumsum(size) - size
        n = int(size.sum())
        start, size = np.arange(n, n + len(symbols)), np.ones(len(symbols), np.int64)
        start[at], size[at] = begin[rule], self.lengths[rule]
        ends = np.cumsum(size)
        kind = np.int32 if max(n + len(symbols), ends[-1]) < 1 << 31 else np.int64
        place = np.repeat((start - ends + size).astype(kind), size)
        place += np.arange(ends[-1], dtype=kind)
        return np.concatenate([self._unrolled((used + self.base).astype(np.uint32)), symbols])[place]

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(self.symbol_lengths(self.sequence))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.sequence[a:b])[skip : skip + stop - start]


CELL_BITS = 18


def _least_of_top(count: np.ndarray, most: int) -> int:
    """The ``most``-th largest of these counts."""
    above = np.cumsum(np.bincount(count)[::-1])
    return len(above) - 1 - int(np.searchsorted(above, most))


def _frequent(pair: np.ndarray, bits: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the ``most`` most frequent pairs in ascending order, places that may hold them, index of the pair there or -1,
    which of all places hold a pair that may be seen ``least`` times).

    Pairs are counted exactly.  A cell counts all of its pairs, so only pairs of cells that reach the bound are sorted.
    """
    mixer = pair.dtype.type(0x9E3779B1 if bits == 32 else 0x9E3779B97F4A7C15)
    cell_bits = max(12, most.bit_length(), min(CELL_BITS, len(pair).bit_length()))
    shift = pair.dtype.type(bits - cell_bits)
    cell = ((pair * mixer) >> shift).astype(np.intp)
    in_cell = np.bincount(cell, minlength=1 << cell_bits)
    open_ = (in_cell >= least).take(cell)
    bound = max(least, _least_of_top(in_cell, most))
    while True:
        at = np.flatnonzero((in_cell >= bound).take(cell))
        held = np.sort(pair.take(at))
        first = np.flatnonzero(np.concatenate([np.ones(min(len(held), 1), np.bool_), held[1:] != held[:-1]]))
        count = np.diff(np.append(first, len(held)))
        # a pair that is more frequent than the last of these is in a cell that reaches its count
        last = max(least, _least_of_top(count, most)) if len(count) >= most else least
        if last >= bound:
            break
        bound = last
    chosen = np.flatnonzero(count >= last)
    chosen = np.sort(chosen[np.lexsort((held[first[chosen]], -count[chosen]))[:most]])  # of equally frequent pairs the smaller
    pairs = held[first[chosen]]
    if not len(pairs):
        return pairs, at, at, open_
    slot = ((pairs * mixer) >> shift).astype(np.intp)
    number = np.full(1 << cell_bits, -1, np.int32)
    number[slot] = np.arange(len(pairs), dtype=np.int32)
    shared = np.zeros(1 << cell_bits, np.bool_)
    shared[np.flatnonzero(np.bincount(slot) > 1)] = True
    own = number.take(cell.take(at))
    kept = own >= 0
    at, own = np.compress(kept, at), np.compress(kept, own)
    other = np.flatnonzero(pairs.take(own) != pair.take(at))
    there = other[shared[cell[at[other]]]]  # two of these pairs are in the cell: look for the other
    own[other] = -1
    found = np.minimum(np.searchsorted(pairs, pair[at[there]]), len(pairs) - 1)
    own[there] = np.where(pairs[found] == pair[at[there]], found, -1)
    return pairs, at, own, open_


def compress(ids: np.ndarray, base: int, rules_a_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> Grammar:
    """Grammar of ``ids`` (all below ``base``).

    Each round counts the pairs of neighbours, gives the most frequent ones a rule each and replaces them from left to
    right without overlap, until no pair is seen ``least`` times.  A replacement makes pairs of its new symbol only, so
    a pair that was once rarer than ``least`` stays so and isn't counted again.  While all symbols fit 16 bits, pairs
    are 32 bits wide instead of 64.
    """
    seq = np.array(ids, np.uint32)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    top, live = base, np.ones(len(seq), np.bool_)  # live: places whose pair may be frequent
    while len(seq) >= 2:
        narrow = top + rules_a_round <= 1 << 16
        symbol, wide, half = (np.uint16, np.uint32, 16) if narrow else (np.uint32, np.uint64, 32)
        seq = seq.astype(symbol, copy=False)
        places = np.flatnonzero(live[:-1]).astype(np.int32 if len(seq) < 1 << 31 else np.int64)
        pair = (seq.take(places).astype(wide) << wide(half)) | seq.take(places + 1)
        pairs, at, own, open_ = _frequent(pair, 2 * half, rules_a_round, least)
        if not len(pairs):
            break
        live[np.compress(~open_, places)] = False
        held = own >= 0
        at, own = places.take(np.compress(held, at)), np.compress(held, own)
        first = np.ones(len(at), np.bool_)  # of a run of overlapping pairs, every second is replaced
        first[1:] = np.diff(at) != 1
        place = np.arange(len(at), dtype=places.dtype)
        kept = (place - np.maximum.accumulate(np.where(first, place, 0))) & 1 == 0
        at, own = np.compress(kept, at), np.compress(kept, own)
        seen = np.bincount(own, minlength=len(pairs)) > 0  # a pair that others overlap everywhere needs no rule
        used, own = np.flatnonzero(seen), (np.cumsum(seen) - 1)[own]
        new = np.stack([pairs[used] >> wide(half), pairs[used] & wide((1 << half) - 1)], 1).astype(np.uint32)
        grammar = Grammar(base, np.zeros((0, 2), np.uint32), lengths, seq)
        lengths = np.concatenate([lengths, grammar.symbol_lengths(new[:, 0]) + grammar.symbol_lengths(new[:, 1])])
        keep = np.ones(len(seq), np.bool_)
        keep[at + 1] = False
        seq[at] = own + top
        picked = np.compress if len(at) > len(seq) // 16 else lambda keep, x: x[keep]  # the faster one for many or few gaps
        seq = picked(keep, seq)
        live[at] = live[np.maximum(at - 1, 0)] = True
        live = picked(keep, live)
        rules.append(new)
        top += len(new)
    return Grammar(base, np.concatenate(rules), lengths, seq.astype(np.uint32))


def to_bytes(g: Grammar) -> bytes:
    """A shard: magic, base, number of rules and symbols, rules, expansion lengths, sequence (32 bits each), crc32."""
    wide = [a.astype("<u4").tobytes() for a in (g.rules.reshape(-1), g.lengths, g.sequence)]
    body = struct.pack("<III", g.base, len(g.rules), len(g.sequence)) + b"".join(wide)
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def from_bytes(data: bytes) -> Grammar:
    body, crc = data[len(MAGIC) : -4], struct.unpack("<I", data[-4:])[0]
    if data[: len(MAGIC)] != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a whole shard")
    base, n, m = struct.unpack_from("<III", body)
    a = np.frombuffer(body, "<u4", offset=12)
    return Grammar(base, a[: 2 * n].reshape(-1, 2), a[2 * n : 3 * n].astype(np.int64), a[3 * n : 3 * n + m])
