"""Splitting texts into the pieces that byte-level BPE merges within, and putting piece ids together.

A slice of texts is split at once by numpy: code points get a class from a table, and where classes change decides
where pieces begin.  Each distinct piece is looked up once, and the ids of whole documents are gathered.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern that split() follows: contractions, then runs of letters, numbers and others that take one space
#: before them, then white space, of which the last character before other text stands alone.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points whose letter, number and space properties do not differ between Unicode versions; texts with others go
#: to the libraries whole.
SETTLED = ((0x0, 0x24F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x4E00, 0x9FA5))
LETTER, NUMBER, OTHER, SPACE, UNSETTLED = range(5)
#: Bytes of distinct pieces, with what Python and the tables take for each, that a worker remembers before it starts
#: afresh: some 1,300,000 words of up to KEY_BYTES, or 700,000 longer ones.
REMEMBERED_BYTES = 160_000_000
PIECE_BYTES = 200
#: Bytes of a piece that fit its key, and what the tables take for such a piece without its ids.
KEY_BYTES = 15
KEY_COST = 80
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are put together at a time; a text is never cut.
SLICE_BYTES = 2_000_000


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.full(0x110000, UNSETTLED, np.uint8)
    for a, b in SETTLED:
        chars = "".join(map(chr, range(a, b + 1)))
        out[a : b + 1] = OTHER
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            out[[ord(c) for c in regex.findall(pattern, chars)]] = kind
    return out


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(pieces of all texts, number of each text's pieces, which texts have unsettled code points).

    Texts with unsettled code points have no pieces; null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    n = len(texts)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    raw = np.frombuffer(data, np.uint8)
    lead = (raw & 0xC0) != 0x80
    place = np.flatnonzero(lead).astype(np.int32)  # byte of each code point
    cp = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    kind = classes()[cp]
    m = len(cp)
    first = np.searchsorted(place, ends[:-1])  # code point at which each text begins
    odd = np.zeros(n, np.bool_)
    if (kind == UNSETTLED).any():
        odd[np.searchsorted(first, np.flatnonzero(kind == UNSETTLED), "right") - 1] = True
    new = np.zeros(m + 4, np.bool_)  # where a text begins; beyond the end everything does
    new[first[first < m]] = True
    new[m:] = True
    begin = new.copy()
    begin[1:m] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin[1:m] & ~new[1:m] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begin[after - 1] = True
    begin[after[cp[after - 1] == 32]] = False
    mark = np.flatnonzero((cp == 39) & begin[:m])
    mark = mark[~new[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    one = mark[np.isin(cp[mark + 1], [ord(c) for c in "stmd"])]
    two = mark[~new[mark + 2]]
    a, b = cp[two + 1], cp[two + 2]
    two = two[(((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    begin[one + 1] = False
    begin[one + 2] = True
    begin[two + 1] = False
    begin[two + 3] = True
    at = np.flatnonzero(begin[:m])
    text = np.searchsorted(first, at, "right") - 1
    count = np.bincount(text, minlength=n)
    stops = np.append(place[at[1:]], len(raw)) if len(at) else at
    if odd.any():
        keep = ~odd[text]
        count[odd] = 0
        parts = [data[a:b] for a, b in zip(place[at[keep]], stops[keep])]
        return pa.array(parts, pa.binary()).cast(pa.string()), count, odd
    offsets = np.append(place[at], len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), count, odd


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def keys(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first eight bytes, the next seven with the length above them, length) of each piece: up to KEY_BYTES they name it."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    begin, size = ends[:-1] - ends[0], np.diff(ends)
    data = pieces.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() + bytes(16)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes at every place
    return eight[begin] & _BELOW[np.minimum(size, 8)], eight[begin + 8 * (size > 8)] & _BELOW[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56), size


class PieceTable:
    """Ids of the distinct pieces seen so far: one flat array, and where each piece starts in it.

    Pieces of up to KEY_BYTES are found by their keys in a table of slots, all at once; a key is the whole piece, so
    nothing is decided by a hash.  Longer pieces are in a dict.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.long: dict[str, int] = {}
        self.slots = np.full(1 << 15, -1, np.int32)
        self.low = np.zeros(1 << 14, np.uint64)
        self.high = np.zeros(1 << 14, np.uint64)
        self.bytes = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _grow(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * _MIX)) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is unknown."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        at = np.flatnonzero((self.low[out] != low) | (self.high[out] != high))
        at = at[out[at] >= 0]
        while len(at):  # another key has the slot: look into the next
            slot[at] = (slot[at] + 1) & (len(self.slots) - 1)
            out[at] = row = self.slots[slot[at]]
            at = at[(row >= 0) & ((self.low[row] != low[at]) | (self.high[row] != high[at]))]
        return out

    def _place(self, rows: np.ndarray) -> None:
        """Give these rows slots."""
        slot = self._slot(self.low[rows], self.high[rows])
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _add(self, new: list[str], cost: int) -> np.ndarray:
        """Encode unknown pieces together; their rows."""
        ids, lens = self.encode(new)
        n = self.known
        self.known += len(new)
        for name in ("start", "size", "low", "high"):
            self._grow(name, self.known)
        self._grow("flat", self.used + len(ids))
        self.size[n : self.known] = lens
        self.start[n : self.known] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.bytes += cost * len(new) + 8 * len(ids)
        return np.arange(n, self.known, dtype=np.int32)

    def _short_rows(self, pieces: pa.StringArray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = self._find(low, high)
        at = np.flatnonzero(out < 0)
        if len(at):
            at = at[np.lexsort((low[at], high[at]))]
            new = np.ones(len(at), np.bool_)
            new[1:] = (low[at[1:]] != low[at[:-1]]) | (high[at[1:]] != high[at[:-1]])
            rows = self._add(pieces.take(pa.array(at[new])).to_pylist(), KEY_COST)
            self.low[rows], self.high[rows] = low[at[new]], high[at[new]]
            if 2 * self.known > len(self.slots):
                self.slots = np.full(1 << (2 * self.known).bit_length(), -1, np.int32)
                rows_of_keys = np.flatnonzero(self.high[: self.known]).astype(np.int32)
                self._place(rows_of_keys)
            else:
                self._place(rows)
            out[at] = rows[np.cumsum(new) - 1]
        return out

    def _long_rows(self, pieces: pa.StringArray) -> np.ndarray:
        coded = pieces.dictionary_encode()
        found = coded.dictionary.to_pylist()
        new = [p for p in found if p not in self.long]
        if new:
            self.long.update(zip(new, self._add(new, PIECE_BYTES).tolist()))
            self.bytes += sum(map(len, new))
        return np.fromiter(map(self.long.__getitem__, found), np.int32, len(found))[coded.indices.to_numpy(zero_copy_only=False)]

    def rows(self, pieces: pa.StringArray) -> np.ndarray:
        """Row of each of these pieces; unknown pieces are encoded together."""
        if self.bytes > REMEMBERED_BYTES:
            self.clear()
        low, high, size = keys(pieces)
        long = size > KEY_BYTES
        if not long.any():
            return self._short_rows(pieces, low, high)
        out = np.zeros(len(pieces), np.int32)
        at = np.flatnonzero(long)
        out[at] = self._long_rows(pieces.take(pa.array(at)))
        at = np.flatnonzero(~long)
        out[at] = self._short_rows(pieces.take(pa.array(at)), low[at], high[at])
        return out

    def ids(self, pieces: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text) for texts of ``counts`` pieces each."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        row = self.rows(pieces)
        size = self.size[row]
        ends = np.zeros(len(row) + 1, np.int32 if len(row) < 1 << 24 else np.int64)
        np.cumsum(size, out=ends[1:])
        at = np.repeat(self.start[row] - ends[:-1], size)
        at += np.arange(ends[-1], dtype=at.dtype)
        return self.flat[at], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]).astype(np.int64)

    def texts(self, texts: pa.StringArray, encode_text: Callable[[str], np.ndarray], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts; ``encode_text`` takes those with unsettled code points, and those marked in ``whole``."""
        pieces, counts, odd = split(texts)
        ids, lens = self.ids(pieces, counts)
        if whole is not None:
            odd = odd | whole
        if not odd.any():
            return ids, lens
        ends = np.concatenate([[0], np.cumsum(lens)])
        parts = [encode_text(t.as_py()) if o else ids[a:b] for t, o, a, b in zip(texts, odd, ends, ends[1:])]
        return np.concatenate(parts).astype(np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of ``text`` each; a row is never cut."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = size // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
