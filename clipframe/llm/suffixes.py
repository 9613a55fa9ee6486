"""Exact substring dedup over suffixes: bytes of every SPAN-byte string that also starts anywhere else.

Sorting the suffixes at all byte positions would move each text hundreds of times.  Instead:

1. Anchors.  In the first half of every SPAN-byte string, the least hash of its GRAM-byte grams marks an anchor.  It
   depends on that string alone, so equal strings have their anchors at the same place.  Each start belongs to one
   anchor; the starts of an anchor are an interval.
2. Anchors whose following LEAD bytes (part of every string of the anchor) occur once cannot have repeats.  If all
   the strings of an anchor together occur again with the same anchor, every start is repeated.  Both are decided on
   hashes, which shuffle instead of texts.
3. What is left are the edges of repeated passages.  Their suffixes are range-partitioned by their leading bytes with
   sampled splitters, so that equal leads meet in one bucket.  A bucket sorts the starts by multikey quicksort over
   wide tokens of the SPAN bytes, compares the bytes of neighbours, and finds which starts are repeated.
4. The repeated starts of a document become covered byte ranges, which are cut out.

Texts are UTF-8 bytes, null is empty; strings never cross documents.  Rows with one doc_id are documents of their own
(rows are named by id and text; rows equal in both repeat each other); null ids are like any other.  Texts may be of any
length.  Empty tables give empty tables; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 400
GRAM = 32
#: Bytes of suffixes that are sorted together, and strings that are compared by bytes at a time.
BUCKET_BYTES = 2_000_000
COMPARED = 4_000
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = pow(int(_B), -1, 1 << 64)


def half(span: int) -> int:
    return span // 2


def lead_bytes(span: int) -> int:
    """Bytes after an anchor that are in every string of it."""
    return span - (half(span) - GRAM)


def _bytes_hash() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class Rolling:
    """Hashes of substrings of one byte array: polynomial prefix sums modulo 2**64 over random byte values."""

    table = _bytes_hash()

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = _powers(int(_B), n)
        self.down = _powers(_INV, n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up, out=self.sum[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sum[stop] - self.sum[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        n = len(self.sum) - size
        return _mix((self.sum[size:] - self.sum[:n]) * self.down[:n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept from call to call."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        step = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * step])
    if len(known) <= 1 << 22:
        _POWERS[base] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(anchor, first start, last start) of each anchor of one document."""
    roll = Rolling(data)
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, roll
    h = roll.all(GRAM)[: len(data) - span + half(span) - GRAM + 1]
    key = (h & ~np.uint64(0xFFFFFF)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFF))
    window, size, least = half(span) - GRAM + 1, 1, key
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    start = np.arange(len(least))
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    at += (start - at + 0xFFFFFF) >> 24 << 24  # texts of more than 16 MB
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], len(at)) - 1, roll


def _marks(span: int):
    """Rows of all anchors, with hashes of what follows them (lead) and of all their strings (whole).

    Wholes that repeat within a batch are settled here: one row of each goes on as known to repeat (state 1), the others
    are spread over the partitions as they are (state 2), so that a text with very many copies is no hot key.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                doc, mark, cols = [], [], [[] for _ in range(5)]
                for d, m, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    buf = text.as_buffer()
                    if buf is None or buf.size < span:
                        continue
                    at, lo, hi, roll = anchors(np.frombuffer(buf, np.uint8), span)
                    doc.append(np.full(len(at), d)), mark.append(np.full(len(at), m))
                    lead, whole = roll.of(at, at + lead_bytes(span)), roll.of(lo, hi + span) + (hi - lo).astype(np.uint64)
                    for c, v in zip(cols, (at, lo, hi, lead.view(np.int64), whole.view(np.int64))):
                        c.append(v)
                if doc:
                    at, lo, hi, lead, whole = map(np.concatenate, cols)
                    _, first, number, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                    state = np.where(count[number] > 1, 2, 0).astype(np.int8)
                    state[first] = np.where(count > 1, 1, 0)
                    spread = _mix(whole.view(np.uint64) + np.arange(len(at), dtype=np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(mark)), pa.array(at.astype(np.int32)), pa.array((at - lo).astype(np.int16)), pa.array((hi - lo).astype(np.int32)), pa.array(np.where(state == 2, spread, lead)), pa.array(whole), pa.array(state)], names=["doc", "mark", "at", "back", "more", "lead", "whole", "state"])

    return run


_MARK = "doc long, mark long, at int, back short, more int, lead long, whole long, state byte"
_SORTED = "doc long, mark long, at int, back short, more int, sure boolean"


def _decide(batches):
    """Anchors with equal leads are in one partition: drop those whose lead occurs once, settle those whose whole repeats.

    Of each whole whose lead has others, one anchor goes on to the edges (sure is false), as they may share part of it.
    """
    kinds = [("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("back", pa.int16()), ("more", pa.int32()), ("lead", pa.int64()), ("whole", pa.int64()), ("state", pa.int8())]
    t = pa.Table.from_batches(list(batches), schema=pa.schema(kinds))
    settled = pc.equal(t["state"], 2)

    def rows(t, sure):
        yield from t.select(["doc", "mark", "at", "back", "more"]).append_column("sure", pa.array(np.full(t.num_rows, sure))).to_batches(20_000)

    yield from rows(t.filter(settled), True)
    t = t.filter(pc.invert(settled))
    if not t.num_rows:
        return
    lead, whole, known = t["lead"].to_numpy(), t["whole"].to_numpy(), t["state"].to_numpy()
    order = np.lexsort((whole, lead))
    lead, whole, known = lead[order], whole[order], known[order].astype(np.int64)
    new_lead = np.concatenate([[True], lead[1:] != lead[:-1]])
    new_whole = new_lead | np.concatenate([[True], whole[1:] != whole[:-1]])
    of_lead, of_whole = np.cumsum(new_lead) - 1, np.cumsum(new_whole) - 1
    repeats = (np.bincount(of_whole) + np.add.reduceat(known, np.flatnonzero(new_whole)))[of_whole] > 1
    wholes = np.bincount(of_lead, weights=new_whole)[of_lead]  # two wholes of one lead may share strings
    yield from rows(t.take(pa.array(order[repeats])), True)
    yield from rows(t.take(pa.array(order[(wholes > 1) & new_whole])), False)


def _suffix_rows(span: int):
    """The text from an anchor's first start to the end of its last string, for each anchor that is no sure one."""

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out = [[] for _ in range(6)]
                for d, m, rows, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                    data = text.as_buffer().to_pybytes()
                    for r in rows:
                        at, back, more = r["at"], r["back"], r["more"]
                        lo = at - back
                        for c, v in zip(out, (d, m, lo, back, data[at : at + lead_bytes(span)], data[lo : lo + more + span])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary(), pa.binary()))], names=["doc", "mark", "lo", "back", "lead", "bytes"])

    return run


def multikey_groups(keys, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of n items over the arrays ``keys``: (order, ends of groups of equal items that have two or more).

    Each pass splits the groups that are still tied by the next token and drops what stands alone.
    """
    items, group = np.arange(n), np.zeros(n, np.int64)
    for key in keys:
        k = key(items)
        order = np.lexsort((k, group))
        items, group, k = items[order], group[order], k[order]
        new = np.ones(len(items), np.bool_)
        new[1:] = (group[1:] != group[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, np.bool_)
        items, group = items[tied], group[tied]
    return items, np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1 if len(group) else np.zeros(0, np.int64)


def repeated_starts(data: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Which of the SPAN-byte strings at ``starts`` of ``data`` are there twice: sorted by wide tokens, compared by bytes."""
    roll, width = Rolling(data), span // 5
    keys = [lambda items, d=d: roll.of(starts[items] + d, starts[items] + d + width) for d in range(0, span - span % width, width)]
    if span % width:
        keys.append(lambda items: roll.of(starts[items] + span - width, starts[items] + span))
    items, ends = multikey_groups(keys, len(starts))
    found = np.zeros(len(starts), np.bool_)
    first = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)) if len(ends) else np.zeros(0, np.int64)
    for i in range(0, len(items), COMPARED):
        own, rep = items[i : i + COMPARED], items[first[i : i + COMPARED]]
        equal = (data[starts[own][:, None] + np.arange(span)] == data[starts[rep][:, None] + np.arange(span)]).all(1) & (own != rep)
        found[own[equal]] = True
        found[rep[equal]] = True
    return found


def _bucket(span: int):
    """Sorted suffix rows of a range: runs of repeated starts (doc, mark, first, last)."""

    def flush(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        raw = t["bytes"].combine_chunks()
        raw = raw if isinstance(raw, pa.Array) else raw.chunk(0)
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        begin = np.cumsum(size) - size
        count = size - span + 1
        row = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # starts meet only those of the same lead at the same distance from their anchors; multikey sorts do the rest
        hit = repeated_starts(data, begin[row] + place, span)
        row, start = row[hit], (t["lo"].to_numpy()[row] + place)[hit]
        if not len(row):
            return
        new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays([t["doc"].combine_chunks().take(pa.array(row[a])), t["mark"].combine_chunks().take(pa.array(row[a])), pa.array(start[a].astype(np.int64)), pa.array(start[z].astype(np.int64))], names=["doc", "mark", "first", "last"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = batch.column("lead")
            cuts = [0]
            if size > BUCKET_BYTES:  # a bucket is worked off between two leads
                change = next((i for i in range(batch.num_rows) if lead[i].as_py() != (last if i == 0 else lead[i - 1].as_py())), None)
                if change is not None:
                    if change:
                        held.append(batch.slice(0, change))
                    yield from flush(held)
                    held, size, cuts = [], 0, [change]
            part = batch.slice(cuts[-1])
            if part.num_rows:
                held.append(part)
                size += part.nbytes
            last = lead[batch.num_rows - 1].as_py()
        if held:
            yield from flush(held)

    return run


def cut_runs(data: bytes, runs: list[tuple[int, int]], span: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed) for runs of repeated starts (first, last)."""
    kept, removed, spans, end = [], 0, 0, 0
    for first, last in sorted(runs):
        stop = last + span
        if first > end or not spans:
            kept.append(data[end:first])
            spans += 1
            removed += stop - first
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    kept.append(data[end:])
    return b"".join(kept), removed, spans


def _cut(span: int):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                texts = b.column("text").to_pylist()
                found = [cut_runs(d, [(r["first"], r["last"]) for r in runs or ()], span) for d, runs in zip(texts, b.column("runs").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d) for d in texts], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([hashlib.sha256(f[0]).hexdigest() for f in found]), pa.array([f[0] for f in found], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256 and kept (binary) of each row."""
    if half(span) <= GRAM:
        raise ValueError(f"span must be over {2 * GRAM + 1}")
    spark = common.ship(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("text"))
    long_texts = named.where(F.octet_length("text") >= span).select("doc", "mark", "text")
    marks = long_texts.mapInArrow(_marks(span), _MARK)
    decided = common.stored(marks.repartition(n, "lead").mapInArrow(_decide, _SORTED), "decided")

    edges = decided.where("NOT sure").groupBy("doc", "mark").agg(F.collect_set(F.struct("at", "back", "more")).alias("rows"))
    suffixes = edges.join(long_texts, ["doc", "mark"]).select("doc", "mark", "rows", "text").mapInArrow(_suffix_rows(span), "doc long, mark long, lo int, back short, lead binary, bytes binary")
    ranged = suffixes.repartitionByRange(n, "lead").sortWithinPartitions("lead")
    found = ranged.mapInArrow(_bucket(span), "doc long, mark long, first long, last long")
    sure = decided.where("sure").select("doc", "mark", (F.col("at") - F.col("back")).cast("long").alias("first"), (F.col("at") - F.col("back") + F.col("more")).cast("long").alias("last"))
    runs = common.stored(sure.unionByName(found), "runs").groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = named.join(runs, ["doc", "mark"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
