"""Document fingerprints by locally consistent parsing.

At each level runs of equal symbols become one symbol, deterministic coin tossing against the left neighbour reduces
the symbols to few labels, local maxima of the labels begin phrases, and a phrase is named by a hash of its symbols.
Boundaries depend only on near symbols, so equal substrings are parsed alike inside, wherever they stand.  A
fingerprint keeps the least name in each of SLOTS classes of the names of two levels; the share of equal slots
estimates the Jaccard likeness of the sets of phrases.

Null texts are empty; all empty texts have one fingerprint.  Order is by descending doc_id, null ids last, rows with
equal ids by text; a table of one row is its own next document.  Texts of any length are parsed whole; repeated rows have
equal fingerprints.  An empty table gives an empty table; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = (2, 3)
SLOTS = 64
GROUP_CHARS = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Hash of 64 bits: xor-shifts and multiplications."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the lowest bit in which a symbol differs from its left neighbour, and that bit."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    differ = x ^ before
    low = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    return place * np.uint64(2) + ((x >> place) & np.uint64(1))


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level and the places of each document's first; no document is empty."""
    begins = np.zeros(len(x), np.bool_)
    begins[first] = True
    new = begins.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(x)).astype(np.uint64)
    x = np.where(run > 1, _mix(x[at] + run * np.uint64(0x9E3779B97F4A7C15)), x[at])
    begins = begins[at]
    first = np.flatnonzero(begins)
    label = x
    for _ in range(4):  # 64 bits, then below 128, 14, 8, 6
        label = _toss(label, first)
    label = label.astype(np.int8)
    cut = begins.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begins[2:]
    at = np.flatnonzero(cut)
    size = np.diff(at, append=len(x))
    place = np.arange(len(x)) - np.repeat(at, size)
    names = _mix(np.add.reduceat(_mix(x + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at) + size.astype(np.uint64))
    return names, np.flatnonzero(begins[at])


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, SLOTS) 16-bit values."""
    out = np.full((len(texts), SLOTS), _EMPTY)
    full = [i for i, t in enumerate(texts) if t]
    if full:
        x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.fromiter((len(texts[i]) for i in full), np.int64, len(full))
        first = np.cumsum(size) - size
        x = _mix(x)
        for level in range(1, max(LEVELS) + 1):
            x, first = parse(x, first)
            if level in LEVELS:
                names = _mix(x + np.uint64(level))
                row = np.repeat(np.array(full), np.diff(first, append=len(x)))
                np.minimum.at(out.reshape(-1), row * SLOTS + (names % np.uint64(SLOTS)).astype(np.int64), names >> np.uint64(6))
        for step in range(1, SLOTS):  # an empty slot takes the value of the next one that isn't
            gap = out == _EMPTY
            gap[[i for i, t in enumerate(texts) if not t]] = False
            if not gap.any():
                break
            moved = np.roll(out, -1, 1)
            out[gap] = np.where(moved[gap] == _EMPTY, _EMPTY, _mix(moved[gap]) >> np.uint64(6))
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Sketches of all texts, a bounded number of code points at a time."""
    parts, own, size = [], [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            parts.append(sketches(own))
            own, size = [], 0
    parts.append(sketches(own))
    return np.concatenate(parts)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=-1)


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as much of the next one (or all of it)."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PLACED = SCHEMA + ", part int, end string, text string"


def _rows(ids, texts, prints, after, after_prints) -> dict:
    new = [edited(t, a) for t, a in zip(texts, after)]
    new_prints = fingerprints(new)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        "fingerprint": pa.array([as_text(p) for p in prints], pa.string()),
        "edited_fingerprint": pa.array([as_text(p) for p in new_prints], pa.string()),
        "near_edited": pa.array(likeness(prints, new_prints), pa.float64()),
        "near_next": pa.array(likeness(prints, after_prints), pa.float64()),
    }


def _end(part: int, which: str, doc_id, text: str) -> pa.RecordBatch:
    row = {name: pa.array([None], kind) for name, kind in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))}
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), **row, "part": pa.array([part], pa.int32()), "end": pa.array([which]), "text": pa.array([text])})


def _within(batches):
    """Results of all documents of a sorted partition but the last; its first and last document as they are."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            b = batch.slice(i, 1000)
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            prints = fingerprints(texts)
            if held is None:
                yield _end(part, "first", ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
            held = ids[-1], texts[-1], prints[-1:]
            if len(ids) > 1:
                n = len(ids) - 1
                found = _rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                yield pa.RecordBatch.from_pydict({**found, "part": pa.array([part] * n, pa.int32()), "end": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string())})
    if held is not None:
        yield _end(part, "last", held[0], held[1])


def _across(batches):
    for b in batches:
        ids, texts, after = (b.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_pydict(_rows(ids, texts, fingerprints(texts), after, fingerprints(after)))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: fingerprints of its text and of its edited text, and likenesses.

    One range shuffle puts the texts in order; each task then works through its part, and only the first and last
    document of each part meet again, so that the last ones find their next document.
    """
    spark = common.ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = common.stored(d.repartitionByRange(n, *order[:1]).sortWithinPartitions(*order).mapInArrow(_within, _PLACED), "placed")
    firsts = placed.where("end = 'first'").select(F.col("part").alias("to_part"), F.col("text").alias("after"))
    parts = placed.where("end = 'first'").select("part")
    to = parts.withColumn("to_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    lasts = placed.where("end = 'last'").select("part", "doc_id", "text").join(to, "part").join(firsts, "to_part")
    return placed.where("end IS NULL").select(*[x.split()[0] for x in SCHEMA.split(", ")]).unionByName(lasts.select("doc_id", "text", "after").mapInArrow(_across, SCHEMA))
