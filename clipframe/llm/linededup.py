"""Line dedup: two Bloom filters for once-seen and twice-seen hashes find suspected repeats, which are then confirmed exactly.

Null texts are one empty line.  Rows with the same doc_id count as one document; a null doc_id counts
as the largest id.  Texts and lines may be of any length; repeated rows have equal results.  Extra columns are kept, but
for any with the name of a result.  Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Largest filter in bits: 64 MB each.  Beyond 4 bits a line, more lines that aren't repeated pass on
#: to the exact step; none is ever missed.
MOST_BITS = 1 << 29
BITS_A_LINE = 4
SEGMENT = 1 << 19  # bits of the filters that are merged together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(common.SPACES)), UPPER, LOWER)


def line_keys(text: Column, least: int) -> Column:
    """Key of each line, null where it is too short to count."""

    def key(line):
        return F.when(F.char_length(line) >= least, line)

    return F.transform(F.transform(common.lines(text), line_key), key)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    """Cell of each hash in a filter of ``bits`` (a power of two) cells."""
    h = h.astype(np.uint64)
    return ((h ^ (h >> np.uint64(31))) & np.uint64(bits - 1)).astype(np.int64)


def _segments(bits: int):
    """Once- and twice-seen filters of a partition, cut into segments that hold a bit."""

    def run(batches):
        once, twice = np.zeros(bits, np.bool_) if bits <= SEGMENT * 64 else None, None
        seen: list[np.ndarray] = []
        if once is not None:
            twice = np.zeros(bits, np.bool_)
        for b in batches:
            cells = _mix(b.column(0).flatten().to_numpy(zero_copy_only=False), bits)
            if once is None:
                seen.append(cells)
                continue
            cells.sort()
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            twice[cells[once[cells]]] = True
            once[cells] = True
        if once is None:  # a filter much larger than the partition: work segment by segment
            cells = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            edges = np.searchsorted(cells, np.arange(0, bits + SEGMENT, SEGMENT))
            for s in np.flatnonzero(np.diff(edges)):
                own = cells[edges[s] : edges[s + 1]] - s * SEGMENT
                n = np.bincount(own, minlength=SEGMENT)
                yield _segment(int(s), n > 0, n > 1)
            return
        size = min(bits, SEGMENT)
        for s in range(bits // size):
            part = slice(s * size, (s + 1) * size)
            if once[part].any():
                yield _segment(s, once[part], twice[part])

    def _segment(s, once, twice):
        import zlib

        packed = [zlib.compress(np.packbits(x).tobytes(), 1) for x in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], names=["segment", "once", "twice"])

    return run


def _merge(batches):
    """OR of the filters of one segment after another: seen twice is seen twice in one partition or once in two."""
    import zlib

    at: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for s, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            x, y = (np.frombuffer(zlib.decompress(v), np.uint8) for v in (one, two))
            if s not in at:
                at[s] = [x.copy(), y.copy()]
            else:
                old = at[s]
                old[1] |= y
                old[1] |= old[0] & x
                old[0] |= x
    for s, (_, two) in at.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zlib.compress(two.tobytes(), 1)], pa.binary())], names=["segment", "twice"])


def twice_seen(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes of the filter of hashes seen twice or more, its number of bits) for a column of arrays of hashes."""
    n = hashes.select(F.sum(F.size("hashes"))).first()[0] or 0
    bits = 1 << 13
    while bits < min(MOST_BITS, BITS_A_LINE * n):
        bits *= 2
    parts = hashes.select("hashes").mapInArrow(_segments(bits), "segment long, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(_merge, "segment long, twice binary")
    import zlib

    size = min(bits, SEGMENT) // 8
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row[0] * size : (row[0] + 1) * size] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out, bits


def _probe(shared, bits: int):
    def run(batches):
        filt = shared.value
        for b in batches:
            keys = b.column("keys").flatten()
            rows = pc.list_parent_indices(b.column("keys")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("keys")).to_numpy(zero_copy_only=False))])
            pos = np.arange(len(keys)) - ends[rows]
            h = b.column("hashes").flatten()
            ok = np.flatnonzero(np.asarray(h.is_valid()))
            cell = _mix(h.fill_null(0).to_numpy(zero_copy_only=False)[ok], bits)
            ok = ok[(filt[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(rows[ok])), b.column("mark").take(pa.array(rows[ok])), pa.array(pos[ok].astype(np.int32)), keys.take(pa.array(ok))], names=["doc", "mark", "pos", "key"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with ``kept_text`` (string), ``n_lines`` and ``n_dropped`` (long).

    Lines whose key (stripped, A-Z lower-cased) has ``least_chars`` code points and is in two documents
    are dropped but for those in the smallest ``id_col`` that holds the key.

    Passes: (1) a map pass writes 8-byte hashes of the distinct keys of each document; (2) a map pass over
    those builds both filters, of which the twice-seen one (at most 64 MB) is broadcast; (3) a map pass over
    the texts lets suspected lines through, and only these shuffle.
    """
    spark = common.ship(docs.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID))
    text = F.col(text_col)
    hashed = F.transform(line_keys(text, least_chars), lambda k: F.when(k.isNotNull(), F.xxhash64(k)))
    distinct = docs.select(F.array_distinct(F.filter(hashed, lambda h: h.isNotNull())).alias("hashes")).where(F.size("hashes") > 0)
    filt, bits = twice_seen(common.stored(distinct, "hashes"))
    shared = spark.sparkContext.broadcast(filt)

    keyed = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), line_keys(text, least_chars).alias("keys"))
    keyed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64(k))))
    suspects = common.stored(keyed.mapInArrow(_probe(shared, bits), "doc long, mark long, pos int, key string"), "suspects")
    firsts = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    drops = suspects.join(common.stored(firsts, "firsts"), "key").where("doc > first").groupBy("doc", "mark").agg(F.collect_set("pos").alias("cut"))

    named = docs.select("*", doc.alias("__doc"), F.xxhash64(text).alias("__mark"))
    drops = drops.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("cut").alias("__cut"))
    joined = named.join(drops, ["__doc", "__mark"], "left")
    all_lines = common.lines(text)
    left = F.when(F.col("__cut").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        common.let(all_lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__cut")), lambda i: F.get(ls, i)), "\n"))
    )
    n_lines = F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.translate(F.coalesce(text, F.lit("")), "\n", "")) + 1
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")], left.alias("kept_text"), n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("__cut"), F.lit(0)).cast("bigint").alias("n_dropped"))
