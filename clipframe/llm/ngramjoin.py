"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams (a shorter document is one gram of all its words; none without words).  Equal
sets are one class.  Classes that share a MinHash band are candidates.  MinHash values of a candidate pair are read in
steps, and the pair is dropped when the posterior probability that its Jaccard likeness reaches the threshold falls
below the tolerance; of what stays, each bucket gives spanning edges.  Within the components of these edges every
pair is compared, pruned in the same way and verified exactly on the sets, in one task a component or, if it is large,
one a tile of two blocks.  No pair leaves a task: only counts of links and spanning edges do.

Every row counts as a document.  Rows are named by id and text, so that an id may have several texts.  Null texts have
no grams and no links; a group in which all ids are null gets a negative class_id of its own.  Texts may be of any
length; extra columns play no part, whatever their names.  Empty tables give empty tables.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

N = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction: verification is in whole numbers
BANDS, ROWS = 32, 5  # at likeness 0.8, all bands differ with probability 3e-6
STEP = 32
TOLERANCE = 1e-7
#: Classes and grams that are compared in one task; larger buckets and components are cut to blocks.
TILE = 2048
GRAMS_A_TILE = 1 << 22
#: Bytes of the bit matrix that counts common grams at a time.
BITS_BYTES = 64_000_000
LAST_ID = (1 << 63) - 1
#: Names of texts that may be broadcast: 64 bytes each.
FEW_IDS = 250_000


@functools.cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: Column) -> Column:
    return F.transform(common.words(text), lambda w: F.xxhash64(w))


def grams(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct grams of all documents, sorted within each; ends of the documents)."""
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    h = _mix(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    begin = np.cumsum(n) - n
    count = np.where(n >= N, n - N + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    at = begin[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    padded = np.concatenate([h, np.zeros(N, np.uint64)])
    g = np.zeros(len(row), np.uint64)
    size = np.minimum(n, N)[row]
    for k in range(N):
        g = _mix(g * np.uint64(3) + np.where(k < size, padded[at + k], np.uint64(k)))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), np.bool_)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(n)), "right")


def minhash(g: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, BANDS * ROWS) MinHash values; documents without grams have all ones."""
    begins = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > begins)
    out = np.full((BANDS * ROWS, len(ends)), 0xFFFFFFFF, np.uint32)
    if len(full):
        for k, m in enumerate(_multipliers()):
            out[k, full] = np.minimum.reduceat(((g * m) >> np.uint64(32)).astype(np.uint32), begins[full])
    return np.ascontiguousarray(out.T)


def bands(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes that hold the band's number."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        out = _mix(out * np.uint64(3) + sig[:, r::ROWS])
    return out


def _sign(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            b = batch.slice(i, 500)
            g, ends = grams(b.column("words"))
            begins = np.concatenate([[0], ends[:-1]])
            n = ends - begins
            sig = minhash(g, ends)
            band = bands(sig).astype(np.uint64).view(np.int64)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(g + np.uint64(s)))]) for s in (1, 2)]
            a, c = ((s[ends] - s[begins]).view(np.int64) for s in sums)
            keep = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(band[n > 0].reshape(-1)))
            low = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("mark"), pa.array(n), pa.array(a), pa.array(c), lists, low], names=["row", "doc_id", "mark", "n_grams", "set_a", "set_b", "bands", "sig"])


@functools.cache
def least_matches(step: int = STEP, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Fewest equal values, after each step, with which a pair stays.

    With a uniform prior, likeness after m of n equal values is Beta(m + 1, n - m + 1); that it reaches t has the
    probability of at most m successes in n + 1 throws of t.
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) of rows that are not dropped.

    ``sig`` may hold the low bytes of the values: bytes that are equal by chance only keep a pair.
    """
    place, same = np.arange(len(b)), np.zeros(len(b), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (sig[a[place], part] == sig[b[place], part]).sum(1, dtype=np.int32)
        place, same = place[same >= least], same[same >= least]
        if not len(place):
            break
    return place


def _groups(batches, names: tuple[str, ...]):
    """Tables of the rows of one group after another; rows come sorted by the long columns ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, np.bool_)
        for c in names:
            new |= np.diff(batch.column(c).to_numpy(zero_copy_only=False)) != 0
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in names):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning(sig: np.ndarray, block: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Pairs of rows that join those whose likeness may reach the threshold; ``across``: only pairs of two blocks."""
    label, edges, sets = np.arange(len(sig)), [], len(sig)
    for i in range(len(sig) - 1):
        if sets == 1:
            break
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # who is joined already need not be compared
        js = js[block[js] != block[i]] if across else js
        js = js[likely(sig, np.full(len(js), i), js)]
        if len(js):
            old, first = np.unique(label[js], return_index=True)
            edges += [(i, j) for j in js[first].tolist()]
            label[np.isin(label, old)] = label[i]
            sets -= len(old)
    return edges


def _span(batches):
    """Rows (v, band, tile, block, across, sig) sorted by (band, tile): spanning edges (a, b) of each bucket's tile."""

    def edges(v, x, y):
        return pa.RecordBatch.from_pydict({"a": pa.array(v[x], pa.int64()), "b": pa.array(v[y], pa.int64())})

    def of(t, v, sig):
        found = spanning(sig, t.column("block").to_numpy(), t.column("across")[0].as_py())
        if found:
            x, y = np.array(found).T
            yield edges(v, x, y)

    two: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs():
        v, sig = np.concatenate([x for x, _ in two]), np.concatenate([x for _, x in two])
        a = np.arange(0, len(v), 2)
        kept = a[likely(sig, a, a + 1)]
        yield edges(v, kept, kept + 1)

    for t in _groups(batches, ("band", "tile")):
        if t.num_rows < 2:
            continue
        v = t.column("v").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(v), BANDS * ROWS)
        if len(v) > 2:
            yield from of(t, v, sig)
            continue
        if not t.column("across")[0].as_py() or t.column("block")[0] != t.column("block")[1]:
            two.append((v, sig))
        if len(two) >= 2000:
            yield from pairs()
            two.clear()
    if two:
        yield from pairs()


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _common(rows: np.ndarray, cols: np.ndarray, n_rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of common grams of each pair (a, b): cells (rows, cols), sorted by column, are counted by blocks of columns."""
    out = np.zeros(len(a), np.int64)
    wide = max(1, BITS_BYTES // (8 * n_rows)) * 64
    last = int(cols[-1]) + 1 if len(cols) else 0
    for begin in range(0, last, wide):
        x, y = np.searchsorted(cols, [begin, begin + wide])
        c = cols[x:y] - begin
        bits = np.zeros((n_rows, min(wide, last - begin) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (rows[x:y], c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
        step = max(1, 4_000_000 // bits.shape[1])
        for i in range(0, len(a), step):
            out[i : i + step] += np.bitwise_count(bits[a[i : i + step]] & bits[b[i : i + step]]).sum(1, dtype=np.int64)
    return out


def _compare(key: np.ndarray, times: np.ndarray, block: np.ndarray, across: bool, words: pa.ListArray):
    """(keys, links of each to other classes' documents, least key of its cluster); ``across``: only pairs of two blocks.

    A key that comes twice is a repeated row and is compared once.
    """
    key, order = np.unique(key, return_index=True)
    times, block, words = times[order], block[order], words.take(pa.array(order))
    g, ends = grams(words)
    n = np.diff(ends, prepend=0)
    sig = minhash(g, ends).astype(np.uint8)
    pairs = []
    for i in range(len(key) - 1):
        js = np.arange(i + 1, len(key))
        js = js[block[js] != block[i]] if across else js
        js = js[likely(sig, np.full(len(js), i), js)]
        if len(js):
            pairs.append((np.full(len(js), i, np.int32), js.astype(np.int32)))
    links, parent = np.zeros(len(key), np.int64), list(range(len(key)))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1  # grams of one document need no bit
        shared = np.flatnonzero(count[inverse] > 1)
        shared = shared[np.argsort(inverse[shared], kind="stable")]
        both = _common(np.repeat(np.arange(len(n)), n)[shared], number[inverse[shared]], len(key), a, b)
        linked = THRESHOLD[1] * both >= THRESHOLD[0] * (n[a] + n[b] - both)
        a, b = a[linked], b[linked]
        links = (np.bincount(a, times[b], len(key)) + np.bincount(b, times[a], len(key))).astype(np.int64)
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = _root(parent, i), _root(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return key, links, key[[_root(parent, i) for i in range(len(key))]]


def _verify(batches):
    """Rows sorted by (comp, tile); each group is compared when its last row has come."""
    for t in _groups(batches, ("comp", "tile")):
        key, times, block = (t.column(c).to_numpy() for c in ("v", "times", "block"))
        key, links, root = _compare(key, times, block, t.column("across")[0].as_py(), t.column("words").chunk(0))
        yield pa.RecordBatch.from_pydict({"v": pa.array(key), "links": pa.array(links), "root": pa.array(root), "comp": pa.array(np.full(len(key), t.column("comp")[0].as_py()))})


def _tiles(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows with ``n_blocks``, the blocks of their group: each goes to every tile (two blocks) that has its own."""
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int"))
    spread = rows.select(group, "n_blocks", "block", *columns, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    tile = F.least("block", "other").cast("long") * F.col("n_blocks") + F.greatest("block", "other")
    return spread.select(group, tile.alias("tile"), "block", (F.col("block") != F.col("other")).alias("across"), *columns)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, class_id, n_links, n_grams, mark, first: one row for each row of ``docs``.

    n_links counts the other documents whose likeness is 0.8 or more, copies included.  class_id is the least id
    of those that links connect, directly or not; a document without links is its own class.  ``mark`` is the hash
    of the text that names a row together with its id; ``first`` holds for one row of each class.
    """
    spark = common.ship(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    own = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", word_hashes(F.col("text")).alias("words"))
    # the numbers of rows are those of the stored table, which alone is read from here on
    signed = common.stored(own.mapInArrow(_sign, "row long, doc_id long, mark long, n_grams long, set_a long, set_b long, bands array<long>, sig binary"), "signed")
    sets = ["set_a", "set_b", "n_grams"]
    classes = signed.where("n_grams > 0").groupBy(*sets).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("order"), "row", "doc_id", "mark")).alias("rep"), F.count("*").alias("times"))
    classes = common.stored(classes.select(F.col("rep.row").alias("v"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.mark").alias("mark"), *sets, "times"), "classes")

    # candidates: classes that share a band, compared by their MinHash values
    reps = signed.where("n_grams > 0").select(F.col("row").alias("v"), "bands", "sig").join(classes.select("v"), "v", "left_semi")
    reps = common.stored(reps, "reps")
    banded = reps.select("v", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    buckets = common.stored(buckets.select("band", F.ceil(F.col("size") / F.lit(tile)).cast("int").alias("n_blocks")), "buckets")
    met = common.stored(banded.join(buckets, "band"), "met")
    dealt = _tiles(met.join(reps.select("v", "sig"), "v"), "band", "v", "sig")
    dealt = dealt.repartition(n, "band", "tile").sortWithinPartitions("band", "tile", "v")
    edges = common.stored(dealt.mapInArrow(_span, "a long, b long").distinct(), "spans")

    # texts of the members meet in their components, in every tile of two blocks
    comps = components(edges)
    member = comps.join(classes.select("v", "doc_id", "mark", "times", "n_grams"), "v")
    n_blocks = F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("n_grams") / F.lit(GRAMS_A_TILE))).cast("int")
    sizes = common.stored(member.groupBy("comp").agg(n_blocks.alias("n_blocks")), "sizes")
    member = common.stored(member.join(sizes, "comp").drop("n_grams"), "members")
    few = member.count() <= FEW_IDS
    wanted = member.select(F.col("doc_id").alias("__id"), "mark", "v", "comp", "times", "n_blocks")
    found = named.join(F.broadcast(wanted) if few else wanted, [F.expr("doc_id <=> __id"), named["mark"] == wanted["mark"]]).select("v", "comp", "times", "n_blocks", "text")
    dealt = _tiles(found, "comp", "v", "times", "text").repartition(n, "comp", "tile").sortWithinPartitions("comp", "tile", "v")
    dealt = dealt.select("v", "comp", "times", "block", "tile", "across", word_hashes(F.col("text")).alias("words"))
    verified = common.stored(dealt.mapInArrow(_verify, "v long, links long, root long, comp long"), "verified")

    counted = verified.groupBy("v").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    spread = verified.join(sizes.where("n_blocks > 1"), "comp").where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
    if spread.limit(1).count():  # clusters of a component that was cut to tiles
        joined = components(spread).select("v", F.col("comp").alias("joined"))
        counted = counted.join(joined, "v", "left").select("v", "links", F.coalesce("joined", "root").alias("root"))
    counted = common.stored(counted.join(classes.select("v", "doc_id"), "v"), "counted")
    firsts = counted.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("order"), "v", "doc_id")).alias("first"))
    counted = counted.join(firsts, "root").select("v", "links", "first")
    of_class = classes.select("v", *sets, "times", F.struct(F.lit(LAST_ID).alias("order"), "v", "doc_id").alias("own")).join(counted, "v", "left").withColumn("first", F.coalesce("first", "own"))
    out = signed.select("row", "doc_id", "mark", *sets).join(of_class.select(*sets, "times", "links", "first"), sets, "left")
    return out.select(
        "doc_id",
        F.coalesce(F.when(F.col("first").isNull(), F.col("doc_id")), F.col("first.doc_id"), -1 - F.coalesce("first.v", "row")).alias("class_id"),
        (F.coalesce("times", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        F.col("n_grams").cast("bigint").alias("n_grams"),
        "mark",
        F.coalesce(F.col("row") == F.col("first.v"), F.lit(True)).alias("first"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group that links connect: that of the least id (null ids last).

    Documents without words stay, and so do all groups of one.  Texts move only where one row of several that are equal
    in id and text stays.
    """
    found = jaccard_join(docs, id_col, text_col).groupBy("doc_id", "mark").agg(F.max("first").alias("first"), F.count("*").alias("n"), F.max("n_grams").alias("n_grams"))
    odd = common.stored(found.where("NOT first OR n > 1 AND n_grams > 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("first").alias("__first")), "odd")
    odd = F.broadcast(odd) if odd.count() <= FEW_IDS else odd
    named = docs.withColumns({"__own": F.col(id_col).cast("bigint"), "__text": F.xxhash64(F.col(text_col))})
    told = named.join(odd, F.expr("__own <=> __id AND __text = __mark"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = told.where("__first").dropDuplicates(["__own", "__text"])
    return told.where("__first IS NULL").select(*columns).unionByName(repeated.select(*columns))
