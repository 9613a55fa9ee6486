"""Token-id files: documents encoded, ended and written as Re-Pair shards that can be decoded at any place.

A file set is a Parquet folder with a row for each shard: the range of documents, the ids and lengths of the
documents in it, and the grammar of their ids (see repair.py).  Shards are written by Spark's committer, so a lost
executor leaves no partial shard.  Null texts are empty documents: their only id is the end id.  Documents stand in
ascending doc_id order, null ids first; rows with equal ids stay documents of their own, by text.  A text of any length
is encoded whole and lies in one shard.  An empty table gives files without shards, which read back as an empty table;
extra columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pieces, repair

#: Ids in a shard: a shard is compressed and decoded in memory.
SHARD_IDS = 2_000_000
#: Places of shards that may be broadcast: 24 MB.
FEW_SHARDS = 1_000_000
SHARD_SCHEMA = "part int, shard int, doc_ids array<long>, n_tokens array<long>, ids long, grammar binary"


def _tokenizer(path: str, added: bool = False):
    """``added``: as the library has it, added tokens in a text are ids of their own; otherwise they are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    return t


@functools.cache
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte of UTF-8 in the vocabulary, and a space for 0xFF, which no text holds."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    chars = [chr(c) for r in (range(0x800), range(0x800, 0xD800, 0x400), range(0xE000, 0x10000, 0x400), range(0x10000, 0x110000, 0x10000)) for c in r]
    return {0xFF: " "} | {b: letter for c in chars for b, letter in zip(c.encode(), level.pre_tokenize_str(c)[0][0])}


@functools.cache
def piece_table(path: str) -> pieces.PieceTable:
    """Pieces are encoded by the library's model one by one, in the letters of their bytes."""
    tokenize, letters = _tokenizer(path).model.tokenize, byte_letters()

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled = b"\xff".join([p.encode() for p in new]).decode("latin-1").translate(letters).split(" ")
        found = [[t.id for t in tokenize(p)] for p in spelled]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    return pieces.PieceTable(encode)


@functools.cache
def text_encoder(path: str, added: bool = False):
    t = _tokenizer(path, added)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def added_tokens(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def encoded(texts: pa.StringArray, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the number of each text's ids.

    With ``added``, texts that hold an added token go to the library whole; the table of pieces can't match it.
    """
    whole = None
    for token in added_tokens(path) if added else ():
        held = pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        whole = held if whole is None else whole | held
    return piece_table(path).texts(texts, text_encoder(path, added), whole)


def _with_end(ids: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    out = np.full(len(ids) + len(lens), end, np.uint32)
    keep = np.ones(len(out), np.bool_)
    keep[np.cumsum(lens + 1) - 1] = False
    out[keep] = ids
    return out


def _write(path: str, end: int, base: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        docs, counts, ids, size = [], [], [], 0

        def shard():
            nonlocal n, docs, counts, ids, size
            g = repair.compress(np.concatenate(ids), base)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([n], pa.int32()), "doc_ids": pa.array([[x for d in docs for x in d]], pa.list_(pa.int64())), "n_tokens": pa.array([np.concatenate(counts)], pa.list_(pa.int64())), "ids": pa.array([size], pa.int64()), "grammar": pa.array([repair.to_bytes(g)], pa.binary())})
            n, docs, counts, ids, size = n + 1, [], [], [], 0
            return row

        for batch in batches:
            for b in pieces.slices(batch):
                own, lens = encoded(b.column("text"), path, True)
                docs.append(b.column("doc_id").to_pylist())
                counts.append(lens + 1)
                ids.append(_with_end(own, lens, end))
                size += len(ids[-1])
                if size >= shard_ids:
                    yield shard()
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, base: int = 50_257, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Encode the texts, append ``end`` to each, and write them to ``path`` in ascending id order.

    ``base`` is above all ids: grammar rules are numbered from it.

    One range shuffle of the texts puts them in order; encoding and compression follow in the same tasks.
    """
    spark = common.ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text"))
    shards = d.mapInArrow(_write(tokenizer, end, base, shard_ids), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)
    return path


def _read(batches):
    for b in batches:
        for row in b.to_pylist():
            g = repair.from_bytes(row["grammar"])
            ids = g.expand(g.sequence).astype("<u4")
            if len(ids) != row["ids"]:
                raise ValueError("a shard's ids are not whole")
            ends = np.cumsum(row["n_tokens"])
            begins = ends - row["n_tokens"]
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + row["before"], pa.int64()), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def _with_before(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``before``: the ids of all shards before them.  Only the counts of shards are gathered."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "shard", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    few = before.count() <= FEW_SHARDS
    return shards.join(F.broadcast(before) if few else before, ["part", "shard"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    return _with_before(common.ship(spark), path).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches):
    for b in batches:
        for row in b.to_pylist():
            g = repair.from_bytes(row["grammar"])
            for d, n, e in zip(row["doc_ids"], row["n_tokens"], np.cumsum(row["n_tokens"]).tolist()):
                ids = g.decode(e - n, e)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of each document, decoded one by one at their places in the shards."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")
