"""Token counts of flat, unindexed token files by a separator scan.

A file is a run of little-endian ids (16 or 32 bits) without any index, cut into blocks of a fixed number of ids
wherever they fall.
Each block is searched for the end-of-document id at once (numpy); a prefix scan over the blocks of a file then
stitches documents that cross blocks.  Files are independent, so no task needs more than the block sums of one.
Null texts are empty documents; empty blocks, files and tables have no documents.  A text of any length is a run of
blocks.  Documents are named by their place in a file, so that repeated rows and null ids stay apart; other columns of
the table of documents play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pieces, tokenfile

BLOCK_IDS = 1 << 18
SCHEMA = "file int, block int, data binary, doc_ids array<long>, kind string"


def _flat(path: str, end: int, block_ids: int, kind: str):
    def run(batches):
        from pyspark import TaskContext

        file, block, names, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row(kind, n, data=None, ids=None):
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([n], pa.int32()), "data": pa.array([data], pa.binary()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "kind": pa.array([kind])})

        for batch in batches:
            for b in pieces.slices(batch):
                # an added token in a text stays ordinary text: its id may be ``end``, which is no id of a document here
                ids = tokenfile._with_end(*tokenfile.encoded(b.column("text"), path), end)
                yield row("names", names, ids=b.column("doc_id").to_pylist())
                names += 1
                held.append(ids)
                size += len(ids)
                if size >= block_ids:
                    flat = np.concatenate(held)
                    for i in range(0, len(flat) - block_ids + 1, block_ids):
                        yield row("ids", block, flat[i : i + block_ids].astype(kind).tobytes())
                        block += 1
                    held = [flat[len(flat) // block_ids * block_ids :]]
                    size = len(held[0])
        if size:
            yield row("ids", block, np.concatenate(held).astype(kind).tobytes())

    return run


def write_flat(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, kind: str = "<u2") -> str:
    """Encode the texts to flat files under ``path``/kind=ids, and the doc ids in the same order to kind=names.

    A task writes one file from the rows that it reads, in their order; nothing shuffles.  ``kind`` must hold every id.
    """
    if end > np.iinfo(kind).max:
        raise ValueError(f"the end id doesn't fit {kind}")
    common.ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.mapInArrow(_flat(tokenizer, end, block_ids, kind), SCHEMA)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return path


def blocks_of_files(spark: SparkSession, paths: str, block_ids: int = BLOCK_IDS, kind: str = "<u4") -> DataFrame:
    """Blocks of raw files of ids: (file string, block int, data binary)."""
    size, width = F.octet_length("content"), np.dtype(kind).itemsize * block_ids
    n = F.ceil(size / F.lit(width)).cast("int")
    b = spark.read.format("binaryFile").load(paths).where(size > 0)
    return b.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("file", "block", F.substring(F.col("content"), F.col("block") * width + 1, F.lit(width)).alias("data"))


def _scan(end: int, kind: str):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids = np.frombuffer(row.column("data")[0].as_py() or b"", kind)
                at = np.flatnonzero(ids == end).astype(np.int64)
                yield pa.RecordBatch.from_arrays([row.column("file"), row.column("block"), pa.array([len(ids)], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def count_tokens(blocks: DataFrame, end: int, kind: str = "<u4") -> DataFrame:
    """file, doc (0-based in its file), start (place of its first id in the file), n_tokens (without the end id), ended.

    ``blocks`` has (file, block, data); blocks of a file but its last may have any length.  Ids after a file's last
    end id are a document that isn't ended.
    """
    common.ship(blocks.sparkSession)
    name = blocks.schema["file"].dataType.simpleString()
    found = common.stored(blocks.select("file", "block", "data").mapInArrow(_scan(end, kind), f"file {name}, block int, n long, ends array<long>"), "ends")
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n", F.size("ends").cast("bigint").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(prior), F.lit(0))).withColumn("doc0", F.coalesce(F.sum("docs").over(prior), F.lit(0)))
    sums = sums.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last")).over(prior), F.lit(-1)))
    j = found.join(sums.select("file", "block", "base", "doc0", "open"), ["file", "block"])
    ends = F.transform("ends", lambda e: e + F.col("base"))
    both = common.let(ends, lambda a: F.arrays_zip(F.concat(F.array("open"), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).alias("a"), a.alias("b")))
    whole = j.where(F.size("ends") > 0).select("file", "doc0", F.posexplode(both).alias("i", "x")).select("file", (F.col("doc0") + F.col("i")).alias("doc"), (F.col("x")["a"] + 1).alias("start"), (F.col("x")["b"] - F.col("x")["a"] - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = sums.groupBy("file").agg(F.sum("n").alias("n"), F.sum("docs").alias("doc"), F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)).alias("last")).where("n - 1 > last")
    return whole.unionByName(tails.select("file", "doc", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended")))


def count_documents(spark: SparkSession, path: str, end: int, kind: str = "<u2") -> DataFrame:
    """Counts of the files of write_flat with the documents' ids: doc_id, n_tokens, file, start."""
    files = spark.read.schema(SCHEMA).parquet(path)  # of an empty table there are no folders of kinds
    blocks = files.where("kind = 'ids'").select("file", "block", "data")
    names = files.where("kind = 'names'").select("file", "block", "doc_ids")
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = names.withColumn("before", F.coalesce(F.sum(F.size("doc_ids").cast("bigint")).over(prior), F.lit(0)))
    names = names.select("file", "before", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("before") + F.col("i")).alias("doc"), "doc_id")
    return count_tokens(blocks, end, kind).join(names, ["file", "doc"]).select("doc_id", "n_tokens", "file", "start")
