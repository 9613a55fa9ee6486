"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet and
reread; all but the last return the columns of documents.

Null and empty texts have no words, so the quality rules reject them; the other stages take them as empty documents,
which have no near copies and are never taken into the mix.  Null ids stay: in a group of near copies they come last.
Rows that are repeated are near copies of each other.  A null source is a source of its own.  Texts may be of any
length.  Further columns are kept as they are, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipframe.llm import bpe, common, linededup, mixing, ngramjoin, quality
from clipframe.llm.queries import documents, tokenizer_file


#: Columns of documents that stages read; others are set apart from the columns that operators add.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"__extra{i}") for i, c in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs``, by their names, of a result on _apart(docs); ``new`` replaces some."""
    return out.select(*[new.get(c, F.col(c if c in OWN else f"__extra{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return _named(quality.cascade(_apart(docs)).where("failed_rule IS NULL"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that another document keeps; n_chars is that of the new text."""
    found = linededup.dedup_lines(_apart(docs))
    return _named(found, docs, text=F.col("kept_text"), n_chars=F.char_length("kept_text").cast("bigint"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies, once; documents without an id count as the last."""
    return _named(ngramjoin.first_of_each(_apart(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(_apart(docs)).where("taken > 0")
    return _named(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of them and of what they decode to."""
    return bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express near-duplicate groups by MinHash nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
