"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(6)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(4000)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


A, B, C, LONG = prose(200), prose(150), prose(120), prose(180_000)
ROWS = [
    (1, A, "en", "a", 5), (2, A + " more", "en", "b", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, LONG, "en", None, 9), (5, LONG, "en", None, 9),
    (None, B, "fr", "b", 5), (None, None, None, "b", None), (6, C, "en", "a", 5), (6, B + "\none more line of it", "en", "a", 5), (7, "too few words", "en", "a", 5),
]
#: Names that operators give to columns of their own.
CLASHES = ["failed_rule", "kept", "kept_text", "n_lines", "n_dropped", "size", "source_size", "target", "epochs", "taken", "first", "mark", "key", "v", "ids", "n_tokens", "a b", "x.y"]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def kept(df):
    return sorted(((r["doc_id"], len(r["text"] or "")) for r in df.collect()), key=str)


def test_decisions(spark):
    good = corpus_pipeline.quality_rules(spark, table(spark), "")
    assert kept(good) == sorted([(1, len(A)), (2, len(A) + 5), (5, len(LONG)), (5, len(LONG)), (None, len(B)), (6, len(C)), (6, len(B) + 20)], key=str)
    lined = corpus_pipeline.line_dedup(spark, table(spark), "")
    assert lined.count() == len(ROWS) and {r["n_chars"] - len(r["text"]) for r in lined.collect()} == {0}
    single = corpus_pipeline.ngram_jaccard(spark, table(spark), "")
    assert kept(single) == sorted([(1, len(A)), (3, 0), (4, 0), (5, len(LONG)), (None, 0), (6, len(C)), (6, len(B) + 20), (7, 13)], key=str)
    mixed = corpus_pipeline.mix_sources(spark, table(spark), "")
    assert all(r["text"] for r in mixed.collect()) and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 4
    encoded = corpus_pipeline.byte_bpe(spark, table(spark), "")
    assert encoded.count() == len(ROWS) and encoded.where("n_tokens = 0").count() == 3


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    out = stage(spark, table(spark, []), "")
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == table(spark).columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_clashing_columns_are_kept(spark, name, stage):
    plain, d = stage(spark, table(spark), ""), table(spark).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    out = stage(spark, d, "")
    assert out.columns == d.columns
    assert kept(out.select("doc_id", "text")) == kept(plain)
    assert all(r[c] == f"own {c}" for r in out.drop("text").collect() for c in CLASHES)
