"""The pipeline's stages against what each is to do with its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.common.stored(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_stages(spark, stages):
    start, good, lined, single, mixed, encoded = stages
    assert 0 < good.count() < start.count() and good.exceptAll(start).count() == 0
    assert lined.count() == good.count() and {r[0] for r in lined.selectExpr("char_length(text) = n_chars").distinct().collect()} == {True}
    classes = corpus_pipeline.ngramjoin.jaccard_join(lined).select("class_id").distinct()
    assert single.count() == classes.count()
    want = corpus_pipeline.mixing.mix(single).selectExpr("sum(epochs) AS n").first()["n"]
    assert mixed.count() == want == encoded.count()


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[-1]).count() == 0
