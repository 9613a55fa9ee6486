"""Connected components of an edge table, by least labels and pointer jumping; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b: long): comp is the least vertex of its component.

    A round gives each vertex the least label of itself and its neighbours, then the label of its label.  Labels are
    combined by min before they shuffle, so a vertex with very many edges is no hot spot of the aggregation.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    both = common.stored(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    label = common.stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("comp")), "labels")
    for _ in range(most_rounds):
        heard = both.join(label.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("comp").alias("heard"))
        near = label.join(heard, "v").select("v", F.col("comp").alias("old"), F.least("comp", "heard").alias("near"))
        jump = label.select(F.col("v").alias("near"), F.col("comp").alias("far"))
        new = common.stored(near.join(jump, "near").select("v", F.least("near", "far").alias("comp"), (F.least("near", "far") < F.col("old")).alias("moved")), "labels")
        label = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
