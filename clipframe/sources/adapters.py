"""Signals and matrices out of event and vector tables.

samples(clip_id, n, y) has gap-free n from 0; feat(clip_id, t, k, x) is a matrix with a row for each cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def samples_of_events(events: DataFrame, signed: bool = False) -> DataFrame:
    """A clip for each user: values by time; ``signed`` takes the clip's mean off."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = F.col("value") - F.avg("value").over(Window.partitionBy("user_id")) if signed else F.col("value")
    return events.select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).cast("bigint").alias("n"), y.cast("double").alias("y"))


def feat_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """A clip for each label: a frame for each vector, by vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    t = embeddings.select(F.col("label").cast("bigint").alias("clip_id"), (F.row_number().over(order) - 1).cast("bigint").alias("t"), "embedding")
    return t.select("clip_id", "t", F.posexplode("embedding").alias("k", "x")).select("clip_id", "t", F.col("k").cast("bigint").alias("k"), F.col("x").cast("double").alias("x"))


def signals(samples: DataFrame, sr: int) -> DataFrame:
    """signal(clip_id, sr, y array): one row a clip, for the kernels."""
    y = F.transform(F.array_sort(F.collect_list(F.struct("n", "y"))), lambda s: s["y"])
    return samples.groupBy("clip_id").agg(F.lit(sr).alias("sr"), y.alias("y"))


def samples_of_signals(signal: DataFrame) -> DataFrame:
    return signal.select("clip_id", F.posexplode("y").alias("n", "y")).select("clip_id", F.col("n").cast("bigint").alias("n"), F.col("y").cast("double").alias("y"))
