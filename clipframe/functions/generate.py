"""Test signals as samples over a range of numbers: nothing is made on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _over(spark: SparkSession, n: int, y) -> DataFrame:
    return spark.range(max(n, 0)).select(F.lit(0).cast("bigint").alias("clip_id"), F.col("id").alias("n"), y(F.col("id").cast("double")).alias("y"))


def tone(spark: SparkSession, frequency: float, sr: int, duration: float) -> DataFrame:
    return _over(spark, int(duration * sr), lambda i: F.sin(F.lit(2.0 * math.pi * frequency / sr) * i))


def chirp(spark: SparkSession, f0: float, f1: float, sr: int, duration: float, linear: bool = False) -> DataFrame:
    """Sweep from f0 to f1: the phase is the integral of a linear or exponential frequency; equal ends are a tone."""
    if f0 == f1:
        return tone(spark, f0, sr, duration)

    def phase(t: Column) -> Column:
        if linear:
            return F.lit(f0) * t + F.lit((f1 - f0) / (2.0 * duration)) * t * t
        rate = math.log(f1 / f0) / duration
        return F.lit(f0 / rate) * (F.exp(F.lit(rate) * t) - 1.0)

    return _over(spark, int(duration * sr), lambda i: F.sin(F.lit(2.0 * math.pi) * phase(i / F.lit(float(sr)))))


def clicks(times: DataFrame, sr: int, length: int, click_duration: float = 0.1, click_freq: float = 1000.0) -> DataFrame:
    """(clip_id, n, y) of (clip_id, time): fading bursts that add up, on ``length`` samples."""
    n = int(click_duration * sr)
    i = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    hit = times.select("clip_id", F.floor(F.col("time") * F.lit(float(sr))).alias("at"), i.alias("i"))
    burst = F.sin(F.lit(2.0 * math.pi * click_freq / sr) * F.col("i")) * F.exp(-F.col("i") / F.lit(0.1 * n))
    made = hit.select("clip_id", (F.col("at") + F.col("i")).cast("bigint").alias("n"), burst.alias("y")).where((F.col("n") < length) & F.lit(n > 0))
    grid = times.select("clip_id").distinct().select("clip_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))).alias("n"))
    return grid.join(made.groupBy("clip_id", "n").agg(F.sum("y").alias("y")), ["clip_id", "n"], "left").select("clip_id", "n", F.coalesce("y", F.lit(0.0)).alias("y"))
