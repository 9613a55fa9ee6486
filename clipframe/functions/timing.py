"""Frame, sample, block and time conversions as column expressions (non-negative whole results saturate at 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    """Round half away from zero; below zero and NaN give 0."""
    return F.when(F.isnan(x) | (x < 0), F.lit(0)).otherwise(F.round(x)).cast("bigint")


def frames_to_time(frames: Column, sr: int, hop_length: int) -> Column:
    return frames * F.lit(float(hop_length)) / F.lit(float(sr))


def time_to_frames(times: Column, sr: int, hop_length: int) -> Column:
    return _whole(times * F.lit(float(sr)) / F.lit(float(hop_length)))


def frames_to_samples(frames: Column, hop_length: int) -> Column:
    return (frames * F.lit(hop_length)).cast("bigint")


def samples_to_frames(samples: Column, hop_length: int) -> Column:
    return _whole(samples.cast("double") / F.lit(float(hop_length)))


def time_to_samples(times: Column, sr: int) -> Column:
    return _whole(times * F.lit(float(sr)))


def samples_to_time(samples: Column, sr: int) -> Column:
    return samples.cast("double") / F.lit(float(sr))


def blocks_to_frames(blocks: Column, block_length: int) -> Column:
    return (blocks * F.lit(block_length)).cast("bigint")


def blocks_to_samples(blocks: Column, block_length: int, hop_length: int) -> Column:
    return (blocks * F.lit(block_length * hop_length)).cast("bigint")


def blocks_to_time(blocks: Column, block_length: int, hop_length: int, sr: int) -> Column:
    return blocks_to_samples(blocks, block_length, hop_length).cast("double") / F.lit(float(sr))


def times_like(spark: SparkSession, n: int, sr: int, hop_length: int) -> DataFrame:
    """(i, x): time of each of n frames."""
    return spark.range(n).select(F.col("id").alias("i"), frames_to_time(F.col("id"), sr, hop_length).alias("x"))


def samples_like(spark: SparkSession, n: int, hop_length: int) -> DataFrame:
    """(i, x): first sample of each of n frames."""
    return spark.range(n).select(F.col("id").alias("i"), frames_to_samples(F.col("id"), hop_length).alias("x"))
