"""Frames of samples, and features of single frames.

A sample is sent to its few frames by exploding the range of their numbers, which needs no join; all that follows is
partitioned by clip first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import signal
from ..sources import adapters


def frame_count(length: Column, frame_length: int, hop_length: int) -> Column:
    return F.when(length < frame_length, F.lit(0)).otherwise(F.floor((length - frame_length) / F.lit(float(hop_length))) + 1).cast("bigint")


def frame_indices(lengths: DataFrame, frame_length: int, hop_length: int, center: bool = False) -> DataFrame:
    """(clip_id, t, start) of every whole window of (clip_id, length); ``center`` makes the clip a frame longer."""
    n = frame_count(F.col("length") + (frame_length if center else 0), frame_length, hop_length)
    t = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")))
    return lengths.select("clip_id", t.alias("t")).withColumn("start", F.col("t") * hop_length)


def frames(samples: DataFrame, frame_length: int, hop_length: int, center: bool = False) -> DataFrame:
    """(clip_id, t, i, y): frames by place i; samples of the padding (zeros) have no rows."""
    if frame_length <= 0 or hop_length <= 0:
        raise ValueError("frame and hop lengths must be positive")
    pad = frame_length // 2 if center else 0
    length = F.count("*").over(Window.partitionBy("clip_id"))
    n = F.col("n") + pad
    last = F.least(F.floor(n / F.lit(float(hop_length))), frame_count(length + (frame_length if center else 0), frame_length, hop_length) - 1)
    first = F.greatest(F.ceil((n - frame_length + 1) / F.lit(float(hop_length))), F.lit(0))
    placed = samples.withColumn("last", last.cast("bigint")).withColumn("first", first.cast("bigint")).where("first <= last")
    t = placed.select("clip_id", "n", "y", F.explode(F.sequence("first", "last")).alias("t"))
    return t.select("clip_id", "t", (F.col("n") + pad - F.col("t") * hop_length).alias("i"), "y")


def rms_frames(samples: DataFrame, frame_length: int, hop_length: int, center: bool = False) -> DataFrame:
    f = frames(samples, frame_length, hop_length, center)
    return f.groupBy("clip_id", "t").agg(F.sqrt(F.sum(F.col("y") * F.col("y")) / F.lit(float(frame_length))).alias("x"))


def rms(samples: DataFrame) -> DataFrame:
    return samples.groupBy("clip_id").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("x"))


def rms_matrix(channels: DataFrame) -> DataFrame:
    """(clip_id, ch, x) of (clip_id, ch, n, y)."""
    return channels.groupBy("clip_id", "ch").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("x"))


def zero_crossing_rate_frames(samples: DataFrame, frame_length: int, hop_length: int) -> DataFrame:
    """Sign changes within each uncentred frame; zero counts as positive.

    A change belongs to the sample after it, so it is found once in the clip and counted in each frame that holds both.
    """
    before = F.lag("y").over(Window.partitionBy("clip_id").orderBy("n"))
    marked = samples.withColumn("y", F.when(before.isNotNull() & ((F.col("y") >= 0) != (before >= 0)), 1.0).otherwise(0.0))
    f = frames(marked, frame_length, hop_length)
    return f.groupBy("clip_id", "t").agg((F.sum(F.when(F.col("i") > 0, F.col("y")).otherwise(0.0)) / F.lit(float(max(frame_length - 1, 1)))).alias("x"))


def zero_crossing_rate(samples: DataFrame) -> DataFrame:
    before = F.lag("y").over(Window.partitionBy("clip_id").orderBy("n"))
    change = F.when(before.isNull() | F.col("y").isNull(), None).when((F.col("y") >= 0) != (before >= 0), 1.0).otherwise(0.0)
    return samples.select("clip_id", change.alias("c")).groupBy("clip_id").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("x"))


def zero_crossings(samples: DataFrame, threshold: float = 1e-10, pad: bool = False) -> DataFrame:
    """(clip_id, n) where the sign differs from the sample before; values within the threshold are zero."""
    order = Window.partitionBy("clip_id").orderBy("n")
    v = samples.withColumn("v", F.when(F.abs("y") <= threshold, 0.0).otherwise(F.col("y")))
    v = v.withColumn("b", F.lag("v").over(order))
    hit = F.col("b").isNotNull() & ((F.col("v") >= 0) != (F.col("b") >= 0))
    return v.where(hit | (F.lit(pad) & F.col("b").isNull() & (F.col("v") != 0))).select("clip_id", "n")


def preemphasis(samples: DataFrame, coef: float = 0.97, zi: float = 0.0) -> DataFrame:
    before = F.coalesce(F.lag("y").over(Window.partitionBy("clip_id").orderBy("n")), F.lit(zi))  # a missing sample is one of zi
    return samples.select("clip_id", "n", (F.col("y") - F.lit(coef) * before).alias("y"))


def deemphasis(samples: DataFrame, coef: float = 0.97, zi: float = 0.0) -> DataFrame:
    """The recurrence over each clip's array, in blocks; from a missing sample on all are missing."""

    def run(batches):
        for b in batches:
            for clip, ys in zip(b.column("clip_id"), b.column("y")):
                y = ys.values
                out, _ = signal.deemphasis(y.to_numpy(zero_copy_only=False), coef, zi)
                missing = np.logical_or.accumulate(y.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"clip_id": pa.repeat(clip, len(out)), "n": pa.array(np.arange(len(out))), "y": pa.array(out, mask=missing)})

    kind = samples.schema["clip_id"].dataType.simpleString()
    return adapters.signals(samples, 1).select("clip_id", "y").mapInArrow(run, f"clip_id {kind}, n long, y double")


def valid_audio(samples: DataFrame) -> DataFrame:
    """The samples, or an error where one isn't finite."""
    ok = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))
    return samples.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error(F.lit("a sample is not finite")).cast("double")))


def valid_audio_2d(channels: DataFrame) -> DataFrame:
    return valid_audio(channels)


def to_mono(channels: DataFrame) -> DataFrame:
    """Mean over channels of (clip_id, ch, n, y)."""
    return channels.groupBy("clip_id", "n").agg(F.avg("y").alias("y"))


def get_duration(signal: DataFrame) -> DataFrame:
    return signal.select("clip_id", (F.size("y") / F.col("sr")).alias("seconds"))


def trim(samples: DataFrame, top_db: float = 60.0) -> DataFrame:
    """(clip_id, start, stop) of what is loud; (0, 0) for a silent clip."""
    top = F.max(F.abs("y")).over(Window.partitionBy("clip_id"))
    loud = (top > 0) & (F.abs("y") >= top / F.lit(10.0 ** (top_db / 20.0)))
    marked = samples.withColumn("n", F.when(loud, F.col("n")))
    return marked.groupBy("clip_id").agg(F.coalesce(F.min("n"), F.lit(0)).cast("bigint").alias("start"), F.coalesce(F.max("n") + 1, F.lit(0)).cast("bigint").alias("stop"))


def split(samples: DataFrame, top_db: float = 60.0, min_interval: int = 1) -> DataFrame:
    """(clip_id, start, stop) of maximal loud runs: loud samples whose number less their rank is equal are one run."""
    clip = Window.partitionBy("clip_id")
    top = F.max(F.abs("y")).over(clip)
    loud = samples.withColumn("top", top).where((F.col("top") > 0) & (F.abs("y") >= F.col("top") / F.lit(10.0 ** (top_db / 20.0))))
    runs = loud.withColumn("run", F.col("n") - F.row_number().over(clip.orderBy("n")))
    found = runs.groupBy("clip_id", "run").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("stop"))
    return found.where(F.col("stop") - F.col("start") >= min_interval).select("clip_id", "start", "stop")


def remix(samples: DataFrame, intervals: DataFrame, align_zeros: bool = False) -> DataFrame:
    """(clip_id, n, y): the intervals (clip_id, seq, start, stop) one after another.

    Aligned, an end moves to the nearest sign change (the earlier of two; the end of the clip is one), found by the last
    change up to it and the first one from it.
    """
    if align_zeros:
        length = samples.groupBy("clip_id").agg(F.count("*").cast("bigint").alias("n"))
        zeros = zero_crossings(samples, -1.0).unionByName(length).withColumn("z", F.col("n"))
        ends = intervals.select("clip_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("start").alias("n")), F.struct(F.lit(1).alias("e"), F.col("stop").alias("n")))).alias("x"))
        both = zeros.unionByName(ends.select("clip_id", "seq", "x.e", "x.n"), allowMissingColumns=True)
        low = F.last("z", ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("n").rangeBetween(Window.unboundedPreceding, 0))
        high = F.first("z", ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("n").rangeBetween(0, Window.unboundedFollowing))
        near = both.withColumn("low", low).withColumn("high", high).where("e IS NOT NULL")
        near = near.withColumn("n", F.when(F.col("low").isNotNull() & (F.col("high").isNull() | (F.col("n") - F.col("low") <= F.col("high") - F.col("n"))), F.col("low")).otherwise(F.col("high")))
        intervals = near.groupBy("clip_id", "seq").agg(F.max(F.when(F.col("e") == 0, F.col("n"))).alias("start"), F.max(F.when(F.col("e") == 1, F.col("n"))).alias("stop"))
    sized = intervals.where("stop > start").withColumn("before", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy("clip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = sized.select("clip_id", "before", "start", F.explode(F.sequence("start", F.col("stop") - 1)).alias("n"))
    return places.join(samples, ["clip_id", "n"]).select("clip_id", (F.col("before") + F.col("n") - F.col("start")).cast("bigint").alias("n"), "y")
