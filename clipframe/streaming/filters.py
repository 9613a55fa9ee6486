"""Signals as streams: event-time windows, and filters whose state goes from batch to batch.

A stream has blocks (clip_id, block, y array) in order of block for each clip; the state of a clip is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import signal

OUT = "clip_id long, block long, y array<double>"


def _carried(blocks: DataFrame, step) -> DataFrame:
    """Each clip's blocks through ``step(y, last) -> (out, last)``; ``last`` is kept between batches."""

    def run(key, parts: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else 0.0
        for part in parts:
            part = part.sort_values("block")
            ys = []
            for y in part["y"]:
                out, last = step(y, last)
                ys.append(list(out))
            yield pd.DataFrame({"clip_id": key[0], "block": part["block"].to_numpy(), "y": ys})
        state.update((float(last),))

    return blocks.groupBy("clip_id").applyInPandasWithState(run, OUT, "last double", "append", "NoTimeout")


def deemphasis(blocks: DataFrame, coef: float = 0.97) -> DataFrame:
    return _carried(blocks, lambda y, last: signal.deemphasis(y, coef, last))


def preemphasis(blocks: DataFrame, coef: float = 0.97) -> DataFrame:
    return _carried(blocks, lambda y, last: signal.preemphasis(y, coef, last))


def windowed_energy(events: DataFrame, window: str, slide: str, late: str) -> DataFrame:
    """(user_id, start, rms) over sliding event-time windows; events later than ``late`` are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.window("ts", window, slide).alias("w"))
    return w.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).select("user_id", F.col("w.start").alias("start"), "rms")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start, stop, n): runs of events that are less than ``gap`` apart."""
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
