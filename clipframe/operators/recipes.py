"""Pipelines of several operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import sequences, signal, tonal
from . import kernel, matrix, rhythm, spectral


def vocal_masks(mag: DataFrame, width: int = 11, power: float = 2.0) -> DataFrame:
    """(clip_id, t, k, background, vocals): what the median over neighbouring frames explains is background."""
    back = matrix.median_filter(mag, width, "t").withColumnRenamed("x", "b")
    both = mag.join(back, ["clip_id", "t", "k"]).withColumn("b", F.least("b", "x")).withColumn("v", F.col("x") - F.col("b"))
    p = lambda c: F.pow(F.col(c), F.lit(power))
    total = p("b") + p("v")
    return both.select("clip_id", "t", "k", F.when(total > 1e-10, p("b") / total).otherwise(0.0).alias("background"), F.when(total > 1e-10, p("v") / total).otherwise(0.0).alias("vocals"))


def separate_vocals(signals: DataFrame, config: signal.StftConfig = signal.StftConfig(), width: int = 11, vocals: bool = True) -> DataFrame:
    """signal of the part that changes fast (or of the rest), each clip in one pass."""

    def part(y, sr):
        spec = signal.stft(y, config)
        mag = np.abs(spec)
        back = np.minimum(signal.upper_median(mag, width, 1), mag)
        fore = mag - back
        mask = (fore if vocals else back) ** 2 / np.maximum(fore**2 + back**2, 1e-10)
        return signal.istft(spec * mask, config, len(y))

    return kernel.over_signals(signals, part, "signal")


def synchronise(pairs: DataFrame, hop_length: int = 512, **chroma) -> DataFrame:
    """(clip_id, step, i, j, cost) of (clip_id, sr, a, b): alignment of the chroma of two recordings."""

    def fn(a, b):
        cost, path = sequences.dtw(a, b, "cosine")
        return [(n, i, j, cost) for n, (i, j) in enumerate(path)]

    def features(name):
        rows = kernel.over_signals(pairs.select("clip_id", "sr", F.col(name).alias("y")), lambda y, sr: tonal.chroma_cqt(y, sr, hop_length=hop_length, **chroma), "frames")
        return kernel.matrices_of_feat(kernel.feat_of_frames(rows)).select("clip_id", "n_rows", F.col("v").alias(name))

    both = features("a").join(features("b").drop("n_rows"), "clip_id")
    return kernel.over_pairs(both, fn, "clip_id long, step long, i long, j long, cost double")


def superflux_onsets(samples: DataFrame, sr: float, n_fft: int, hop_length: int, n_mels: int, lag: int = 1, max_size: int = 3) -> DataFrame:
    """(clip_id, n, y): flux over the maximum of neighbouring mel bands, of decibels."""
    mel = spectral.melspectrogram(samples, sr, n_fft, hop_length, n_mels)
    db = mel.withColumn("x", F.lit(10.0) * F.log10(F.col("x") + F.lit(1e-10)))
    return rhythm.superflux(db, lag, max_size)
