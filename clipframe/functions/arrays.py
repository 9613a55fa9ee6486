"""Padding, cutting and framing of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def tiny() -> Column:
    """A small constant for guarded divisions."""
    return F.lit(TINY)


def fix_length(y: Column, length: int, fill: float = 0.0) -> Column:
    """Cut, or filled on the right."""
    return F.concat(F.slice(y, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(y), F.lit(0))))


def pad_center(y: Column, length: int, fill: float = 0.0) -> Column:
    """In the middle of ``length`` values, or the middle ``length`` of them."""
    lack = F.lit(length) - F.size(y)
    left = F.floor(F.abs(lack) / 2.0).cast("int")
    fills = lambda n: F.array_repeat(F.lit(fill), n)
    return F.when(lack >= 0, F.concat(fills(F.greatest(left, F.lit(0))), y, fills(F.greatest(lack - left, F.lit(0))))).otherwise(F.slice(y, left + 1, length))


def frame_array(y: Column, frame_length: int, hop_length: int, center: bool = False, fill: float = 0.0) -> Column:
    """Array of frames; centred, a frame's length of ``fill`` is put around."""
    if frame_length <= 0 or hop_length <= 0:
        raise ValueError("frame and hop lengths must be positive")
    half = frame_length // 2
    padded = F.concat(F.array_repeat(F.lit(fill), half), y, F.array_repeat(F.lit(fill), frame_length - half)) if center else y
    n = F.floor((F.size(padded) - frame_length) / F.lit(float(hop_length))).cast("int")
    starts = F.when((n >= 0) & (F.size(y) > 0), F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(padded), lambda p: F.transform(starts, lambda t: F.slice(p, t * hop_length + 1, frame_length))), F.lit(0))
