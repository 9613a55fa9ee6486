"""Kernels over tables: a signal or matrix is one row, so a kernel runs in a narrow mapInArrow without a shuffle.

Signals are signal(clip_id, sr, y array); matrices are matrix(clip_id, n_rows, v array in row order).  A kernel
gives a matrix (a row for each frame: clip_id, t, v), a signal, or scalars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..kernels import image, rhythm, sequences, signal, tonal

__all__ = ["beat_track", "chroma_cqt", "cqt", "dtw", "feat_of_frames", "hpss", "image", "istft", "matrices_of_feat", "melspectrogram", "mfcc", "over_matrices", "over_pairs", "over_signals", "pyin", "rhythm", "sequences", "signal", "stft", "tonal", "yin"]

FRAMES = "clip_id long, t long, v array<double>"
SPECTRUM = "clip_id long, t long, re array<double>, im array<double>"
SIGNAL = "clip_id long, sr int, y array<double>"
MARKS = "clip_id long, idx long"
SCALAR = "clip_id long, x double"


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    for v in column:
        yield v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid else np.zeros(0)


def _lists(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _frames(clip: int, m: np.ndarray, start: int = 0) -> dict:
    n = m.shape[1]
    return {"clip_id": pa.array(np.full(n, clip)), "t": pa.array(np.arange(start, start + n)), "v": _lists(m.T)}


def _spectrum(clip: int, m: np.ndarray) -> dict:
    n = m.shape[1]
    return {"clip_id": pa.array(np.full(n, clip)), "t": pa.array(np.arange(n)), "re": _lists(m.real.T), "im": _lists(m.imag.T)}


def _signal(clip: int, y: np.ndarray, sr: int) -> dict:
    return {"clip_id": pa.array([clip], pa.int64()), "sr": pa.array([sr], pa.int32()), "y": _lists(np.asarray(y, float)[None])}


def _marks(clip: int, idx) -> dict:
    return {"clip_id": pa.array(np.full(len(idx), clip)), "idx": pa.array(np.asarray(idx, np.int64))}


_MAKERS = {"frames": (_frames, FRAMES), "spectrum": (_spectrum, SPECTRUM), "marks": (_marks, MARKS), "scalar": (lambda c, x: {"clip_id": pa.array([c], pa.int64()), "x": pa.array([float(x)])}, SCALAR)}


def over_signals(signals: DataFrame, fn: Callable, kind: str, permissive: bool = False) -> DataFrame:
    """``fn(y, sr)`` of each clip as ``kind``: frames, spectrum, marks, scalar or signal.

    Empty and non-finite signals fail the job, as kernels check them; ``permissive`` leaves such clips out.
    """
    make, schema = _MAKERS.get(kind, (None, SIGNAL))

    def run(batches):
        for b in batches:
            for clip, sr, y in zip(b.column("clip_id").to_pylist(), b.column("sr").to_pylist(), _vectors(b.column("y"))):
                try:
                    out = fn(y, sr)
                except ValueError:
                    if permissive:
                        continue
                    raise
                yield pa.RecordBatch.from_pydict(make(clip, out) if make else _signal(clip, out, sr))

    return signals.select("clip_id", "sr", "y").mapInArrow(run, schema)


def over_matrices(matrices: DataFrame, fn: Callable, kind: str = "frames") -> DataFrame:
    """``fn(matrix)`` of each clip's matrix(clip_id, n_rows, v); frames may come as an iterator of strips of columns."""
    make, schema = _MAKERS[kind]

    def run(batches):
        for b in batches:
            for clip, n, v in zip(b.column("clip_id").to_pylist(), b.column("n_rows").to_pylist(), _vectors(b.column("v"))):
                out, at = fn(v.reshape(n, -1)), 0
                if not isinstance(out, Iterator):
                    yield pa.RecordBatch.from_pydict(make(clip, out))
                    continue
                for strip in out:
                    yield pa.RecordBatch.from_pydict(make(clip, strip, at))
                    at += strip.shape[1]

    return matrices.select("clip_id", "n_rows", "v").mapInArrow(run, schema)


def over_pairs(pairs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Rows of ``fn(a, b)`` (tuples after clip_id) for (clip_id, n_rows, a, b), two matrices with equal rows."""

    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for clip, n, a, b in zip(batch.column("clip_id").to_pylist(), batch.column("n_rows").to_pylist(), _vectors(batch.column("a")), _vectors(batch.column("b"))):
                rows = list(fn(a.reshape(n, -1), b.reshape(n, -1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[clip] * len(rows), *zip(*rows)] if rows else [[]] * len(to), to)], schema=to)

    return pairs.select("clip_id", "n_rows", "a", "b").mapInArrow(run, schema)


def matrices_of_feat(feat: DataFrame) -> DataFrame:
    """matrix(clip_id, n_rows, v) of feat(clip_id, t, k, x): a clip's matrix is one row."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("k", "t", "x"))), lambda s: s["x"])
    return feat.groupBy("clip_id").agg((F.max("k") + 1).alias("n_rows"), v.alias("v"))


def feat_of_frames(frames: DataFrame) -> DataFrame:
    return frames.select("clip_id", "t", F.posexplode("v").alias("k", "x")).select("clip_id", "t", F.col("k").cast("bigint").alias("k"), "x")


def stft(signals: DataFrame, config: signal.StftConfig = signal.StftConfig()) -> DataFrame:
    return over_signals(signals, lambda y, sr: signal.stft(y, config), "spectrum")


def istft(spectra: DataFrame, config: signal.StftConfig = signal.StftConfig(), sr: int = 22050, length: int | None = None) -> DataFrame:
    """signal(clip_id, sr, y) of spectra(clip_id, t, re, im); a clip's frames meet in one task."""
    grouped = spectra.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("t", "re", "im"))).alias("f"))

    def run(batches):
        for b in batches:
            for clip, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.array([np.array(x["re"]) + 1j * np.array(x["im"]) for x in f]).T
                yield pa.RecordBatch.from_pydict(_signal(clip, signal.istft(m, config, length), sr))

    return grouped.mapInArrow(run, SIGNAL)


def melspectrogram(signals: DataFrame, n_fft: int = 2048, hop_length: int = 512, n_mels: int = 128) -> DataFrame:
    return over_signals(signals, lambda y, sr: tonal.mel_power(y, sr, n_fft, hop_length, n_mels), "frames")


def mfcc(signals: DataFrame, n_mfcc: int = 20, n_fft: int = 2048, hop_length: int = 512, n_mels: int = 128) -> DataFrame:
    """Transform, filterbank, decibels and cosine transform in one pass over each clip."""
    return over_signals(signals, lambda y, sr: tonal.mfcc(y, sr, n_mfcc, n_fft, hop_length, n_mels), "frames")


def chroma_cqt(signals: DataFrame, **options) -> DataFrame:
    return over_signals(signals, lambda y, sr: tonal.chroma_cqt(y, sr, **options), "frames")


def cqt(signals: DataFrame, **options) -> DataFrame:
    return over_signals(signals, lambda y, sr: tonal.cqt(y, sr, **options), "spectrum")


def yin(signals: DataFrame, **options) -> DataFrame:
    """feat with one row a frame: v holds the frequency."""
    return over_signals(signals, lambda y, sr: tonal.yin(y, sr, **options)[None], "frames")


def pyin(signals: DataFrame, **options) -> DataFrame:
    """v holds frequency, voiced (0 or 1) and probability."""
    return over_signals(signals, lambda y, sr: np.stack([np.asarray(a, float) for a in tonal.pyin(y, sr, **options)]), "frames")


def beat_track(signals: DataFrame, **options) -> DataFrame:
    return over_signals(signals, lambda y, sr: rhythm.beat_track(y, sr, **options)[1], "marks")


def hpss(signals: DataFrame, config: signal.StftConfig = signal.StftConfig(), part: int = 0, **options) -> DataFrame:
    """The harmonic (0) or percussive (1) part of each clip."""
    return over_signals(signals, lambda y, sr: signal.istft(signal.hpss(signal.stft(y, config), **options)[part], config, len(y)), "signal")


def dtw(pairs: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(clip_id, step, i, j, cost): the path, and the cost of all of it."""

    def fn(a, b):
        cost, path = sequences.dtw(a, b, metric)
        return [(n, i, j, cost) for n, (i, j) in enumerate(path)]

    return over_pairs(pairs, fn, "clip_id long, step long, i long, j long, cost double")
