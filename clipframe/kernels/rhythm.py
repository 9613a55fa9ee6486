"""Onset envelopes, tempo and beats of one signal."""

from __future__ import annotations

import math

import numpy as np

from ..plans import bases
from .signal import StftConfig, autocorrelate, stft


def _flux(mag: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(mag, axis=1, prepend=0.0), 0.0)


def onset_strength(y, n_fft: int = 2048, hop_length: int = 512) -> np.ndarray:
    """Sum of the rises of all magnitudes; the first frame rises from nothing."""
    return _flux(np.abs(stft(y, StftConfig.of(n_fft, hop_length)))).sum(0) if len(y) else np.zeros(0)


def onset_strength_multi(y, sr: float, n_fft: int, hop_length: int, bands) -> np.ndarray:
    """The same in bands of (low, high) Hz, half open in bins."""
    rise = _flux(np.abs(stft(y, StftConfig.of(n_fft, hop_length))))
    edge = lambda f: min(max(math.floor(f * n_fft / sr + 0.5), 0), len(rise))
    return np.stack([rise[edge(a) : max(edge(a), edge(b))].sum(0) for a, b in bands]) if len(bands) else np.zeros((0, rise.shape[1]))


def onset_detect(y, n_fft: int = 2048, hop_length: int = 512, threshold: float = 0.1) -> np.ndarray:
    e = onset_strength(y, n_fft, hop_length)
    return np.flatnonzero((e[1:-1] > threshold) & (e[1:-1] >= e[:-2]) & (e[1:-1] > e[2:])) + 1 if len(e) > 2 else np.zeros(0, int)


def onset_backtrack(envelope, events, search_range: int) -> np.ndarray:
    """Each event moved back to the earliest lowest frame within the range, if one is lower."""
    e = np.asarray(envelope, float)
    out = []
    for i in events:
        if i < len(e):
            a = max(0, i - search_range)
            j = a + int(e[a : i + 1].argmin())
            i = j if e[j] < e[i] else i
        out.append(int(i))
    return np.array(out, int)


def tempogram(envelope, win_length: int) -> np.ndarray:
    """(lags, windows): plain autocorrelation of every whole window."""
    e = np.asarray(envelope, float)
    if not len(e) or win_length <= 0:
        return np.zeros((0, 0))
    if len(e) < win_length:
        return np.zeros((min(win_length, len(e)), 0))
    w = np.lib.stride_tricks.sliding_window_view(e, win_length)
    size = bases.next_pow2(2 * win_length)
    return np.fft.irfft(np.abs(np.fft.rfft(w, size, axis=1)) ** 2, size, axis=1)[:, :win_length].T


def fourier_tempogram(envelope, win_length: int) -> np.ndarray:
    e = np.asarray(envelope, float)
    if win_length <= 0 or len(e) < win_length:
        return np.zeros((0, 0))
    taps = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(win_length) / max(win_length - 1, 1))
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(e, win_length) * taps, bases.next_pow2(win_length), axis=1)).T


def tempogram_ratio(gram) -> np.ndarray:
    gram = np.asarray(gram, float)
    mean = gram.mean(1, keepdims=True) if gram.size else gram
    return np.divide(gram, mean, out=np.zeros_like(gram), where=mean > 1e-10) if gram.size else gram


def _best_lag(envelope, first: int, stop: int, otherwise: int) -> int:
    """Lag of the highest positive autocorrelation, the smallest of equals."""
    corr = autocorrelate(envelope)[first:stop]
    return first + int(corr.argmax()) if len(corr) and corr.max() > 0 else otherwise


def tempo(y, sr: int, n_fft: int = 2048, hop_length: int = 512) -> float:
    return envelope_tempo(onset_strength(y, n_fft, hop_length), sr, hop_length)


def envelope_tempo(envelope, sr: int, hop_length: int) -> float:
    """BPM of the best lag from a quarter of a second (240 BPM) to a second (60 BPM); 0 if there is none."""
    if len(envelope) < 3 or hop_length <= 0 or sr <= 0:
        return 0.0
    lag = _best_lag(envelope, int(max(sr / hop_length / 4.0, 1.0)), min(len(envelope), max(sr // hop_length, 1)), 0)
    return 60.0 * sr / (lag * hop_length) if lag else 0.0


def beat_tempo(envelope, sr: int, hop_length: int, start_bpm: float | None = None) -> float:
    if len(envelope) < 3:
        return 120.0 if start_bpm is None else start_bpm
    first = max(sr // hop_length // 4, 1)
    lag = _best_lag(envelope, first, min(2 * sr // hop_length, len(envelope) // 2), first)
    return min(max(60.0 * sr / (lag * hop_length), 30.0), 300.0)


def find_beats(envelope, bpm: float, sr: int, hop_length: int) -> np.ndarray:
    """The first peak, then the highest frame around each whole period from it, if it has a tenth of the maximum."""
    e = np.asarray(envelope, float)
    period = math.floor(60.0 * sr / (bpm * hop_length) + 0.5)
    if not len(e) or not period:
        return np.zeros(0, int)
    half = period // 2
    head = e[:half]
    first = int(head.argmax()) if len(head) and head.max() > 0 else 0
    beats = [first]
    for at in range(first + period, len(e), period):
        a = max(at - half, 0)
        own = e[a : min(at + half, len(e))]
        if len(own) and own.max() > 0 and own.max() > 0.1 * max(e.max(), 0.0):
            beats.append(a + int(own.argmax()))
    return np.array(beats, int)


def beat_track(y, sr: int, envelope=None, hop_length: int = 512, start_bpm: float | None = None) -> tuple[float, np.ndarray]:
    e = np.asarray(onset_strength(y, 2048, hop_length) if envelope is None else envelope, float)
    if len(e) < 2:
        return 120.0, np.zeros(0, int)
    bpm = beat_tempo(e, sr, hop_length, start_bpm)
    return bpm, find_beats(e, bpm, sr, hop_length)


def plp(y, sr: int, envelope=None, hop_length: int = 512, win_length: int = 384, tempo_min: float = 30.0, tempo_max: float = 300.0) -> np.ndarray:
    """Predominant local pulse: the envelope weighted by the strongest tempo around each frame, smoothed, at most 1.

    The tempo axis is that of the window length, though the transform has the next power of two.
    """
    e = np.asarray(onset_strength(y, 2048, hop_length) if envelope is None else envelope, float)
    if not len(e) or win_length <= 0:
        return np.zeros(0)
    unit = lambda v: v / v.max() if v.max() > 0 else v
    gram = fourier_tempogram(e, win_length)
    if not gram.size:
        return unit(e)
    bpm = np.arange(len(gram)) * sr * 60.0 / (hop_length * win_length)
    inside = np.where(((bpm >= tempo_min) & (bpm <= tempo_max))[:, None], gram, 0.0)
    inside[0] = np.where(inside.argmax(0) == 0, 0.0, inside[0])
    top = inside.max(0)
    pulse = np.zeros(len(e))
    at = np.arange(len(top)) + win_length // 2
    fits = (at < len(e)) & (inside.argmax(0) > 0)
    pulse[at[fits]] = e[at[fits]] * top[fits]
    sums = np.concatenate([[0.0], np.cumsum(unit(pulse))])
    i = np.arange(len(e))
    a, b = np.maximum(i - 3, 0), np.minimum(i + 4, len(e))
    return unit((sums[b] - sums[a]) / (b - a))


def peak_pick(x, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float, wait: int) -> np.ndarray:
    """Strict maxima of a window that exceed the mean of the others, at least ``wait`` apart (also from the start)."""
    x = np.asarray(x, float)
    out, last = [], 0
    for i, v in enumerate(x):
        if wait > 0 and i < last + wait:
            continue
        near = np.delete(x[max(i - pre_max, 0) : i + post_max + 1], min(i, pre_max))
        rest = np.delete(x[max(i - pre_avg, 0) : i + post_avg + 1], min(i, pre_avg))
        if (near < v).all() and v >= (rest.mean() if len(rest) else 0.0) + delta:
            out.append(i)
            last = i
    return np.array(out, int)
