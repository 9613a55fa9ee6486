"""Filterbanks, bases and frequency grids."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.scales import MEL_BREAK, MEL_BREAK_HZ, MEL_HZ, MEL_LOG_STEP
from . import windows


def next_pow2(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def expand_to(length: int, min_length: int | None = None) -> int:
    """Next power of two of the larger of both; 0 gives 1."""
    return next_pow2(max(length, min_length or 0))


def hz_to_mel(f, htk: bool = False):
    f = np.asarray(f, float)
    if htk:
        return 2595.0 * np.log10(1.0 + f / 700.0)
    return np.where(f >= MEL_BREAK_HZ, MEL_BREAK + np.log(np.maximum(f, 1e-300) / MEL_BREAK_HZ) / MEL_LOG_STEP, f / MEL_HZ)


def mel_to_hz(m, htk: bool = False):
    m = np.asarray(m, float)
    if htk:
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    return np.where(m >= MEL_BREAK, MEL_BREAK_HZ * np.exp((m - MEL_BREAK) * MEL_LOG_STEP), m * MEL_HZ)


def mel_frequencies(n_mels: int, fmin: float, fmax: float, htk: bool = False) -> np.ndarray:
    if n_mels <= 0:
        return np.zeros(0)
    return mel_to_hz(np.linspace(hz_to_mel(max(fmin, 0.0), htk), hz_to_mel(fmax, htk), n_mels), htk)


def fft_frequencies(sr: float, n_fft: int) -> np.ndarray:
    return np.arange(n_fft // 2 + 1) * sr / n_fft if n_fft else np.zeros(0)


def cqt_frequencies(n_bins: int, fmin: float, bins_per_octave: int = 12, tuning: float = 0.0) -> np.ndarray:
    return fmin * 2.0 ** ((np.arange(n_bins) + tuning) / bins_per_octave)


def tempo_frequencies(sr: float, hop_length: int, win_length: int) -> np.ndarray:
    """BPM of win_length // 2 + 1 bins of a transform of the window itself."""
    return np.arange(win_length // 2 + 1) * sr * 60.0 / (hop_length * win_length) if win_length else np.zeros(0)


fourier_tempo_frequencies = tempo_frequencies


def tempogram_frequencies(n_bins: int, sr: float, hop_length: int, win_length: int) -> np.ndarray:
    """BPM of the bins of a Fourier tempogram, whose transform has the next power of two."""
    return np.arange(n_bins) * sr * 60.0 / (hop_length * next_pow2(win_length)) if win_length else np.zeros(0)


@functools.lru_cache(64)
def mel_filterbank(sr: float, n_fft: int, n_mels: int, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """Triangles of unit area, evenly spaced in mel: (n_mels, n_fft // 2 + 1)."""
    edges = mel_frequencies(n_mels + 2, fmin, min(fmax or sr / 2.0, sr / 2.0))
    f = fft_frequencies(sr, n_fft)
    low, mid, high = (edges[i : n_mels + i, None] for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        tri = np.minimum((f - low) / (mid - low), (high - f) / (high - mid))
        out = np.maximum(np.nan_to_num(tri), 0.0) * 2.0 / (high - low)
    return np.nan_to_num(out, posinf=0.0)


@functools.lru_cache(64)
def chroma_filterbank(sr: float, n_fft: int, n_chroma: int = 12, tuning: float = 0.0, ctroct: float = 5.0, octwidth: float | None = None, base_c: bool = True) -> np.ndarray:
    """Gaussian bumps around each pitch class, unit columns, octaves weighted around ctroct: (n_chroma, bins)."""
    if n_fft <= 0 or n_chroma <= 0:
        return np.zeros((n_chroma, n_fft // 2 + 1))
    f = np.arange(1, n_fft) * sr / n_fft
    place = n_chroma * np.log2(f / (440.0 * 2.0 ** (tuning / n_chroma) / 16.0))
    place = np.concatenate([place[:1] - 1.5 * n_chroma, place]) if len(place) else np.zeros(1)
    width = np.append(np.maximum(np.diff(place), 1.0), 1.0)
    bins = n_fft // 2 + 1
    half = math.floor(n_chroma / 2.0 + 0.5)
    d = np.fmod(place[None, :bins] - np.arange(n_chroma)[:, None] + half + 10.0 * n_chroma, n_chroma) - half
    w = np.exp(-0.5 * (2.0 * d / width[:bins]) ** 2)
    w = w / np.maximum(np.sqrt((w * w).sum(0)), 1e-10)
    if octwidth is not None:
        w = w * np.exp(-0.5 * ((place[:bins] / n_chroma - ctroct) / octwidth) ** 2)
    return np.roll(w, -3 * (n_chroma // 12), 0) if base_c else w


@functools.lru_cache(64)
def cq_to_chroma(n_input: int, bins_per_octave: int, n_chroma: int = 12, fmin: float = 32.70, base_c: bool = True) -> np.ndarray:
    """(n_chroma, n_input) matrix that folds constant-Q bins to pitch classes.

    If the bins of an octave aren't a multiple of n_chroma, each of the first bins stands for itself.
    """
    out = np.zeros((n_chroma, n_input))
    if min(n_input, bins_per_octave, n_chroma) == 0:
        return out
    merge, odd = divmod(bins_per_octave, n_chroma)
    if odd or not merge:
        n = min(n_input, n_chroma)
        out[np.arange(n), np.arange(n)] = 1.0
        return out
    b = np.arange(n_input) % bins_per_octave
    row = (b + merge // 2) % bins_per_octave // merge
    midi = (12.0 * math.log2(fmin / 440.0) + 69.0) % 12.0
    turn = (midi if base_c else midi - 9.0) * n_chroma / 12.0
    turn = int(math.copysign(math.floor(abs(turn) + 0.5), turn))
    out[(row + turn) % n_chroma, np.arange(n_input)] = 1.0
    return out


def tonnetz_basis() -> np.ndarray:
    """(6, 12): cosine and sine of fifths, minor thirds and major thirds; the last with radius one half."""
    c = np.arange(12)
    return np.concatenate([[r * np.cos(2 * np.pi * s * c / 12.0), r * np.sin(2 * np.pi * s * c / 12.0)] for s, r in ((7, 1.0), (3, 1.0), (4, 0.5))])


def dct_basis(n_in: int, n_out: int) -> np.ndarray:
    """Orthonormal DCT-II: (n_out, n_in); its transpose is the inverse."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    scale = np.where(k == 0, math.sqrt(1.0 / max(n_in, 1)), math.sqrt(2.0 / max(n_in, 1)))
    return scale * np.cos(np.pi * k * (2 * i + 1) / (2.0 * max(n_in, 1)))


def mr_frequencies(tuning: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Centre frequencies of MIDI 24 to 108 and the sample rates at which each is filtered."""
    midi = np.arange(24, 109) + tuning
    return 440.0 * 2.0 ** ((midi - 69.0) / 12.0), np.repeat([882.0, 4410.0, 22050.0], [36, 34, 15])


def relative_bandwidth(freqs) -> np.ndarray:
    if len(freqs) <= 1:
        return np.zeros(1)
    logs = np.log2(freqs)
    bins = np.concatenate([[1.0 / (logs[1] - logs[0])], 2.0 / (logs[2:] - logs[:-2]), [1.0 / (logs[-1] - logs[-2])]])
    r = 2.0 ** (2.0 / bins)
    return (r - 1.0) / (r + 1.0)


def wavelet_lengths(freqs, sr: float, window: str = "hann", filter_scale: float = 1.0, gamma: float | None = 0.0, alpha=None) -> tuple[np.ndarray, float]:
    """(lengths in samples, highest cutoff) of wavelets; gamma None takes the bandwidth of hearing."""
    freqs = np.asarray(freqs, float)
    if not len(freqs) or filter_scale <= 0:
        raise ValueError("frequencies and a positive filter_scale are needed")
    a = relative_bandwidth(freqs) if alpha is None else np.asarray(alpha, float)
    g = a * 24.7 / 0.108 if gamma is None else np.full(len(freqs), float(gamma))
    with np.errstate(divide="ignore", invalid="ignore"):
        q = filter_scale / a
        cutoff = freqs * (1.0 + 0.5 * windows.window_bandwidth(window) / q) + 0.5 * g
        return q * sr / (freqs + g / a), float(max(0.0, cutoff.max()))


def _atoms(freqs, lengths, sr: float, window: str, pad_fft: bool, norm: str) -> np.ndarray:
    longest = math.ceil(lengths.max())
    out = np.zeros((len(freqs), next_pow2(longest) if pad_fft else longest), complex)
    for row, f, length in zip(out, freqs, lengths):
        n, half = math.ceil(length), int(length / 2.0)
        j = np.arange(-half, half + 1)[:n]
        atom = np.zeros(n, complex)
        atom[: len(j)] = np.exp(2j * np.pi * f / sr * j)
        atom *= windows.get_window(window, n)
        size = {"l1": lambda x: x.sum(), "l2": lambda x: math.sqrt((x * x).sum()), "max": lambda x: x.max()}[norm](np.abs(atom))
        left = (out.shape[1] - n) // 2
        row[left : left + n] = atom / size if size > 1e-10 else atom
    return out


def wavelet(freqs, sr: float, window: str = "hann", filter_scale: float = 1.0, pad_fft: bool = True, norm: str = "l1", gamma: float | None = 0.0, alpha=None) -> tuple[np.ndarray, np.ndarray]:
    """(windowed complex sinusoids, their lengths)."""
    lengths, _ = wavelet_lengths(freqs, sr, window, filter_scale, gamma, alpha)
    return _atoms(freqs, lengths, sr, window, pad_fft, norm), lengths


def constant_q_lengths(sr: float, fmin: float | None = None, n_bins: int = 84, bins_per_octave: int = 12, window: str = "hann", filter_scale: float = 1.0, gamma: float = 0.0) -> np.ndarray:
    fmin = 32.7 if fmin is None else fmin
    if min(sr, fmin, bins_per_octave, filter_scale, n_bins) <= 0:
        raise ValueError("sr, fmin, bins_per_octave, filter_scale and n_bins must be positive")
    freqs = cqt_frequencies(n_bins, fmin, bins_per_octave)
    r = 2.0 ** (2.0 / bins_per_octave)
    alpha = (r - 1.0) / (r + 1.0)
    if freqs[-1] * (1.0 + 0.5 * windows.window_bandwidth(window) * alpha / filter_scale) > sr / 2.0:
        raise ValueError("the highest filter exceeds the Nyquist frequency")
    return filter_scale / alpha * sr / (freqs + gamma / alpha)


def constant_q(sr: float, fmin: float | None = None, n_bins: int = 84, bins_per_octave: int = 12, window: str = "hann", filter_scale: float = 1.0, pad_fft: bool = True, norm: str = "l1", gamma: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(constant-Q kernels, their lengths)."""
    lengths = constant_q_lengths(sr, fmin, n_bins, bins_per_octave, window, filter_scale, gamma)
    return _atoms(cqt_frequencies(n_bins, 32.7 if fmin is None else fmin, bins_per_octave), lengths, sr, window, pad_fft, norm), lengths


def bandpass(center: float, bandwidth: float, sr: float) -> np.ndarray:
    """Second-order band-pass section (b0, b1, b2, 1, a1, a2) with unit peak gain."""
    w = 2.0 * math.pi * center / sr
    a = math.sin(w) * bandwidth / (2.0 * center)
    return np.array([a, 0.0, -a, 1.0 + a, -2.0 * math.cos(w), 1.0 - a]) / (1.0 + a)


def sos_bandpass(center: float, bandwidth: float, sr: float, order: int = 1) -> np.ndarray:
    """``order`` equal sections; the bandwidth is at least 1 Hz."""
    return np.tile(bandpass(center, max(bandwidth, 1.0), sr), (max(order, 1), 1))


def semitone_filterbank(center_freqs=None, tuning: float = 0.0, sample_rates=None, q: float = 25.0, order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """(sections of each filter, sample rates)."""
    freqs, rates = mr_frequencies(tuning) if center_freqs is None or sample_rates is None else (np.asarray(center_freqs), np.asarray(sample_rates))
    if len(freqs) != len(rates):
        raise ValueError("a sample rate is needed for each frequency")
    return [np.tile(bandpass(f, f / q, sr), (order, 1)) for f, sr in zip(freqs, rates)], rates


def contrast_bands(sr: float, n_fft: int, n_bands: int, fmin: float) -> list[tuple[int, int, int, int]]:
    """(band, first bin, last bin, bins averaged at either end) of each octave band that has bins.

    A band but the first starts one bin lower, the last goes up to the Nyquist frequency, and the others lose their
    top bin, which still counts for the number averaged.
    """
    f = fft_frequencies(sr, n_fft)
    edges = np.concatenate([[0.0], fmin * 2.0 ** np.arange(n_bands + 1)])
    out = []
    for k in range(n_bands + 1):
        own = np.flatnonzero((f >= edges[k]) & (f <= edges[k + 1]))
        if not len(own):
            continue
        first = own[0] - 1 if k and own[0] else own[0]
        last = len(f) - 1 if k == n_bands else own[-1]
        q = max(1, math.floor(0.02 * (last - first + 1) + 0.5))
        out.append((k, int(first), int(last if k == n_bands else last - 1), q))
    return out


def long_table(spark: SparkSession, matrix: np.ndarray, row: str, col: str, value: str, keep_zeros: bool = False) -> DataFrame:
    """A parameter matrix as rows (row, col, value); zeros are left out unless wanted.  Its size depends on parameters alone."""
    import pyarrow as pa

    i, j = np.nonzero(np.ones_like(matrix, bool) if keep_zeros else matrix)
    return spark.createDataFrame(pa.table({row: pa.array(i, pa.int64()), col: pa.array(j, pa.int64()), value: pa.array(matrix[i, j].astype(float))}))
