"""Constant-Q transforms, chroma and pitch of one signal or matrix."""

from __future__ import annotations

import math

import numpy as np

from ..plans import bases, windows
from .signal import StftConfig, centred, checked, frame, frame_padded, griffinlim, stft, to_db


def mel_power(y, sr: float, n_fft: int = 2048, hop_length: int = 512, n_mels: int = 128) -> np.ndarray:
    return bases.mel_filterbank(sr, n_fft, n_mels) @ np.abs(stft(y, StftConfig.of(n_fft, hop_length))) ** 2


def mfcc(y, sr: float, n_mfcc: int = 20, n_fft: int = 2048, hop_length: int = 512, n_mels: int = 128) -> np.ndarray:
    """Cepstra of mel power in decibels; the floor of 80 dB is that of each frame."""
    db = to_db(mel_power(y, sr, n_fft, hop_length, n_mels), top_db=None)
    return bases.dct_basis(n_mels, n_mfcc) @ np.maximum(db, db.max(0, initial=-np.inf) - 80.0)


def mel_to_stft(mel, sr: float, n_fft: int, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    return bases.mel_filterbank(sr, n_fft, len(mel), fmin, fmax).T @ np.asarray(mel, float)


def mel_to_audio(mel, sr: float, n_fft: int = 2048, hop_length: int = 512, fmin: float = 0.0, fmax: float | None = None, n_iter: int = 32, length: int | None = None, seed: int = 0) -> np.ndarray:
    return griffinlim(mel_to_stft(mel, sr, n_fft, fmin, fmax), StftConfig.of(n_fft, hop_length), n_iter, length, 0.99, seed)


def mfcc_to_mel(cepstra, n_mels: int = 128) -> np.ndarray:
    return 10.0 ** (bases.dct_basis(n_mels, len(cepstra)).T @ np.asarray(cepstra, float) / 10.0)


def mfcc_to_audio(cepstra, n_mels: int, sr: float, n_fft: int = 2048, hop_length: int = 512, fmin: float = 0.0, fmax: float | None = None, n_iter: int = 32, length: int | None = None, seed: int = 0) -> np.ndarray:
    return mel_to_audio(mfcc_to_mel(cepstra, n_mels), sr, n_fft, hop_length, fmin, fmax, n_iter, length, seed)


def spectral_contrast(y, sr: float, n_fft: int = 2048, hop_length: int = 512, n_bands: int = 6, fmin: float = 200.0) -> np.ndarray:
    """Peaks over valleys of octave bands in decibels, floored 80 dB below the highest peak of the signal."""
    if n_bands <= 0 or n_fft <= 0 or fmin <= 0:
        raise ValueError("n_bands, n_fft and fmin must be positive")
    mag = np.abs(stft(y, StftConfig.of(n_fft, max(hop_length, 1))))
    if sr / 2.0 <= fmin or not mag.size:
        return np.zeros((0, 0))
    peak, valley = np.zeros((2, n_bands + 1, mag.shape[1]))
    for k, first, last, q in bases.contrast_bands(sr, n_fft, n_bands, fmin):
        own = np.sort(mag[first : last + 1], 0)
        valley[k], peak[k] = own[:q].sum(0) / q, own[::-1][:q].sum(0) / q
    peak, valley = (10.0 * np.log10(np.maximum(x, 1e-10)) for x in (peak, valley))
    low = peak.max() - 80.0
    return np.maximum(peak, low) - np.maximum(valley, low)


def chroma_stft(y, sr: float, n_fft: int = 2048, hop_length: int = 512, n_chroma: int = 12, tuning: float = 0.0, octwidth: float | None = 2.0) -> np.ndarray:
    raw = bases.chroma_filterbank(sr, n_fft, n_chroma, tuning, 5.0, octwidth, True) @ np.abs(stft(y, StftConfig.of(n_fft, hop_length))) ** 2
    return normalized(raw, -1)


def normalized(x: np.ndarray, norm: int, axis: int = 0) -> np.ndarray:
    """By sum (1), length (2) or maximum (-1) along an axis; near-zero columns and other norms stay."""
    size = {1: lambda v: np.abs(v).sum(axis, keepdims=True), 2: lambda v: np.sqrt((v * v).sum(axis, keepdims=True)), -1: lambda v: np.abs(v).max(axis, keepdims=True, initial=0.0)}.get(norm)
    if size is None:
        return x
    s = size(x)
    return np.divide(x, s, out=x.copy(), where=s > 1e-10)


def estimate_tuning_cents(chroma, resolution: float = 1.0, bins_per_octave: int = 12) -> float:
    """Shift in cents, of -50 to 50, at which the interpolated chroma has most energy; the first of equals."""
    chroma = np.asarray(chroma, float)
    if not chroma.size:
        return 0.0
    n, best = len(chroma), (-math.inf, 0.0)
    for i in range(int(100.0 / resolution) + 1):
        cents = -50.0 + i * resolution
        at = (np.arange(n) + cents / 100.0 * bins_per_octave / 12.0) % n
        low = np.floor(at).astype(int) % n
        part = (at - np.floor(at))[:, None]
        score = float(((chroma[low] * (1 - part) + chroma[(low + 1) % n] * part) ** 2).sum())
        if score > best[0]:
            best = score, cents
    return best[1]


def tonnetz(chroma) -> np.ndarray:
    chroma = np.asarray(chroma, float)
    if len(chroma) != 12:
        return np.zeros((6, chroma.shape[1]))
    total = chroma.sum(0)
    return bases.tonnetz_basis() @ np.divide(chroma, total, out=np.zeros_like(chroma), where=total > 1e-10)


def vqt_plan(sr: float, fmin: float, n_bins: int, bins_per_octave: int, tuning: float, filter_scale: float, gamma: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(transform size, lower bin, part, scale) of each output bin."""
    if n_bins <= 0 or bins_per_octave <= 0:
        raise ValueError("n_bins and bins_per_octave must be positive")
    freqs = bases.cqt_frequencies(n_bins, fmin, bins_per_octave, tuning)
    q = filter_scale / (2.0 ** (1.0 / bins_per_octave) - 1.0)
    lengths = np.maximum(np.ceil(sr / (freqs / q + gamma) * filter_scale), 1.0)
    n_fft = max(bases.next_pow2(int(lengths.max())), 512)
    at = freqs * n_fft / sr
    low = np.floor(at).astype(int)
    return n_fft, low, at - low, np.where(low < n_fft // 2, np.sqrt(n_fft / lengths), 0.0)


def vqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_bins: int = 84, bins_per_octave: int = 12, tuning: float = 0.0, filter_scale: float = 1.0, gamma: float = 0.0) -> np.ndarray:
    """One transform of each frame, read between its bins at the wanted frequencies."""
    y = checked(y)
    n_fft, low, part, scale = vqt_plan(sr, fmin, n_bins, bins_per_octave, tuning, filter_scale, gamma)
    n = (len(y) - n_fft // 2) // hop_length + 1 if len(y) > n_fft // 2 else 1
    taps = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / (n_fft - 1))
    spec = np.fft.rfft(frame(np.pad(y, (0, max(0, (n - 1) * hop_length + n_fft - len(y)))), n_fft, hop_length)[:n] * taps, axis=1)
    top = n_fft // 2
    mixed = spec[:, np.minimum(low, top)] * (1.0 - part) + spec[:, np.minimum(low + 1, top)] * part
    return (mixed * scale).T


def cqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_bins: int = 84, bins_per_octave: int = 12, tuning: float = 0.0, filter_scale: float = 1.0) -> np.ndarray:
    return vqt(y, sr, hop_length, fmin, n_bins, bins_per_octave, tuning, filter_scale, 0.0)


def pseudo_cqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_bins: int = 84, bins_per_octave: int = 12) -> np.ndarray:
    return cqt(y, sr, hop_length, fmin, n_bins, bins_per_octave)


def hybrid_cqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_bins: int = 84, bins_per_octave: int = 12) -> np.ndarray:
    return cqt(y, sr, hop_length, fmin, n_bins, bins_per_octave)


def icqt(spec, sr: float, hop_length: int = 512, fmin: float = 32.70, bins_per_octave: int = 12, n_iter: int = 16) -> np.ndarray:
    """Signal of a constant-Q spectrum: a faint sine as start, then rounds with the wanted magnitudes and found phases."""
    spec = np.asarray(spec)
    if not spec.size:
        raise ValueError("the spectrum is empty")
    n_bins, n = spec.shape
    size = (n + 1) * hop_length
    freqs = bases.cqt_frequencies(n_bins, fmin, bins_per_octave)
    q = 1.0 / (2.0 ** (1.0 / bins_per_octave) - 1.0)
    n_fft = max(bases.next_pow2(math.ceil(sr * q / freqs[0])), 512)
    bins = np.floor(freqs * n_fft / sr + 0.5).astype(int)
    inside = bins < n_fft // 2
    taps = windows.hann(n_fft)
    y = 0.01 * np.sin(0.001 * np.arange(size))
    for _ in range(n_iter):
        found = cqt(y, sr, hop_length, fmin, n_bins, bins_per_octave)
        m = min(n, found.shape[1])
        new = np.abs(spec[:, :m]) * np.exp(1j * np.angle(found[:, :m]))
        full = np.zeros((m, n_fft), complex)
        for b, row in zip(bins[inside], new[inside]):  # of two bins at one place the higher stays
            full[:, b] = row
            if b:
                full[:, n_fft - b] = row.conj()
        parts = np.fft.ifft(full, axis=1).real * taps
        out, norm = np.zeros((2, size + n_fft))
        at = (np.arange(m) * hop_length)[:, None] + np.arange(n_fft)
        np.add.at(out, at, parts)
        np.add.at(norm, at, np.broadcast_to(taps**2, at.shape))
        y = np.divide(out, norm, out=out, where=norm > 1e-8)[:size]
    return y


def griffinlim_cqt(mag, sr: float, hop_length: int = 512, fmin: float = 32.70, bins_per_octave: int = 12, n_iter: int = 16) -> np.ndarray:
    return icqt(np.asarray(mag, float).astype(complex), sr, hop_length, fmin, bins_per_octave, n_iter)


def _folded(x: np.ndarray, threshold: float, norm: int) -> np.ndarray:
    return normalized(np.where(x < threshold, 0.0, x) if threshold > 0 else x, norm)


def chroma_cqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_chroma: int = 12, n_octaves: int = 7, bins_per_octave: int = 36, tuning: float = 0.0, norm: int = -1, threshold: float = 0.0, cqt_mode: str = "full") -> np.ndarray:
    n = n_octaves * bins_per_octave
    spec = hybrid_cqt(y, sr, hop_length, fmin, n, bins_per_octave) if cqt_mode == "hybrid" else cqt(y, sr, hop_length, fmin, n, bins_per_octave, tuning)
    return _folded(bases.cq_to_chroma(n, bins_per_octave, n_chroma, fmin, True) @ np.abs(spec), threshold, norm)


def chroma_cens(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_chroma: int = 12, n_octaves: int = 7, bins_per_octave: int = 36, tuning: float = 0.0, win_len_smooth: int = 41, cqt_mode: str = "full") -> np.ndarray:
    """Quantised, smoothed and normalised chroma."""
    c = chroma_cqt(y, sr, hop_length, fmin, n_chroma, n_octaves, bins_per_octave, tuning, 1, 0.0, cqt_mode)
    c = 0.25 * sum((c > step).astype(float) for step in (0.4, 0.2, 0.1, 0.05))
    if win_len_smooth > 0:
        w = windows.hann(win_len_smooth)
        half = win_len_smooth // 2
        padded = np.pad(c, ((0, 0), (half, win_len_smooth)))
        c = np.lib.stride_tricks.sliding_window_view(padded, win_len_smooth, axis=1)[:, : c.shape[1]] @ w / w.sum()
    return normalized(c, 2)


def chroma_vqt(y, sr: float, hop_length: int = 512, fmin: float = 32.70, n_octaves: int = 7, bins_per_octave: int = 12, tuning: float = 0.0, gamma: float = 0.0, norm: int = -1, threshold: float = 0.0) -> np.ndarray:
    spec = np.abs(vqt(y, sr, hop_length, fmin, n_octaves * bins_per_octave, bins_per_octave, tuning, 1.0, gamma))
    return _folded(spec.reshape(n_octaves, bins_per_octave, -1).sum(0), threshold, norm)


def _cmndf(frames: np.ndarray, n_tau: int) -> np.ndarray:
    """Cumulative mean normalised difference of each frame, lags 0 .. n_tau - 1."""
    n = frames.shape[1]
    size = bases.next_pow2(2 * n)
    corr = np.fft.irfft(np.abs(np.fft.rfft(frames, size, axis=1)) ** 2, size, axis=1)[:, :n_tau]
    power = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, 1)], 1)
    tau = np.arange(n_tau)
    d = np.maximum(power[:, n - tau] + power[:, [n]] - power[:, tau] - 2.0 * corr, 0.0)
    d[d < 1e-12 * power[:, [n]]] = 0.0  # rounding of the transform
    total = np.cumsum(np.where(tau > 0, d, 0.0), 1)
    out = np.ones_like(d)
    return np.divide(d * tau, total, out=out, where=(total > 0) & (tau > 0))


def _parabola(a, b, c):
    """Offset of the extremum through three equidistant values; NaN or infinite if they are in line."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 0.5 * (a - c) / (a - 2.0 * b + c)


def yin(y, sr: float, frame_length: int = 2048, hop_length: int = 512, fmin: float = 40.0, fmax: float | None = None, threshold: float = 0.1) -> np.ndarray:
    """Fundamental frequency of each uncentred frame; 0 where there is none.

    Lags go up to half a frame; a signal shorter than a frame is one short frame.
    """
    y = checked(y)
    if frame_length <= 0 or hop_length <= 0:
        raise ValueError("frame and hop lengths must be positive")
    fmax = sr / 4.0 if fmax is None else fmax
    frames = frame(y, frame_length, hop_length) if len(y) >= frame_length else y[None]
    low, high = max(int(sr / fmax), 1), int(min(sr / fmin, frame_length / 2))
    if high < 3 or low >= high or frames.shape[1] < high:
        return np.zeros(len(frames))
    c = _cmndf(frames, high)
    dip = np.zeros_like(c, bool)
    dip[:, low : high - 1] = (c[:, low : high - 1] < threshold) & (c[:, low : high - 1] < c[:, low + 1 : high])
    tau = dip.argmax(1)
    row = np.arange(len(c))
    fine = tau + _parabola(c[row, tau - 1], c[row, tau], c[row, np.minimum(tau + 1, high - 1)])
    with np.errstate(divide="ignore", invalid="ignore"):
        f = sr / fine
        return np.where(dip.any(1) & (fine > 0) & (f >= fmin) & (f <= fmax), f, 0.0)


def piptrack(y, sr: float, n_fft: int = 2048, hop_length: int = 512, fmin: float = 150.0, fmax: float = 4000.0, threshold: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitudes) of the spectral peaks above an absolute threshold, 0 elsewhere."""
    mag = np.abs(stft(y, StftConfig.of(n_fft, hop_length)))
    pitch, size = np.zeros((2, *mag.shape))
    n = len(mag)
    if not mag.size or n < 3:
        return pitch, size
    first = min(max(math.ceil(fmin * n_fft / sr), 1), n - 2)
    last = min(max(math.floor(fmax * n_fft / sr), first + 1), n - 2)
    a, b, c = mag[first - 1 : last], mag[first : last + 1], mag[first + 1 : last + 2]
    peak = (b > a) & (b > c) & (b > threshold)
    at = np.arange(first, last + 1)[:, None]
    pitch[first : last + 1][peak] = ((at + _parabola(a, b, c)) * sr / n_fft)[peak]
    size[first : last + 1][peak] = b[peak]
    return pitch, size


def pitch_tuning(freqs, resolution: float = 0.01, bins_per_octave: int = 12) -> float:
    """Most frequent offset from the tuned bins, in bins; of equally frequent ones the last."""
    freqs = np.asarray(freqs, float)
    freqs = freqs[freqs > 0]
    if not len(freqs):
        return 0.0
    off = bins_per_octave * np.log2(freqs / 27.5) % 1.0
    off = np.where(off >= 0.5, off - 1.0, off)
    n = math.ceil(1.0 / resolution) + 1
    count = np.bincount(np.minimum(np.floor((off + 0.5) / resolution).astype(int), n - 1), minlength=n)
    return float((n - 1 - count[::-1].argmax()) * resolution - 0.5)


def estimate_tuning(y, sr: float, n_fft: int = 2048, resolution: float = 0.01, bins_per_octave: int = 12) -> float:
    """Tuning in bins from the louder half of the spectral peaks."""
    if not len(y):
        return 0.0
    pitch, mag = piptrack(y, sr, n_fft, n_fft // 4)
    loud = np.sort(mag[mag > 0])
    return pitch_tuning(pitch[(pitch > 0) & (mag >= loud[len(loud) // 2])], resolution, bins_per_octave) if len(loud) else 0.0


def beta_weights(n: int, a: float, b: float) -> np.ndarray:
    """Probability of each of n equal parts of [0, 1] under a Beta distribution, by Simpson's rule."""

    def cdf(x):
        if x <= 0 or x >= 1:
            return float(x >= 1)
        t = np.linspace(0.0, x, 101)
        f = np.where((t > 0) & (t < 1), np.maximum(t, 1e-300) ** (a - 1) * (1 - t) ** (b - 1), 0.0)
        w = np.ones(101)
        w[1:-1:2], w[2:-1:2] = 4.0, 2.0
        area = float(w @ f) * x / 300.0
        return min(max(area * math.gamma(a + b) / (math.gamma(a) * math.gamma(b)), 0.0), 1.0)

    return np.maximum(np.diff([cdf(i / n) for i in range(n + 1)]), 0.0)


def pyin(y, sr: float, fmin: float = 65.0, fmax: float = 2093.0, frame_length: int = 2048, hop_length: int = 512, n_thresholds: int = 100, beta_params: tuple[float, float] = (2.0, 18.0), resolution: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency or NaN, voiced, probability of voice) of each centred frame, by pitch candidates and a Viterbi path."""
    none = np.zeros(0), np.zeros(0, bool), np.zeros(0)
    fmax = min(fmax, sr / 2.0)
    if not len(y) or frame_length <= 0 or hop_length <= 0 or fmin >= fmax:
        return none
    shortest, longest = math.floor(sr / fmax), min(math.ceil(sr / fmin), frame_length - 1)
    if shortest >= longest or longest == 0:
        return none
    padded = centred(np.asarray(y, float), frame_length)
    if len(padded) < frame_length:
        padded = np.pad(padded, (0, frame_length - len(padded)))
    frames = frame(padded, frame_length, hop_length)
    per_semitone = math.ceil(1.0 / resolution)
    n_bins = math.floor(12.0 * per_semitone * math.log2(fmax / fmin)) + 1
    weights = beta_weights(n_thresholds, *beta_params)
    limits = np.arange(n_thresholds) / n_thresholds
    c = _cmndf(frames, longest)
    obs, voiced = np.zeros((len(frames), 2 * n_bins)), np.zeros(len(frames))
    for t, row in enumerate(c):
        p, voiced[t] = _candidates(row, limits, weights, sr, shortest, fmin, n_bins, per_semitone)
        obs[t, :n_bins], obs[t, n_bins:] = p, (1.0 - voiced[t]) / n_bins
    width = math.floor(35.92 * 12.0 * hop_length / sr + 0.5) * per_semitone + 1
    states = _pitch_path(obs, n_bins, width, 0.01)
    flag = states < n_bins
    return np.where(flag, fmin * 2.0 ** (states % n_bins / (12.0 * per_semitone)), np.nan), flag, voiced


def _candidates(c, limits, weights, sr, shortest, fmin, n_bins, per_semitone) -> tuple[np.ndarray, float]:
    """Pitch probabilities of a frame: each threshold spreads its weight over the dips below it, short lags first."""
    n = len(c)
    i = np.arange(max(shortest, 1), n - 1)
    dips = i[(c[i] < c[i - 1]) & (c[i] < c[i + 1])]
    if shortest < n - 1 and c[shortest] < c[shortest + 1] and (not len(dips) or dips[0] != shortest):
        dips = np.concatenate([[shortest], dips])
    if not len(dips):
        return np.full(n_bins, 0.01 / n_bins), 0.01
    shift = np.zeros(len(dips))
    inner = dips > 0
    move = _parabola(c[dips[inner] - 1], c[dips[inner]], c[dips[inner] + 1])
    shift[inner] = np.where(np.abs(np.nan_to_num(move, nan=9.0, posinf=9.0, neginf=9.0)) <= 1.0, move, 0.0)
    below = c[dips][None, :] < limits[:, None]
    share = np.where(below, np.exp(-2.0 * dips), 0.0)
    total = share.sum(1, keepdims=True)
    mass = (np.divide(share, total, out=np.zeros_like(share), where=total > 0) * weights[:, None]).sum(0)
    tau = dips + shift
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(tau > 0, sr / tau, 0.0)
        at = np.floor(12.0 * per_semitone * np.log2(np.maximum(f, 1e-300) / fmin) + 0.5)
    ok = (f >= fmin) & (at >= 0) & (at < n_bins)
    p = np.bincount(at[ok].astype(int), mass[ok], n_bins)
    if p.sum() <= 0:
        return np.full(n_bins, 1.0 / n_bins), 0.01
    return p / p.sum(), min(max(float(p.sum()), 0.01), 0.99)


def _pitch_path(obs: np.ndarray, n: int, width: int, switch: float) -> np.ndarray:
    """Most probable states; pitch moves are triangular, the transition also applies to the first frame."""
    gap = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    move = np.where(gap <= width, (1.0 - switch) * (1.0 - gap / (width + 1.0)), 1e-10)
    before = np.full(2 * n, 0.5 / n)
    back = np.zeros(obs.shape, int)
    for t, o in enumerate(np.maximum(obs, 1e-10)):
        now = np.empty(2 * n)
        for half in (0, 1):
            own, other = before[half * n : half * n + n], before[(1 - half) * n : (2 - half) * n]
            stay = own[:, None] * move
            best = stay.argmax(0)
            value = stay[best, np.arange(n)]
            jump = other.argmax()
            cross = other[jump] * switch / n
            better = cross > value if half == 0 else cross >= value
            back[t, half * n : half * n + n] = np.where(better, jump + (1 - half) * n, best + half * n)
            now[half * n : half * n + n] = np.where(better, cross, value) * o[half * n : half * n + n]
        before = now / now.sum() if now.sum() > 0 else now
    states = np.zeros(len(obs), int)
    states[-1] = before.argmax()
    for t in range(len(obs) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def interp(x, values, at, fill: float = 0.0, kind: str = "linear") -> np.ndarray:
    """Interpolation over rows: values (points, columns) at new points; outside is ``fill``, nearest ties go down."""
    x, values, at = np.asarray(x, float), np.asarray(values, float), np.asarray(at, float)
    if len(x) != len(values) or not len(x):
        return np.full((len(at), *values.shape[1:]), fill)
    low = np.clip(np.searchsorted(x, at, "right") - 1, 0, max(len(x) - 2, 0))
    high = np.minimum(low + 1, len(x) - 1)
    span = x[high] - x[low]
    part = np.divide(at - x[low], span, out=np.zeros(len(at)), where=np.abs(span) >= 1e-10)
    if kind == "nearest":
        part = (np.abs(at - x[low]) > np.abs(x[high] - at)).astype(float)
    out = values[low] * (1.0 - part)[:, None] + values[high] * part[:, None]
    return np.where(((at >= x[0]) & (at <= x[-1]))[:, None], out, fill)


def interp_harmonics(x, freqs, harmonics, kind: str = "linear", fill: float = 0.0) -> np.ndarray:
    """(harmonics, frequencies, frames)."""
    return np.stack([interp(freqs, x, h * np.asarray(freqs), fill, kind) for h in harmonics]) if len(harmonics) else np.zeros((0, *np.shape(x)))


def salience(s, freqs, harmonics, weights=None, filter_peaks: bool = True, fill: float = 0.0, kind: str = "linear") -> np.ndarray:
    """Weighted mean over harmonics; optionally only at the spectral peaks, the rest is ``fill``."""
    s = np.asarray(s, float)
    w = np.asarray(weights if weights is not None and len(weights) == len(harmonics) else np.ones(len(harmonics)), float)
    total = np.tensordot(w, interp_harmonics(s, freqs, harmonics, kind, 0.0), 1)
    out = total / w.sum() if w.sum() > 1e-10 else total
    if not filter_peaks:
        return out
    peak = np.zeros(s.shape, bool)
    peak[1:-1] = (s[1:-1] > s[:-2]) & (s[1:-1] > s[2:])
    return np.where(peak, out, fill)


def f0_harmonics(x, f0, freqs, harmonics, kind: str = "linear", fill: float = 0.0) -> np.ndarray:
    """(harmonics, frames): the spectrum at multiples of each frame's f0."""
    x, f0 = np.asarray(x, float), np.asarray(f0, float)
    if not x.size or len(freqs) != len(x) or len(f0) != x.shape[1]:
        return np.zeros((len(harmonics), x.shape[1] if x.ndim > 1 else 0))
    out = np.full((len(harmonics), len(f0)), fill)
    for t in np.flatnonzero(np.isfinite(f0) & (f0 > 0)):
        got = interp(freqs, x[:, [t]], np.asarray(harmonics) * f0[t], fill, kind)[:, 0]
        out[:, t] = np.where(np.isfinite(got), got, fill)
    return out


def zero_crossing_rate(y) -> float:
    s = np.asarray(y, float) >= 0
    return float((s[1:] != s[:-1]).mean()) if len(s) > 1 else 0.0


def frame_feature(y, name: str, frame_length: int = 2048, hop_length: int = 512, center: bool = True) -> np.ndarray:
    """zcr or rms of each frame."""
    f = frame_padded(y, frame_length, hop_length, center)
    if name == "rms":
        return np.sqrt((f * f).mean(1))
    s = f >= 0
    return (s[:, 1:] != s[:, :-1]).sum(1) / max(frame_length - 1, 1)
