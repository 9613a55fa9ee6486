"""Fourier transforms, filters and effects of one signal."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from ..plans import bases, windows


def checked(y) -> np.ndarray:
    """The signal as float64; empty or non-finite signals are errors."""
    y = np.asarray(y, float)
    if not y.size:
        raise ValueError("the signal is empty")
    if not np.isfinite(y).all():
        raise ValueError("the signal has values that are not finite")
    return y


@dataclass(frozen=True)
class StftConfig:
    """n_fft, hop, window; changing n_fft alone leaves the window as it is."""

    n_fft: int = 2048
    hop_length: int = 512
    win_length: int = 2048
    center: bool = True
    window: str | tuple = "hann"
    pad_mode: str = "constant"

    @classmethod
    def of(cls, n_fft: int, hop_length: int | None = None, **more) -> StftConfig:
        return cls(n_fft=n_fft, hop_length=n_fft // 4 if hop_length is None else hop_length, win_length=n_fft, **more)

    def taps(self) -> np.ndarray:
        w = windows.get_window(self.window, self.win_length) if isinstance(self.window, str) else np.asarray(self.window, float)
        return windows.pad_to(w, self.n_fft)

    def check(self) -> None:
        if self.n_fft <= 0 or self.hop_length <= 0:
            raise ValueError("n_fft and hop_length must be positive")


def rfft(y) -> np.ndarray:
    y = np.asarray(y, float)
    return np.fft.rfft(y) if y.size else np.zeros(0, complex)


def fft(x) -> np.ndarray:
    return np.fft.fft(np.asarray(x))


def ifft(x) -> np.ndarray:
    return np.fft.ifft(np.asarray(x))


def frame(y, frame_length: int, hop_length: int) -> np.ndarray:
    """(frames, frame_length) without padding; a signal shorter than a frame is an error."""
    y = np.asarray(y, float)
    if frame_length <= 0 or hop_length <= 0 or len(y) < frame_length:
        raise ValueError("the signal is shorter than a frame, or a length isn't positive")
    return np.lib.stride_tricks.sliding_window_view(y, frame_length)[::hop_length]


def centred(y: np.ndarray, n_fft: int, pad_mode: str = "constant") -> np.ndarray:
    pad = n_fft // 2
    if pad_mode == "reflect":
        return np.pad(y, pad, mode="reflect") if len(y) > 1 else np.pad(y, pad, mode="edge")
    return np.pad(y, pad)


def frame_padded(y, frame_length: int, hop_length: int, center: bool = True, value: float = 0.0) -> np.ndarray:
    """(frames, frame_length): all whole windows of the signal, padded by half a frame on both sides if centred."""
    y = np.asarray(y, float)
    if frame_length <= 0 or hop_length <= 0:
        raise ValueError("frame and hop lengths must be positive")
    if center and y.size:
        y = np.pad(y, (frame_length // 2, frame_length - frame_length // 2), constant_values=value)
    return frame(y, frame_length, hop_length) if len(y) >= frame_length else np.zeros((0, frame_length))


def stft(y, config: StftConfig = StftConfig()) -> np.ndarray:
    """(n_fft // 2 + 1, frames)."""
    y = checked(y)
    config.check()
    y = centred(y, config.n_fft, config.pad_mode) if config.center else y
    if len(y) < config.n_fft:
        return np.zeros((config.n_fft // 2 + 1, 0), complex)
    return np.fft.rfft(frame(y, config.n_fft, config.hop_length) * config.taps(), axis=1).T


def istft(spec, config: StftConfig = StftConfig(), length: int | None = None) -> np.ndarray:
    """Overlap-add over squared windows; ``length`` cuts but never pads."""
    spec = np.asarray(spec)
    if not spec.size:
        raise ValueError("the spectrum is empty")
    n_fft, n = (spec.shape[0] - 1) * 2, spec.shape[1]
    w = replace(config, n_fft=n_fft).taps()
    parts = np.fft.irfft(spec.T, n_fft, axis=1) * w
    out, norm = np.zeros(n * config.hop_length + n_fft), np.zeros(n * config.hop_length + n_fft)
    at = (np.arange(n) * config.hop_length)[:, None] + np.arange(n_fft)
    np.add.at(out, at, parts)
    np.add.at(norm, at, np.broadcast_to(w * w, at.shape))
    out = np.divide(out, norm, out=out.copy(), where=norm > 1e-8)
    if config.center:
        out = out[n_fft // 2 : len(out) - n_fft // 2]
    return out[:length]


def magphase(spec) -> tuple[np.ndarray, np.ndarray]:
    mag = np.abs(spec)
    return mag, np.divide(spec, mag, out=np.zeros_like(spec, dtype=complex), where=mag > 0)


def to_db(x, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0, factor: float = 10.0) -> np.ndarray:
    db = factor * (np.log10(np.maximum(x, amin)) - math.log10(max(ref, amin)))
    return np.maximum(db, db.max() - top_db) if top_db is not None and db.size else db


def pcen(spec, sr: float, hop_length: int, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, time_constant: float = 0.4, eps: float = 1e-6) -> np.ndarray:
    spec = np.asarray(spec, float)
    if not spec.shape[1]:
        raise ValueError("the spectrogram has no frame")
    a = math.exp(-hop_length / (time_constant * sr))
    smooth = np.empty_like(spec)
    smooth[:, 0] = spec[:, 0]
    for t in range(1, spec.shape[1]):
        smooth[:, t] = a * smooth[:, t - 1] + (1.0 - a) * spec[:, t]
    return (spec / (eps + smooth) ** gain + bias) ** power - bias**power


def reassigned_spectrogram(y, config: StftConfig = StftConfig()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(magnitudes, times in frames, frequencies in bins), both moved to the centres of energy and kept on the grid."""
    w = windows.get_window(config.window, config.win_length) if isinstance(config.window, str) else np.asarray(config.window, float)
    slope = np.zeros_like(w)
    slope[1:-1] = (w[2:] - w[:-2]) / 2.0
    s, by_time, by_slope = (stft(y, replace(config, window=tuple(v))) for v in (w, w * np.arange(len(w)), slope))
    mag, n = np.abs(s), s.shape
    f, t = np.arange(n[0], dtype=float)[:, None], np.arange(n[1], dtype=float)[None, :]
    loud = mag > 1e-10
    power = np.where(loud, mag * mag, 1.0)
    time = np.clip(t - (by_time * s.conj()).real / power / config.hop_length, 0.0, max(n[1] - 1.0, 0.0))
    omega = 2.0 * np.pi * f / config.n_fft
    shift = np.divide((by_slope * s.conj()).imag / power, omega, out=np.zeros(n), where=omega > 1e-10)
    return mag, np.where(loud, time, t), np.where(loud, np.clip(f + shift, 0.0, n[0] - 1.0), f)


def griffinlim(mag, config: StftConfig = StftConfig(), n_iter: int = 32, length: int | None = None, momentum: float = 0.99, seed: int = 0) -> np.ndarray:
    """Signal of a magnitude spectrogram: random phases by ``seed``, then rounds of inversion and analysis."""
    mag = np.asarray(mag, float)
    if not mag.size:
        raise ValueError("the spectrogram is empty")
    spec = mag * np.exp(1j * np.random.default_rng(seed).uniform(-np.pi, np.pi, mag.shape))
    before = None
    for _ in range(n_iter):
        y = istft(spec, config, length)
        if before is not None and momentum > 0:
            n = min(len(y), len(before))
            y[:n] += momentum * (y[:n] - before[:n])
        before = y.copy()
        new = stft(y, config)
        size, phase = magphase(new)
        n = min(new.shape[1], spec.shape[1])
        spec[:, :n] = mag[:, :n] * np.where(size > 1e-10, phase, 1.0)[: len(spec), :n]
    return istft(spec, config, length)


def fmt(y, t_min: float = 0.5, n_fmt: int | None = None, beta: float = 0.5, over_sample: float = 1.0) -> np.ndarray:
    """Fast Mellin transform: exponential resampling, weighting, Fourier transform."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 3 or t_min <= 0:
        raise ValueError("three samples and a positive t_min are needed")
    step = math.log(n - 1.0) - math.log(n - 2.0)
    if n_fmt is None:
        n_fmt = math.ceil(over_sample * (math.log(n - 1.0) - math.log(t_min)) / step)
    if n_fmt < 3:
        raise ValueError("n_fmt must be at least 3")
    start = math.log(t_min) - math.log(n)
    x = np.clip(np.exp(start * (1.0 - np.arange(n_fmt) / n_fmt)), t_min / n, (n - 1.0) / n)
    at = np.minimum(np.floor(x * n).astype(int), n - 2)
    part = x * n - at
    values = (y[at] * (1.0 - part) + y[at + 1] * part) * x**beta * math.sqrt(n) / n_fmt
    return np.fft.rfft(values, bases.next_pow2(n_fmt))


def sosfilt(sos, x) -> np.ndarray:
    """Cascade of second-order sections (b0, b1, b2, 1, a1, a2)."""
    y = np.asarray(x, float)
    for b0, b1, b2, _, a1, a2 in np.atleast_2d(sos):
        out, z1, z2 = [], 0.0, 0.0
        for v in y.tolist():
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            out.append(o)
        y = np.array(out)
    return y


def sosfiltfilt(sos, x) -> np.ndarray:
    """Forwards and backwards, without padding."""
    return sosfilt(sos, sosfilt(sos, x)[::-1])[::-1]


def filtfilt(section, x) -> np.ndarray:
    """One section forwards and backwards over an odd extension of the signal."""
    x = np.asarray(x, float)
    if not x.size:
        return x
    pad = 3 * min(max(3, len(x) // 10), 100)
    i = np.arange(1, pad + 1)
    left = 2.0 * x[0] - x[np.minimum(i, len(x) - 1)][::-1]
    right = 2.0 * x[-1] - x[np.maximum(len(x) - 1 - i, 0)]
    return sosfiltfilt(section, np.concatenate([left, x, right]))[pad : pad + len(x)]


def sections_filtfilt(sos, x) -> np.ndarray:
    for section in np.atleast_2d(sos) if len(sos) else ():
        x = filtfilt(section, x)
    return np.asarray(x, float)


def iirt(y, sr: float, win_length: int = 2048, hop_length: int = 512, center: bool = True, fmin: float = 27.5, fmax: float = 4186.0, bins_per_octave: int = 12, tuning: float = 0.0, q_factor: float = 25.0) -> np.ndarray:
    """Mean power by band and frame through zero-phase filters, each at a sample rate that suits it (plain decimation)."""
    y = checked(y)
    if win_length <= 0 or hop_length <= 0:
        raise ValueError("win_length and hop_length must be positive")
    fmin, fmax = max(fmin, 20.0), min(fmax, 0.475 * sr)
    if fmin >= fmax:
        raise ValueError("fmin must be below fmax")
    centres = bases.cqt_frequencies(math.ceil(math.log2(fmax / fmin) * bins_per_octave), fmin, bins_per_octave, tuning)
    centres = centres[centres < sr / 2.0]
    y = np.pad(y, win_length // 2) if center else y
    n = (len(y) - win_length) // hop_length + 1 if len(y) >= win_length else 0
    if not len(centres) or not n:
        raise ValueError("no band or no frame")
    out = np.zeros((len(centres), n))
    half_up = lambda v: np.floor(np.asarray(v) + 0.5).astype(int)
    for row, f in zip(out, centres):
        ratio = max(1, int(sr / min(max(4.0 * f, 1000.0), sr)))
        got = sections_filtfilt(bases.sos_bandpass(f, f / q_factor, sr / ratio, 2), y[::ratio])
        win = int(half_up(win_length / ratio))
        if not win or not half_up(hop_length / ratio):
            continue
        sums = np.concatenate([[0.0], np.cumsum(got * got)])
        at = half_up(np.arange(n) * hop_length / ratio)
        fits = at + win <= len(got)
        row[fits] = (sums[at[fits] + win] - sums[at[fits]]) * ratio / win
    return out


def lpc(y, order: int, compat: bool = False) -> np.ndarray:
    """Linear prediction coefficients 1..order by Levinson's recursion.

    compat=True updates the coefficients in place over the whole mirrored range, which visits each pair twice from
    order 3 on; it exists only to reproduce results made that way.
    """
    y = np.asarray(y, float)
    if len(y) <= order:
        return np.zeros(order)
    r = np.array([y[: len(y) - k] @ y[k:] for k in range(order + 1)])
    if r[0] < 1e-10:
        return np.zeros(order)
    a, error = np.zeros(order + 1), r[0]
    a[0] = 1.0
    for i in range(1, order + 1):
        k = -(a[:i] @ r[i:0:-1]) / error
        if compat:
            for j in range(1, i):
                a[j] += k * a[i - j]
        else:
            a[1:i] += k * a[1:i][::-1].copy()
        a[i] = k
        error *= 1.0 - k * k
        if error <= 0:
            break
    return a[1:]


def resample(y, src_sr: int, dst_sr: int, taps: int = 256, cutoff: float = 0.95) -> np.ndarray:
    """Windowed-sinc resampling to round(n * dst / src) samples, without delay."""
    y = np.asarray(y, float)
    if src_sr <= 0 or dst_sr <= 0:
        raise ValueError("sample rates must be positive")
    if src_sr == dst_sr or not y.size:
        return y.copy()
    n = math.floor(len(y) * dst_sr / src_sr + 0.5)
    band = cutoff * min(1.0, dst_sr / src_sr)
    half = math.ceil(taps / 2 / min(1.0, dst_sr / src_sr))
    padded = np.pad(y, half + 1)
    out = np.empty(n)
    for i in range(0, n, 4096):
        x = np.arange(i, min(i + 4096, n)) * src_sr / dst_sr
        base = np.floor(x).astype(int)
        k = np.arange(-half + 1, half + 1)
        d = x[:, None] - (base[:, None] + k)
        w = 0.35875 + 0.48829 * np.cos(np.pi * d / half) + 0.14128 * np.cos(2 * np.pi * d / half) + 0.01168 * np.cos(3 * np.pi * d / half)
        out[i : i + len(x)] = (padded[base[:, None] + k + half + 1] * band * np.sinc(band * d) * w).sum(1)
    return out


def autocorrelate(y, max_lag: int | None = None) -> np.ndarray:
    y = np.asarray(y, float)
    n = len(y)
    if not n:
        return y
    size = bases.next_pow2(2 * n)
    return np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2, size)[: min(n, n if max_lag is None else max_lag)]


#: Samples of a recurrence that are worked off at once.
BLOCK = 64


def deemphasis(y, coef: float = 0.97, zi: float = 0.0) -> tuple[np.ndarray, float]:
    """y[n] + coef * out[n - 1]; also the last output, from which a next part goes on."""
    y = np.asarray(y, float)
    out, last = np.empty(len(y)), float(zi)
    power = np.float64(coef) ** np.arange(BLOCK + 1)
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    within = np.where(lag >= 0, power[np.maximum(lag, 0)], 0.0)
    for i in range(0, len(y), BLOCK):
        part = y[i : i + BLOCK]
        n = len(part)
        if np.isfinite(part).all():
            out[i : i + n] = within[:n, :n] @ part + power[1 : n + 1] * last
        else:  # what isn't finite must not reach the samples before it
            for k, v in enumerate(part.tolist()):
                out[i + k] = last = v + coef * last
        last = float(out[i + n - 1])
    return out, last


def preemphasis(y, coef: float = 0.97, zi: float = 0.0) -> tuple[np.ndarray, float]:
    y = np.asarray(y, float)
    return y - coef * np.concatenate([[zi], y[:-1]])[: len(y)], float(y[-1]) if len(y) else zi


def upper_median(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Median of a window i +- size // 2 that shrinks at the edges; of an even number the upper one."""
    x = np.moveaxis(np.asarray(x, float), axis, -1)
    half, n = size // 2, x.shape[-1]
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)], constant_values=np.inf)
    view = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=-1), axis=-1)
    i = np.arange(n)
    count = np.minimum(i + half, n - 1) - np.maximum(i - half, 0) + 1
    return np.moveaxis(np.take_along_axis(view, np.broadcast_to((count // 2)[:, None], (*x.shape, 1)), -1)[..., 0], -1, axis)


def hpss(spec, kernel_size: tuple[int, int] = (31, 31), power: float = 2.0, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(harmonic, percussive) parts of a spectrum by medians along time and along frequency."""
    spec = np.asarray(spec)
    mag = np.abs(spec)
    h, p = upper_median(mag, kernel_size[0], 1) ** power, upper_median(mag, kernel_size[1], 0) ** power
    total, m = h + p + 1e-10, 10.0 ** (margin / 20.0)
    return spec * (h * m / total), spec * (p * m / total)


def harmonic(spec, kernel_size: int = 31) -> np.ndarray:
    return hpss(spec, (kernel_size, 17), 2.0, 1.0)[0]


def percussive(spec, kernel_size: int = 31) -> np.ndarray:
    return hpss(spec, (31, kernel_size), 2.0, 1.0)[1]


def phase_vocoder(spec, rate: float, hop_length: int) -> np.ndarray:
    """Spectrum of the signal played ``rate`` times as fast."""
    spec = np.asarray(spec)
    if not spec.size or rate <= 0:
        return np.zeros((0, 0), complex)
    hop = max(hop_length, 1)
    steps = np.arange(math.ceil((spec.shape[1] - 1) / rate)) * rate
    steps = steps[steps < spec.shape[1] - 1]
    at = np.floor(steps).astype(int)
    part = steps - at
    a, b = spec[:, at], spec[:, at + 1]
    omega = (np.pi * np.arange(spec.shape[0]) / max(spec.shape[0] - 1, 1))[:, None]
    drift = np.fmod(np.angle(b) - np.angle(a) - omega * hop + np.pi, 2.0 * np.pi) - np.pi
    phase = omega * hop + drift
    if len(steps):
        phase[:, 0] = np.angle(a[:, 0])
    return ((1.0 - part) * np.abs(a) + part * np.abs(b)) * np.exp(1j * np.cumsum(phase, 1))


def time_stretch(y, rate: float, n_fft: int = 2048, hop_length: int = 512) -> np.ndarray:
    if not len(y) or rate <= 0:
        return np.zeros(0)
    config = StftConfig.of(n_fft, max(hop_length, 1))
    return istft(phase_vocoder(stft(y, config), rate, config.hop_length), config)


def pitch_shift(y, sr: int, n_steps: float, n_fft: int = 2048, hop_length: int = 512, compat: bool = False) -> np.ndarray:
    """The signal higher by n_steps semitones, at most as long as before.

    compat=True resamples the other way, which lowers the pitch for positive steps.
    """
    if not len(y):
        return np.zeros(0)
    r = 2.0 ** (n_steps / 12.0)
    return resample(time_stretch(y, 1.0 / r, n_fft, hop_length), sr, int(sr * r if compat else sr / r))[: len(y)]


def split(y, top_db: float = 60.0, min_interval: int = 1) -> list[tuple[int, int]]:
    loud = np.abs(y) >= np.max(np.abs(y), initial=0.0) / 10.0 ** (top_db / 20.0) if np.any(y) else np.zeros(len(y), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud, [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= min_interval]


def trim(y, top_db: float = 60.0) -> tuple[np.ndarray, tuple[int, int]]:
    """The signal from its first to its last loud sample."""
    found = split(y, top_db)
    a, b = (found[0][0], found[-1][1]) if found else (0, 0)
    return np.asarray(y, float)[a:b], (a, b)


def remix(y, intervals, align_zeros: bool = True) -> np.ndarray:
    """The intervals one after another, their ends moved to the nearest zero crossing (the earlier of two)."""
    y = np.asarray(y, float)
    sign = y >= 0
    zeros = np.append(np.flatnonzero(sign[1:] != sign[:-1]) + 1, len(y))

    def near(i):
        return int(zeros[np.argmin(np.abs(zeros - i))]) if align_zeros else i

    return np.concatenate([np.zeros(0), *[y[near(a) : near(b)] for a, b in intervals]])


def buf_to_float(data: bytes, n_bytes: int) -> np.ndarray:
    """Little-endian signed samples of 1, 2 or 4 bytes in [-1, 1)."""
    if n_bytes not in (1, 2, 4) or len(data) % n_bytes:
        raise ValueError("samples have 1, 2 or 4 bytes, and the buffer is a multiple of that")
    return np.frombuffer(data, f"<i{n_bytes}") / 2.0 ** (8 * n_bytes - 1)


def clicks(times, sr: int, length: int | None = None, click_duration: float = 0.1, click_freq: float = 1000.0) -> np.ndarray:
    times = np.asarray(times, float)
    n = int(click_duration * sr)
    out = np.zeros(math.ceil(times.max(initial=0.0)) * sr if length is None else length)
    i = np.arange(n)
    burst = np.sin(2 * np.pi * click_freq * i / sr) * np.exp(-i / (0.1 * n)) if n else np.zeros(0)
    for start in np.floor(times * sr).astype(int):
        stop = min(start + n, len(out))
        if start < stop:
            out[start:stop] += burst[: stop - start]
    return out


@dataclass(frozen=True)
class SosFilter:
    """A cascade of sections."""

    sections: tuple = field(default_factory=tuple)

    @classmethod
    def bandpass(cls, center: float, bandwidth: float, sr: float, order: int = 1) -> SosFilter:
        return cls(tuple(map(tuple, bases.sos_bandpass(center, bandwidth, sr, order))))

    def filter(self, x) -> np.ndarray:
        return sosfilt(self.sections, x) if self.sections else np.asarray(x, float)

    def filtfilt(self, x) -> np.ndarray:
        return sections_filtfilt(self.sections, x)
