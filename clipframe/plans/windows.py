"""Windows and kernels made of them."""

from __future__ import annotations

import math

import numpy as np

# Cosine coefficients of the periodic windows, and the names they go by.
COSINES = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}
NAMES = {"hann": "hann", "hanning": "hann", "hamming": "hamming", "blackman": "blackman", "bartlett": "bartlett", "triangle": "bartlett"}


def parse_window(name: str) -> str | None:
    """Canonical name of a window, None if unknown."""
    return NAMES.get(name.lower())


def get_window(name: str, n: int) -> np.ndarray:
    """Periodic window of n values; one value is 1."""
    kind = parse_window(name)
    if kind is None:
        raise ValueError(f"unknown window {name!r}")
    if n <= 1:
        return np.ones(max(n, 0))
    i = np.arange(n)
    if kind == "bartlett":
        return 1.0 - np.abs(2.0 * i / n - 1.0)
    return sum((-1.0) ** k * c * np.cos(2.0 * np.pi * k * i / n) for k, c in enumerate(COSINES[kind]))


def get_window_from_str(name: str, n: int) -> np.ndarray | None:
    return None if parse_window(name) is None else get_window(name, n)


def hann(n: int) -> np.ndarray:
    return get_window("hann", n)


def hamming(n: int) -> np.ndarray:
    return get_window("hamming", n)


def blackman(n: int) -> np.ndarray:
    return get_window("blackman", n)


def bartlett(n: int) -> np.ndarray:
    return get_window("bartlett", n)


def rotated(kernel: np.ndarray, angle: float) -> np.ndarray:
    """A matrix turned about its centre, bilinear, zero outside."""
    rows, cols = kernel.shape
    dy, dx = np.mgrid[:rows, :cols] - np.array([(rows - 1) / 2, (cols - 1) / 2])[:, None, None]
    x = dx * math.cos(angle) + dy * math.sin(angle) + (cols - 1) / 2
    y = -dx * math.sin(angle) + dy * math.cos(angle) + (rows - 1) / 2
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    padded = np.pad(kernel, 2)
    clip = lambda v, n: np.clip(v + 2, 0, n + 3)
    at = lambda b, a: padded[clip(y0 + b, rows), clip(x0 + a, cols)]
    fx, fy = x - x0, y - y0
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def diagonal_filter(window: str, n: int, slope: float = 1.0, zero_mean: bool = False) -> np.ndarray:
    """n x n kernel with a window along a diagonal of the slope; sums to 1 before an optional mean is taken off."""
    kernel = np.diag(get_window(window, n))
    turn = math.pi / 4 - math.atan(slope)
    if abs(turn) > 0.01:
        kernel = rotated(kernel, turn)
    kernel = np.maximum(kernel, 0.0)
    if kernel.sum() > 0:
        kernel = kernel / kernel.sum()
    return kernel - kernel.mean() if zero_mean and n else kernel


def diagonal_filter_from_str(window: str, n: int, slope: float = 1.0, zero_mean: bool = False) -> np.ndarray:
    return diagonal_filter(window, n, slope, zero_mean) if parse_window(window) else np.zeros((0, 0))


def window_bandwidth(window: str, n: int = 1000) -> float:
    """Equivalent noise bandwidth in bins."""
    w = get_window(window, n or 1000)
    return len(w) * float((w * w).sum()) / float(w.sum()) ** 2


def window_bandwidth_from_str(window: str, n: int = 1000) -> float | None:
    return window_bandwidth(window, n) if parse_window(window) else None


def pad_to(w: np.ndarray, n: int) -> np.ndarray:
    """A window in the middle of n values."""
    if len(w) > n:
        raise ValueError("the window is longer than n_fft")
    left = (n - len(w)) // 2
    return np.pad(w, (left, n - len(w) - left))


def window_sumsquare(window: np.ndarray, n_frames: int, hop_length: int, win_length: int | None = None, n_fft: int | None = None) -> np.ndarray:
    """Sum of squared windows over overlapping frames."""
    if not len(window) or n_frames <= 0 or hop_length <= 0:
        return np.zeros(0)
    w2 = np.asarray(window)[: win_length or len(window)] ** 2
    out = np.zeros((n_frames - 1) * hop_length + (n_fft or len(window)))
    at = (np.arange(n_frames) * hop_length)[:, None] + np.arange(len(w2))
    inside = at < len(out)
    np.add.at(out, at[inside], np.broadcast_to(w2, at.shape)[inside])
    return out
