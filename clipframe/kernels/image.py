"""Rasters of spectrograms and waveforms."""

from __future__ import annotations

import numpy as np

# Polynomial coefficients (constant first) of the palettes' red, green and blue.
PALETTES = {
    "viridis": ((0.267004, 0.003991, 1.096452, -2.146305, 1.167419), (0.004874, 1.015861, -0.107203, -0.449175, 0.539506), (0.329415, 1.421511, -2.482568, 1.871714, -0.140092)),
    "magma": ((0.001462, 0.169823, 2.240361, -1.106994), (0.000466, 0.100897, 0.699060, 0.203185), (0.013866, 0.563622, -0.543021, 0.966020)),
    "inferno": ((0.001462, 0.277106, 2.421006, -1.699106), (0.000466, 0.031596, 0.867279, 0.101106), (0.013866, 0.711039, -1.213691, 0.489140)),
    "plasma": ((0.050383, 2.028154, -1.078553), (0.029803, 0.260172, 0.709818), (0.527975, 0.548977, -1.076952, 1.0)),
}
LINE, PAPER = (31, 119, 180), (255, 255, 255)


def parse_colormap(name: str) -> str | None:
    name = {"gray": "grayscale", "grey": "grayscale"}.get(name.lower(), name.lower())
    return name if name in (*PALETTES, "grayscale", "coolwarm") else None


def to_rgb(values, cmap: str = "viridis") -> np.ndarray:
    """(..., 3) bytes of values clamped to [0, 1]."""
    t = np.clip(np.asarray(values, float), 0.0, 1.0)
    kind = parse_colormap(cmap)
    if kind is None:
        raise ValueError(f"unknown palette {cmap!r}")
    if kind == "grayscale":
        rgb = np.stack([t, t, t], -1)
    elif kind == "coolwarm":
        cold = t < 0.5
        rgb = np.stack([np.where(cold, 0.230 + 1.540 * t, 1.0), np.where(cold, 0.299 + 0.802 * t, 1.0 - 1.6 * (t - 0.5)), np.where(cold, 1.0, 1.0 - 1.8 * (t - 0.5))], -1)
    else:
        rgb = np.stack([np.polynomial.polynomial.polyval(t, c) for c in PALETTES[kind]], -1)
    return (np.clip(rgb, 0.0, 1.0) * 255.0).astype(np.uint8)


def spectrogram_to_rgb(data, cmap: str = "viridis", vmin: float | None = None, vmax: float | None = None) -> tuple[int, int, bytes]:
    """(width, height, pixels): low frequencies below."""
    data = np.asarray(data, float)
    if not data.size:
        return 0, 0, b""
    low, high = data.min() if vmin is None else vmin, data.max() if vmax is None else vmax
    return data.shape[1], data.shape[0], to_rgb((data[::-1] - low) / max(high - low, 1e-10), cmap).tobytes()


def waveform_to_rgb(y, width: int, height: int, color=LINE, background=PAPER) -> bytes:
    """Envelope of each pixel column, joined to the one before."""
    y = np.asarray(y, float)
    if not y.size or width <= 0 or height <= 0:
        return b""
    pixels = np.tile(np.array(background, np.uint8), (height, width, 1))
    low, span = y.min(), max(y.max() - y.min(), 1e-10)
    row = lambda v: int((1.0 - (v - low) / span) * (height - 1))
    before = None
    for x in range(width):
        own = y[int(x * len(y) / width) : min(int((x + 1) * len(y) / width), len(y))]
        if not len(own):
            continue
        top, bottom = row(own.max()), row(own.min())
        middle = (top + bottom) // 2
        ends = [top, bottom] if before is None else [top, bottom, before, middle]
        pixels[min(ends) : min(max(ends), height - 1) + 1, x] = color
        before = middle
    return pixels.tobytes()


def scale_image(pixels: bytes, width: int, height: int, scale: int) -> tuple[int, int, bytes]:
    if scale <= 1:
        return width, height, pixels
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    return width * scale, height * scale, a.repeat(scale, 0).repeat(scale, 1).tobytes()


def save_ppm(path: str, width: int, height: int, pixels: bytes) -> None:
    with open(path, "wb") as f:
        f.write(b"P6\n%d %d\n255\n" % (width, height) + pixels)


def save_spectrogram(data, path: str, cmap: str = "viridis", vmin: float | None = None, vmax: float | None = None) -> None:
    save_ppm(path, *spectrogram_to_rgb(data, cmap, vmin, vmax))


def save_waveform(y, path: str, width: int, height: int) -> None:
    save_ppm(path, width, height, waveform_to_rgb(y, width, height))
