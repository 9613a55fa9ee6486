"""Parameter objects with the usual defaults; ``with_`` gives a changed copy, ``compute`` runs the operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..kernels import rhythm, tonal
from ..kernels.signal import StftConfig

__all__ = ["BeatTrackConfig", "CqtConfig", "MfccConfig", "MfccToAudioConfig", "OnsetDetectConfig", "StftConfig", "VqtConfig", "YinConfig"]


class _With:
    def with_(self, **changes):
        return replace(self, **changes)


@dataclass(frozen=True)
class CqtConfig(_With):
    sr: int = 22050
    hop_length: int = 512
    fmin: float = 32.70
    n_bins: int = 84
    bins_per_octave: int = 12
    tuning: float = 0.0
    filter_scale: float = 1.0

    def compute(self, y):
        return tonal.cqt(y, self.sr, self.hop_length, self.fmin, self.n_bins, self.bins_per_octave, self.tuning, self.filter_scale)


@dataclass(frozen=True)
class VqtConfig(CqtConfig):
    gamma: float = 0.0

    def compute(self, y):
        return tonal.vqt(y, self.sr, self.hop_length, self.fmin, self.n_bins, self.bins_per_octave, self.tuning, self.filter_scale, self.gamma)


@dataclass(frozen=True)
class MfccConfig(_With):
    sr: int = 22050
    n_fft: int = 2048
    hop_length: int = 512
    n_mfcc: int = 20
    n_mels: int = 128

    def compute(self, y):
        return tonal.mfcc(y, self.sr, self.n_mfcc, self.n_fft, self.hop_length, self.n_mels)


@dataclass(frozen=True)
class MfccToAudioConfig(_With):
    sr: int = 22050
    n_fft: int = 2048
    hop_length: int = 512
    fmin: float = 0.0
    fmax: float | None = None
    n_iter: int = 32

    def compute(self, cepstra, n_mels: int = 128, length: int | None = None):
        return tonal.mfcc_to_audio(cepstra, n_mels, self.sr, self.n_fft, self.hop_length, self.fmin, self.fmax, self.n_iter, length)


@dataclass(frozen=True)
class YinConfig(_With):
    sr: int = 22050
    frame_length: int = 2048
    hop_length: int = 512
    fmin: float = 40.0
    fmax: float | None = None
    threshold: float = 0.1

    def compute(self, y):
        return tonal.yin(y, self.sr, self.frame_length, self.hop_length, self.fmin, self.fmax, self.threshold)


@dataclass(frozen=True)
class OnsetDetectConfig(_With):
    n_fft: int = 2048
    hop_length: int = 512
    threshold: float = 0.1

    def detect(self, y):
        return rhythm.onset_detect(y, self.n_fft, self.hop_length, self.threshold)


@dataclass(frozen=True)
class BeatTrackConfig(_With):
    sr: int = 22050
    hop_length: int = 512
    start_bpm: float | None = None

    def track(self, y, envelope=None):
        return rhythm.beat_track(y, self.sr, envelope, self.hop_length, self.start_bpm)
