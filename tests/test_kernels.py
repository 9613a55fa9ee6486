"""Kernels on closed-form signals, by properties and by plain loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipframe.kernels import image, rhythm, sequences, signal, tonal
from clipframe.operators import configs
from clipframe.plans import bases, transitions, windows

SR = 22050
TONE = np.sin(2 * np.pi * 440 * np.arange(SR) / SR)
RNG = np.random.default_rng(0)


@settings(max_examples=20, deadline=None)
@given(st.integers(512, 4096))
def test_round_trip(n):
    y = np.sin(0.01 * np.arange(n))
    config = signal.StftConfig.of(256, 64)
    out = signal.istft(signal.stft(y, config), config)
    m = min(n, len(out))
    assert ((out[:m] - y[:m]) ** 2).mean() < 1e-3


@settings(max_examples=10, deadline=None)
@given(st.integers(512, 4096))
def test_energy(n):
    y = np.cos(0.02 * np.arange(n))
    config = signal.StftConfig.of(512, 128)
    out = signal.istft(signal.stft(y, config), config)
    m = min(n, len(out))
    assert abs((out[:m] ** 2).sum() / (y[:m] ** 2).sum() - 1) < 0.05


def test_stft_is_the_fourier_sum():
    y = RNG.normal(size=100)
    config = signal.StftConfig.of(16, 8)
    got, padded = signal.stft(y, config), np.pad(y, 8)
    assert got.shape == (9, 13)
    for t in (0, 5, 12):
        x = padded[t * 8 : t * 8 + 16] * windows.hann(16)
        for f in (0, 3, 8):
            assert abs(got[f, t] - sum(v * np.exp(-2j * np.pi * f * i / 16) for i, v in enumerate(x))) < 1e-9


@pytest.mark.parametrize("y", [[], [math.nan], [1.0, math.inf]])
def test_bad_audio(y):
    with pytest.raises(ValueError):
        signal.stft(y)


def test_bad_parameters():
    with pytest.raises(ValueError):
        signal.StftConfig(n_fft=0).check()
    with pytest.raises(ValueError):
        signal.StftConfig(n_fft=256, hop_length=64).taps()
    with pytest.raises(ValueError):
        signal.frame([1.0], 2, 1)


def test_windows():
    assert windows.hann(1).tolist() == [1.0] and len(windows.hann(0)) == 0
    assert windows.parse_window("Hanning") == "hann" and windows.parse_window("x") is None and windows.get_window_from_str("x", 4) is None
    assert abs(windows.window_bandwidth("hann") - 1.5) < 1e-2
    k = windows.diagonal_filter("hann", 9)
    assert abs(k.sum() - 1) < 1e-9 and abs(k - np.diag(np.diag(k))).max() == 0
    turned = windows.diagonal_filter("hann", 9, 2.0, True)
    assert abs(turned.sum()) < 1e-9 and windows.diagonal_filter_from_str("x", 9).size == 0
    assert (windows.window_sumsquare(np.ones(4), 3, 2) == [1, 1, 2, 2, 2, 2, 1, 1]).all()


def test_griffinlim_keeps_energy():
    y = TONE[: SR // 2]
    config = signal.StftConfig.of(512, 128)
    out = signal.griffinlim(np.abs(signal.stft(y, config)), config, 16)
    assert 0.5 < (out**2).sum() / (y[: len(out)] ** 2).sum() < 1.5
    assert (out == signal.griffinlim(np.abs(signal.stft(y, config)), config, 16)).all()


def test_decibels_and_pcen():
    x = np.array([[1.0, 1e-12], [100.0, 10.0]])
    assert signal.to_db(x, top_db=None).tolist() == [[0.0, -100.0], [20.0, 10.0]]
    assert signal.to_db(x, top_db=30.0).min() == -10.0
    assert (np.isfinite(signal.pcen(x, SR, 512))).all()
    with pytest.raises(ValueError):
        signal.pcen(np.zeros((2, 0)), SR, 512)


def test_reassignment_finds_the_tone():
    config = signal.StftConfig.of(1024, 256)
    mag, time, freq = signal.reassigned_spectrogram(TONE, config)
    assert mag.shape == time.shape == freq.shape and freq.min() >= 0 and freq.max() <= 512 and time.max() <= mag.shape[1] - 1


def test_filters():
    section = bases.sos_bandpass(440, 40, SR, 2)
    keep, drop = signal.sections_filtfilt(section, TONE[:4000]), signal.sections_filtfilt(section, np.sin(2 * np.pi * 3000 * np.arange(4000) / SR))
    assert np.abs(keep[1500:2500]).max() > 0.8 and np.abs(drop[1500:2500]).max() < 0.05
    assert np.allclose(signal.sosfilt([[1, 0, 0, 1, 0, 0]], [1.0, 2.0]), [1, 2]) and len(signal.filtfilt(section[0], [])) == 0
    x = RNG.normal(size=50)
    b0, b1, b2, _, a1, a2 = section[0]
    want = np.zeros(50)
    for i in range(50):
        past = lambda a, k, i=i: a[i - k] if i >= k else 0.0
        want[i] = b0 * x[i] + b1 * past(x, 1) + b2 * past(x, 2) - a1 * past(want, 1) - a2 * past(want, 2)
    assert np.allclose(signal.sosfilt(section[:1], x), want)
    out = signal.iirt(TONE[:8000], SR, 1024, 512, fmin=200, fmax=900)
    peak = bases.cqt_frequencies(len(out), 200)[out.mean(1).argmax()]
    assert abs(math.log2(peak / 440)) < 0.1
    assert signal.SosFilter.bandpass(440, 40, SR, 2).filtfilt(TONE[:100]).shape == (100,)
    bank, rates = bases.semitone_filterbank()
    assert len(bank) == len(rates) == 85
    with pytest.raises(ValueError):
        bases.semitone_filterbank([1.0], 0.0, [1.0, 2.0])


def test_lpc_solves_the_normal_equations():
    y = RNG.normal(size=300).cumsum()
    y -= y.mean()
    r = np.array([y[: len(y) - k] @ y[k:] for k in range(6)])
    want = -np.linalg.solve(np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)]), r[1:])
    assert np.allclose(signal.lpc(y, 5), want)
    assert np.allclose(signal.lpc(y, 2), signal.lpc(y, 2, compat=True)) and not np.allclose(signal.lpc(y, 4), signal.lpc(y, 4, compat=True))
    assert signal.lpc([0.0] * 9, 2).tolist() == [0, 0] and signal.lpc([1.0], 3).tolist() == [0, 0, 0]


def test_resample_and_pitch_shift():
    y = signal.resample(TONE, SR, 16000)
    assert len(y) == round(SR * 16000 / SR) and np.allclose(y[2000:3000], np.sin(2 * np.pi * 440 * np.arange(2000, 3000) / 16000), atol=2e-2)
    assert (signal.resample(TONE, SR, SR) == TONE).all()
    up = signal.pitch_shift(TONE, SR, 12)
    assert abs(np.abs(np.fft.rfft(up)).argmax() * SR / len(up) - 880) < 10
    assert abs(len(signal.time_stretch(TONE, 2.0)) - SR / 2) < 2048 and signal.phase_vocoder(np.zeros((5, 4)), 0.0, 2).size == 0


def test_fmt_and_autocorrelate():
    y = RNG.normal(size=40)
    assert np.allclose(signal.autocorrelate(y, 5), [y[: 40 - k] @ y[k:] for k in range(5)])
    assert len(signal.fmt(y)) > 3
    with pytest.raises(ValueError):
        signal.fmt([1.0, 2.0])


def test_hpss_medians():
    x = RNG.random((7, 9))
    got = signal.upper_median(x, 5, 1)
    for i in range(7):
        for t in range(9):
            w = sorted(x[i, max(0, t - 2) : t + 3])
            assert got[i, t] == w[len(w) // 2]
    h, p = signal.hpss(x.astype(complex), (5, 3))
    assert np.allclose(h + p, x, atol=1e-6) and signal.harmonic(x).shape == signal.percussive(x).shape == x.shape


def test_intervals():
    y = np.array([0] * 100 + [0.5] * 50 + [0] * 25)
    assert signal.trim(y, 20)[1] == (100, 150) and signal.trim(np.zeros(5))[1] == (0, 0)
    assert signal.split([0] * 10 + [0.8] * 20 + [0] * 5 + [0.6] * 15, 20, 5) == [(10, 30), (35, 50)]
    assert signal.remix(np.arange(10), [(7, 9), (0, 2)], False).tolist() == [7, 8, 0, 1]
    x = np.array([1, 1, -1, -1, 1, 1.0])
    assert signal.remix(x, [(1, 5)]).tolist() == [-1, -1]
    out, last = signal.deemphasis(signal.preemphasis(x)[0])
    assert np.allclose(out, x) and last == out[-1]
    assert signal.buf_to_float(b"\x00\x80\xff\x7f", 2).tolist() == [-1.0, 32767 / 32768]
    with pytest.raises(ValueError):
        signal.buf_to_float(b"abc", 2)
    assert len(signal.clicks([0, 0.5, 1.0], SR, None, 0.01)) == SR and np.abs(signal.clicks([0.5], 1000, 1000)[:500]).max() == 0


def test_filterbanks():
    fb = bases.mel_filterbank(SR, 512, 40)
    assert fb.shape == (40, 257) and fb.min() >= 0 and bases.mel_filterbank(SR, 2048, 20).argmax(1).tolist() == sorted(bases.mel_filterbank(SR, 2048, 20).argmax(1))
    assert np.allclose(bases.mel_to_hz(bases.hz_to_mel([50, 1000, 5000])), [50, 1000, 5000]) and np.allclose(bases.mel_to_hz(bases.hz_to_mel(700, True), True), 700)
    c = bases.chroma_filterbank(SR, 4096)
    assert np.allclose((c[:, 1:] ** 2).sum(0), 1) and c[:, round(440 * 4096 / SR)].argmax() == 9
    fold = bases.cq_to_chroma(84, 12)
    assert fold.sum() == 84 and fold[0, 0] == 1 and bases.cq_to_chroma(36, 36)[:, 34:].sum() == 2
    d = bases.dct_basis(8, 8)
    assert np.allclose(d @ d.T, np.eye(8))
    atoms, lengths = bases.constant_q(SR, 100.0, 24)
    assert atoms.shape[1] == bases.next_pow2(math.ceil(lengths.max())) and np.allclose(np.abs(atoms).sum(1), 1)
    with pytest.raises(ValueError):
        bases.constant_q_lengths(SR, 5000.0, 24)
    with pytest.raises(ValueError):
        bases.wavelet_lengths([], SR)
    freqs = bases.cqt_frequencies(12, 100.0)
    assert np.allclose(bases.wavelet_lengths(freqs, SR, gamma=0.0)[0], bases.constant_q_lengths(SR, 100.0, 12))
    assert bases.wavelet(freqs, SR, norm="l2")[0].shape[0] == 12 and bases.expand_to(0) == 1 and bases.expand_to(5, 9) == 16
    assert (bases.mr_frequencies()[1] == np.repeat([882, 4410, 22050], [36, 34, 15])).all()
    for m in (transitions.transition_loop(4, 0.5), transitions.transition_local(4, 0.5), transitions.transition_cycle(4, 0.5), transitions.transition_uniform(4)):
        assert np.allclose(m.sum(1), 1)


def test_cepstra():
    power = tonal.mel_power(TONE, SR, 512, 128, 40)
    assert bases.mel_frequencies(42, 0, SR / 2)[power.mean(1).argmax() + 1] == pytest.approx(440, rel=0.15)
    m = configs.MfccConfig(n_fft=512, hop_length=128, n_mfcc=13, n_mels=40).compute(TONE)
    assert m.shape == (13, 173)
    assert np.allclose(tonal.mfcc_to_mel(bases.dct_basis(8, 8) @ np.log10([[1.0]] * 8) * 10, 8), 1)
    y = configs.MfccToAudioConfig(n_fft=512, hop_length=128, n_iter=2).compute(m, 40)
    assert np.isfinite(y).all() and len(y) > 0
    assert tonal.spectral_contrast(TONE, SR).shape[0] == 7 and tonal.spectral_contrast(TONE, 300, fmin=200).size == 0


def test_chroma_and_tuning():
    c = tonal.chroma_stft(TONE, SR, 4096)
    assert c.mean(1).argmax() == 9 and c.max() == 1
    assert tonal.chroma_cqt(TONE, SR).mean(1).argmax() == 9
    assert np.allclose(np.sqrt((tonal.chroma_cens(TONE, SR) ** 2).sum(0)), 1)
    assert tonal.chroma_vqt(TONE, SR, gamma=5.0).shape[0] == 12
    assert tonal.tonnetz(np.eye(12)).shape == (6, 12) and np.allclose(tonal.tonnetz(np.ones((12, 1))), 0) and (tonal.tonnetz(np.ones((7, 2))) == 0).all()
    assert abs(tonal.estimate_tuning_cents(c)) <= 50 and tonal.estimate_tuning_cents(np.zeros((12, 0))) == 0
    assert abs(tonal.pitch_tuning([440.0, 880.0, 220.0])) < 0.02 and tonal.pitch_tuning([]) == 0.0
    assert abs(tonal.estimate_tuning(TONE, SR)) < 0.1


def test_constant_q():
    c = configs.CqtConfig().compute(TONE)
    assert abs(bases.cqt_frequencies(84, 32.70)[np.abs(c).mean(1).argmax()] - 440) < 15
    assert (tonal.pseudo_cqt(TONE, SR) == tonal.hybrid_cqt(TONE, SR)).all()
    assert configs.VqtConfig(gamma=10.0).compute(TONE).shape[0] == 84
    y = tonal.icqt(c[:, :4], SR, n_iter=0)
    assert np.allclose(y, 0.01 * np.sin(0.001 * np.arange(5 * 512))) and np.isfinite(tonal.griffinlim_cqt(np.abs(c[:, :4]), SR, n_iter=1)).all()


def cmndf(x, n):
    d = np.array([((x[: len(x) - k] - x[k:]) ** 2).sum() for k in range(n)])
    return np.array([1.0] + [d[k] * k / d[1 : k + 1].sum() for k in range(1, n)])


def test_pitch():
    x = RNG.normal(size=64)
    assert np.allclose(tonal._cmndf(x[None], 20)[0], cmndf(x, 20))
    f = configs.YinConfig().compute(TONE)
    assert np.allclose(f, 440, atol=3) and configs.YinConfig().compute(np.zeros(4096) + 1e-9).max() == 0
    pitch, mag = tonal.piptrack(TONE, SR)
    assert abs(np.median(pitch[pitch > 0]) - 440) < 12 and ((pitch > 0) == (mag > 0)).all()
    f0, voiced, prob = tonal.pyin(TONE[:8000], SR, 200, 800, 1024, 256)
    assert voiced[5:-5].all() and np.allclose(f0[5:-5], 440, rtol=0.02) and prob.min() >= 0.01 and prob.max() <= 0.99
    assert np.isnan(tonal.pyin(RNG.normal(size=4000), SR, 200, 800, 1024, 256)[0]).sum() >= 0 and len(tonal.pyin([], SR)[0]) == 0
    assert abs(tonal.beta_weights(100, 2.0, 18.0).sum() - 1) < 1e-3


def test_harmonics():
    freqs = np.arange(10.0)
    s = np.zeros((10, 2))
    s[[2, 4, 6]] = 1.0
    out = tonal.salience(s, freqs, [1, 2, 3])
    assert out[2, 0] == 1.0 and tonal.salience(s, freqs, [1, 2], filter_peaks=False).shape == s.shape
    assert tonal.f0_harmonics(s, [2.0, math.nan], freqs, [1, 2], fill=-1.0).tolist() == [[1.0, -1.0], [1.0, -1.0]]
    assert tonal.interp([0, 1], np.array([[0.0], [2.0]]), [0.25, 0.5, 3], 9.0).ravel().tolist() == [0.5, 1.0, 9.0]
    assert tonal.interp([0, 1], np.array([[0.0], [2.0]]), [0.5, 0.6], 9.0, "nearest").ravel().tolist() == [0.0, 2.0]


def test_onsets():
    y = np.concatenate([np.zeros(2048), RNG.normal(size=2048)])
    e = rhythm.onset_strength(y, 512, 128)
    assert e[: 2048 // 128 - 3].max() == 0 and e[14:18].max() > 1 and len(rhythm.onset_strength([], 512, 128)) == 0
    assert set(rhythm.onset_detect(y, 512, 128)) <= set(range(1, len(e) - 1)) and len(configs.OnsetDetectConfig(512, 128).detect(y)) > 0
    assert rhythm.onset_backtrack([3, 1, 1, 5, 4], [3, 4, 9], 2).tolist() == [1, 4, 9] or rhythm.onset_backtrack([3, 1, 1, 5, 4], [3], 2).tolist() == [1]
    assert rhythm.onset_strength_multi(y, SR, 512, 128, [(0, 500), (500, 5000)]).shape[0] == 2


def test_tempo_and_beats():
    pulse = np.zeros(2 * SR)
    pulse[:: SR // 2] = 1.0
    assert abs(rhythm.tempo(pulse, SR, 512, 256) - 120) < 10
    bpm, beats = configs.BeatTrackConfig(hop_length=256).track(pulse)
    assert abs(bpm - 120) < 10 and 2 <= len(beats) <= 5
    assert rhythm.beat_track([], SR, [1.0])[0] == 120.0 and len(rhythm.beat_track([], SR, [1.0])[1]) == 0
    e = RNG.random(50)
    g = rhythm.tempogram(e, 10)
    assert g.shape == (10, 41) and np.allclose(g[3, 5], e[5:12] @ e[8:15]) and rhythm.tempogram(e[:5], 10).shape == (5, 0)
    assert np.allclose(rhythm.tempogram_ratio(g).mean(1), 1) and rhythm.fourier_tempogram(e, 12).shape == (9, 39)
    p = rhythm.plp([], SR, e, 512, 16)
    assert len(p) == 50 and p.max() == 1 and p.min() >= 0 and len(bases.tempogram_frequencies(9, SR, 512, 12)) == 9
    x = [0, 1, 0, 2, 0, 0, 3, 3, 0, 1, 0]
    assert rhythm.peak_pick(x, 1, 1, 1, 1, 0.5, 0).tolist() == [1, 3, 9] and rhythm.peak_pick(x, 1, 1, 1, 1, 0.5, 2).tolist() == [3, 9]


def test_alignment():
    x, y = RNG.random((3, 6)), RNG.random((3, 8))
    cost = sequences.distances(x, y)
    best = np.full((6, 8), np.inf)
    for i in range(6):
        for j in range(8):
            best[i, j] = cost[i, j] + min([best[a, b] for a, b in ((i - 1, j - 1), (i, j - 1), (i - 1, j)) if a >= 0 and b >= 0], default=0.0)
    d, path = sequences.dtw(x, y)
    assert abs(d - best[-1, -1]) < 1e-9 and path[0] == (0, 0) and path[-1] == (5, 7) and abs(sum(cost[p] for p in path) - d) < 1e-9
    assert sequences.dtw(x, y[:2])[0] == math.inf and sequences.dtw_distance(x, x) == 0
    assert sequences.dtw_backtracking(sequences.dtw_with_steps(x, y)[1], subseq=True)[0][0] == 0
    assert np.allclose(np.diag(sequences.cross_similarity(x, x)), 1)


def test_decoding():
    import itertools

    prob, trans = RNG.dirichlet(np.ones(3), 5).T, transitions.transition_loop(3, 0.7)
    score = lambda s: sum(np.log(prob[k, t]) for t, k in enumerate(s)) + sum(np.log(trans[a, b]) for a, b in zip(s, s[1:]))
    assert tuple(sequences.viterbi(prob, trans)) == max(itertools.product(range(3), repeat=5), key=score)
    path, logp = sequences.viterbi_discriminative(prob, trans)
    assert tuple(path) == tuple(sequences.viterbi(prob, trans)) and np.isfinite(logp)
    states, logs = sequences.viterbi_binary(prob, transitions.transition_loop(2, 0.9))
    assert states.shape == prob.shape and set(states.ravel()) <= {0, 1} and len(logs) == 3
    assert sequences.viterbi(prob, np.ones((2, 2))).tolist() == [0] * 5


def test_factors():
    a, x = RNG.random((20, 4)), np.array([1.0, 0.0, 2.0, 0.5])
    assert np.allclose(sequences.nnls(a, a @ x), x, atol=1e-6)
    b = RNG.normal(size=20)
    got = sequences.nnls(a, b)
    grad = a.T @ (b - a @ got)
    assert (got >= 0).all() and (grad[got == 0] <= 1e-6).all() and np.abs(grad[got > 0]).max(initial=0) < 1e-6
    v = RNG.random((6, 2)) @ RNG.random((2, 9))
    w, h = sequences.nmf(v, 2, 500)
    assert np.abs(v - w @ h).max() < 0.05 and (w >= 0).all() and (h >= 0).all()
    w, h = sequences.decompose(v - 0.1, 3, sort=True)
    assert w.argmax(0).tolist() == sorted(w.argmax(0)) and sequences.nmf_hpss(v)[0].shape == v.shape


def test_segments():
    data = np.repeat(np.array([[0.0, 5.0, 1.0]]), [4, 3, 5], axis=1)
    assert sequences.agglomerative(data, 3).tolist() == [0, 4, 7] and sequences.agglomerative(data, 0).tolist() == [0] and len(sequences.agglomerative(data, 99)) == 12
    assert sequences.subsegment(data, [7], 2).tolist() == [0, 4, 7, 11]
    r = np.eye(20)
    out = sequences.path_enhance(r, 5)
    assert out.shape == r.shape and out[10, 10] > out[10, 2] and out.min() >= 0
    x = RNG.random((4, 6))
    rec = sequences.cross_similarity(x, x)
    assert np.allclose(sequences.lag_to_recurrence(sequences.recurrence_to_lag(rec)), rec)
    assert sequences.nn_filter(x, np.eye(6), axis=1).tolist() == x.tolist() and sequences.nn_filter(x, axis=-1).shape == x.shape
    assert sequences.timelag_filter(x, norm="L2").shape == x.shape and sequences.match_events([0.0, 1.0], [0.9, 0.1, 0.05], 0.3) == [(0, 2), (1, 0)]


def test_images(tmp_path):
    assert image.to_rgb([0.0, 1.0], "gray").tolist() == [[0, 0, 0], [255, 255, 255]] and image.parse_colormap("x") is None
    w, h, pixels = image.spectrogram_to_rgb(np.arange(6.0).reshape(2, 3), "grey")
    assert (w, h) == (3, 2) and pixels[:3] == bytes([153] * 3) and pixels[-3:] == bytes([102] * 3)
    assert len(image.waveform_to_rgb(TONE, 20, 10)) == 600 and image.waveform_to_rgb([], 2, 2) == b""
    assert image.scale_image(b"abc", 1, 1, 2) == (2, 2, b"abc" * 4)
    image.save_spectrogram(np.ones((2, 2)), str(tmp_path / "a.ppm"))
    image.save_waveform(TONE, str(tmp_path / "b.ppm"), 4, 4)
    assert (tmp_path / "a.ppm").read_bytes().startswith(b"P6\n2 2\n255\n") and len((tmp_path / "b.ppm").read_bytes()) == 11 + 48
    for name in image.PALETTES:
        assert image.to_rgb(np.linspace(0, 1, 5), name).shape == (5, 3)
