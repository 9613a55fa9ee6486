"""WAV files, streams and kernels over tables."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipframe.kernels import signal, tonal
from clipframe.operators import framing, kernel, matrix, spectral
from clipframe.sources import adapters, wav
from clipframe.streaming import filters

TONE = 0.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)


def float_wav(x, sr):
    x = np.asarray(x, "<f4").T
    fmt = struct.pack("<HHIIHH", 3, x.shape[1], sr, sr * 4 * x.shape[1], 4 * x.shape[1], 32)
    return b"RIFF" + struct.pack("<I", 36 + x.nbytes) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()


def test_wav_codec():
    data = wav.encode_wav(np.stack([TONE, -TONE]), 8000)
    x, sr = wav.decode_wav(data)
    assert sr == 8000 and x.shape == (2, 4000) and np.abs(x[0] - TONE).max() < 1e-4
    part, _ = wav.decode_wav(data, 0.1, 0.05)
    assert (part == x[:, 800:1200]).all() and wav.decode_wav(data, 9.0)[0].shape == (2, 0)
    assert np.allclose(wav.decode_wav(float_wav([TONE], 8000))[0][0], TONE)
    assert np.frombuffer(wav.encode_wav([2.0, -2.0], 8)[44:], "<i2").tolist() == [32767, -32767]
    with pytest.raises(ValueError):
        wav.decode_wav(b"nothing")


def test_files(spark, tmp_path):
    for i, name in enumerate(("b.wav", "a.WAV", "sub/c.wav", "d.txt")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(wav.encode_wav(TONE * (i + 1) / 4, 8000))
    found = lambda **k: [r["path"].rsplit("/", 1)[1] for r in wav.find_files(spark, str(tmp_path / "in"), **k).collect()]
    assert found() == ["a.WAV", "b.wav", "c.wav"] and found(recurse=False) == ["a.WAV", "b.wav"] and found(case_sensitive=True) == ["b.wav", "c.wav"]
    assert found(offset=-1) == ["c.wav"] and found(offset=9) == [] and found(limit=1, offset=1) == ["b.wav"]
    loaded = wav.load(spark, str(tmp_path / "in" / "*.wav"), sr=4000, mono=True, duration=0.25)
    row = loaded.first()
    assert (row["sr"], row["channels"], len(row["samples"][0])) == (4000, 1, 1000) and wav.get_samplerate(loaded).first()["sr"] == 4000
    blocks = wav.stream_blocks(wav.load_wav(spark, str(tmp_path / "in" / "b.wav")), 1500).collect()
    assert sorted(len(b["samples"]) for b in blocks) == [1000, 1500, 1500]
    with pytest.raises(Exception, match="no decoder"):
        wav.load(spark, str(tmp_path / "in" / "d.txt")).collect()
    signals = wav.to_signals(wav.load_wav(spark, str(tmp_path / "in" / "b.wav")))
    assert framing.get_duration(signals).first()["seconds"] == 0.5
    out = wav.save_wav(signals, str(tmp_path / "encoded"))
    wav.write_files(out, str(tmp_path / "files"))
    assert wav.decode_wav(next((tmp_path / "files").glob("*.wav")).read_bytes())[0].shape == (1, 4000)
    ends = spark.createDataFrame([("a/b.MP3",), ("a.b/c",)], "p string").select(wav.detect_format(F.col("p"))).collect()
    assert [r[0] for r in ends] == ["mp3", None]
    assert wav.list_examples(spark).count() == 0 and wav.example(spark, "x") is None and wav.version() in wav.cite()


def test_kernels_over_tables(spark):
    df = spark.createDataFrame([(1, 8000, TONE.tolist()), (2, 8000, TONE[:3000].tolist())], "clip_id long, sr int, y array<double>")
    config = signal.StftConfig.of(256, 64)
    spec = kernel.stft(df, config)
    assert spec.where("clip_id = 1").count() == 63
    back = kernel.istft(spec, config, 8000).where("clip_id = 1").first()["y"]
    assert np.allclose(back[:3900], TONE[:3900], atol=1e-6)
    relational = {(r["t"], r["f"]): r["re"] for r in spectral.stft(adapters.samples_of_signals(df.where("clip_id = 2")), 256, 64).collect()}
    direct = signal.stft(TONE[:3000], config)
    assert all(abs(direct[f, t].real - v) < 1e-6 for (t, f), v in relational.items())
    assert kernel.mfcc(df, 13, 256, 64, 20).first()["v"].__len__() == 13 and kernel.melspectrogram(df, 256, 64, 20).count() > 0
    assert abs(np.median([r["v"][0] for r in kernel.yin(df, frame_length=512, hop_length=256).collect()]) - 440) < 3
    assert kernel.pyin(df.limit(1), frame_length=512, hop_length=512, fmin=200.0, fmax=800.0).count() > 0 and kernel.beat_track(df, hop_length=64).count() > 0
    assert len(kernel.hpss(df, config, kernel_size=(5, 5)).first()["y"]) <= 4000 and kernel.chroma_cqt(df, hop_length=512, n_octaves=5).count() > 0
    empty = spark.createDataFrame([(3, 8000, [])], df.schema)
    assert kernel.over_signals(df.union(empty), lambda y, sr: float(signal.checked(y).mean()), "scalar", permissive=True).count() == 2
    with pytest.raises(Exception, match="empty"):
        kernel.stft(empty).collect()


def test_relational_twins(spark):
    r = np.random.default_rng(1)
    m = r.random((6, 9))
    feat = spark.createDataFrame([(1, t, k, float(m[k, t])) for k in range(6) for t in range(9)], "clip_id long, t long, k long, x double")
    grid = lambda df, shape: np.array([x["x"] for x in df.orderBy("k", "t").collect()]).reshape(shape)
    assert np.allclose(grid(matrix.median_filter(feat, 5, "t"), (6, 9)), signal.upper_median(m, 5, 1))
    assert np.allclose(grid(spectral.normalize_frames(feat, "l1"), (6, 9)), tonal.normalized(m, 1))
    sparse = matrix.sparsify_rows(feat, 0.5)
    assert matrix.nnz(sparse).first()["n"] == sparse.count() and matrix.to_dense(sparse, 9, 6).count() == 54 and matrix.sparsify_rows(feat, 1.0).count() == 0
    bounds = spark.createDataFrame([(1, 3), (1, 6)], "clip_id long, t long")
    assert np.allclose(grid(matrix.sync(feat, bounds), (6, 3)), m.reshape(6, 3, 3).mean(2)) and matrix.sync(feat, bounds, "max", pad=False).count() == 6
    with pytest.raises(Exception, match="negative"):
        matrix.fix_frames_f32(spark.createDataFrame([(1, -1.0)], "clip_id long, t double")).collect()
    with pytest.raises(Exception, match="finite"):
        framing.valid_audio(spark.createDataFrame([(1, 0, float("nan"))], "clip_id long, n long, y double")).collect()
    stereo = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 3.0)], "clip_id long, ch int, n long, y double")
    assert framing.to_mono(stereo).first()["y"] == 2.0
    slices = matrix.index_to_slice_f32(spark.createDataFrame([(1, 2.5), (1, 5.0)], "clip_id long, t double"), 0, 9).collect()
    assert sorted((x["start"], x["stop"]) for x in slices) == [(0, 2), (2, 5), (5, 9)]
    assert matrix.delta(feat, 5, 2).count() == 54 and matrix.delta(feat, 1).where("x <> 0").count() == 0
    with pytest.raises(ValueError):
        matrix.stack_memory(feat, 6, 0)


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"/tmp/clipframe-stream-{name}-{np.random.randint(1 << 30)}").start()
    q.processAllAvailable()
    q.stop()


def test_streamed_filters(spark, tmp_path):
    schema = "clip_id long, block long, y array<double>"
    for b in range(4):
        spark.createDataFrame([(c, b, (TONE[b * 50 : b * 50 + 50] * c).tolist()) for c in (1, 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "blocks"))
        blocks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "blocks"))
    for name, made, whole in (("de", filters.deemphasis, signal.deemphasis), ("pre", filters.preemphasis, signal.preemphasis)):
        run(made(blocks), name)
        rows = spark.sql(f"SELECT * FROM {name} WHERE clip_id = 2 ORDER BY block").collect()
        assert np.allclose(np.concatenate([r["y"] for r in rows]), whole(TONE[:200] * 2)[0])


def test_event_windows(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")
    run(filters.windowed_energy(events, "1 hour", "30 minutes", "1 hour"), "energy")
    run(filters.sessions(events, "2 hours", "1 hour"), "visits")
    assert spark.sql("SELECT count(*) AS n FROM energy").first()["n"] > 0 and spark.sql("SELECT sum(n) AS n FROM visits").first()["n"] > 0


def test_wav_stream(spark, tmp_path):
    from clipframe.streaming.wav_source import WavBlocks

    (tmp_path / "a.wav").write_bytes(wav.encode_wav(TONE, 8000))
    spark.dataSource.register(WavBlocks)
    blocks = spark.readStream.format("wav_blocks").option("path", str(tmp_path / "a.wav")).option("chunk_size", 1500).load()
    q = blocks.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(6):
        q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT chunk, size(samples[0]) AS n FROM chunks ORDER BY chunk").collect()
    assert [(r["chunk"], r["n"]) for r in rows] == [(0, 1500), (1, 1500), (2, 1000)]
