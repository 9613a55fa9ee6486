"""Pipelines of several operators, and the SQL surface."""

import numpy as np
import pytest

from clipframe import sqlapi
from clipframe.kernels.signal import StftConfig
from clipframe.operators import recipes
from clipframe.sources import adapters

SR = 8000
TONE = np.sin(2 * np.pi * 440 * np.arange(SR) / SR)


def test_sql_functions(spark):
    sqlapi.register(spark)
    r = spark.sql("SELECT hz_to_mel(mel_to_hz(20D)) AS a, midi_to_hz(hz_to_midi(300D)) AS b, note_name(-1) AS c, power_db(100D) AS d, amplitude_db(10D) AS e, frame_time(2, 100, 50) AS f, time_frame(-1D, 10, 2) AS g").first()
    assert [r["a"], r["b"], r["d"], r["e"], r["f"]] == pytest.approx([20, 300, 20, 20, 1]) and (r["c"], r["g"]) == ("B-2", 0)
    rows = spark.sql("SELECT * FROM frames(ARRAY(1D, 2D, 3D, 4D), 2, 1)").collect()
    assert [(x["t"], x["i"], x["y"]) for x in rows] == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 3), (2, 0, 3), (2, 1, 4)]


def test_vocals(spark):
    burst = TONE.copy()
    burst[3000:3400] += np.sin(2 * np.pi * 1500 * np.arange(400) / SR)
    df = spark.createDataFrame([(1, SR, burst.tolist())], "clip_id long, sr int, y array<double>")
    config = StftConfig.of(256, 64)
    voice = np.array(recipes.separate_vocals(df, config, 31).first()["y"])
    rest = np.array(recipes.separate_vocals(df, config, 31, vocals=False).first()["y"])
    assert (voice[3050:3350] ** 2).mean() > 20 * (voice[5000:6000] ** 2).mean() and np.allclose((voice + rest)[500:6500], burst[500:6500], atol=0.3)


def test_synchronise(spark):
    notes = lambda n: np.concatenate([np.sin(2 * np.pi * f * np.arange(n) / SR) for f in (262, 330, 392, 523)])
    df = spark.createDataFrame([(1, SR, notes(8000).tolist(), notes(6000).tolist())], "clip_id long, sr int, a array<double>, b array<double>")
    path = recipes.synchronise(df, 512, n_octaves=4, bins_per_octave=12, fmin=65.4).orderBy("step").collect()
    assert (path[0]["i"], path[0]["j"]) == (0, 0) and all(b["i"] - a["i"] in (0, 1) and b["j"] - a["j"] in (0, 1) for a, b in zip(path, path[1:]))
    middle = [p for p in path if p["i"] == path[-1]["i"] // 2][0]
    assert abs(middle["j"] / path[-1]["j"] - 0.5) < 0.15


def test_superflux(spark):
    y = np.concatenate([np.zeros(600), TONE[:600]])
    df = adapters.samples_of_signals(spark.createDataFrame([(1, SR, y.tolist())], "clip_id long, sr int, y array<double>"))
    rows = {r["n"]: r["y"] for r in recipes.superflux_onsets(df, SR, 64, 32, 8).collect()}
    assert 17 <= max(rows, key=rows.get) <= 20
