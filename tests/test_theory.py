"""Names and scales of music theory, and scalar conversions at their edges."""

import pytest
from pyspark.sql import functions as F

from clipframe.functions import scales, theory, timing


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_scales_of_raga():
    assert len(theory.list_thaat()) == 10 and len(theory.list_mela()) == 72 and theory.list_mela()[64] == ("mechakalyani", 65)
    assert theory.thaat_to_degrees("Bilaval") == [0, 2, 4, 5, 7, 9, 11] and theory.thaat_to_degrees("x") is None
    assert theory.mela_to_degrees("Kanakangi") == [0, 1, 2, 5, 7, 8, 9] and theory.mela_to_degrees("mechakalyani") == [0, 2, 4, 6, 7, 9, 11]
    assert theory.mela_to_degrees_by_index(73) is None and theory.mela_to_degrees("x") is None
    assert all(len(set(theory.mela_to_degrees_by_index(i))) == 7 for i in range(1, 73))
    assert theory.mela_to_svara(1)[:4] == ["S", "R₁", "G₁", "G₂"] and theory.mela_to_svara(36, False, False)[9:] == ["Dha2", "Dha3", "Ni3"]
    assert theory.mela_to_svara(0) == ["?"] * 12


def test_keys():
    assert theory.key_to_degrees("C:maj") == [0, 2, 4, 5, 7, 9, 11] and theory.key_to_degrees("A:min") == [9, 11, 0, 2, 4, 5, 7]
    assert theory.key_to_degrees("Bb:loc") == [10, 11, 1, 3, 4, 6, 8] and theory.key_to_degrees("C") is None and theory.key_to_degrees("C:x") is None
    assert theory.key_to_notes("Eb:maj", False)[3] == "Eb" and theory.key_to_notes("E:maj", False)[3] == "D#" and theory.key_to_notes("H:maj") == ["?"] * 12
    assert theory.note_to_pitch_class("Cb") == 11 and theory.note_to_pitch_class("f♯") == 6 and theory.note_to_pitch_class("") is None
    assert [theory.fifths_to_note("C", n, False) for n in (0, 1, -1, 6, -6, 7, 14, -8)] == ["C", "G", "F", "F#", "Gb", "C#", "C##", "Fb"]
    with pytest.raises(ValueError):
        theory.fifths_to_note("", 1)


def test_intervals():
    assert theory.pythagorean_intervals(3, False) == pytest.approx([1, 1.5, 1.125]) and theory.pythagorean_intervals(0) == []
    assert theory.plimit_intervals([3], 3) == pytest.approx(sorted([1, 1.5, 4 / 3]))
    five = theory.plimit_intervals([3, 5], 12)
    assert len(five) == 12 and five[0] == 1 and min(abs(x - 1.25) for x in five) < 1e-9 and theory.plimit_intervals([2], 5) == []
    assert theory.interval_frequencies(24, 100, "equal")[12] == pytest.approx(200) and theory.interval_frequencies(5, 100, "x") == []
    assert theory.interval_frequencies(3, 100, "ji3", 2, 0.0, False)[2] == pytest.approx(200)
    assert theory.interval_frequencies_custom(4, 10, [1, 1.5, 3]) == [10, 15, 20, 30]


def test_just_names(spark):
    name = lambda x, u="C", uni=False: one(spark, theory.interval_to_fjs(F.col("v"), F.lit(u), uni), v=float(x))
    assert [name(x) for x in (1.0, 1.5, 4 / 3, 1.25, 1.2, 1.75, 0.0)] == ["C", "G", "F", "E^5", "Eb^5", "Bb^7", "?"]
    assert name(1.25, uni=True) == "E⁵" and name(10 / 9) == "D_5" and name(1.25, "G") == "B^5"
    assert one(spark, theory.hz_to_fjs(F.col("v"), F.lit(261.63), None, False), v=392.44) == "G" and one(spark, theory.hz_to_fjs(F.col("v")), v=-1.0) == "?"
    df = theory.hz_to_fjs_batch(spark.createDataFrame([(440.0,), (660.0,)], "f double"), "f", unicode=False)
    assert [r["fjs"] for r in df.orderBy("f").collect()] == ["A", "E"]


def test_svara(spark):
    h = lambda m, **k: one(spark, theory.midi_to_svara_h(F.col("m"), F.lit(60), **k), m=m)
    assert [h(60), h(61), h(72, unicode=False), h(47, unicode=False), h(72), h(47, abbr=False)] == ["S", "r", "S^1", "N_2", "S\u0307", "Ni" + "\u0323" * 2]
    c = lambda m, **k: one(spark, theory.midi_to_svara_c(F.col("m"), F.lit(60), 1, **k), m=m)
    assert [c(62, unicode=False), c(74, unicode=False), c(50, unicode=False), c(84, unicode=False), c(72)] == ["G1", "G1'", "G1,", "S", "S\u0307"]
    assert one(spark, theory.note_to_svara_h(F.col("n"), F.lit("C4")), n="D4") == "R" and one(spark, theory.note_to_svara_h(F.col("n"), F.lit("C4")), n="Db4") == "?"
    assert one(spark, theory.note_to_svara_c(F.col("n"), F.lit("C4"), 1, unicode=False), n="D4") == "G1" and one(spark, theory.hz_to_svara_c(F.col("v"), F.lit(0.0), 1), v=1.0) == "?"
    assert one(spark, theory.midi_to_svara_c(F.col("m"), F.lit(60), 99), m=60) == "?"


def test_notes(spark):
    n = lambda x: one(spark, scales.note_to_midi(F.col("n")), n=x)
    assert [n("A4"), n(" c#-1 "), n("Bb3"), n("x"), n("C")] == [69, 1, None, None, None]
    assert one(spark, scales.midi_to_note(F.col("m")), m=-1) == "B-2" and one(spark, scales.hz_to_note(F.col("v")), v=0.0) == "N/A"
    assert one(spark, scales.hz_to_midi(F.col("v")), v=-5.0) == 0.0 and one(spark, scales.hz_to_octs(F.col("v")), v=0.0) == float("-inf")
    assert one(spark, scales.a_weighting(F.col("v")), v=1000.0) == pytest.approx(0, abs=0.05) and one(spark, scales.a_weighting(F.col("v")), v=0.0) == -80.0
    assert one(spark, scales.perceptual_weighting(F.col("v"), "C"), v=0.0) == float("-inf") and one(spark, scales.frequency_weighting(F.col("v"), "q"), v=5.0) == 0.0
    assert one(spark, scales.mu_expand(scales.mu_compress(F.col("v"))), v=-0.3) == pytest.approx(-0.3)
    with pytest.raises(ValueError):
        scales.perceptual_weighting(F.col("v"), "Z")
    with pytest.raises(Exception, match="whole"):
        one(spark, scales.valid_int(F.col("v"), "n"), v=1.5)


def test_times(spark):
    assert [one(spark, timing.time_to_frames(F.col("v"), 10, 4), v=v) for v in (0.2, 0.19, -3.0, float("nan"))] == [1, 0, 0, 0]
