"""Null in, null out: scalar functions on nulls and zeros, with code generation and without."""

import math

import pytest
from pyspark.sql import functions as F

from clipframe import sqlapi
from clipframe.functions import scales, theory

#: Of a frequency or another double.
DOUBLES = {
    "hz_to_mel": scales.hz_to_mel, "mel_to_hz": scales.mel_to_hz, "hz_to_octs": scales.hz_to_octs, "octs_to_hz": scales.octs_to_hz, "hz_to_midi": scales.hz_to_midi, "midi_to_hz": scales.midi_to_hz,
    "a4_to_tuning": scales.a4_to_tuning, "tuning_to_a4": scales.tuning_to_a4, "hz_to_note": scales.hz_to_note, "z_weighting": scales.z_weighting, "perceptual_a": lambda f: scales.perceptual_weighting(f, "A"),
    "perceptual_d": lambda f: scales.perceptual_weighting(f, "D"), "db_to_power": scales.db_to_power, "db_to_amplitude": scales.db_to_amplitude, "mu_compress": scales.mu_compress, "mu_expand": scales.mu_expand,
    "i16_to_float": scales.i16_to_float, "i32_to_float": scales.i32_to_float, "is_positive_int": scales.is_positive_int,
}
WHOLE = {
    "midi_to_note": scales.midi_to_note, "svara_h": lambda m: theory.midi_to_svara_h(m, F.lit(60)), "svara_c": lambda m: theory.midi_to_svara_c(m, F.lit(60), 1),
    "svara_h_of_null": lambda m: theory.midi_to_svara_h(F.lit(60), m), "svara_c_of_null": lambda m: theory.midi_to_svara_c(F.lit(60), m, 1),
}


@pytest.fixture(params=["CODEGEN_ONLY", "NO_CODEGEN"])
def session(spark, request):
    spark.conf.set("spark.sql.codegen.factoryMode", request.param)
    spark.conf.set("spark.sql.codegen.wholeStage", str(request.param == "CODEGEN_ONLY").lower())
    yield spark
    spark.conf.unset("spark.sql.codegen.factoryMode")
    spark.conf.unset("spark.sql.codegen.wholeStage")


def test_null_gives_null(session):
    d = session.createDataFrame([(None, None)], "x double, m int")
    row = d.select(*[f(F.col("x")).alias(k) for k, f in DOUBLES.items()], *[f(F.col("m")).alias(k) for k, f in WHOLE.items()]).first()
    assert {k: v for k, v in row.asDict().items() if v is not None} == {}


def test_notes_that_are_none(session):
    d = session.createDataFrame([("Db4",), (None,), ("",)], "n string")
    for f in (lambda n: theory.note_to_svara_h(n, F.lit("C4")), lambda n: theory.note_to_svara_c(n, F.lit("C4"), 1), lambda n: theory.note_to_svara_h(F.lit("C4"), n)):
        assert [r[0] for r in d.select(f(F.col("n"))).collect()] == ["?"] * 3
    assert [r[0] for r in d.select(scales.note_to_midi(F.col("n"))).collect()] == [None] * 3


def test_floors(session):
    """A weighting of a missing frequency is its floor, as it is of zero."""
    d = session.createDataFrame([(None,), (0.0,), (-5.0,)], "f double")
    for kind in "ABCD":
        assert [r[0] for r in d.select(scales.frequency_weighting(F.col("f"), kind)).collect()] == [-80.0] * 3
    got = [list(r) for r in d.select(scales.hz_to_octs(F.col("f")), scales.hz_to_midi(F.col("f")), scales.hz_to_note(F.col("f")), scales.a4_to_tuning(F.col("f"))).collect()]
    assert got[0] == [None] * 4 and got[1] == [-math.inf, 0.0, "N/A", -math.inf] and got[2][:3] == [-math.inf, 0.0, "N/A"] and math.isnan(got[2][3])


def test_sql_functions(session):
    sqlapi.register(session)
    row = session.sql("SELECT note_name(CAST(m AS INT)) AS a, hz_to_midi(x) AS b, hz_to_mel(x) AS c, mel_to_hz(x) AS d, midi_to_hz(x) AS e FROM VALUES (CAST(NULL AS DOUBLE), CAST(NULL AS INT)) v(x, m)").first()
    assert list(row) == [None] * 5
