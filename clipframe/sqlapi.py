"""The scalar conversions as SQL functions, which Catalyst inlines, and frames as a table function.

    register(spark)
    spark.sql("SELECT hz_to_mel(440D), note_name(60)")
    spark.sql("SELECT * FROM frames(ARRAY(1D, 2D, 3D, 4D), 2, 1)")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions.scales import MEL_BREAK, MEL_BREAK_HZ, MEL_HZ, MEL_LOG_STEP, NOTES

#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("hz_to_mel", "f DOUBLE", "DOUBLE", f"CASE WHEN f >= {MEL_BREAK_HZ}D THEN {MEL_BREAK}D + ln(f / {MEL_BREAK_HZ}D) / {MEL_LOG_STEP}D ELSE f / {MEL_HZ}D END"),
    ("mel_to_hz", "m DOUBLE", "DOUBLE", f"CASE WHEN m >= {MEL_BREAK}D THEN {MEL_BREAK_HZ}D * exp((m - {MEL_BREAK}D) * {MEL_LOG_STEP}D) ELSE m * {MEL_HZ}D END"),
    ("hz_to_midi", "f DOUBLE", "DOUBLE", "CASE WHEN f > 0 THEN 12D * log2(f / 440D) + 69D WHEN f <= 0 THEN 0D END"),
    ("midi_to_hz", "m DOUBLE", "DOUBLE", "440D * power(2D, (m - 69D) / 12D)"),
    ("note_name", "midi INT", "STRING", f"CASE WHEN midi IS NOT NULL THEN concat(element_at(array({', '.join(repr(n) for n in NOTES)}), coalesce(pmod(midi, 12), 0) + 1), CAST(CAST(floor(midi / 12D) - 1 AS INT) AS STRING)) END"),
    ("power_db", "x DOUBLE", "DOUBLE", "10D * log10(greatest(x, 1e-10D))"),
    ("amplitude_db", "x DOUBLE", "DOUBLE", "20D * log10(greatest(x, 1e-10D))"),
    ("frame_time", "t BIGINT, sr INT, hop INT", "DOUBLE", "CAST(t * hop AS DOUBLE) / sr"),
    ("time_frame", "s DOUBLE, sr INT, hop INT", "BIGINT", "CAST(greatest(round(s * sr / hop), 0D) AS BIGINT)"),
)


@udtf(returnType="t: bigint, i: bigint, y: double")
class Frames:
    """Rows (t, i, y) of every whole frame of an array."""

    def eval(self, y: list, frame_length: int, hop_length: int) -> Iterator[tuple]:
        for t, start in enumerate(range(0, len(y or ()) - frame_length + 1, hop_length)):
            for i in range(frame_length):
                yield t, i, y[start + i]


def register(spark: SparkSession) -> None:
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("frames", Frames)
