"""Pitch and loudness scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slaney's mel scale is linear to 1000 Hz (mel 15), then logarithmic.
MEL_HZ = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_BREAK = 15.0
MEL_LOG_STEP = 0.068751777
# Corner frequencies of the weighting curves and their gains at 1 kHz.
A_CORNERS = (20.6, 107.7, 737.9, 12194.0)
B_CORNERS = (20.6, 158.5, 12194.0)
C_CORNERS = (20.6, 12194.0)
GAINS = {"A": 2.0, "B": 0.17, "C": 0.06}
D_ZERO, D_ZERO_WIDTH, D_POLE, D_POLE_WIDTH = 1037918.5, 1080768.1, 9837328.0, 11723776.0
D_SCALE, D_LOW, D_HIGH, D_UNIT = 6.896689e-5, 79919.29, 1345600.0, 0.456
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")

NEG_INF = float("-inf")


def _positive(f: Column, value: Column, otherwise: float) -> Column:
    """``value`` above zero, ``otherwise`` at zero and below; null stays null."""
    return F.when(f > 0, value).when(f <= 0, F.lit(otherwise))


def _log2(x: Column) -> Column:
    """As IEEE has it: -inf at zero, NaN below (the built-in gives null)."""
    return F.when(x == 0, F.lit(NEG_INF)).when(x < 0, F.lit(float("nan"))).otherwise(F.log2(x))


def named(names, place: Column) -> Column:
    """The name at a 0-based place; null where the place is null (under code generation element_at gives the last)."""
    return F.when(place.isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.coalesce(place.cast("int"), F.lit(0)) + 1))


def hz_to_mel(f: Column, htk: bool = False) -> Column:
    if htk:
        return F.lit(2595.0) * F.log10(F.lit(1.0) + f / F.lit(700.0))
    return F.when(f >= MEL_BREAK_HZ, F.lit(MEL_BREAK) + F.ln(f / F.lit(MEL_BREAK_HZ)) / F.lit(MEL_LOG_STEP)).otherwise(f / F.lit(MEL_HZ))


def mel_to_hz(m: Column, htk: bool = False) -> Column:
    if htk:
        return F.lit(700.0) * (F.pow(F.lit(10.0), m / F.lit(2595.0)) - F.lit(1.0))
    return F.when(m >= MEL_BREAK, F.lit(MEL_BREAK_HZ) * F.exp((m - F.lit(MEL_BREAK)) * F.lit(MEL_LOG_STEP))).otherwise(m * F.lit(MEL_HZ))


def _c0(tuning: float, bins_per_octave: int) -> float:
    return 440.0 * 2.0 ** (tuning / bins_per_octave) / 16.0


def hz_to_octs(f: Column, tuning: float = 0.0, bins_per_octave: int = 12) -> Column:
    return _positive(f, F.log2(f / F.lit(_c0(tuning, bins_per_octave))), NEG_INF)


def octs_to_hz(o: Column, tuning: float = 0.0, bins_per_octave: int = 12) -> Column:
    return F.lit(_c0(tuning, bins_per_octave)) * F.pow(F.lit(2.0), o)


def hz_to_midi(f: Column, guard: bool = True) -> Column:
    """0 at zero and below; without ``guard`` the bare formula (-inf and NaN)."""
    midi = F.lit(12.0) * _log2(f / F.lit(440.0)) + F.lit(69.0)
    return _positive(f, midi, 0.0) if guard else midi


def midi_to_hz(m: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (m - F.lit(69.0)) / F.lit(12.0))


def a4_to_tuning(a4: Column) -> Column:
    return F.lit(12.0) * _log2(a4 / F.lit(440.0))


def tuning_to_a4(t: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), t / F.lit(12.0))


def midi_to_note(midi: Column) -> Column:
    """Name with sharps and octave; also for negative numbers (octave by floor)."""
    return F.concat(named(NOTES, F.pmod(midi, F.lit(12))), (F.floor(midi / F.lit(12.0)) - 1).cast("int").cast("string"))


def hz_to_note(f: Column) -> Column:
    return F.when(f > 0, midi_to_note(F.round(hz_to_midi(f)).cast("int"))).when(f <= 0, "N/A")


def note_to_midi(note: Column) -> Column:
    """Number of a name of sharps and an octave; null for anything else, flats included."""
    n = F.upper(F.trim(note))
    parts = r"^([A-G]#?)([+-]?\d+)$"
    place = F.array_position(F.array(*map(F.lit, NOTES)), F.regexp_extract(n, parts, 1)).cast("int") - 1
    octave = F.regexp_extract(n, parts, 2).try_cast("int")
    return F.when(n.rlike(parts) & (place >= 0), place + (octave + 1) * 12)


def note_to_hz(note: Column) -> Column:
    return midi_to_hz(note_to_midi(note).cast("double"))


def _ratio(f: Column, kind: str) -> Column:
    """The curve of a weighting before decibels, by products of its corner frequencies."""
    f2 = f * f
    at = lambda corner: f2 + F.lit(corner * corner)
    if kind == "A":
        a, b, c, d = A_CORNERS
        return F.lit(d * d) * f2 * f2 / (at(a) * F.sqrt(at(b) * at(c)) * at(d))
    if kind == "B":
        a, b, d = B_CORNERS
        return F.lit(d * d) * f2 * f / (at(a) * F.sqrt(at(b)) * at(d))
    a, d = C_CORNERS
    return F.lit(d * d) * f2 / (at(a) * at(d))


def _abc(f: Column, kind: str) -> Column:
    return F.lit(20.0) * F.log10(_ratio(f, kind)) + F.lit(GAINS[kind])


def _d_shape(f: Column) -> Column:
    f2 = f * f
    return (F.pow(F.lit(D_ZERO) - f2, F.lit(2.0)) + F.lit(D_ZERO_WIDTH) * f2) / (F.pow(F.lit(D_POLE) - f2, F.lit(2.0)) + F.lit(D_POLE_WIDTH) * f2)


def _floor(f: Column, db: Column, min_db: float) -> Column:
    return F.when(f > 0, F.greatest(db, F.lit(min_db))).otherwise(F.lit(min_db))


def a_weighting(f: Column, min_db: float = -80.0) -> Column:
    return _floor(f, _abc(f, "A"), min_db)


def b_weighting(f: Column, min_db: float = -80.0) -> Column:
    return _floor(f, _abc(f, "B"), min_db)


def c_weighting(f: Column, min_db: float = -80.0) -> Column:
    return _floor(f, _abc(f, "C"), min_db)


def d_weighting(f: Column, min_db: float = -80.0, guard: bool = True) -> Column:
    """``min_db`` at zero and below; without ``guard`` the formula there too (-32.2 at zero), floored like the rest."""
    db = F.lit(20.0) * F.log10(_d_shape(f) / F.lit(D_UNIT))
    return _floor(f, db, min_db) if guard else F.greatest(db, F.lit(min_db))


def z_weighting(f: Column) -> Column:
    return F.when(f.isNotNull(), F.lit(0.0))


def frequency_weighting(f: Column, kind: str, min_db: float = -80.0) -> Column:
    """By name, in any case; an unknown name is flat."""
    found = {"A": a_weighting, "B": b_weighting, "C": c_weighting, "D": d_weighting}.get(kind.upper())
    return found(f, min_db) if found else z_weighting(f)


def multi_frequency_weighting(f: Column, kinds, min_db: float = -80.0) -> Column:
    """Array with a value for each kind; ``kinds`` is a string of letters or a list of names."""
    return F.array(*[frequency_weighting(f, k, min_db) for k in kinds])


def perceptual_weighting(f: Column, kind: str) -> Column:
    """Unfloored curves, -inf where f isn't positive; D is the full formula."""
    if kind not in ("A", "B", "C", "D"):
        raise ValueError(f"unknown weighting {kind!r}")
    f2 = f * f
    if kind == "D":
        db = F.lit(20.0) * F.log10(f / F.lit(D_SCALE) * F.sqrt(_d_shape(f) / ((f2 + F.lit(D_LOW)) * (f2 + F.lit(D_HIGH)))))
    else:
        db = _abc(f, kind)
    return _positive(f, db, NEG_INF)


def amplitude_db(x: Column, ref: float = 1.0, amin: float = 1e-10, factor: float = 20.0) -> Column:
    """Decibels before any floor at the top."""
    import math

    return F.lit(factor) * F.log10(F.greatest(x, F.lit(amin))) - F.lit(factor * math.log10(max(ref, amin)))


def db_to_power(db: Column, ref: float = 1.0) -> Column:
    return F.lit(ref) * F.pow(F.lit(10.0), db / F.lit(10.0))


def db_to_amplitude(db: Column, ref: float = 1.0) -> Column:
    return F.lit(ref) * F.pow(F.lit(10.0), db / F.lit(20.0))


def mu_compress(x: Column, mu: float = 255.0) -> Column:
    import math

    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.log1p(F.lit(mu) * F.abs(x)) / F.lit(math.log1p(mu))


def mu_expand(y: Column, mu: float = 255.0) -> Column:
    return F.when(y < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - F.lit(1.0)) / F.lit(mu)


def abs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def phasor(angle: Column) -> Column:
    return F.struct(F.cos(angle).alias("re"), F.sin(angle).alias("im"))


def i16_to_float(x: Column) -> Column:
    return x / F.lit(32768.0)


def i32_to_float(x: Column) -> Column:
    return x / F.lit(2147483648.0)


def is_positive_int(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf")) & (x > 0) & (x == F.floor(x))


def valid_int(x: Column, name: str) -> Column:
    """x, or an error if it isn't finite and whole."""
    ok = ~F.isnan(x) & (F.abs(x) != float("inf")) & (x == F.floor(x))
    return F.when(ok, x).otherwise(F.raise_error(F.lit(f"{name} must be a whole number")).cast("double"))
