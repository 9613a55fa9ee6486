"""Music theory: scales, svara, keys, circle of fifths and just-intonation names.

Small tables are Python values on the driver; whatever maps a column is a column expression over literal arrays.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scales

# Scale degrees of the Hindustani thaats.
THAATS = {
    "bilaval": (0, 2, 4, 5, 7, 9, 11),
    "khamaj": (0, 2, 4, 5, 7, 9, 10),
    "kafi": (0, 2, 3, 5, 7, 9, 10),
    "asavari": (0, 2, 3, 5, 7, 8, 10),
    "bhairavi": (0, 1, 3, 5, 7, 8, 10),
    "kalyan": (0, 2, 4, 6, 7, 9, 11),
    "marva": (0, 1, 4, 6, 7, 9, 11),
    "poorvi": (0, 1, 4, 6, 7, 8, 11),
    "todi": (0, 1, 3, 6, 7, 8, 11),
    "bhairav": (0, 1, 4, 5, 7, 8, 11),
}
# Names of the 72 melakarta ragas in order.
MELAS = """
kanakangi ratnangi ganamurthi vanaspathi manavathi tanarupi senavathi hanumathodi dhenuka natakapriya kokilapriya
rupavathi gayakapriya vakulabharanam mayamalavagaula chakravakom suryakantham hatakambari jhankaradhwani
natabhairavi keeravani kharaharapriya gaurimanohari varunapriya mararanjini charukesi sarasangi harikambhoji
dheerasankarabharanam naganandini yagapriya ragavardhini gangeyabhushani vagadheeswari sulini chalanatta salagam
jalarnavam jhalavarali navaneetham pavani raghupriya gavambodhi bhavapriya subhapanthuvarali shadvidhamargini
suvarnangi divyamani dhavalambari namanarayani kamavardhini ramapriya gamanasrama viswambhari syamalangi
shanmukhapriya simhendramadhyamam hemavathi dharmavathi neethimathi kanthamani rishabhapriya latangi vachaspathi
mechakalyani chitrambari sucharitra jyotisvarupini dhatuvardhini nasikabhushani kosalam rasikapriya
""".split()
# Modes by their names.
MODES = {
    ("maj", "major", "ion", "ionian"): (0, 2, 4, 5, 7, 9, 11),
    ("min", "minor", "aeo", "aeolian"): (0, 2, 3, 5, 7, 8, 10),
    ("dor", "dorian"): (0, 2, 3, 5, 7, 9, 10),
    ("phr", "phryg", "phrygian"): (0, 1, 3, 5, 7, 8, 10),
    ("lyd", "lydian"): (0, 2, 4, 6, 7, 9, 11),
    ("mix", "mixolyd", "mixolydian"): (0, 2, 4, 5, 7, 9, 10),
    ("loc", "locr", "locrian"): (0, 1, 3, 5, 6, 8, 10),
}
MAJOR = ("maj", "major", "ion", "ionian")
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
FIFTHS = "FCGDAEB"
SHARP, FLAT = "#♯", "b♭!"
# Hindustani names, short and full.
SVARA_H = ("S", "r", "R", "g", "G", "m", "M", "P", "d", "D", "n", "N"), ("Sa", "re", "Re", "ga", "Ga", "ma", "Ma", "Pa", "dha", "Dha", "ni", "Ni")
# Just intervals as (ratio to six places, powers of 5 and 7).
JUST = (
    (1.0, 0, 0), (1.067871, 0, 0), (1.125, 0, 0), (1.185185, 0, 0), (1.265625, 0, 0), (1.333333, 0, 0), (1.423828, 0, 0),
    (1.5, 0, 0), (1.580247, 0, 0), (1.6875, 0, 0), (1.777778, 0, 0), (1.898438, 0, 0),
    (1.041667, 1, 0), (1.066667, -1, 0), (1.111111, -1, 0), (1.2, 1, 0), (1.25, 1, 0), (1.6, 1, 0), (1.666667, 1, 0),
    (1.8, -1, 0), (1.875, 1, 0),
    (1.166667, 0, 1), (1.142857, 0, -1), (1.285714, 0, -1), (1.4, 0, 1), (1.428571, 1, -1), (1.75, 0, 1), (1.714286, 0, -1),
)
NEAR, FIFTH_TOLERANCE, MOST_FIFTHS = 0.001, 65.0 / 63.0, 31


def list_thaat() -> list[str]:
    return list(THAATS)


def list_mela() -> list[tuple[str, int]]:
    return [(name, i) for i, name in enumerate(MELAS, 1)]


def thaat_to_degrees(thaat: str) -> list[int] | None:
    found = THAATS.get(thaat.lower())
    return list(found) if found else None


def mela_to_degrees_by_index(mela: int) -> list[int] | None:
    """Degrees of a melakarta: the pairs (Ri, Ga) and (Dha, Ni) run through their six orders, Ma is raised from 37 on."""
    if not 1 <= mela <= 72:
        return None
    pairs = list(itertools.combinations((0, 1, 2, 3), 2))
    ri, ga = pairs[(mela - 1) % 36 // 6]
    dha, ni = pairs[(mela - 1) % 6]
    return [0, ri + 1, ga + 1, 5 if mela <= 36 else 6, 7, dha + 8, ni + 8]


def mela_to_degrees(mela: str) -> list[int] | None:
    return mela_to_degrees_by_index(MELAS.index(mela.lower()) + 1) if mela.lower() in MELAS else None


def mela_to_svara(mela: int, abbr: bool = True, unicode: bool = True) -> list[str]:
    """Names of the twelve semitones in a melakarta; "?" twelve times outside 1..72."""
    if not 1 <= mela <= 72:
        return ["?"] * 12
    s, r, g, m, p, d, n = ("S", "R", "G", "M", "P", "D", "N") if abbr else ("Sa", "Ri", "Ga", "Ma", "Pa", "Dha", "Ni")
    low, high = (mela - 1) % 36, (mela - 1) % 6
    names = [s, r + "1", g + "1" if low < 6 else r + "2", g + "2" if low < 30 else r + "3", g + "3", m + "1", m + "2", p, d + "1", n + "1" if high == 0 else d + "2", d + "3" if high == 5 else n + "2", n + "3"]
    return [x.translate(str.maketrans("123", "₁₂₃")) for x in names] if unicode else names


def note_to_pitch_class(note: str) -> int | None:
    if not note or note[0].upper() not in LETTERS:
        return None
    return (LETTERS[note[0].upper()] + sum(c in SHARP for c in note[1:]) - sum(c in FLAT for c in note[1:])) % 12


def key_to_degrees(key: str) -> list[int] | None:
    """Pitch classes of a key "tonic:mode"."""
    tonic, _, mode = key.partition(":")
    pitch = note_to_pitch_class(tonic)
    scale = next((v for k, v in MODES.items() if mode.lower() in k), None)
    return None if pitch is None or scale is None or ":" in mode else [(d + pitch) % 12 for d in scale]


def key_to_notes(key: str, unicode: bool = True) -> list[str]:
    """Spelling of the twelve pitch classes in a key: sharps or flats by its tonic, else by the circle of fifths."""
    tonic, _, mode = key.partition(":")
    pitch = note_to_pitch_class(tonic)
    if pitch is None or key.count(":") != 1:
        return ["?"] * 12
    sharps = any(c in tonic for c in "#♯")
    if not sharps and not any(c in tonic for c in "b♭"):
        sharps = (pitch if mode.lower() in MAJOR else pitch + 3) * 7 % 12 < 6
    sign = ("♯" if unicode else "#") if sharps else ("♭" if unicode else "b")
    natural = {v: k for k, v in LETTERS.items()}
    return [natural.get(i) or natural[i - 1 if sharps else i + 1] + sign for i in range(12)]


def fifths_to_note(unison: str, fifths: int, unicode: bool = True) -> str:
    """Name of the note so many fifths above ``unison``."""
    if not unison:
        raise ValueError("unison must be a note name")
    at = FIFTHS.find(unison[0].upper())
    turn, place = divmod((at if at >= 0 else 1) + fifths, 7)
    count = turn + sum(c in SHARP for c in unison[1:]) - sum(c in FLAT for c in unison[1:])
    one, two = (("♯", "𝄪") if count >= 0 else ("♭", "𝄫")) if unicode else (("#", "##") if count >= 0 else ("b", "bb"))
    return FIFTHS[place] + two * (abs(count) // 2) + one * (abs(count) % 2)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def midi_to_svara_h(midi: Column, sa: Column, abbr: bool = True, unicode: bool = True) -> Column:
    """Hindustani name; octaves from Sa are dots, or ^n and _n."""
    step = midi - sa
    name = scales.named(SVARA_H[0 if abbr else 1], F.pmod(step, F.lit(12)))
    octave = F.floor(step / F.lit(12.0)).cast("int")
    mark = (lambda sign, dot, n: F.repeat(F.lit(dot), n)) if unicode else (lambda sign, dot, n: F.concat(F.lit(sign), n.cast("string")))
    return F.when(octave < 0, F.concat(name, mark("_", "\u0323", -octave))).when(octave > 0, F.concat(name, mark("^", "\u0307", octave))).otherwise(name)


def midi_to_svara_c(midi: Column, sa: Column, mela: int, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    """Carnatic name in a melakarta; only the octaves next to that of Sa are marked."""
    names = mela_to_svara(mela, abbr, unicode)
    if names[0] == "?":
        return F.when(midi.isNotNull(), F.lit("?"))
    step = midi - sa
    name = scales.named(names, F.pmod(step, F.lit(12)))
    if not octave:
        return name

    def mark(dot, sign):
        return F.concat(F.substring(name, 1, 1), F.lit(dot), F.substring(name, 2, 99)) if unicode else F.concat(name, F.lit(sign))

    return F.when(step.between(12, 23), mark("\u0307", "'")).when(step.between(-12, -1), mark("\u0323", ",")).otherwise(name)


def _rounded_midi(f: Column) -> Column:
    return F.round(scales.hz_to_midi(f)).cast("int")


def hz_to_svara_h(f: Column, sa: Column, abbr: bool = True, unicode: bool = True) -> Column:
    return F.when((f > 0) & (sa > 0), midi_to_svara_h(_rounded_midi(f), _rounded_midi(sa), abbr, unicode)).otherwise("?")


def hz_to_svara_c(f: Column, sa: Column, mela: int, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return F.when((f > 0) & (sa > 0), midi_to_svara_c(_rounded_midi(f), _rounded_midi(sa), mela, abbr, octave, unicode)).otherwise("?")


def note_to_svara_h(note: Column, sa: Column, abbr: bool = True, unicode: bool = True) -> Column:
    return F.coalesce(midi_to_svara_h(scales.note_to_midi(note), scales.note_to_midi(sa), abbr, unicode), F.lit("?"))


def note_to_svara_c(note: Column, sa: Column, mela: int, abbr: bool = True, octave: bool = True, unicode: bool = True) -> Column:
    return F.coalesce(midi_to_svara_c(scales.note_to_midi(note), scales.note_to_midi(sa), mela, abbr, octave, unicode), F.lit("?"))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fifths_of(interval: Column) -> Column:
    """Fewest fifths (1 before -1) that come near the interval up to octaves; 0 if none of up to 31 do."""
    tried = [0, *(s * p for p in range(1, MOST_FIFTHS + 1) for s in (1, -1))]
    tolerance = math.log2(FIFTH_TOLERANCE)

    def near(x):
        off = F.log2(interval) - x * F.lit(math.log2(1.5))
        return F.abs(off - F.round(off)) <= F.lit(tolerance)

    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, tried)), near), F.lit(0)), F.lit(0))


def interval_to_fjs(interval: Column, unison: Column, unicode: bool = True) -> Column:
    """Name of an interval above ``unison``: a note of the circle of fifths and its factors above 3."""
    one, two = ("♯", "𝄪") if unicode else ("#", "##")
    flat, double = ("♭", "𝄫") if unicode else ("b", "bb")

    def spelled(fifths):
        at = F.array_position(_strings(FIFTHS), F.upper(F.substring(unison, 1, 1))).cast("int") - 1
        place = F.when(at >= 0, at).otherwise(1) + fifths
        signs = F.substring(unison, 2, 99)
        count = lambda chars: F.char_length(signs) - F.char_length(F.translate(signs, chars, ""))
        n = F.floor(place / F.lit(7.0)).cast("int") + count(SHARP) - count(FLAT)
        note = scales.named(FIFTHS, F.pmod(place, F.lit(7)))
        ups = lambda a, b, k: F.concat(F.repeat(F.lit(a), F.floor(k / F.lit(2.0)).cast("int")), F.repeat(F.lit(b), k % 2))
        return F.concat(note, F.when(n >= 0, ups(two, one, n)).otherwise(ups(double, flat, -n)))

    folded = interval * F.pow(F.lit(2.0), -F.floor(F.log2(interval)))
    table = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("five"), F.lit(b).alias("seven"), F.lit(i).alias("i")) for i, (r, a, b) in enumerate(JUST)])

    def suffix(x):
        rows = F.filter(F.transform(table, lambda t: F.struct(F.abs(x - t["r"]).alias("d"), t["i"].alias("i"), t["five"].alias("five"), t["seven"].alias("seven"))), lambda t: t["d"] < NEAR)
        best = F.get(F.array_sort(rows), F.lit(0))
        power = lambda sign: F.when(best["five"] == sign, 5).otherwise(1) * F.when(best["seven"] == sign, 7).otherwise(1)
        digits = lambda n, to: F.translate(n.cast("string"), "0123456789", to)
        up = digits(power(1), "⁰¹²³⁴⁵⁶⁷⁸⁹") if unicode else F.concat(F.lit("^"), power(1).cast("string"))
        down = digits(power(-1), "₀₁₂₃₄₅₆₇₈₉") if unicode else F.concat(F.lit("_"), power(-1).cast("string"))
        return F.concat(F.when(power(1) > 1, up).otherwise(""), F.when(power(-1) > 1, down).otherwise(""))

    return F.when(interval > 0, F.concat(_let(fifths_of(interval), spelled), _let(folded, suffix))).otherwise("?")


def hz_to_fjs(f: Column, fmin: Column | None = None, unison: Column | None = None, unicode: bool = True) -> Column:
    """Name of f above fmin (f itself if none); the unison defaults to the note of fmin."""
    base = f if fmin is None else fmin
    name = F.regexp_replace(scales.hz_to_note(base), r"\d+$", "") if unison is None else unison
    return F.when((f > 0) & (base > 0), interval_to_fjs(f / base, name, unicode)).otherwise("?")


def hz_to_fjs_batch(df: DataFrame, f: str, name: str = "fjs", unison: str | None = None, unicode: bool = True) -> DataFrame:
    """``df`` with the name of each frequency above the least one of the table (one aggregate, joined as one row)."""
    least = df.agg(F.min(f).alias("__fmin"))
    return df.crossJoin(F.broadcast(least)).withColumn(name, hz_to_fjs(F.col(f), F.col("__fmin"), None if unison is None else F.lit(unison), unicode)).drop("__fmin")


def pythagorean_intervals(bins_per_octave: int, sort: bool = True) -> list[float]:
    logs = [k * math.log2(3.0) % 1.0 for k in range(bins_per_octave)]
    return [2.0**x for x in (sorted(logs) if sort else logs)]


def plimit_intervals(primes, bins_per_octave: int, sort: bool = True) -> list[float]:
    """Just intervals grown from 1: always the neighbour of least total harmonic distance to those already in.

    The distance of two points is the log-prime size of their difference, counted twice where a power goes from
    numerator to denominator; ties go to the smaller point, then to the earlier one.
    """
    odd = [p for p in primes if p > 2]
    if not odd or bins_per_octave <= 0:
        return []
    logs = [math.log2(p) for p in odd]

    def distance(a, b):
        parts = (x + y - 2 * (min(max(x, 0), max(y, 0)) - max(max(-x, 0), max(-y, 0))) for x, y in zip(a, b))
        return round(sum(g * w for g, w in zip(parts, logs)), 6)

    steps = [tuple(s * (i == j) for j in range(len(odd))) for i in range(len(odd)) for s in (1, -1)]
    chosen, open_ = [(0,) * len(odd)], dict.fromkeys(steps)
    while len(chosen) < bins_per_octave:
        best = min(open_, key=lambda p: (round(sum(distance(p, c) for c in chosen), 5), sum(abs(x) * w for x, w in zip(p, logs))))
        del open_[best]
        chosen.append(best)
        for step in steps:
            new = tuple(a + b for a, b in zip(best, step))
            if new not in chosen:
                open_.setdefault(new)
    fractions = [sum(p * w for p, w in zip(point, logs)) % 1.0 for point in chosen]
    return [2.0**x for x in (sorted(fractions) if sort else fractions)]


def _tiled(ratios: list[float], n_bins: int, fmin: float, sort: bool) -> list[float]:
    out = [fmin * r * 2.0**octave for octave in range(math.ceil(n_bins / len(ratios))) for r in ratios][:n_bins] if ratios else []
    return sorted(out) if sort else out


def interval_frequencies(n_bins: int, fmin: float, intervals: str, bins_per_octave: int = 12, tuning: float = 0.0, sort: bool = True) -> list[float]:
    """Frequencies of a tuning system; an unknown one has none."""
    if fmin <= 0 or n_bins <= 0:
        return []
    limit = re.fullmatch(r"ji([357])", intervals)
    if intervals == "equal":
        ratios = [2.0 ** ((tuning + i) / bins_per_octave) for i in range(bins_per_octave)]
    elif intervals == "pythagorean":
        ratios = pythagorean_intervals(bins_per_octave, sort)
    elif limit:
        ratios = plimit_intervals([p for p in (3, 5, 7) if p <= int(limit[1])], bins_per_octave, sort)
    else:
        ratios = []
    return _tiled(ratios, n_bins, fmin, sort)


def interval_frequencies_custom(n_bins: int, fmin: float, custom, sort: bool = True) -> list[float]:
    return _tiled([r for r in custom if 1.0 <= r < 2.0], n_bins, fmin, sort) if fmin > 0 and n_bins > 0 else []
