"""Relational spectra: frames joined with small cosine and sine tables, and features of what comes out.

The Fourier sum over a joined basis suits short frames; long ones go through the Arrow kernels (see kernel.py).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scales
from ..plans import bases, windows
from .framing import frames


def fourier_basis(spark, n_fft: int, window: str | None = "hann") -> DataFrame:
    """(i, f, c, s): windowed cosine and minus sine; the phase is reduced before it is taken."""
    import pyarrow as pa

    i, f = (a.ravel() for a in np.meshgrid(np.arange(n_fft), np.arange(n_fft // 2 + 1), indexing="ij"))
    phase = 2.0 * np.pi * (i * f % n_fft) / n_fft
    w = (windows.get_window(window, n_fft) if window else np.ones(n_fft))[i]
    return spark.createDataFrame(pa.table({"i": i, "f": f, "c": w * np.cos(phase), "s": -w * np.sin(phase)}))


def stft(samples: DataFrame, n_fft: int, hop_length: int, center: bool = True, window: str | None = "hann") -> DataFrame:
    """spec(clip_id, t, f, re, im)."""
    basis = F.broadcast(fourier_basis(samples.sparkSession, n_fft, window))  # n_fft * (n_fft / 2 + 1) rows
    f = frames(samples, n_fft, hop_length, center).join(basis, "i")
    return f.groupBy("clip_id", "t", "f").agg(F.sum(F.col("y") * F.col("c")).alias("re"), F.sum(F.col("y") * F.col("s")).alias("im"))


def magnitude(spec: DataFrame) -> DataFrame:
    """feat(clip_id, t, k, x)."""
    return spec.select("clip_id", "t", F.col("f").alias("k"), F.sqrt(scales.abs2(F.col("re"), F.col("im"))).alias("x"))


def power(spec: DataFrame) -> DataFrame:
    return spec.select("clip_id", "t", F.col("f").alias("k"), scales.abs2(F.col("re"), F.col("im")).alias("x"))


def istft(spec: DataFrame, n_fft: int, hop_length: int, center: bool = True, window: str = "hann") -> DataFrame:
    """samples: distributed overlap-add, each sample from its few frames, divided by the sum of squared windows."""
    import pyarrow as pa

    spark = spec.sparkSession
    i, f = (a.ravel() for a in np.meshgrid(np.arange(n_fft), np.arange(n_fft // 2 + 1), indexing="ij"))
    weight = np.where((f == 0) | (2 * f == n_fft), 1.0, 2.0) / n_fft
    phase = 2.0 * np.pi * (i * f % n_fft) / n_fft
    w = windows.get_window(window, n_fft)[i]
    basis = F.broadcast(spark.createDataFrame(pa.table({"i": i, "f": f, "c": weight * np.cos(phase), "s": -weight * np.sin(phase), "w": w})))
    out = spec.join(basis, "f").groupBy("clip_id", "t", "i").agg(F.sum(F.col("re") * F.col("c") + F.col("im") * F.col("s")).alias("v"), F.first("w").alias("w"))
    pad = n_fft // 2 if center else 0
    last = spec.groupBy("clip_id").agg(((F.max("t") + 1) * hop_length).alias("len"))
    n = F.col("t") * hop_length + F.col("i") - pad
    added = out.withColumn("n", n).groupBy("clip_id", "n").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    y = F.when(F.col("w2") > 1e-8, F.col("v") / F.col("w2")).otherwise(F.col("v"))
    keep = added.join(last, "clip_id").where((F.col("n") >= 0) & (F.col("n") < F.col("len") + (0 if center else n_fft)))
    return keep.select("clip_id", F.col("n").cast("bigint").alias("n"), y.alias("y"))


def to_db(feat: DataFrame, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0, factor: float = 10.0, per_frame: bool = False) -> DataFrame:
    """Decibels; the floor is top_db below the maximum of the clip, or of the frame."""
    db = feat.withColumn("x", scales.amplitude_db(F.col("x"), ref, amin, factor))
    if top_db is None:
        return db
    top = F.max("x").over(Window.partitionBy("clip_id", "t") if per_frame else Window.partitionBy("clip_id"))
    return db.withColumn("x", F.greatest(F.col("x"), top - F.lit(top_db)))


def power_to_db(feat: DataFrame, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> DataFrame:
    return to_db(feat, ref, amin, top_db, 10.0)


def amplitude_to_db(feat: DataFrame, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> DataFrame:
    return to_db(feat, ref, amin, top_db, 20.0)


def spectral_centroid(feat: DataFrame, sr: float, n_fft: int) -> DataFrame:
    f = F.col("k") * F.lit(sr / n_fft)
    total = F.sum("x")
    return feat.groupBy("clip_id", "t").agg(F.when(total > 1e-10, F.sum(f * F.col("x")) / total).otherwise(0.0).alias("x"))


def spectral_bandwidth(feat: DataFrame, sr: float, n_fft: int) -> DataFrame:
    """Spread around the centroid, which a window over the frame finds without a join."""
    frame = Window.partitionBy("clip_id", "t")
    f = F.col("k") * F.lit(sr / n_fft)
    total = F.sum("x").over(frame)
    c = F.when(total > 1e-10, F.sum(f * F.col("x")).over(frame) / total).otherwise(0.0)
    own = feat.withColumn("d", F.pow(f - c, F.lit(2.0)))
    return own.groupBy("clip_id", "t").agg(F.when(F.sum("x") > 1e-10, F.sqrt(F.sum(F.col("d") * F.col("x")) / F.sum("x"))).otherwise(0.0).alias("x"))


def spectral_rolloff(feat: DataFrame, sr: float, n_fft: int, roll_percent: float = 0.85) -> DataFrame:
    """Frequency of the first bin at which the running sum reaches the share; the last bin if none does."""
    frame = Window.partitionBy("clip_id", "t")
    run = F.sum("x").over(frame.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    hit = feat.withColumn("hit", F.when(run >= F.lit(roll_percent) * F.sum("x").over(frame), F.col("k")))
    return hit.groupBy("clip_id", "t").agg((F.coalesce(F.min("hit"), F.max("k")) * F.lit(sr / n_fft)).alias("x"))


def spectral_flatness(feat: DataFrame, power: float = 2.0) -> DataFrame:
    p = F.pow(F.col("x"), F.lit(power))
    mean = F.avg(p)
    return feat.groupBy("clip_id", "t").agg(F.when(mean > 1e-10, F.exp(F.avg(F.ln(p + F.lit(1e-10)))) / mean).otherwise(0.0).alias("x"))


def poly_features(feat: DataFrame, n_bins: int, order: int = 1) -> DataFrame:
    """Least-squares coefficients over [0, 1], low powers first: moments times the inverse Gram matrix."""
    x = np.arange(n_bins) / max(n_bins - 1, 1)
    v = np.vander(x, order + 1, increasing=True)
    solve = np.linalg.pinv(v)  # (order + 1, bins)
    return contract(feat, solve)


def contract(feat: DataFrame, matrix: np.ndarray) -> DataFrame:
    """matrix @ feat for each frame: a join with the non-zero cells of a parameter matrix, and a sum."""
    table = F.broadcast(bases.long_table(feat.sparkSession, matrix, "m", "k", "w"))  # bounded by the parameters
    return feat.join(table, "k").groupBy("clip_id", "t", F.col("m").alias("k")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def all_rows(out: DataFrame, feat: DataFrame, n_rows: int) -> DataFrame:
    """Rows of zero for cells that no non-zero weight reached."""
    grid = feat.select("clip_id", "t").distinct().select("clip_id", "t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_rows - 1).cast("bigint"))).alias("k"))
    return grid.join(out, ["clip_id", "t", "k"], "left").select("clip_id", "t", "k", F.coalesce("x", F.lit(0.0)).alias("x"))


def melspectrogram(samples: DataFrame, sr: float, n_fft: int, hop_length: int, n_mels: int) -> DataFrame:
    p = power(stft(samples, n_fft, hop_length))
    return all_rows(contract(p, bases.mel_filterbank(sr, n_fft, n_mels)), p, n_mels)


def mel_to_stft(feat: DataFrame, sr: float, n_fft: int, n_mels: int) -> DataFrame:
    return all_rows(contract(feat, bases.mel_filterbank(sr, n_fft, n_mels).T), feat, n_fft // 2 + 1)


def dct_type_ii(feat: DataFrame, n_in: int, n_out: int) -> DataFrame:
    return contract(feat, bases.dct_basis(n_in, n_out))


def dct_type_iii(feat: DataFrame, n_in: int, n_out: int) -> DataFrame:
    return contract(feat, bases.dct_basis(n_out, n_in).T)


def mfcc(samples: DataFrame, sr: float, n_mfcc: int, n_fft: int, hop_length: int, n_mels: int) -> DataFrame:
    db = to_db(melspectrogram(samples, sr, n_fft, hop_length, n_mels), per_frame=True)
    return dct_type_ii(db, n_mels, n_mfcc)


def mfcc_to_mel(feat: DataFrame, n_mfcc: int, n_mels: int) -> DataFrame:
    return dct_type_iii(feat, n_mfcc, n_mels).withColumn("x", scales.db_to_power(F.col("x")))


def normalize_frames(feat: DataFrame, norm: str = "max") -> DataFrame:
    """Each frame by its sum ("l1"), length ("l2") or maximum; near-zero frames stay."""
    return _normalize(feat, Window.partitionBy("clip_id", "t"), norm)


def normalize_bins(feat: DataFrame, norm: str = "max") -> DataFrame:
    return _normalize(feat, Window.partitionBy("clip_id", "k"), norm)


def _normalize(feat: DataFrame, over, norm: str) -> DataFrame:
    size = {"l1": lambda: F.sum(F.abs("x")).over(over), "l2": lambda: F.sqrt(F.sum(F.col("x") * F.col("x")).over(over)), "max": lambda: F.max(F.abs("x")).over(over)}[norm]()
    return feat.withColumn("s", size).withColumn("x", F.when(F.col("s") > 1e-10, F.col("x") / F.col("s")).otherwise(F.col("x"))).drop("s")


def chroma_stft(samples: DataFrame, sr: float, n_fft: int, hop_length: int, n_chroma: int = 12, octwidth: float | None = 2.0) -> DataFrame:
    p = power(stft(samples, n_fft, hop_length))
    return normalize_frames(contract(p, bases.chroma_filterbank(sr, n_fft, n_chroma, 0.0, 5.0, octwidth, True)), "max")


def tonnetz(chroma: DataFrame) -> DataFrame:
    """Six coordinates of each frame of twelve pitch classes."""
    total = F.sum("x").over(Window.partitionBy("clip_id", "t"))
    unit = chroma.withColumn("x", F.when(total > 1e-10, F.col("x") / total).otherwise(0.0))
    return contract(unit, np.where(np.abs(bases.tonnetz_basis()) < 1e-12, 1e-300, bases.tonnetz_basis()))


def spectral_contrast(mag: DataFrame, sr: float, n_fft: int, n_bands: int, fmin: float) -> DataFrame:
    """Of magnitudes: mean of the highest over mean of the lowest bins of each band, in decibels."""
    spark = mag.sparkSession
    rows = [(k, b, q) for k, first, last, q in bases.contrast_bands(sr, n_fft, n_bands, fmin) for b in range(first, last + 1)]
    table = F.broadcast(spark.createDataFrame(rows, "band long, k long, q long"))
    own = mag.join(table, "k")
    band = Window.partitionBy("clip_id", "t", "band")
    ranked = own.withColumn("up", F.row_number().over(band.orderBy("x", "k"))).withColumn("down", F.row_number().over(band.orderBy(F.col("x").desc(), F.col("k").desc())))
    mean = lambda rank: F.sum(F.when(F.col(rank) <= F.col("q"), F.col("x"))) / F.max("q")
    both = ranked.groupBy("clip_id", "t", "band").agg(mean("up").alias("valley"), mean("down").alias("peak"))
    db = lambda c: F.lit(10.0) * F.log10(F.greatest(F.col(c), F.lit(1e-10)))
    both = both.withColumn("peak", db("peak")).withColumn("valley", db("valley"))
    low = F.max("peak").over(Window.partitionBy("clip_id")) - 80.0
    return both.withColumn("low", low).select("clip_id", "t", F.col("band").alias("k"), (F.greatest("peak", "low") - F.greatest("valley", "low")).alias("x"))


def pcen(feat: DataFrame, sr: float, hop_length: int, gain: float = 0.98, bias: float = 2.0, power_: float = 0.5, time_constant: float = 0.4, eps: float = 1e-6) -> DataFrame:
    """Gain control by a one-pole average: a fold over each bin's series."""
    a = math.exp(-hop_length / (time_constant * sr))
    series = feat.groupBy("clip_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("xs"))

    def step(acc, x):
        new = F.when(F.size(acc) == 0, x).otherwise(F.lit(a) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + F.lit(1.0 - a) * x)
        return F.concat(acc, F.array(new))

    smooth = series.withColumn("ms", F.aggregate("xs", F.array().cast("array<double>"), step))
    z = smooth.select("clip_id", "k", F.posexplode(F.arrays_zip("xs", "ms")).alias("t", "z"))
    x = F.pow(F.col("z.xs") / F.pow(F.lit(eps) + F.col("z.ms"), F.lit(gain)) + F.lit(bias), F.lit(power_)) - F.lit(bias**power_)
    return z.select("clip_id", F.col("t").cast("bigint").alias("t"), "k", x.alias("x"))


def piptrack(mag: DataFrame, sr: float, n_fft: int, fmin: float, fmax: float, threshold: float) -> DataFrame:
    """(clip_id, t, k, pitch, mag): spectral peaks with interpolated frequencies."""
    top = n_fft // 2 - 1
    first = min(max(math.ceil(fmin * n_fft / sr), 1), top)
    last = min(max(math.floor(fmax * n_fft / sr), first + 1), top)
    frame = Window.partitionBy("clip_id", "t").orderBy("k")
    m = mag.withColumn("a", F.lag("x").over(frame)).withColumn("c", F.lead("x").over(frame))
    peak = m.where(F.col("k").between(first, last) & (F.col("x") > F.col("a")) & (F.col("x") > F.col("c")) & (F.col("x") > threshold))
    p = F.lit(0.5) * (F.col("a") - F.col("c")) / (F.col("a") - 2.0 * F.col("x") + F.col("c"))
    return peak.select("clip_id", "t", "k", ((F.col("k") + p) * F.lit(sr / n_fft)).alias("pitch"), F.col("x").alias("mag"))


def pitch_tuning(freqs: DataFrame, resolution: float = 0.01, bins_per_octave: int = 12) -> DataFrame:
    """(clip_id, x) of (clip_id, f): most frequent offset from the tuned bins; of equally frequent ones the last."""
    top = math.ceil(1.0 / resolution)
    b = F.lit(float(bins_per_octave)) * F.log2(F.col("f") / F.lit(27.5))
    off = b - F.floor(b)
    off = F.when(off >= 0.5, off - 1.0).otherwise(off)
    slot = F.least(F.floor((off + 0.5) / F.lit(resolution)), F.lit(top)).cast("bigint")
    counts = freqs.where("f > 0").select("clip_id", slot.alias("slot")).groupBy("clip_id", "slot").agg(F.count("*").alias("n"))
    best = counts.groupBy("clip_id").agg(F.max(F.struct("n", "slot"))["slot"].alias("slot"))
    return best.select("clip_id", (F.col("slot") * F.lit(resolution) - F.lit(0.5)).alias("x"))
