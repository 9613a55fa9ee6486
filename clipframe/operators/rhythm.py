"""Onsets, tempo and beats as relations.  An envelope is samples(clip_id, n, y) with a row for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def onset_strength(mag: DataFrame) -> DataFrame:
    """Sum of the rises of all bins of feat(clip_id, t, k, x); the first frame rises from nothing."""
    before = F.lag("x", 1, 0.0).over(Window.partitionBy("clip_id", "k").orderBy("t"))
    rise = mag.select("clip_id", F.col("t").alias("n"), F.greatest(F.col("x") - before, F.lit(0.0)).alias("r"))
    return rise.groupBy("clip_id", "n").agg(F.sum("r").alias("y"))


def onset_strength_multi(mag: DataFrame, sr: float, n_fft: int, bands: list[tuple[float, float]]) -> DataFrame:
    """(clip_id, band, n, y): the same in bands of (low, high) Hz, half open in bins."""
    edge = lambda f: min(max(int(f * n_fft / sr + 0.5), 0), n_fft // 2 + 1)
    rows = [(b, k) for b, (low, high) in enumerate(bands) for k in range(edge(low), edge(high))]
    table = F.broadcast(mag.sparkSession.createDataFrame(rows, "band long, k long"))
    before = F.lag("x", 1, 0.0).over(Window.partitionBy("clip_id", "k").orderBy("t"))
    rise = mag.select("clip_id", F.col("t").alias("n"), "k", F.greatest(F.col("x") - before, F.lit(0.0)).alias("r"))
    return rise.join(table, "k").groupBy("clip_id", "band", "n").agg(F.sum("r").alias("y"))


def onset_detect(envelope: DataFrame, threshold: float) -> DataFrame:
    """(clip_id, n) of interior peaks above the threshold."""
    order = Window.partitionBy("clip_id").orderBy("n")
    e = envelope.withColumn("a", F.lag("y").over(order)).withColumn("b", F.lead("y").over(order))
    return e.where((F.col("y") > threshold) & (F.col("y") >= F.col("a")) & (F.col("y") > F.col("b"))).select("clip_id", "n")


def onset_backtrack(envelope: DataFrame, events: DataFrame, search_range: int) -> DataFrame:
    """(clip_id, n, back): each event and the earliest lowest frame within the range before it, itself if none is lower.

    A window over the envelope finds the lowest frame for every place, so events join by equality.
    """
    near = Window.partitionBy("clip_id").orderBy("n").rowsBetween(-search_range, 0)
    low = F.min(F.struct("y", "n")).over(near)
    own = envelope.withColumn("low", low)
    back = own.select("clip_id", "n", F.when(F.col("low.y") < F.col("y"), F.col("low.n")).otherwise(F.col("n")).alias("back"))
    return events.join(back, ["clip_id", "n"], "left").select("clip_id", "n", F.coalesce("back", "n").alias("back"))


def lag_products(samples: DataFrame, first: int, last: int) -> DataFrame:
    """(clip_id, lag, x): autocorrelation at lags first..last, as an equality join on the shifted place."""
    lags = F.explode(F.sequence(F.lit(first), F.lit(last)))
    shifted = samples.select("clip_id", lags.alias("lag"), "n", F.col("y").alias("a")).withColumn("n", F.col("n") + F.col("lag"))
    return shifted.join(samples, ["clip_id", "n"]).groupBy("clip_id", F.col("lag").cast("bigint").alias("lag")).agg(F.sum(F.col("a") * F.col("y")).alias("x"))


def autocorrelate(samples: DataFrame, max_lag: int) -> DataFrame:
    return lag_products(samples, 0, max_lag - 1)


def tempogram(envelope: DataFrame, win_length: int) -> DataFrame:
    """feat(clip_id, t, k = lag, x): autocorrelation of every whole window; shorter clips have none.

    The sum of a window's products at one lag is a moving sum of the products, so each product is made once.
    """
    length = F.count("*").over(Window.partitionBy("clip_id"))
    e = envelope.withColumn("len", length).where(F.col("len") >= win_length)
    pairs = e.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(win_length - 1))).alias("k"), (F.col("n")).alias("i"), F.col("y").alias("a"), "len").withColumn("n", F.col("i") + F.col("k"))
    made = pairs.join(e.select("clip_id", "n", "y"), ["clip_id", "n"]).select("clip_id", "k", "i", (F.col("a") * F.col("y")).alias("p"), "len")
    # the window from t needs the win - k products from i = t on: a difference of two running sums
    total = made.withColumn("run", F.sum("p").over(Window.partitionBy("clip_id", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    ends = total.select("clip_id", "k", "len", (F.col("i") - (win_length - 1 - F.col("k"))).alias("t"), "run")
    starts = total.select("clip_id", "k", (F.col("i") + 1).alias("t"), F.col("run").alias("before"))
    out = ends.where((F.col("t") >= 0) & (F.col("t") <= F.col("len") - win_length)).join(starts, ["clip_id", "k", "t"], "left")
    return out.select("clip_id", F.col("t").cast("bigint").alias("t"), F.col("k").cast("bigint").alias("k"), (F.col("run") - F.coalesce("before", F.lit(0.0))).alias("x"))


def tempogram_ratio(gram: DataFrame) -> DataFrame:
    """Each value over its lag's mean over time."""
    mean = F.avg("x").over(Window.partitionBy("clip_id", "k"))
    return gram.withColumn("m", mean).select("clip_id", "t", "k", F.when(F.col("m") > 1e-10, F.col("x") / F.col("m")).otherwise(0.0).alias("x"))


def _best_lag(products: DataFrame) -> DataFrame:
    """(clip_id, lag): the highest positive product, the smallest lag of equals."""
    best = products.where("x > 0").groupBy("clip_id").agg(F.max(F.struct("x", (-F.col("lag")).alias("less")))["less"].alias("less"))
    return best.select("clip_id", (-F.col("less")).alias("lag"))


def tempo(envelope: DataFrame, sr: int, hop_length: int) -> DataFrame:
    """(clip_id, bpm) by the best lag of up to a second; 0 if there is none."""
    first, last = int(max(sr / hop_length / 4.0, 1.0)), max(sr // hop_length, 1) - 1
    best = _best_lag(lag_products(envelope, first, max(last, first)).where(F.col("lag") <= last))
    clips = envelope.groupBy("clip_id").agg(F.count("*").alias("len"))
    bpm = F.when(F.col("len") < 3, 0.0).otherwise(F.coalesce(F.lit(60.0 * sr) / (F.col("lag") * F.lit(hop_length)), F.lit(0.0)))
    return clips.join(best, "clip_id", "left").select("clip_id", bpm.alias("bpm"))


def beat_tempo(envelope: DataFrame, sr: int, hop_length: int, start_bpm: float | None = None) -> DataFrame:
    """(clip_id, bpm) for beats: lags of up to two seconds and half the clip, at most 300 and at least 30 BPM."""
    first, most = max(sr // hop_length // 4, 1), 2 * sr // hop_length
    clips = envelope.groupBy("clip_id").agg(F.count("*").alias("len"))
    products = lag_products(envelope, first, max(most - 1, first)).join(clips, "clip_id").where((F.col("lag") < most) & (F.col("lag") < F.floor(F.col("len") / 2.0)))
    best = _best_lag(products.select("clip_id", "lag", "x"))
    bpm = F.least(F.greatest(F.lit(60.0 * sr) / (F.coalesce("lag", F.lit(first)) * F.lit(hop_length)), F.lit(30.0)), F.lit(300.0))
    return clips.join(best, "clip_id", "left").select("clip_id", F.when(F.col("len") < 2, 120.0).when(F.col("len") < 3, 120.0 if start_bpm is None else start_bpm).otherwise(bpm).alias("bpm"))


def beat_track(envelope: DataFrame, sr: int, hop_length: int, start_bpm: float | None = None) -> DataFrame:
    """(clip_id, beat, n): the first peak and the highest frame around each whole period from it.

    The slots are an arithmetic series from the first peak, so they are generated and joined by range of frames.
    """
    bpm = beat_tempo(envelope, sr, hop_length, start_bpm)
    clips = envelope.groupBy("clip_id").agg(F.count("*").alias("len"), F.max("y").alias("top")).join(bpm, "clip_id").where("len >= 2")
    clips = clips.withColumn("period", F.round(F.lit(60.0 * sr) / (F.col("bpm") * F.lit(hop_length))).cast("bigint")).where("period > 0")
    clips = clips.withColumn("half", F.floor(F.col("period") / 2.0).cast("bigint"))
    e = envelope.join(clips, "clip_id")
    head = e.where("n < half AND y > 0").groupBy("clip_id").agg(F.max(F.struct("y", (-F.col("n")).alias("less")))["less"].alias("less"))
    first = clips.join(head, "clip_id", "left").withColumn("first", F.coalesce(-F.col("less"), F.lit(0).cast("bigint")))
    # frame n is near slot s if first + s * period - half <= n < first + s * period + half
    at = e.join(first.select("clip_id", "first"), "clip_id")
    slot = F.floor((F.col("n") - F.col("first") + F.col("half")) / F.col("period"))
    near = at.withColumn("slot", slot.cast("bigint"))
    near = near.where((F.col("slot") >= 1) & (F.col("first") + F.col("slot") * F.col("period") < F.col("len")) & (F.col("n") < F.col("first") + F.col("slot") * F.col("period") + F.col("half")))
    best = near.where("y > 0").groupBy("clip_id", "slot").agg(F.max(F.struct("y", (-F.col("n")).alias("less"))).alias("b"), F.max("top").alias("top"))
    found = best.where(F.col("b.y") > F.col("top") * 0.1).select("clip_id", F.col("slot").alias("beat"), (-F.col("b.less")).alias("n"))
    return found.unionByName(first.select("clip_id", F.lit(0).cast("bigint").alias("beat"), F.col("first").alias("n")))


def localmax(samples: DataFrame) -> DataFrame:
    """(clip_id, n) of strict interior maxima."""
    order = Window.partitionBy("clip_id").orderBy("n")
    e = samples.withColumn("a", F.lag("y").over(order)).withColumn("b", F.lead("y").over(order))
    return e.where((F.col("y") > F.col("a")) & (F.col("y") > F.col("b"))).select("clip_id", "n")


def localmin(samples: DataFrame) -> DataFrame:
    """(clip_id, n, is_min): below the value before and not above the one after; the first never, the last by the one before."""
    order = Window.partitionBy("clip_id").orderBy("n")
    low = (F.col("y") < F.lag("y").over(order)) & F.coalesce(F.col("y") <= F.lead("y").over(order), F.lit(True))
    return samples.select("clip_id", "n", F.coalesce(low, F.lit(False)).alias("is_min"))


def localmin_2d(feat: DataFrame, axis: str = "t") -> DataFrame:
    """(clip_id, t, k, is_min) along time or bins; a single place is none."""
    order = Window.partitionBy("clip_id", "k" if axis == "t" else "t").orderBy(axis)
    low = (F.col("x") < F.lag("x").over(order)) & F.coalesce(F.col("x") <= F.lead("x").over(order), F.lit(True))
    return feat.select("clip_id", "t", "k", F.coalesce(low, F.lit(False)).alias("is_min"))


def peak_candidates(samples: DataFrame, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float) -> DataFrame:
    """(clip_id, n) of strict maxima of their window that exceed the mean of their neighbours by delta (no waiting).

    The neighbours alone are summed one by one from the last to the first, as the SQL's join does, so that a value which
    exceeds the mean by exactly delta passes on both sides.
    """
    order = Window.partitionBy("clip_id").orderBy("n")
    others = [F.max("y").over(order.rowsBetween(a, b)) for a, b in ((-pre_max, -1), (1, post_max)) if a <= b]
    around = order.rowsBetween(-pre_avg, post_avg)
    n = F.count("y").over(around) - 1
    total = F.lit(0.0)
    for k in [k for k in range(post_avg, -pre_avg - 1, -1) if k]:
        total = total + F.coalesce(F.lead("y", k).over(order), F.lit(0.0))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    top = F.greatest(*others, F.lit(float("-inf")).cast("double")) if len(others) > 1 else F.coalesce(*others, F.lit(float("-inf")))
    c = samples.withColumn("others", top).withColumn("mean", mean)
    return c.where((F.col("y") > F.col("others")) & (F.col("y") >= F.col("mean") + F.lit(delta))).select("clip_id", "n")


def superflux(mel_db: DataFrame, lag: int = 1, max_size: int = 3) -> DataFrame:
    """(clip_id, n, y): rises over the maximum of neighbouring bands ``lag`` frames before."""
    half = max_size // 2
    wide = mel_db.withColumn("w", F.max("x").over(Window.partitionBy("clip_id", "t").orderBy("k").rowsBetween(-half, half)))
    before = F.lag("w", lag).over(Window.partitionBy("clip_id", "k").orderBy("t"))
    rise = wide.select("clip_id", F.col("t").alias("n"), F.greatest(F.col("x") - before, F.lit(0.0)).alias("r"))
    return rise.groupBy("clip_id", "n").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("y"))
