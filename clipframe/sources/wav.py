"""WAV files as a Spark source, sink and stream.

Batches read through ``binaryFile``, so any file system that Spark knows is open; offset and duration cut the bytes
before samples are made.  Other formats go to a decoder that the caller registers.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels.signal import resample

#: Endings that are searched for if none are given.
EXTENSIONS = ("aac", "au", "flac", "m4a", "mp3", "ogg", "wav")
#: Decoders by ending: bytes to (samples (channels, frames), sample rate).
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {}
SCHEMA = "path string, sr int, channels int, samples array<array<float>>"
VERSION = "0.1.0"


def version() -> str:
    return VERSION


def cite(ver: str | None = None) -> str:
    return f"clipframe {ver or VERSION}: a Spark engine for signals"


def list_examples(spark: SparkSession) -> DataFrame:
    """The registry of example recordings; it is empty."""
    return spark.createDataFrame([], "key string, desc string, filename string")


def example_info(spark: SparkSession, key: str) -> DataFrame:
    return list_examples(spark).where(F.col("key") == key)


def example(spark: SparkSession, key: str) -> str | None:
    row = example_info(spark, key).first()
    return row["filename"] if row else None


def detect_format(path: Column) -> Column:
    """Lower-cased ending of the file's name, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def find_files(spark: SparkSession, directory: str, ext: list[str] | None = None, recurse: bool = True, case_sensitive: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(path) of the files with these endings, sorted; a negative offset counts from the end.

    Only all-lower and all-upper endings match without regard to case.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(directory).select("path")
    ends = list(ext or EXTENSIONS)
    ends = ends if case_sensitive else [*map(str.lower, ends), *map(str.upper, ends)]
    found = found.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(ends))
    if offset < 0:
        offset = max(found.count() + offset, 0)
    out = found.orderBy("path").offset(offset)
    return out if limit is None else out.limit(limit)


def _chunks(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(format, channels, sample rate, bits, start, size) from the chunks of a RIFF file; sizes beyond the file are cut."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, sr = struct.unpack_from("<HHI", data, at + 8)
            bits = struct.unpack_from("<H", data, at + 22)[0]
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", data, at + 32)[0]
            form = kind, channels, sr, bits
        if name == b"data" and form:
            return (*form, at + 8, min(size, len(data) - at - 8))
        at += 8 + size + size % 2
    raise ValueError("a WAV file without format or data")


def decode_wav(data: bytes, offset: float | None = None, duration: float | None = None) -> tuple[np.ndarray, int]:
    """(samples (channels, frames), sample rate); whole numbers are scaled by their bits."""
    channels, sr, bits, size = *_chunks(data)[1:4], _chunks(data)[5]
    frames = size // (bits // 8 * channels)
    first = min(int((offset or 0.0) * sr), frames)
    return decode_frames(data, first, frames - first if duration is None else int(duration * sr)), sr


def decode_frames(data: bytes, first: int, n: int) -> np.ndarray:
    """Samples (channels, frames) of so many frames from ``first`` on, or as many as there are; reads only their bytes."""
    kind, channels, _, bits, start, size = _chunks(data)
    width = bits // 8
    n = max(min(n, size // (width * channels) - first), 0)
    raw = data[start + first * width * channels : start + (first + n) * width * channels]
    if kind == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2.0**23
    else:
        x = (np.frombuffer(raw, f"<i{width}") / 2.0 ** (bits - 1)).astype(np.float32)
    return x.reshape(-1, channels).T


def encode_wav(samples: np.ndarray, sr: int) -> bytes:
    """16-bit PCM: clamped, times 32767, towards zero."""
    x = np.atleast_2d(np.asarray(samples, float))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((len(x), 2, sr, 0, "NONE", ""))
        w.writeframes((np.clip(x, -1.0, 1.0) * 32767.0).astype("<i2").T.tobytes())
    return out.getvalue()


def load(spark: SparkSession, path: str, sr: int | None = None, mono: bool = False, offset: float | None = None, duration: float | None = None) -> DataFrame:
    """(path, sr, channels, samples) of audio files, one row a file; resampled to ``sr`` if given."""
    decoders = dict(DECODERS)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                end = p.rsplit(".", 1)[-1].lower()
                if end == "wav":
                    x, rate = decode_wav(data, offset, duration)
                elif end in decoders:
                    x, rate = decoders[end](data)
                    first = int((offset or 0.0) * rate)
                    x = x[:, first : None if duration is None else first + int(duration * rate)]
                else:
                    raise ValueError(f"no decoder for {end!r}: register one in clipframe.sources.wav.DECODERS")
                x = x.mean(0, keepdims=True) if mono else x
                if sr and sr != rate:
                    x, rate = np.stack([resample(c, rate, sr) for c in x]), sr
                rows = [c.astype(np.float32).tolist() for c in x]
                yield pa.RecordBatch.from_pydict({"path": pa.array([p]), "sr": pa.array([rate], pa.int32()), "channels": pa.array([len(rows)], pa.int32()), "samples": pa.array([rows], pa.list_(pa.list_(pa.float32())))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def load_wav(spark: SparkSession, path: str, offset: float | None = None, duration: float | None = None) -> DataFrame:
    return load(spark, path, offset=offset, duration=duration)


load_audio = load


def get_samplerate(loaded: DataFrame) -> DataFrame:
    return loaded.select("path", "sr")


def to_signals(loaded: DataFrame) -> DataFrame:
    """signal(clip_id, sr, y): channels averaged, clips numbered by path hash."""
    n = F.size("samples")
    y = F.aggregate(F.slice("samples", 2, F.greatest(n - 1, F.lit(0))), F.get("samples", F.lit(0)), lambda a, c: F.zip_with(a, c, lambda u, v: u + v))
    return loaded.select(F.xxhash64("path").alias("clip_id"), "sr", F.transform(y, lambda v: (v / n).cast("double")).alias("y"))


def save_wav(signals: DataFrame, folder: str) -> DataFrame:
    """Encode signal(clip_id, sr, y) in tasks and write (clip_id, wav) as Parquet to ``folder``; write_files makes files of it."""

    def run(batches):
        for b in batches:
            for clip, sr, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield pa.RecordBatch.from_pydict({"clip_id": pa.array([clip], pa.int64()), "wav": pa.array([encode_wav(y, sr)], pa.binary())})

    signals.select("clip_id", "sr", "y").mapInArrow(run, "clip_id long, wav binary").write.parquet(folder)
    return signals.sparkSession.read.parquet(folder)


def write_files(encoded: DataFrame, folder: str) -> None:
    """One file a clip, by each executor, in a folder that all of them share."""

    def put(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r['clip_id']}.part")
            with open(part, "wb") as f:
                f.write(r["wav"])
            os.replace(part, os.path.join(folder, f"{r['clip_id']}.wav"))

    encoded.foreachPartition(put)


def stream_blocks(loaded: DataFrame, chunk_size: int) -> DataFrame:
    """(path, chunk, ch, samples): blocks of at most chunk_size frames, the last one short."""
    c = loaded.select("path", F.posexplode("samples").alias("ch", "all"))
    n = F.ceil(F.size("all") / F.lit(float(chunk_size))).cast("int")
    b = c.where(F.size("all") > 0).select("path", "ch", "all", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return b.select("path", F.col("chunk").cast("bigint").alias("chunk"), "ch", F.slice("all", F.col("chunk") * chunk_size + 1, chunk_size).alias("samples"))


def numbered(found: DataFrame) -> DataFrame:
    """Paths with their place in the sorted list."""
    return found.withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)
