"""WAV files as a Structured Streaming source: blocks of one file in order, so many frames a batch.

    spark.dataSource.register(WavBlocks)
    spark.readStream.format("wav_blocks").option("path", "/shared/a.wav").option("chunk_size", 4096).load()

Options: path (of a file that the driver can read), chunk_size, offset and duration in seconds.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "sr int, channels int, chunk long, samples array<array<float>>"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk_size", 4096))
        self.offset = float(options.get("offset", 0.0))
        self.duration = float(options["duration"]) if "duration" in options else None
        if self.chunk <= 0:
            raise ValueError("chunk_size must be positive")

    def _block(self, chunk: int):
        """The chunk's rows: none beyond the end, where the last one is short.  Only the chunk's bytes are read."""
        import mmap

        from ..sources.wav import _chunks, decode_frames

        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            sr, begin = _chunks(data)[2], chunk * self.chunk
            left = self.chunk if self.duration is None else min(self.chunk, int(self.duration * sr) - begin)
            part = decode_frames(data, int(self.offset * sr) + begin, left)
        return [(sr, len(part), chunk, [c.tolist() for c in part])] if part.shape[1] else []

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def read(self, start: dict):
        rows = self._block(start["chunk"])
        return iter(rows), {"chunk": start["chunk"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for c in range(start["chunk"], end["chunk"]) for r in self._block(c)])

    def commit(self, end: dict) -> None:
        pass


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)
