"""Byte-level BPE by DuckDB recursive queries in each partition, on the ranks of a rank file.

The distinct pieces of a slice of texts become rows (word, position, token); a recursive query joins neighbours
with the merge table and contracts each word's leftmost pair of least rank until no word changes.  Ids are decoded
by an ordered aggregation over (document, position) rows joined with the vocabulary.  Null texts are empty and have
no ids; rows are encoded one by one, so repeated rows and null ids have results of their own, and texts of any length
are encoded whole.  Empty tables give empty tables; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

#: Longer pieces (in bytes) would take a recursion step for each merge; they are merged by a loop instead.
LONGEST = 64
#: Words that are merged by one recursive query, which holds every step of them.
WORDS_A_QUERY = 40_000
SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"

# A row is a token of a word: wp is word * 256 + position, positions are dense.  best is the word's least
# rank * 256 + position over the pairs in the merge table; what stands right of it moves up by one.
_ENCODE = """
WITH RECURSIVE t(step, wp, id) AS (
    SELECT 0::UTINYINT, wp, id FROM pieces
  UNION ALL (
    WITH pair AS (
        SELECT wp, id, lead(id) OVER (ORDER BY wp) AS right_id, lead(wp) OVER (ORDER BY wp) AS right_wp FROM t
    ), best AS (
        SELECT wp >> 8 AS w, min(m.rank * 256 + (wp & 255)) AS b
        FROM pair JOIN merges m ON m.ab = (pair.id::BIGINT << 16) + pair.right_id WHERE right_wp = wp + 1 GROUP BY wp >> 8
    )
    SELECT t.step + 1, t.wp - ((t.wp & 255) > (b & 255))::INT, CASE WHEN (t.wp & 255) = (b & 255) THEN b >> 8 ELSE t.id END::INT
    FROM t JOIN best ON best.w = t.wp >> 8 WHERE (t.wp & 255) <> (b & 255) + 1
  )
)
SELECT t.wp >> 8 AS w, id FROM t JOIN (SELECT wp >> 8 AS w, max(step) AS step FROM t GROUP BY 1) e ON e.w = t.wp >> 8 AND e.step = t.step ORDER BY wp
"""

_DECODE = "SELECT doc, string_agg(s, '' ORDER BY p) AS text FROM ids JOIN vocabulary USING (id) GROUP BY doc"


class Codec:
    """One DuckDB database with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = pieces.rank_file(path)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), rank.append(r)
        self.db = duckdb.connect(":memory:", config={"threads": "1", "temp_directory": ""})
        self._table("merges_", {"ab": pa.array((np.array(a, np.int64) << 16) + np.array(b, np.int64)), "rank": pa.array(rank, pa.int64())})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self._table("vocabulary_", {"id": pa.array(list(self.ranks.values()), pa.int32()), "s": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_")
        self.table = pieces.PieceTable(self.encode_pieces)

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register(name, pa.table(columns))

    def merge_loop(self, piece: bytes) -> np.ndarray:
        """Ids of a long piece: a heap of pairs over a linked list, leftmost least rank first."""
        import heapq

        part = [bytes([c]) for c in piece]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i):
            j = after[i]
            if j < len(part) and (r := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] is not x or j >= len(part) or part[j] is not y:
                continue
            part[i], part[j] = x + y, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[t] for t in part if t is not None], np.uint32)

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of each piece's ids."""
        raw = [p.encode() for p in new]
        known = [self.ranks.get(x) for x in raw]  # a piece that is a token is that token
        size = np.ones(len(raw), np.int64)
        parts: dict[int, np.ndarray] = {}
        short = []
        for i, (x, r) in enumerate(zip(raw, known)):
            if r is None:
                if len(x) > LONGEST:
                    parts[i] = self.merge_loop(x)
                    size[i] = len(parts[i])
                else:
                    short.append(i)
        found = []
        for k in range(0, len(short), WORDS_A_QUERY):
            own = short[k : k + WORDS_A_QUERY]
            lens = np.fromiter((len(raw[i]) for i in own), np.int64, len(own))
            at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            ids = self.byte_id[np.frombuffer(b"".join(raw[i] for i in own), np.uint8)]
            self._table("pieces", {"wp": pa.array(np.repeat(np.arange(len(own)), lens) * 256 + at), "id": pa.array(ids)})
            got = self.db.execute(_ENCODE).fetchnumpy()
            size[own] = np.bincount(got["w"], minlength=len(own))
            found.append((np.array(own), got["id"].astype(np.uint32)))
        ends = np.cumsum(size)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        alone = [i for i, r in enumerate(known) if r is not None]
        flat[ends[alone] - 1] = [known[i] for i in alone]
        for own, ids in found:
            n = size[own]
            flat[np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for i, ids in parts.items():
            flat[ends[i] - len(ids) : ends[i]] = ids
        return flat, size

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """Bytes of each document."""
        out = [b""] * len(lens)
        if len(ids):
            doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
            self._table("ids", {"doc": pa.array(doc), "p": pa.array(np.arange(len(ids), dtype=np.int32)), "id": pa.array(ids.astype(np.int32))})
            for d, text in self.db.execute(_DECODE).fetchall():
                out[d] = text.encode("latin-1")
        return out


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str):
    def run(batches):
        import regex

        own, by_pattern = codec(path), regex.compile(pieces.PATTERN)

        def encode_text(text):
            found = by_pattern.findall(text)
            return own.table.ids(pa.array(found, pa.string()), np.array([len(found)]))[0]

        for batch in batches:
            for b in pieces.slices(batch):
                ids, lens = own.table.texts(b.column("text"), encode_text)
                decoded = own.decode(ids, lens)
                ends = np.cumsum(lens).tolist()
                raw = [ids[a:e].astype("<u4").tobytes() for a, e in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(lens, pa.int64()), "ids": pa.array(raw, pa.binary()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw]), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded])})

    return run


def encode_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32 bits each), ids_sha256 and decoded_sha256 of each row.  No shuffle."""
    common.ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_encode(ranks), SCHEMA)
