"""Token ids in a binary segment format with Elias-Fano document boundaries.

A segment is a byte string: a header, the documents' ends coded by Elias-Fano,
a sampled select table over them, and the documents' ids joined into one array
of 16- or 32-bit integers. With n ends below u, the code takes about
2 + log2(u / n) bits for each end; the select structure turns the number of a
document into its offset without a table of 64-bit offsets.

Segments are the rows of a Parquet table, which Spark's committer makes whole
even when executors are lost; with each goes its place in the order and its
documents' doc_ids (delta-coded by Parquet).

Defined cases: a null text is an empty one (its end id alone); null doc_ids come
first; rows that repeat a doc_id stand side by side, ordered by a hash of their text; a
text of any length is one row of one segment; other columns are ignored, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import slices, written

MAGIC = b"EFSEG1\0\0"
HEADER = struct.Struct("<8sBBxxxxxxQQQQ")  # magic, low bits, id bytes, documents, ids, bytes of lows, bytes of highs
SAMPLE = 64
SEGMENT_IDS = 1 << 20


def encode_segment(ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The segment of documents that end at ``ends`` (ascending, the last is len(ids))."""
    n, u = len(ends), len(ids) + 1
    low = max(0, (u // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    lows = np.packbits(((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low else np.zeros(0, np.uint8)
    places = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    bits[places] = 1
    highs = np.packbits(bits, bitorder="little")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = HEADER.pack(MAGIC, low, width, n, len(ids), len(lows), len(highs))
    return head + lows.tobytes() + highs.tobytes() + places[::SAMPLE].astype("<u4").tobytes() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """Reads a segment by select: ``end(i)`` and ``document(i)`` of one document, ``ends()`` of many."""

    def __init__(self, data: bytes):
        magic, self.low, width, self.n, self.n_ids, lows, highs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = HEADER.size
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        at += lows + highs
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + 4 * samples)

    def select(self, i: int) -> int:
        """The place of the i-th set bit among the high bits, from the sample before it on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            some = np.unpackbits(self.highs[byte : byte + 64], bitorder="little")
            set_bits = np.flatnonzero(some[skip:]) + skip
            if left < len(set_bits):
                return byte * 8 + int(set_bits[left])
            left, byte, skip = left - len(set_bits), byte + 64, 0

    def end(self, i: int) -> int:
        """Where document i ends; -1 gives 0."""
        if i < 0:
            return 0
        value = 0
        for k in range(self.low):
            bit = i * self.low + k
            value |= (int(self.lows[bit // 8]) >> bit % 8 & 1) << k
        return (self.select(i) - i) << self.low | value

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return self.ids[self.end(i - 1) : self.end(i)]

    def ends(self, of: np.ndarray | None = None) -> np.ndarray:
        """Where each document of ``of`` (ascending numbers; all, if not given) ends: a batch of selects, each from the sample before it."""
        of = np.arange(self.n) if of is None else np.asarray(of)
        high = np.empty(len(of), np.int64)
        group = of // SAMPLE
        for g in np.unique(group).tolist():
            at = int(self.samples[g])
            to = int(self.samples[g + 1]) if g + 1 < len(self.samples) else 8 * len(self.highs)
            bits = np.unpackbits(self.highs[at // 8 : -(-to // 8)], bitorder="little")
            places = np.flatnonzero(bits[at % 8 :]) + at
            own = group == g
            high[own] = places[of[own] % SAMPLE] - of[own]
        out = high << self.low
        if self.low:
            where = of[:, None] * self.low + np.arange(self.low)
            bits = self.lows[where // 8] >> (where % 8).astype(np.uint8) & 1
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return out


def write_segments(
    docs: DataFrame, tokenizer_path: str, chunks: str = tokens.WORD_CHUNKS, end_id: int = 2, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode documents in ascending doc_id order, write the segments to the shared folder, return them as read back.

    Texts are dealt by ranges of doc_id (sampled bounds), then encoded in order.
    Columns: part, ids_before (in the part), n_ids, doc_ids, segment.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(src.schema["doc_id"].dataType)), T.StructField("segment", T.BinaryType()),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, part = tokens.encoder(tokenizer_path, chunks), TaskContext.get().partitionId()
        names: list = []
        parts: list[bytes] = []
        size = before = 0
        kind = None

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // 4 for p in parts])
            data = encode_segment(ends, np.frombuffer(b"".join(parts), dtype="<u4"))
            cols = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in (part for batch in batches for part in slices(batch, 1)):
            kind = b.schema.field(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([text or "" for text in b.column(1).to_pylist()])):
                names.append(doc_id)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
                if size >= segment_ids:
                    yield segment()
                    names, parts, before, size = [], [], before + size, 0
        if parts:
            yield segment()

    return written(src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "segments")


def read_documents(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document of the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    Only one row for each part (a shuffle partition of the writing job) is
    summed in one place and broadcast.
    """
    parts = segments.groupBy("part").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("total"))
    bases = parts.select(F.col("part"), (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    kind = segments.schema["doc_ids"].dataType.elementType
    fields = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                s = Segment(b.column(2)[k].as_py())
                ends = s.ends()
                starts = np.concatenate([[0], ends[:-1]])
                ids = s.ids.astype("<u4")
                cols = [
                    b.column(1)[k].values, pa.array(starts + b.column(0)[k].as_py(), pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[i:j]) for i, j in zip(starts, ends)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([ids[i:j].astype(np.int32) for i, j in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    rows = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("ids_before")).alias("at"), "doc_ids", "segment")
    return rows.mapInArrow(run, T.StructType(fields))
