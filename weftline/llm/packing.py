"""Cost-balanced packing of documents into training sequences.

A document of n ids costs ``linear * n + quadratic * n * n`` (feed-forward and
attention work). Documents go, by descending length, to the sequence of lowest
cost so far that still has room for them; if none has, the emptiest takes what
it can and the rest goes on. Ids beyond a multiple of the sequence length are
what is packed: the full multiples are sequences of their own.

Each partition packs its own documents in windows, so nothing is shuffled. A
window fills whole sequences exactly and hands what is left to the next window;
only the last sequence of a partition is padded.

Defined cases: a null text is an empty one, and an empty document still has its
end id; rows that repeat a doc_id are separate documents; a null doc_id stays
null; documents of equal length go in the order in which they come; a text of
any length is held as one row; other columns are ignored, whatever their names; no
rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import slices

LENGTH = 2048
WINDOW = 2048
#: Ids in a batch of pieces, a text's or a window's more at most.
_YIELD_IDS = 1 << 18


def balance(lengths: list[int], length: int, sequences: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Assign documents to sequences: (document, its start, count, sequence) in order of placing.

    What finds no room when every sequence is full is not placed.
    """
    free = np.full(sequences, length, dtype=np.int64)
    cost = np.zeros(sequences)
    placed = []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, n = 0, lengths[doc]
        while n > 0:
            fits = free >= n
            if fits.any():
                s, take = int(np.where(fits, cost, np.inf).argmin()), n
            else:
                s = int(free.argmax())
                take = int(free[s])
                if take == 0:
                    break
            placed.append((doc, start, take, s))
            free[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return placed


class _Packer:
    """Packs one partition's documents as they come."""

    def __init__(self, length: int, window: int, linear: float, quadratic: float, first: int):
        self.length, self.window, self.linear, self.quadratic, self.next = length, window, linear, quadratic, first
        self.waiting: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, doc_tokens, start, ids
        self.rows: list[tuple] = []  # doc_id, start, ids, doc_tokens, sequence_id, offset
        self.held = 0  # ids in rows

    def taken(self) -> list[tuple]:
        """The rows, which are then let go."""
        rows, self.rows, self.held = self.rows, [], 0
        return rows

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            self.rows.append((doc_id, start, ids[start : start + self.length], n, self.next, 0))
            self.held += self.length
            self.next += 1
        if n > whole:
            self.waiting.append((doc_id, n, whole, ids[whole:].copy()))
        if len(self.waiting) >= self.window:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        lengths = [len(x[3]) for x in self.waiting]
        sequences = (sum(lengths) + (self.length - 1) * last) // self.length
        if not sequences:
            return  # too little for a sequence: it waits
        ends = [0] * len(lengths)
        offsets = [0] * sequences
        for doc, start, take, s in balance(lengths, self.length, sequences, self.linear, self.quadratic):
            doc_id, n, before, ids = self.waiting[doc]
            self.rows.append((doc_id, before + start, ids[start : start + take], n, self.next + s, offsets[s]))
            self.held += take
            ends[doc] = start + take
            offsets[s] += take
        self.next += sequences
        self.waiting = [(d, n, before + end, ids[end:].copy()) for (d, n, before, ids), end in zip(self.waiting, ends) if end < len(ids)]


def pack(
    docs: DataFrame, tokenizer_path: str, chunks: str = tokens.BYTE_CHUNKS, length: int = LENGTH, window: int = WINDOW,
    linear: float = 1.0, quadratic: float = 1.0 / LENGTH, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    ``window`` bounds what a task holds: that many document ends, each shorter
    than ``length`` ids.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [
        src.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = [
            pa.array([r[0] for r in rows], kind),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) for r in rows], pa.int64()),
            pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
            *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)),
        ]
        if with_ids:
            cols.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    def run(batches):
        enc = tokens.encoder(tokenizer_path, chunks)
        packer = _Packer(length, window, linear, quadratic, TaskContext.get().partitionId() << 32)
        kind = None
        for b in (part for batch in batches for part in slices(batch, 1)):
            kind = b.schema.field(0).type
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode([text or "" for text in b.column(1).to_pylist()])):
                packer.add(doc_id, np.frombuffer(data + end, dtype="<u4"))
                if packer.held >= _YIELD_IDS:
                    yield table(packer.taken(), kind)
        if kind is not None:
            packer.flush(last=True)
            if packer.rows:
                yield table(packer.taken(), kind)

    return src.mapInArrow(run, T.StructType(fields))
