"""Matroska media columns: a muxer for 8-bit samples and a parser into packet tables.

The parser walks variable-length EBML elements, also those of unknown size:
segment, clusters, simple blocks and block groups, all four lacings, tracks and
cues. Each packet (frame) has its track, timestamp, byte range and key flag.

Defined cases: a null text is an empty one and gives one block of zero bytes; a
null media value has no packets and the error "null"; bytes that end within an
element or are no EBML give the packets before that place and an error; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Fixed values of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, KIND, LACED, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}

PAD = 64
SAMPLE_RATE = 8000
FRAME = 512
LACE = 8
CLUSTER_BLOCKS = 16


# --- writing


def vint(n: int, width: int = 0) -> bytes:
    """A data size (or lace size) as a variable-length integer; all ones are left for unknown sizes."""
    w = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def laced_block(frames: list[bytes], track: int, time: int) -> bytes:
    """A simple block; equal frames are laced with fixed size, others with EBML sizes."""
    if len(frames) == 1:
        lacing, sizes = 0, b""
    elif len({len(f) for f in frames}) == 1:
        lacing, sizes = 0x04, bytes([len(frames) - 1])
    else:
        lacing = 0x06
        sizes = bytes([len(frames) - 1]) + vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            w = next(k for k in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * k - 1) - 1)
            sizes += vint(len(b) - len(a) + (1 << 7 * w - 1) - 1, w)
    return element(SIMPLE, vint(track) + struct.pack(">hB", time, 0x80 | lacing) + sizes + b"".join(frames))


_HEAD = element(
    EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2)
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK,
        _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACED, 1) + element(CODEC, b"A_PCM/INT/LIT")
        + element(AUDIO, _float(RATE, SAMPLE_RATE) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of unsigned 8-bit samples; cues follow the clusters."""
    info = element(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / SAMPLE_RATE) + element(MUXER, b"weftline") + element(WRITER, b"weftline"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    block = FRAME * LACE
    for start in range(0, len(payload), block * CLUSTER_BLOCKS):
        time = start * 1000 // SAMPLE_RATE
        blocks = [_uint(TIME, time)]
        end = min(len(payload), start + block * CLUSTER_BLOCKS)
        for b in range(start, end, block):
            frames = [payload[f : min(f + FRAME, end)] for f in range(b, min(b + block, end), FRAME)]
            blocks.append(laced_block(frames, 1, b * 1000 // SAMPLE_RATE - time))
        parts.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE, _uint(CUE_TIME, time) + element(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# --- reading


class Broken(ValueError):
    """The bytes end too early or are not EBML."""


@dataclass
class Parsed:
    """packets: (track, timestamp in ms, offset, size, key, cluster); tracks by number; cues: (ms, track, offset of the cluster)."""

    packets: list[tuple[int, float, int, int, bool, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[float, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    error: str | None = None


def read_vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, place after it, whether all its bits are ones)."""
    if at >= end:
        raise Broken("ends within an element")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise Broken("not a variable-length integer")
    if at + width > end:
        raise Broken("ends within an element")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return n if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def children(data: bytes, at: int, end: int, inside: int = 0):
    """(id, start, end) of the elements from at to end. One of unknown size ends before the next that can't be in it."""
    while at < end:
        ident, at, _ = read_vint(data, at, end, True)
        size, at, unknown = read_vint(data, at, end, False)
        if unknown:
            stop = end
            if ident == CLUSTER:
                probe = at
                while probe < end:
                    found, p, _ = read_vint(data, probe, end, True)
                    if found in _TOP:
                        stop = probe
                        break
                    n, p, _ = read_vint(data, p, end, False)
                    probe = p + n
        else:
            stop = at + size
        if stop > end:
            if ident in (SEGMENT, CLUSTER):  # what is there of them can be read
                yield ident, at, end
            raise Broken("ends within an element")
        yield ident, at, stop
        at = stop


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def frames_of(data: bytes, a: int, end: int) -> tuple[int, int, int, list[int], int]:
    """Of a block: track, relative time, flags, the sizes of its frames, where the first starts."""
    track, a, _ = read_vint(data, a, end, False)
    if a + 3 > end:
        raise Broken("ends within a block")
    time, flags = struct.unpack_from(">hB", data, a)
    a += 3
    lacing = flags & 0x06
    if not lacing:
        return track, time, flags, [end - a], a
    if a >= end:
        raise Broken("ends within a block")
    n, a = data[a] + 1, a + 1
    if lacing == 0x04:
        if (end - a) % n:
            raise Broken("frames of a fixed-size lace differ")
        return track, time, flags, [(end - a) // n] * n, a
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 0x02:
            size = 0
            while True:
                if a >= end:
                    raise Broken("ends within a block")
                size, a = size + data[a], a + 1
                if data[a - 1] < 255:
                    break
        else:
            before = a
            size, a, _ = read_vint(data, a, end, False)
            if k:
                size += sizes[-1] - ((1 << 7 * (a - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - a - sum(sizes))
    if min(sizes) < 0:
        raise Broken("frames exceed their block")
    return track, time, flags, sizes, a


def parse(data: bytes | None) -> Parsed:
    """The packet table, tracks and cues of a Matroska file."""
    out = Parsed()
    if data is None:
        out.error = "null"
        return out
    try:
        found = False
        for ident, a, b in children(data, 0, len(data)):
            found |= ident == EBML
            if not found:
                raise Broken("no EBML header")
            if ident == SEGMENT:
                _segment(data, a, b, out)
        if not found:
            raise Broken("no EBML header")
    except Broken as e:
        out.error = str(e)
    return out


def _segment(data: bytes, start: int, end: int, out: Parsed) -> None:
    clusters = 0
    for ident, a, b in children(data, start, end):
        if ident == INFO:
            out.scale = next((_int(data, x, y) for i, x, y in children(data, a, b) if i == SCALE), out.scale)
        elif ident == TRACKS:
            for i, x, y in children(data, a, b):
                if i == TRACK:
                    _track(data, x, y, out)
        elif ident == CUES:
            for i, x, y in children(data, a, b):
                if i == CUE:
                    _cue(data, x, y, start, out)
        elif ident == CLUSTER:
            time = 0
            for i, x, y in children(data, a, b):
                if i == TIME:
                    time = _int(data, x, y)
                elif i == SIMPLE:
                    _block(data, x, y, time, clusters, None, out)
                elif i == GROUP:
                    inner = list(children(data, x, y))
                    key = all(j != REFERENCE for j, _, _ in inner)
                    for j, p, q in inner:
                        if j == BLOCK:
                            _block(data, p, q, time, clusters, key, out)
            clusters += 1


def _block(data: bytes, a: int, b: int, time: int, cluster: int, key: bool | None, out: Parsed) -> None:
    track, relative, flags, sizes, at = frames_of(data, a, b)
    rate = out.tracks.get(track, {}).get("sample_bytes_per_ms", 0)
    ms = (time + relative) * out.scale / 1e6
    for size in sizes:
        out.packets.append((track, ms, at, size, bool(flags & 0x80) if key is None else key, cluster))
        at += size
        ms += size / rate if rate else 0  # frames of a lace follow each other


def _track(data: bytes, a: int, b: int, out: Parsed) -> None:
    found = {i: (x, y) for i, x, y in children(data, a, b)}
    t = {"type": _int(data, *found.get(KIND, (0, 0))), "codec": data[slice(*found.get(CODEC, (0, 0)))].decode("ascii", "replace")}
    if AUDIO in found:
        audio = {i: (x, y) for i, x, y in children(data, *found[AUDIO])}
        t["rate"] = _real(data, *audio[RATE]) if RATE in audio else 8000.0
        t["channels"] = _int(data, *audio[CHANNELS]) if CHANNELS in audio else 1
        t["depth"] = _int(data, *audio[DEPTH]) if DEPTH in audio else 0
        if t["codec"].startswith("A_PCM"):
            t["sample_bytes_per_ms"] = t["rate"] * t["channels"] * t["depth"] / 8000
    out.tracks[_int(data, *found.get(NUMBER, (0, 0)))] = t


def _cue(data: bytes, a: int, b: int, segment: int, out: Parsed) -> None:
    time = 0
    for i, x, y in children(data, a, b):
        if i == CUE_TIME:
            time = _int(data, x, y)
        elif i == CUE_AT:
            at = {j: _int(data, p, q) for j, p, q in children(data, x, y)}
            out.cues.append((time * out.scale / 1e6, at.get(CUE_TRACK, 0), segment + at.get(CUE_CLUSTER, 0)))


def feature(data: bytes, p: Parsed, samples: bytes) -> str:
    """Integers that describe a parsed file and its samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    ms = round(p.packets[-1][1]) if p.packets else 0
    clusters = len({q[5] for q in p.packets})
    cued = sum(data[c[2] : c[2] + 4] == CLUSTER.to_bytes(4, "big") for c in p.cues)
    return f"packets={len(p.packets)};clusters={clusters};cues={cued};last_ms={ms};mean={int(x.sum())}/{len(x)};energy={int((x * x).sum())};crossings={crossings}"


# --- operators


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded with zero bytes to a positive multiple of 64, muxed."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in batches:
            for part in slices(b, 1, most_rows=512):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [mux(r.ljust(max(PAD, -(-len(r) // PAD) * PAD), b"\0")) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, codec, timestamp_ms, byte_offset, n_bytes, is_key, cluster, error.

    A file with no packet gives one row whose packet is null; so does one with
    an error, after its packets.
    """
    src = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = T.StructType([
        T.StructField("id", src.schema["id"].dataType), T.StructField("packet", T.LongType()), T.StructField("track", T.LongType()), T.StructField("codec", T.StringType()),
        T.StructField("timestamp_ms", T.DoubleType()), T.StructField("byte_offset", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("is_key", T.BooleanType()), T.StructField("cluster", T.LongType()), T.StructField("error", T.StringType()),
    ])

    def run(batches):
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
            for part in slices(b, 1, most_rows=256):
                rows: list[tuple] = []
                for ident, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    p = parse(data)
                    rows += [(ident, i, t, p.tracks.get(t, {}).get("codec"), ms, at, n, key, c, None) for i, (t, ms, at, n, key, c) in enumerate(p.packets)]
                    if p.error or not p.packets:
                        rows.append((ident, *[None] * 8, p.error))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=schema.names)

    return src.mapInArrow(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``text_media`` hold: hashes of the samples read back and of the file, and a feature string."""
    schema = T.StructType([
        media.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    ])

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in b.column(2):
                data = value.as_py()
                p = parse(data)
                if p.error:
                    raise Broken(p.error)
                samples = b"".join([data[at : at + n] for _, _, at, n, _, _ in p.packets])
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, p, samples))
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
