"""Media columns: Matroska files as binary values, and their packet tables.

The reader walks EBML elements by their variable-length ids and sizes (unknown sizes too), collects
tracks, clusters, block groups, simple blocks and cues, and splits laced blocks (Xiph, EBML and
fixed-size), giving each packet its track, timestamp and byte range. The writer stores byte strings
as 8-bit PCM, fixed-size frames laced into blocks, with a cue for each cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import utf8_chunks

# Element ids: fixed values of the format.
EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 192  # samples a packet: 24 ms at 8000 a second
RATE = 8000
LACED = 8
CLUSTER_PACKETS = 208
PAD = b" "


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _size(value: int, width: int = 0) -> bytes:
    """An EBML size; the all-ones value of each width is reserved for unknown sizes."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _signed(value: int) -> bytes:
    n = next(k for k in range(1, 9) if abs(value) < (1 << 7 * k - 1))
    return ((value + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(kind: int, track: int, relative: int, frames: list[bytes], lacing: int, flags: int = 0x80) -> bytes:
    """A Block or SimpleBlock of frames; one frame needs no lacing."""
    if len(frames) == 1:
        lacing = NO_LACING
    head = _size(track) + struct.pack(">hB", relative, flags | lacing << 1)
    sizes = [len(f) for f in frames]
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _size(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    elif lacing == FIXED and len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return element(kind, head + b"".join(frames))


def _head(n_packets: int) -> bytes:
    audio = element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, audio)
    info = _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", n_packets * FRAME * 1000 / RATE)) + element(MUXING_APP, b"media columns") + element(WRITING_APP, b"media columns")
    return element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, entry))


def write(payload: bytes, lacing: int = FIXED) -> bytes:
    """A Matroska file whose only track's packets, joined, are payload (a positive multiple of FRAME bytes)."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a payload has a positive multiple of {FRAME} bytes")
    n, ms = len(payload) // FRAME, FRAME * 1000 // RATE
    parts, cues = [_head(n)], []
    at = len(parts[0])
    for first in range(0, n, CLUSTER_PACKETS):
        last = min(n, first + CLUSTER_PACKETS)
        body = [_uint(TIMESTAMP, first * ms)]
        for i in range(first, last, LACED):
            end = min(last, i + LACED)
            if lacing == FIXED and end - i > 1:  # frames of one size stand as they are
                data = payload[i * FRAME : end * FRAME]
                body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hBB", (i - first) * ms, 0x84, end - i - 1) + data))
            else:
                body.append(block(SIMPLE_BLOCK, 1, (i - first) * ms, [payload[k * FRAME : (k + 1) * FRAME] for k in range(i, end)], lacing))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    head = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ, 2))
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


class Packets(NamedTuple):
    """A packet table: equally long arrays, in file order; and what stands beside the packets."""

    track: np.ndarray
    timestamp_ns: np.ndarray
    at: np.ndarray
    size: np.ndarray
    block: np.ndarray
    key: np.ndarray
    lacing: np.ndarray
    cluster: np.ndarray
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte of its cluster
    clusters: list[int]  # first byte of each


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.scale, self.origin = data, 1_000_000, 0
        self.rows: list[tuple[int, int, list[int], int, int, bool, int]] = []
        self.tracks, self.cues, self.clusters = {}, [], []

    def varint(self, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
        """(value, next byte, whether all value bits are ones)."""
        first = self.data[at]
        if not first:
            raise ValueError(f"no variable-length integer at byte {at}")
        n = 9 - first.bit_length()
        if at + n > len(self.data):
            raise ValueError("the file ends in an integer")
        raw = int.from_bytes(self.data[at : at + n], "big")
        value = raw & ((1 << 7 * n) - 1)
        return raw if keep_marker else value, at + n, value == (1 << 7 * n) - 1

    def children(self, at: int, end: int, of: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(id, first byte, first and last byte of the body). A body of unknown size ends before the next
        element that can't be its child."""
        while at < end:
            start = at
            kind, at, _ = self.varint(at, True)
            size, at, unknown = self.varint(at)
            if unknown:
                if kind not in (SEGMENT, CLUSTER):
                    raise ValueError("only segments and clusters may have unknown sizes")
                stop = end if kind == SEGMENT else self.cluster_end(at, end)
            else:
                stop = at + size
            if stop > end:
                raise ValueError(f"the element at byte {start} is cut off")
            yield kind, start, at, stop
            at = stop

    def cluster_end(self, at: int, end: int) -> int:
        while at < end:
            start = at
            kind, at, _ = self.varint(at, True)
            if kind in _TOP:
                return start
            size, at, _ = self.varint(at)
            at += size
        return end

    def uint(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def read(self) -> Packets:
        kinds = []
        for kind, _, a, b in self.children(0, len(self.data)):
            kinds.append(kind)
            if kind == EBML:
                types = [self.data[x:y] for k, _, x, y in self.children(a, b) if k == DOC_TYPE]
                if types and types[0].rstrip(b"\0") not in (b"matroska", b"webm"):
                    raise ValueError("another document type")
            elif kind == SEGMENT:
                self.segment(a, b)
        if kinds[:1] != [EBML] or SEGMENT not in kinds:
            raise ValueError("no Matroska file")
        return self.packets()

    def segment(self, a: int, b: int) -> None:
        self.origin, found = a, list(self.children(a, b))
        for kind, _, x, y in found:
            if kind == INFO:
                for k, _, p, q in self.children(x, y):
                    if k == TIMESTAMP_SCALE:
                        self.scale = self.uint(p, q)
            elif kind == TRACKS:
                for k, _, p, q in self.children(x, y):
                    if k == TRACK_ENTRY:
                        self.track(p, q)
        for kind, start, x, y in found:
            if kind == CLUSTER:
                self.clusters.append(start)
                self.cluster(x, y)
            elif kind == CUES:
                for k, _, p, q in self.children(x, y):
                    if k == CUE_POINT:
                        self.cue(p, q)

    def track(self, a: int, b: int) -> None:
        own = {"number": 0, "type": 0, "codec": "", "default_ns": 0}
        for k, _, p, q in self.children(a, b):
            if k == TRACK_NUMBER:
                own["number"] = self.uint(p, q)
            elif k == TRACK_TYPE:
                own["type"] = self.uint(p, q)
            elif k == CODEC_ID:
                own["codec"] = self.data[p:q].rstrip(b"\0").decode()
            elif k == DEFAULT_DURATION:
                own["default_ns"] = self.uint(p, q)
        self.tracks[own["number"]] = own

    def cue(self, a: int, b: int) -> None:
        time, places = 0, []
        for k, _, p, q in self.children(a, b):
            if k == CUE_TIME:
                time = self.uint(p, q)
            elif k == CUE_POSITIONS:
                own = {kk: self.uint(x, y) for kk, _, x, y in self.children(p, q)}
                places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0) + self.origin))
        self.cues += [(time * self.scale, track, at) for track, at in places]

    def cluster(self, a: int, b: int) -> None:
        base = 0
        for kind, _, x, y in self.children(a, b):
            if kind == TIMESTAMP:
                base = self.uint(x, y)
            elif kind == SIMPLE_BLOCK:
                self.block(base, x, y, None)
            elif kind == BLOCK_GROUP:
                inner = list(self.children(x, y))
                key = not any(k == REFERENCE for k, *_ in inner)
                for k, _, p, q in inner:
                    if k == BLOCK:
                        self.block(base, p, q, key)

    def block(self, base: int, a: int, b: int, key: bool | None) -> None:
        track, at, _ = self.varint(a)
        if at + 3 > b:
            raise ValueError("a block is cut off")
        relative, flags = struct.unpack_from(">hB", self.data, at)
        at, lacing = at + 3, flags >> 1 & 3
        sizes: list[int] = []
        if lacing:
            n = self.data[at] + 1
            at += 1
            if lacing == XIPH:
                for _ in range(n - 1):
                    size = 0
                    while self.data[at] == 255:
                        size, at = size + 255, at + 1
                    sizes.append(size + self.data[at])
                    at += 1
            elif lacing == EBML_LACING and n > 1:
                size, at, _ = self.varint(at)
                sizes.append(size)
                for _ in range(n - 2):
                    start = at
                    raw, at, _ = self.varint(at)
                    sizes.append(sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1))
            elif lacing == FIXED:
                if (b - at) % n:
                    raise ValueError("a laced block has no equal parts")
                sizes = [(b - at) // n] * (n - 1)
        rest = b - at - sum(sizes)
        if rest < 0 or min(sizes, default=0) < 0:
            raise ValueError("a laced block is too short")
        self.rows.append((track, (base + relative) * self.scale, [*sizes, rest], at, len(self.clusters) - 1, bool(flags & 0x80) if key is None else key, lacing))

    def packets(self) -> Packets:
        rows = self.rows
        many = np.array([len(r[2]) for r in rows], dtype=np.int64)
        of = np.repeat(np.arange(len(rows)), many)
        size = np.array([s for r in rows for s in r[2]], dtype=np.int64)
        within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        before = np.cumsum(size) - size
        column = lambda k, kind=np.int64: np.array([r[k] for r in rows], dtype=kind)[of]
        default = np.array([self.tracks.get(r[0], {}).get("default_ns", 0) for r in rows], dtype=np.int64)[of]
        at = column(3) + before - (before[np.cumsum(many) - many][of] if len(of) else 0)
        return Packets(column(0), column(1) + within * default, at, size, of, column(5, bool), column(6), column(4), self.tracks, self.cues, self.clusters)


def read(data: bytes) -> Packets:
    """The packet table of a file. Files that are cut off or no Matroska raise ValueError."""
    try:
        return _Reader(data).read()
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file is cut off: {e}") from e


def pad(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % FRAME or (FRAME if not raw else 0))


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8, padded with spaces to a positive multiple of
    FRAME bytes, as the samples of a Matroska file. Null is empty; repeated rows give equal files; an
    empty table gives no rows; other columns are ignored."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in utf8_chunks(batch.column("text")):
                media = [write(pad(bytes(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


PACKET = "array<struct<track:bigint,timestamp_ns:bigint,at:bigint,size:bigint,block:bigint,key:boolean,lacing:bigint,cluster:bigint>>"


def packet_tables(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, packets, cues, error): the packet table of each value of a media column. Null gives no
    packets; a value that is no whole Matroska file gives none, and what is wrong as error."""
    source = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    packet = pa.list_(pa.struct([(k, pa.bool_() if k == "key" else pa.int64()) for k in ("track", "timestamp_ns", "at", "size", "block", "key", "lacing", "cluster")]))
    cue = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster_at", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value, found, error = batch.column("media")[i].as_py(), None, None
                try:
                    found = read(value) if value is not None else None
                except ValueError as e:
                    error = str(e)
                names = ("track", "timestamp_ns", "at", "size", "block", "key", "lacing", "cluster")
                table = [dict(zip(names, r, strict=True)) for r in zip(*(getattr(found, k).tolist() for k in names), strict=True)] if found else []
                cues = [{"timestamp_ns": t, "track": k, "cluster_at": a} for t, k, a in found.cues] if found else []
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([table], packet), pa.array([cues], cue), pa.array([error], pa.string())], names=["id", "packets", "cues", "error"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(rows, f"id {kind}, packets {PACKET}, cues array<struct<timestamp_ns:bigint,track:bigint,cluster_at:bigint>>, error string")


def payload(data: bytes, packets: Packets, track: int = 1) -> bytes:
    """The packets of a track, joined; runs of neighbours are copied at once."""
    own = packets.track == track
    at, size = packets.at[own], packets.size[own]
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(at)]]) - 1
    return b"".join(data[a:b] for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True))


def digests(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Per media value: doc_id, n_bytes (as given), payload_bytes, payload_sha256, tail_crc32 (last 16 payload bytes),
    media_bytes, media_sha256 and feature, a text of packets, blocks, clusters, cues, the duration and
    the mean absolute difference of neighbouring samples. Null media give null in all columns but the first
    two; a damaged value raises an error; repeated rows give equal rows; an empty table gives none."""
    source = media.select(media[id_col].alias("doc_id"), media[size_col].alias("n_bytes"), media[media_col].alias("media"))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        found = read(data)
        back = payload(data, found)
        samples = np.frombuffer(back, dtype=np.uint8)
        change = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
        ms = int(found.timestamp_ns[-1] // 1_000_000) + FRAME * 1000 // RATE if len(found.at) else 0
        starts = set(found.clusters)
        good = sum(c[2] in starts for c in found.cues)
        feature = f"packets={len(found.at)};blocks={int(found.block[-1]) + 1 if len(found.at) else 0};clusters={len(found.clusters)};cues={good};ms={ms};change={change / max(1, len(samples) - 1):.4f}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            column = batch.column("media")
            found = [one(column[i].as_py()) for i in range(batch.num_rows)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
