"""BAM files in ranges of BGZF blocks, a task a range, and one sorted BAM file as a sink; no other libraries.

A file is never held whole. A range that doesn't begin at a known record looks for one: a place from which several
records follow each other. Each task also looks for the place at which the next range begins and compares it with
the end of its own last record; so no record is lost or read twice, or the read fails and split=0 reads the file
in one task. Places are virtual offsets: the block's place in the file, times 65536, and the place in the block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ALIGNMENTS, RECORDS

# Fixed values of the format: codes of bases, of CIGAR operations, and bytes of a tag's value.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"
WIDTHS = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FIXED = struct.Struct("<3i2B3H4i")
_PAIRS = [a + b for a in BASES for b in BASES]
#: Compressed bytes of a range; a block's most bytes; bytes read at a time; rows of a batch; records that prove a place.
SPLIT, BLOCK, READ, BATCH, PROOF = 32 << 20, 1 << 16, 1 << 20, 10_000, 4


def open_file(uri: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows, to be read by range."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    if "://" in uri:
        files, name = pafs.FileSystem.from_uri(uri)
        return files.open_input_file(name)
    return pafs.LocalFileSystem().open_input_file(os.path.abspath(uri))


def block_extent(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(bytes, bytes before the deflated data) of the BGZF block at a place, None where there is none."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    k, end = at + 12, min(at + 12 + extra, len(data))
    while k + 4 <= end:
        name, n = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if name == b"BC" and n == 2 and k + 6 <= end:
            return struct.unpack_from("<H", data, k + 4)[0] + 1, 12 + extra
        k += 4 + n
    return None


def blocks(source: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of the blocks from a place on, empty ones left out."""
    held, first = b"", at
    while at < size:
        if first + len(held) < min(at + BLOCK, size):
            held, first = held[at - first :] + source.read_at(READ, first + len(held)), at
        found = block_extent(held, at - first)
        if found is None:
            raise ValueError(f"no BGZF block at {at}")
        n, skip = found
        data = zlib.decompress(held[at - first + skip : at - first + n - 8], -15)
        if data:
            yield at, data
        at += n


def members(source: pa.NativeFile, size: int) -> Iterator[tuple[int, bytes]]:
    """The same of a gzip file that is not BGZF, whose places are only counted."""
    member, at, k = zlib.decompressobj(31), 0, 0
    while at < size:
        data = source.read_at(READ >> 3, at)
        at += len(data)
        while data:
            out = member.decompress(data)
            if out:
                yield k, out
                k += 1
            data = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def parse_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, (name, length) of the references, where the records start); struct.error if more bytes are needed."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("no BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    text, at, out = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n, []
    (n,) = struct.unpack_from("<i", data, at)
    at += 4
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        (length,) = struct.unpack_from("<i", data, at + 4 + size)
        out.append((data[at + 4 : at + 3 + size].decode(), length))
        at += 8 + size
    return text, out, at


def read_header(source: pa.NativeFile, size: int) -> tuple[str, list[tuple[str, int]], tuple[int, int], bool]:
    """(text, references, (place of a block, bytes of it before the first record), whether the file is BGZF).

    Only the blocks of the header are read.
    """
    regular = block_extent(source.read_at(BLOCK, 0)) is not None
    whole, starts, goal = b"", [], 1
    for place, data in blocks(source, 0, size) if regular else members(source, size):
        starts.append((len(whole), place))
        whole += data
        if len(whole) < goal:
            continue
        try:
            text, names, end = parse_header(whole)
        except struct.error:
            goal = 2 * len(whole)
            continue
        start, place = max(s for s in starts if s[0] <= end)
        return text, names, (place, end - start), regular
    text, names, end = parse_header(whole)
    start, place = max(s for s in starts if s[0] <= end)
    return text, names, (place, end - start), regular


def records(stream: Iterator[tuple[int, bytes]], skip: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(virtual offset, bytes, start, end) of each record of a stream of blocks; start is that of its size field."""
    tail, began = b"", 0
    for place, data in stream:
        whole, at, skip = tail + data, skip, 0
        old = len(tail)
        while len(whole) >= at + 4:
            (n,) = struct.unpack_from("<i", whole, at)
            if n < 32:
                raise ValueError("no record where one is due")
            if at + 4 + n > len(whole):
                break
            yield began if at < old else place << 16 | at - old, whole, at, at + 4 + n
            at += 4 + n
        if at >= old:
            began = place << 16 | at - old
        tail = whole[at:]
    if tail:
        raise ValueError("the file ends within a record")


def next_block(source: pa.NativeFile, at: int, size: int) -> int | None:
    """Place of the first block at or after a place: its header, and a block or the file's end after it."""
    while at < size:
        data = source.read_at(3 * BLOCK, at)
        k = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= k < BLOCK:
            found = block_extent(data, k)
            if found and (at + k + found[0] == size or block_extent(data, k + found[0])):
                return at + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        at += BLOCK
    return None


def _plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record at a place ends if its fixed fields, name and CIGAR can be a record's, as far as data goes."""
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, ref2, pos2, _ = _FIXED.unpack_from(data, at)
    if not (32 <= size < 1 << 29 and -1 <= ref < len(lengths) and -1 <= ref2 < len(lengths) and n_name and n_seq >= 0 and pos >= -1 and pos2 >= -1):
        return None
    if 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size or (ref >= 0 and pos > lengths[ref]) or (ref2 >= 0 and pos2 > lengths[ref2]):
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops : 4]
    return at + 4 + size if all(c & 15 < len(CIGAR) for c in ops) else None


def _candidates(data: bytes, n_refs: int) -> list[int]:
    """Places whose fixed fields can be a record's, found for all places at once."""
    m = len(data) - 35
    if m <= 0:
        return []
    raw = np.frombuffer(data, dtype="uint8")
    words = np.lib.stride_tricks.as_strided(raw, (len(data) - 3, 4), (1, 1)).copy().view("<i4")[:, 0]
    size, ref, pos, n_seq, ref2, pos2 = (words[k : k + m] for k in (0, 4, 8, 20, 24, 28))
    fits = (size >= 32) & (size < 1 << 29) & (n_seq >= 0) & (n_seq <= size) & (raw[12 : 12 + m] > 0)
    for r, p in ((ref, pos), (ref2, pos2)):
        fits &= (r >= -1) & (r < n_refs) & (p >= -1)
    return np.flatnonzero(fits).tolist()


def _first_record(data: bytes, lengths: list[int], whole: bool) -> int | None:
    """The first place from which records follow each other: PROOF of them, or up to the end where data is whole."""
    for start in _candidates(data, len(lengths)):
        at, n = start, 0
        while n < PROOF:
            if whole and at == len(data):
                return start
            if at + 36 > len(data):
                break
            at = _plausible(data, at, lengths)
            if at is None:
                break
            n += at <= len(data)
            if at > len(data):
                break
        if n == PROOF:
            return start
    return None


def resynchronise(source: pa.NativeFile, at: int, size: int, lengths: list[int]) -> int | None:
    """Virtual offset of the first record that starts in a block at or after a place, None without any."""
    at = next_block(source, at, size)
    if at is None:
        return None
    data, starts, goal = b"", [], 4 * BLOCK

    def virtual(k: int) -> int:
        start, place = max(s for s in starts if s[0] <= k)
        return place << 16 | k - start

    for place, more in blocks(source, at, size):
        starts.append((len(data), place))
        data += more
        if len(data) >= goal:
            found = _first_record(data, lengths, False)
            if found is not None:
                return virtual(found)
            goal *= 4
    found = _first_record(data, lengths, True)
    return None if found is None else virtual(found)


def read_range(source: pa.NativeFile, size: int, low: int, high: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Records that start in the blocks of a range of the file; the first range has the header, the last the end."""
    _, names, (place, skip), regular = read_header(source, size)
    if not regular:
        if low == 0:
            stream = members(source, size)
            for k, data in stream:
                if k == place:
                    yield from records(_chain((k, data), stream), skip)
                    return
        return
    lengths = [n for _, n in names]

    def boundary(at: int) -> tuple[int, int] | None:
        """Where the first record at or after a place of the file starts."""
        if at <= place:
            return place, skip
        found = None if at >= size else resynchronise(source, at, size, lengths)
        return None if found is None else (found >> 16, found & 0xFFFF)

    begin, after = boundary(low), boundary(high)
    if begin == after:
        return
    for found in records(blocks(source, begin[0], size), begin[1]):
        if found[0] >= high << 16:
            if after != (found[0] >> 16, found[0] & 0xFFFF):
                break
            return
        yield found
    else:
        if after is None:
            return
    raise ValueError(f"the records of bytes {low} to {high} do not meet the next range; read the file with split=0")


def _chain(first: tuple[int, bytes], rest: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    yield first
    yield from rest


def text_tags(data: bytes, at: int, end: int) -> dict[str, str]:
    """A record's tags with text."""
    out = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            if kind == "Z":
                out[name] = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            (n,) = struct.unpack_from("<i", data, at + 1)
            at += 5 + n * WIDTHS[chr(data[at])]
        else:
            at += WIDTHS[kind]
    return out


def decode(data: bytes, at: int, end: int, names: list[tuple[str, int]]) -> tuple:
    """The columns of a record."""
    _, ref, pos, n_name, _, _, n_ops, flag, n_seq, _, _, _ = _FIXED.unpack_from(data, at)
    at += 36 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    half = (n_seq + 1) // 2
    seq = "".join([_PAIRS[b] for b in data[at : at + half]])[:n_seq]
    cigar = "".join([f"{o >> 4}{CIGAR[o & 15]}" for o in ops]) or "*"
    return names[ref][0] if ref >= 0 else None, pos if pos >= 0 else None, cigar, seq, flag, list(text_tags(data, at + half + n_seq, end).items())


_ARROW = {
    "rname": pa.string(), "pos": pa.int64(), "cigar": pa.string(), "seq": pa.string(), "flag": pa.int32(), "tags": pa.map_(pa.string(), pa.string()),
    "ref": pa.int32(), "place": pa.int64(), "record": pa.binary(),
}


def read_bam(spark: SparkSession, path: str, chromosome: str | None = None, start: int = 0, end: int = 1 << 31, *, keep_records: bool = False, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files, a task a range of split compressed bytes (0: a task a file); path may be a pattern or a folder.

    With a chromosome, records elsewhere or that start at end or later are dropped before they are decoded, and those
    that end before start later, by operators. keep_records adds ref, place and record, the record's bytes, as
    write_bam takes them. An empty folder gives no rows; a file that isn't BAM or ends within a record is an error.
    """
    names = list(_ARROW) if keep_records else list(_ARROW)[:6]
    schema = pa.schema([(n, _ARROW[n]) for n in names])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for r in some.to_pylist():
                with open_file(r["path"]) as source:
                    known = read_header(source, r["length"])[1]
                    wanted = next((k for k, (n, _) in enumerate(known) if n == chromosome), -2)
                    rows = []
                    for place, data, at, stop in read_range(source, r["length"], r["low"], r["high"]):
                        ref, pos = struct.unpack_from("<2i", data, at + 4)
                        if chromosome is not None and (ref != wanted or pos >= end):
                            continue
                        row = decode(data, at, stop, known)
                        rows.append((*row, ref, place, data[at:stop]) if keep_records else row)
                        if len(rows) == BATCH:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    step = F.lit(split) if split else F.col("length")
    ranges = files.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))))
    ranges = ranges.withColumn("high", F.least(F.col("low") + step, F.col("length")))
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    if split:
        total = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
        tasks = min(max(int(total), 1), 100_000)
    found = ranges.repartitionByRange(tasks, "path", "low").mapInArrow(read, RECORDS if keep_records else ALIGNMENTS)
    return found.filter(F.col("rname") == chromosome) if chromosome is not None else found


def header_of(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """(text, (name, length) of the references) of the first of the files, of which only the header is read."""
    first = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").first()
    with open_file(first["path"]) as source:
        return read_header(source, first["length"])[:2]


def block(data: bytes) -> bytes:
    """A BGZF block; without data, the one that ends a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    own = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(own) + 25)
    return head + own + struct.pack("<2I", zlib.crc32(data), len(data))


def sorted_header(text: str, names: list[tuple[str, int]]) -> bytes:
    """A header whose first line says that the records are sorted by coordinate."""
    lines = text.splitlines()
    first = [f for f in lines.pop(0).split("\t") if not f.startswith(("SO:", "GO:", "SS:"))] if lines and lines[0].startswith("@HD") else ["@HD", "VN:1.6"]
    own = "".join(line + "\n" for line in ["\t".join([*first, "SO:coordinate"]), *lines]).encode()
    known = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in names)
    return b"BAM\1" + struct.pack("<i", len(own)) + own + struct.pack("<i", len(names)) + known


def write_bam(path: str, alignments: DataFrame, text: str, names: list[tuple[str, int]], before: list[str] = []) -> None:  # noqa: B006
    """One BAM file of alignments read with keep_records, by reference, position and strand; ties by the columns of
    before, then by their place. Tasks sort and deflate ranges of it, and the driver only strings their blocks together."""
    most = 65_280

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for some in batches:
            out = []
            for r in some.column(0):
                held += r.as_py()
                while len(held) >= most:
                    out.append(block(bytes(held[:most])))
                    del held[:most]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(bytes(held))], pa.binary())], names=["b"])

    last = F.when(F.col("ref") < 0, 1).otherwise(0)
    ordered = alignments.orderBy(last, "ref", "pos", F.col("flag").bitwiseAND(16), *before, "place").select("record")
    head = sorted_header(text, names)
    with open(path, "wb") as out:
        for k in range(0, len(head), most):
            out.write(block(head[k : k + most]))
        for r in ordered.mapInArrow(pack, "b binary").toLocalIterator():
            out.write(r["b"])
        out.write(block(b""))
