"""WARC records in ZIP-packaged web archives, written by partition and read by byte ranges.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (or ``.warc``), one gzip member
a record, and ``indexes/index.cdxj``, a JSON line a record with its place in the WARC member. The
reader parses the end records (ZIP64 ones too), the central directory and the members' local headers,
and then reads single records by range; it extracts nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, filesystem, join_hot, new_path, write_atomically

#: Payloads of fewer bytes are always stored whole.
LEAST_SHARED = 100
ARCHIVE_BYTES = 1 << 30
_END = 22
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header_at: int


class ZipWriter:
    """Stored members written to a stream; sizes follow the data, ZIP64 fields where needed or asked for."""

    def __init__(self, force_zip64: bool = False):
        self.at, self.members, self.force = 0, [], force_zip64

    def _out(self, data: bytes) -> bytes:
        self.at += len(data)
        return data

    def member(self, name: str, parts: Iterator[bytes]) -> Iterator[bytes]:
        start, crc, size, raw = self.at, 0, 0, name.encode()
        yield self._out(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            yield self._out(part)
        wide = self.force or size > _MAX32
        yield self._out(struct.pack("<4sL2Q" if wide else "<4s3L", b"PK\x07\x08", crc, size, size))
        self.members.append(Member(name, 0, 0x0808, crc, size, size, start))

    def end(self) -> Iterator[bytes]:
        start = self.at
        for m in self.members:
            raw, extra = m.name.encode(), b""
            wide, far = self.force or m.size > _MAX32, self.force or m.header_at > _MAX32
            if wide or far:
                body = (struct.pack("<2Q", m.size, m.packed) if wide else b"") + (struct.pack("<Q", m.header_at) if far else b"")
                extra = struct.pack("<2H", 1, len(body)) + body
            sizes = (_MAX32, _MAX32) if wide else (m.packed, m.size)
            yield self._out(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, m.flags, 0, 0, 0x21, m.crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if far else m.header_at) + raw + extra)
        size, n, at = self.at - start, len(self.members), self.at
        wide = self.force or start > _MAX32 or n >= _MAX16
        if wide:
            yield self._out(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1))
        yield self._out(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, *(2 * [_MAX16 if wide else n]), _MAX32 if wide else size, _MAX32 if wide else start, 0))


class ZipReader:
    """Members of a ZIP file by name, and byte ranges of the stored ones. source: has size() and read_at(n, at)."""

    def __init__(self, source):
        self.source, self.members, self._data_at = source, {}, {}
        size = source.size()
        tail_at = max(0, size - _END - _MAX16)
        tail = source.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + _END > len(tail) or end + _END + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end record of a ZIP archive")
        _, _, _, n, length, at = struct.unpack_from("<4H2L", tail, end + 4)
        locator_at = tail_at + end - 20
        if locator_at >= 0:
            mark, _, wide_at, _ = struct.unpack("<4sLQL", source.read_at(20, locator_at))
            if mark == b"PK\x06\x07":
                mark, _, _, _, _, _, _, n, length, at = struct.unpack("<4sQ2H2L4Q", source.read_at(56, wide_at))
                if mark != b"PK\x06\x06":
                    raise ValueError("the ZIP64 end record is missing")
        self._central(source.read_at(length, at), n)

    def _central(self, data: bytes, n: int) -> None:
        at = 0
        for _ in range(n):
            mark, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, header_at = struct.unpack_from("<4s6H3L5H2L", data, at)
            if mark != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, place = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while place + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, place)
                if kind == 1:  # ZIP64: the fields whose short form is full, in this order
                    field = place + 4
                    if size == _MAX32:
                        (size,), field = struct.unpack_from("<Q", extra, field), field + 8
                    if packed == _MAX32:
                        (packed,), field = struct.unpack_from("<Q", extra, field), field + 8
                    if header_at == _MAX32:
                        (header_at,) = struct.unpack_from("<Q", extra, field)
                place += 4 + length
            self.members[name] = Member(name, method, flags, crc, packed, size, header_at)
            at += 46 + n_name + n_extra + n_comment

    def read(self, name: str, at: int, n: int) -> bytes:
        """n bytes of a stored member from byte at on."""
        m = self.members[name]
        if m.method or m.flags & 1:
            raise ValueError(f"{name} is not stored as it is")
        if not 0 <= at <= at + n <= m.size:
            raise ValueError(f"{name} has no bytes {at} to {at + n}")
        if name not in self._data_at:
            head = self.source.read_at(30, m.header_at)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"{name} has no local header")
            self._data_at[name] = m.header_at + 30 + sum(struct.unpack_from("<2H", head, 26))
        return self.source.read_at(n, self._data_at[name] + at)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (which has the HTTP head only) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> Record:
    """One WARC record, gzip-compressed or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _fields(head)
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


def _page(urn: str | None) -> int | None:
    name = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(name[1]) if name else None


def _write(root: str, compress: bool, limit: int, force_zip64: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows = TaskContext.get().partitionId(), 0, (r for b in batches for r in _rows(b))
        row = next(rows, None)
        while row is not None:
            archive, index = ZipWriter(force_zip64), []

            def records() -> Iterator[bytes]:
                nonlocal row
                at, name = 0, "data.warc" + ".gz" * compress  # noqa: B023
                while row is not None and at < limit:
                    page_id, url, payload, digest, refers_to = row
                    data = make_record(page_id, url, payload, digest, refers_to)
                    data = gzip.compress(data, 6, mtime=0) if compress else data
                    index.append({"id": page_id, "url": url, "type": "response" if refers_to is None else "revisit", "digest": f"sha256:{digest}", "filename": name, "offset": at, "length": len(data)})  # noqa: B023
                    at += len(data)
                    yield data
                    row = next(rows, None)

            def parts() -> Iterator[bytes]:
                yield from archive.member("archive/data.warc" + ".gz" * compress, records())  # noqa: B023
                yield from archive.member("indexes/index.cdxj", (json.dumps(x).encode() + b"\n" for x in index))  # noqa: B023
                yield from archive.end()  # noqa: B023

            path = f"{root}/part-{part:08d}-{number:04d}.wacz"
            size = write_atomically(path, parts())
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "n_records": pa.array([len(index)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
            number += 1

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        page_id, url, html, digest, refers_to = (batch.column(k)[i].as_py() for k in range(5))
        yield page_id, url, (html or "").encode(), digest, refers_to


def write_archives(
    pages: DataFrame, *, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES, force_zip64: bool = False,
) -> tuple[str, DataFrame]:
    """Writes a WARC record a row; returns the folder and the archives (path, n_records, n_bytes).

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of LEAST_SHARED bytes
    or more, those of the smallest id are responses and the others revisit them; the smallest id comes
    from an aggregate with partial results, and digests that occur once don't enter the join. Ids are
    integers; null ids are written as null and never revisited; a null url leaves out the target;
    repeated rows give a record each; an empty table writes no archive; other columns are ignored.
    Archives are cut at archive_bytes and get their final name when whole.
    """
    spark = pages.sparkSession
    root = (root or new_path(spark, "archives")).rstrip("/")
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    shared = rows.filter(F.col("n") >= LEAST_SHARED).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows")).filter(F.col("_rows") > 1)
    joined = rows.join(shared.select("_digest", "_first"), F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    source = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    written = source.mapInArrow(_write(root, compress, archive_bytes, force_zip64), "path string, n_records bigint, n_bytes bigint")
    return root, Scratch(spark, "archive-manifest").save(written, "manifest")


def _read(keep_html: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    archive = ZipReader(source)
                    index = archive.members["indexes/index.cdxj"]
                    lines = archive.read(index.name, 0, index.size).split(b"\n")[:-1]
                    for first in range(0, len(lines), 500):
                        out = [_read_record(archive, json.loads(x)) for x in lines[first : first + 500]]
                        columns = [[r[k] for r in out] for k in range(6 + keep_html)]
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return run


def _read_record(archive: ZipReader, entry: dict) -> tuple:
    record = parse_record(archive.read("archive/" + entry["filename"], entry["offset"], entry["length"]))
    kind, digest = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(record.http["content-length"])
    if kind == "response" and (len(record.payload), hashlib.sha256(record.payload).hexdigest()) != (size, digest):
        raise ValueError("a payload differs from its digest or length")
    return (
        _page(record.headers["warc-record-id"]), record.headers.get("warc-target-uri"), size, digest, kind,
        _page(record.headers.get("warc-refers-to")), record.payload.decode() if kind == "response" else None,
    )


def _index_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the responses of archives, from their indexes alone."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, name = filesystem(path)
            with files.open_input_file(name) as source:
                archive = ZipReader(source)
                index = archive.members["indexes/index.cdxj"]
                lines = [json.loads(x) for x in archive.read(index.name, 0, index.size).split(b"\n")[:-1]]
            own = [x for x in lines if x["type"] == "response"]
            yield pa.RecordBatch.from_pydict({
                "_digest": pa.array([x["digest"].removeprefix("sha256:") for x in own], pa.string()), "_at": pa.array([x["id"] for x in own], pa.int64()), "_path": pa.array([path] * len(own), pa.string()),
                "_entry": pa.array([json.dumps({k: x[k] for k in ("filename", "offset", "length")}) for x in own], pa.string()),
            })


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills html by range reads of the records at _path and _entry."""
    for batch in batches:
        found: dict[tuple, str] = {}
        for path, entry in sorted(set(zip(batch.column("_path").to_pylist(), batch.column("_entry").to_pylist(), strict=True))):
            files, name = filesystem(path)
            with files.open_input_file(name) as source:
                found[path, entry] = _read_record(ZipReader(source), json.loads(entry))[6]
        kept = [c for c in batch.schema.names if c not in ("_path", "_entry")]
        texts = [found[k] for k in zip(batch.column("_path").to_pylist(), batch.column("_entry").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "html"])


def read_archives(archives: DataFrame, *, keep_html: bool = False) -> DataFrame:
    """Per record of the archives (column path): page_id, url, payload_bytes and payload_digest of the
    full payload (a revisit has them in its heads), record_type, refers_to, and with keep_html the
    payload; that of a revisit is read by range from the response that it refers to, whose place comes
    from the indexes. A damaged archive or a payload that does not fit its digest raises an error.
    """
    spark = archives.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = archives.select("path").repartitionByRange(n, "path")
    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not keep_html:
        return paths.mapInArrow(_read(False), kinds)
    scratch = Scratch(spark, "revisits")
    rows = paths.mapInArrow(_read(True), kinds + ", html string")
    revisits = scratch.save(rows.filter("record_type = 'revisit'").drop("html"), "rows")
    often = revisits.groupBy(F.col("payload_digest").alias("_often")).agg(F.count("*").alias("_n"))
    places = paths.mapInArrow(_index_of, "_digest string, _at bigint, _path string, _entry string")
    places = scratch.save(places.join(often, F.col("_digest") == F.col("_often")).groupBy("_digest").agg(F.min(F.struct("_at", "_path", "_entry")).alias("_p"), F.max("_n").alias("_n")).select("_digest", "_n", "_p._path", "_p._entry"), "places")
    found = join_hot(revisits, "payload_digest", places, "_digest", "_n", revisits.count()).select(*revisits.columns, "_path", "_entry")
    return rows.filter("record_type <> 'revisit'").unionByName(found.mapInArrow(_fetch, kinds + ", html string"))
