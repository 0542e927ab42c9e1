import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest

from clonalis.llm import warc_zip as wz
from clonalis.llm.runtime import filesystem

LONG, OTHER = "<p>" + "é" * 60, "x" * 100
PAGES = [
    (3, "http://a/1", LONG), (1, "http://a/2", LONG), (2, None, LONG), (9, "http://b\r\nX: y", "short"), (8, "u", "short"), (4, "u", None), (5, "u", ""), (None, "u", OTHER), (7, "u", OTHER),
    (6, "u", OTHER), (6, "u", OTHER), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "HTTP/1.1\r\n\r\nWARC/1.0\r\n\r\n" * 2000), (None, "u", "q" * 200), (None, "u", "q" * 200),
]


def expected(pages):
    least = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = least.get(html)
        refers = first if first is not None and first != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, n int")


@pytest.mark.parametrize("options", [{}, {"compress": False}, {"force_zip64": True}, {"archive_bytes": 300}])
def test_round_trip(spark, options):
    _, archives = wz.write_archives(frame(spark, PAGES).repartition(3), **options)
    rows = wz.read_archives(archives, keep_html=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=repr) == expected(PAGES)
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha256(r.html.encode()).hexdigest() == r.payload_digest
    if options.get("archive_bytes"):
        assert archives.count() > 5
    assert archives.agg({"n_records": "sum"}).first()[0] == len(PAGES)
    for a in archives.collect():  # another reader agrees on the members
        files, name = filesystem(a.path)
        with zipfile.ZipFile(io.BytesIO(files.open_input_file(name).read())) as z:
            assert z.testzip() is None
            lines = [json.loads(x) for x in z.read("indexes/index.cdxj").splitlines()]
            warc = z.read("archive/" + lines[0]["filename"])
            assert sum(x["length"] for x in lines) == len(warc)
            wz.parse_record(warc[lines[-1]["offset"] : lines[-1]["offset"] + lines[-1]["length"]])


def test_empty_table(spark):
    _, archives = wz.write_archives(frame(spark, []))
    assert archives.count() == 0 and wz.read_archives(archives).count() == 0


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_foreign_archives(method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("a.txt", b"0123456789" * 10)
        with z.open("ü/b", "w", force_zip64=True) as f:
            f.write(b"xyz")
        z.comment = b"a comment PK\x05\x06 with a mark"
    reader = wz.ZipReader(Source(b"prefix-free" * 0 + out.getvalue()))
    assert list(reader.members) == ["a.txt", "ü/b"] and reader.members["a.txt"].size == 100
    if method == zipfile.ZIP_STORED:
        assert reader.read("a.txt", 12, 5) == b"23456" and reader.read("ü/b", 0, 3) == b"xyz"
        with pytest.raises(ValueError):
            reader.read("a.txt", 90, 11)
    else:
        with pytest.raises(ValueError):
            reader.read("a.txt", 0, 5)


def test_damage():
    with pytest.raises(ValueError):
        wz.ZipReader(Source(b"no archive at all, only text that is long enough"))
    with pytest.raises(ValueError):
        wz.parse_record(wz.make_record(1, "u", b"abc", "00", None)[:-2])
    assert wz.parse_record(wz.make_record(1, "u", b"", "00", None)).payload == b""
    assert pa.array([wz._page("<urn:x-page:-5>")])[0].as_py() == -5
