import io
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonalis.sources import bam

NAMES = [("one", 5_000), ("two", 70_000), ("chrX", 900)]


def record(rng, k, ref, pos, long=False):
    n = int(rng.integers(60_000, 90_000)) if long else int(rng.integers(1, 160))
    seq = rng.choice(list("ACGTN"), n)
    codes = [bam.BASES.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, n, 2))
    name = f"read:{k}".encode() + b"\0"
    tags = b"CBZC" + str(k % 7).encode() + b"-1\0" + b"NMi" + struct.pack("<i", k) + b"UBZU" + str(k % 11).encode() + b"\0" + b"ZBBs" + struct.pack("<i2h", 2, 5, 6)
    ops = [(n, 0)] if n < 4 else [(2, 4), (n - 2, 0)]
    if ref < 0:
        ops = []
    body = struct.pack("<2i2B3H4i", ref, pos, len(name), 60, 0, len(ops), 16 * (k % 2), n, -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *(m << 4 | o for m, o in ops)) + packed + bytes(rng.integers(0, 60, n, dtype="uint8")) + tags
    cigar = "".join(f"{m}{bam.CIGAR[o]}" for m, o in ops) or "*"
    row = (NAMES[ref][0] if ref >= 0 else None, pos if pos >= 0 else None, cigar, "".join(seq), 16 * (k % 2), {"CB": f"C{k % 7}-1", "UB": f"U{k % 11}"})
    return struct.pack("<i", len(body)) + body, row


def head(comments=1):
    text = ("@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@CO\tline {i} {'x' * 50}\n" for i in range(comments))).encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(NAMES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in NAMES)


def build(seed, n, long=(), comments=1, lot=700):
    """(file, rows): blocks of changing sizes, some empty, cut anywhere."""
    rng = np.random.default_rng(seed)
    parts, rows = [], []
    for k in range(n):
        ref = int(rng.integers(-1, 3))
        data, row = record(rng, k, ref, int(rng.integers(0, 890)) if ref >= 0 else -1, k in long)
        parts.append(data)
        rows.append(row)
    data, out, at = head(comments) + b"".join(parts), [], 0
    while at < len(data):
        m = int(rng.integers(1, 2 * lot))
        out.append(bam.block(data[at : at + m]))
        if rng.random() < 0.05:
            out.append(bam.block(b""))
        at += m
    return b"".join(out) + bam.block(b""), rows


def plain(data, low, high):
    source = pa.BufferReader(data)
    names = bam.read_header(source, len(data))[1]
    for _, held, at, end in bam.read_range(source, len(data), low, high):
        *most, tags = bam.decode(held, at, end, names)
        yield (*most, dict(tags))


@pytest.mark.parametrize("seed,n,long,comments,lot", [(1, 300, (), 1, 700), (2, 60, (7, 8, 40), 1, 9000), (3, 200, (), 400, 300), (4, 0, (), 1, 700), (5, 1, (), 1, 40), (6, 12, tuple(range(12)), 1, 30_000)])
def test_ranges_hold_each_record_once(seed, n, long, comments, lot):
    data, rows = build(seed, n, long, comments, lot)
    assert list(plain(data, 0, len(data))) == rows
    for split in (len(data) // 2 + 1, len(data) // 7 + 1, 5_000):
        got = [r for low in range(0, len(data), split) for r in plain(data, low, min(low + split, len(data)))]
        assert got == rows


def test_broken_files_are_errors():
    data, _ = build(1, 50)
    for bad in (b"text", bam.block(b"no bam file"), data[: len(data) // 2]):
        with pytest.raises(Exception):
            list(plain(bad, 0, len(bad)))
    cut = head() + b"\x40\0\0\0" + b"\0" * 20
    with pytest.raises(ValueError, match="within a record"):
        list(plain(bam.block(cut), 0, len(bam.block(cut))))


def test_a_wrong_place_is_an_error(monkeypatch):
    data, _ = build(1, 300)
    right = bam.resynchronise
    monkeypatch.setattr(bam, "resynchronise", lambda *a: right(*a) + 1)
    with pytest.raises(ValueError, match="split=0"):
        list(plain(data, 0, len(data) // 2))


def test_read_and_write(spark, tmp_path):
    key = lambda r: (r[0] or "~", r[1] or -1, r[3], r[4], sorted(r[5].items()))
    (tmp_path / "in").mkdir()
    rows = []
    for k in (1, 2):
        data, some = build(k, 200)
        (tmp_path / f"in/{k}.bam").write_bytes(data)
        rows += some
    table = bam.read_bam(spark, str(tmp_path / "in"), split=3_000)
    assert table.rdd.getNumPartitions() > 4
    assert sorted((tuple(r) for r in table.collect()), key=key) == sorted(rows, key=key)
    near = bam.read_bam(spark, str(tmp_path / "in"), "chrX", 100, 400, keep_records=True, split=3_000)
    want = sorted((r for r in rows if r[0] == "chrX" and r[1] < 400), key=key)
    assert sorted((tuple(r)[:6] for r in near.collect()), key=key) == want
    text, names = bam.header_of(spark, str(tmp_path / "in"))
    assert names == NAMES
    every = bam.read_bam(spark, str(tmp_path / "in/1.bam"), keep_records=True, split=3_000)
    bam.write_bam(str(tmp_path / "out.bam"), every, text, names)
    data = (tmp_path / "out.bam").read_bytes()
    got = list(plain(data, 0, len(data)))
    assert sorted(got, key=key) == sorted(rows[:200], key=key)
    places = [(NAMES.index(next(n for n in NAMES if n[0] == r[0])) if r[0] else 9, -1 if r[1] is None else r[1], r[4] & 16) for r in got]
    assert places == sorted(places) and data.endswith(bam.block(b""))
    assert bam.read_header(pa.BufferReader(data), len(data))[0].splitlines()[0] == "@HD\tVN:1.6\tSO:coordinate"
    bam.write_bam(str(tmp_path / "none.bam"), every.filter(F.lit(False)), "", names)
    assert bam.read_bam(spark, str(tmp_path / "none.bam")).count() == 0 and io.open(tmp_path / "none.bam", "rb").read(4) == b"\x1f\x8b\x08\x04"
