import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonalis.llm import matroska as mk


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.sampled_from([mk.NO_LACING, mk.XIPH, mk.FIXED, mk.EBML_LACING]), st.integers(0, 9))
def test_round_trip(n, lacing, seed):
    data = np.random.default_rng(seed).integers(0, 256, n * mk.FRAME, dtype=np.uint8).tobytes()
    if lacing == mk.NO_LACING:
        n, data = min(n, 8), data[: mk.FRAME]
    media = mk.write(data, lacing)
    found = mk.read(media)
    assert mk.payload(media, found) == data
    assert [media[a : a + s] for a, s in zip(found.at, found.size, strict=True)] == [data[i : i + mk.FRAME] for i in range(0, len(data), mk.FRAME)]
    assert found.timestamp_ns.tolist() == [i * 24_000_000 for i in range(len(found.at))]
    assert [c[2] for c in found.cues] == found.clusters and found.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [c[0] for c in found.cues] == [i * 24_000_000 for i in range(0, len(found.at), mk.CLUSTER_PACKETS)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=20), st.sampled_from([mk.XIPH, mk.EBML_LACING]), st.integers(1, 300), st.integers(-32768, 32767))
def test_lacing_of_any_sizes(frames, lacing, track, relative):
    body = mk._uint(mk.TIMESTAMP, 40_000) + mk.block(mk.SIMPLE_BLOCK, track, relative, frames, lacing, 0)
    media = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm")) + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, body))
    found = mk.read(media)
    assert [media[a : a + s] for a, s in zip(found.at, found.size, strict=True)] == frames
    assert set(found.track) == {track} and set(found.timestamp_ns) == {(40_000 + relative) * 1_000_000} and not found.key.any()


def test_unknown_sizes_groups_and_void():
    cluster = lambda t, *blocks: mk._id(mk.CLUSTER) + b"\x01" + b"\xff" * 7 + mk._uint(mk.TIMESTAMP, t) + b"".join(blocks)
    group = mk.element(mk.BLOCK_GROUP, mk.block(mk.BLOCK, 2, 5, [b"abc"], 0, 0) + mk._uint(mk.BLOCK_DURATION, 9) + mk.element(mk.REFERENCE, b"\xff"))
    key = mk.element(mk.BLOCK_GROUP, mk.block(mk.BLOCK, 2, -5, [b"", b"de"], mk.EBML_LACING, 0))
    entry = mk.element(mk.TRACK_ENTRY, mk._uint(mk.TRACK_NUMBER, 2) + mk._uint(mk.DEFAULT_DURATION, 7) + mk.element(mk.CODEC_ID, b"X\0\0"))
    info = mk.element(mk.INFO, mk._uint(mk.TIMESTAMP_SCALE, 1000))
    body = mk.element(0xEC, b"\0" * 300) + info + mk.element(mk.TRACKS, entry) + cluster(100, group) + cluster(200, mk.element(0xEC, b"--"), key)
    media = mk.element(mk.EBML, b"") + mk._id(mk.SEGMENT) + b"\xff" + body
    found = mk.read(media)
    assert found.size.tolist() == [3, 0, 2] and found.timestamp_ns.tolist() == [105_000, 195_000, 195_007]
    assert found.key.tolist() == [False, True, True] and found.cluster.tolist() == [0, 1, 1] and found.tracks[2]["codec"] == "X"


@pytest.mark.parametrize("data", [b"", b"\0", b"abc", mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"avi")), mk.element(mk.EBML, b""), mk.write(b"x" * 192)[:-1], mk.write(b"x" * 1920)[:200]])
def test_damage(data):
    with pytest.raises(ValueError):
        mk.read(data)


def test_columns(spark):
    texts = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 191), (5, "long text " * 30000), (6, "x" * 191), (None, "y")]
    d = spark.createDataFrame([(i, t, b"", 7) for i, t in texts], "doc_id long, text string, media binary, n_bytes int")
    media = mk.write_media(d)
    rows = {r.doc_id: r for r in mk.digests(media).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        want = raw + b" " * ((-len(raw) % 192) if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        whole = mk.write(want)
        assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())
    assert rows[4][1:] == rows[6][1:]
    mixed = spark.createDataFrame([(1, bytearray(mk.write(b"a" * 384))), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")
    got = {r.id: r for r in mk.packet_tables(mixed).collect()}
    assert [p.size for p in got[1].packets] == [192, 192] and got[2].packets == [] and got[2].error is None and got[3].error
    assert mk.digests(mk.write_media(d.limit(0))).count() == 0


def test_header_of_a_block():
    assert struct.unpack(">BhB", mk.block(mk.SIMPLE_BLOCK, 1, -2, [b"z"], mk.FIXED)[2:6]) == (0x81, -2, 0x80)
