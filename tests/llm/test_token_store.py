import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonalis.llm import token_store as ts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(docs, end=2):
    tokenizer, at, out = plain(), 0, []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
    return out


DOCS = [
    (5, "Hello world, it's  two spaces."), (1, None), (2, ""), (3, " lead"), (9, "tail "), (4, "a\n b\t c \n d"), (7, "x<|endoftext|>y z"), (8, "é ü   x　 y 日本語 テスト"),
    (6, "The quick brown fox. " * 300), (11, "The quick brown fox.\nJumps over 12345 !!! dogs'll"), (10, "   "), (12, "a   b"), (7, "same id"), (None, "no id"), (5, "Hello world, it's  two spaces."),
]


def test_whole_round_trip(spark):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, ids string, shard int")
    root, manifest = ts.write_token_files(d, tokenizer_path=PATH, end_id=2)
    got = [tuple(r) for r in ts.read_token_files(root, manifest, keep_ids=True).orderBy("start").collect()]
    assert got == expected(DOCS)
    assert manifest.agg({"n_ids": "sum"}).first()[0] == sum(r[2] for r in got)
    vocabulary = ts.read_vocabulary(f"{root}/vocab.bin")
    counts = np.bincount([i for r in got for i in r[4]], minlength=50257)
    assert list(vocabulary) == sorted(np.flatnonzero(counts), key=lambda i: (-counts[i], i))


def test_empty_table(spark):
    root, manifest = ts.write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path=PATH, end_id=2)
    assert manifest.count() == 0 and ts.read_token_files(root, manifest).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab '.,\n\t  é1日<|endoftext>", max_size=40), max_size=6))
def test_pieces_equal_whole_texts(texts):
    tokenizer, encoder = plain(), ts._encoder(PATH)
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=50))
def test_code_round_trip(values):
    control, data = ts.encode_ranks(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert ts.decode_ranks(control, data, len(values)).tolist() == values


def test_small_cache():
    encoder, tokenizer = ts._Encoder(PATH, 2), plain()
    for text in ("a b c d e f", "c d x y z", "a b c"):
        assert np.frombuffer(encoder([text])[0], encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
