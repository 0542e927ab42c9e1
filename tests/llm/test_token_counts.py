import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonalis.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback=False):
    """The tokenizers library's own unigram model over the same pieces; id 0 is the unknown piece."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    least = min((s for _, s in pieces), default=0.0)
    head = [("<unk>", least)] + ([(f"<0x{b:02X}>", least) for b in range(256)] if byte_fallback else [])
    t = Tokenizer(models.Unigram(head + pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.SPACE, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TINY = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -3.0), ("aba", -6.0), ("é", -2.0), ("bé", -4.0), ("▁ab", -5.0), ("\n", -3.0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\nzq日", max_size=30), st.booleans())
def test_ties_and_unknown_characters(text, fallback):
    assert tc.Counter(tc.make_vocabulary(TINY, fallback)).text(text) == library(TINY, fallback)(text)


@pytest.fixture(scope="module")
def real():
    vocabulary = tc.load_vocabulary(PATH)
    return tc.Counter(vocabulary), library(vocabulary.pieces, vocabulary.byte_fallback)


TEXTS = ["Hello world", " two  spaces ", "Osiñ ciónmente Keitkeitpf schtzsch", "a▁b ▁", "日本語 テスト 🎉🎉", "x" * 400, "tabs\tand\nlines \n\n end", "", " ", "  ", "supercalifragilistic 12345 !!!"]


@pytest.mark.parametrize("text", TEXTS)
def test_public_vocabulary(real, text):
    assert real[0].text(text) == real[1](text)


def test_documents(spark, real):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = tc.count_tokens(docs, vocabulary_path=PATH).collect()
    assert len(rows) == len(texts)
    for r in rows[:120]:
        assert (r.n_chars, r.n_tokens) == (len(texts[r.doc_id]), real[1](texts[r.doc_id]))


def test_edge_cases(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 5), (4, "word " * 100000, 5)], "doc_id long, text string, n_tokens int")
    rows = tc.count_tokens(d, vocabulary_path=PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in rows) == [(0, True), (1, False), (2, False), (2, False), (4, True)]
    assert tc.count_tokens(d.limit(0), vocabulary_path=PATH).count() == 0


def test_small_cache_and_no_pieces(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 1)
    assert tc.Counter(tc.make_vocabulary(TINY)).text("a b a b a") == library(TINY)("a b a b a")
    assert tc.Counter(tc.make_vocabulary([])).text("abc") == 1
