"""Count-only unigram tokenization.

The Aho-Corasick automaton of the vocabulary lists, at each end position, the pieces that end there,
longest first. The best path to that position carries its score and its number of pieces, nothing else:
a longer piece comes from an earlier start, and a later candidate replaces it only with a greater
score, which is how the tokenizer's own lattice breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 1_000_000
LONGEST_KEPT = 64  # characters; longer words are counted each time


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]  # in the order of their ids
    unknown: float  # score of a character without a piece
    byte_fallback: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model; control, unknown and byte pieces match no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return make_vocabulary(pieces, any(model.is_byte(i) for i in ids), min(model.get_score(i) for i in ids))


def make_vocabulary(pieces: list[tuple[str, float]], byte_fallback: bool = False, least: float | None = None) -> Vocabulary:
    worst = min((s for _, s in pieces), default=0.0) if least is None else least
    return Vocabulary([p for p in pieces if p[0]], worst - UNKNOWN_PENALTY, byte_fallback)


class Counter:
    """Numbers of pieces of words and texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.unknown, self.byte_fallback = vocabulary.unknown, vocabulary.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton()
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over one word, which no piece crosses. A run of characters without
        pieces is one unknown piece, or its UTF-8 bytes with byte fallback."""
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = iter(()) if self.empty else self.automaton.iter(word)
        at, found = next(matches, (n, None))
        for end in range(1, n + 1):
            best = None
            single = False
            while at == end - 1:
                length, own = found
                start = end - length
                candidate = score[start] + own
                if best is None or candidate > best:
                    best, pieces = candidate, count[start] + 1
                single = length == 1
                at, found = next(matches, (n, None))
            if not single:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    best, unknown[end] = candidate, True
                    pieces = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.byte_fallback else not unknown[end - 1])
            score[end], count[end] = best, pieces
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a text whose spaces become SPACE; each starts a word, the text itself too."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]  # the text starts with its own space
        kept, total = self.kept, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(w) <= LONGEST_KEPT:
                    if len(kept) >= CACHE_ENTRIES:
                        kept.clear()
                    kept[w] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def count_tokens(docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, n_tokens of the whole text under the vocabulary's unigram model.

    Spaces are written as SPACE and start words, one is put before the text if it has none, and no
    piece crosses a word's start, so that equal words share one computation while they are kept. Null
    and empty texts have no tokens; repeated rows each get a row; an empty table gives none; other
    columns are ignored. Scores are added in double precision per word.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in batches:
            texts = batch.column("text")
            chars, tokens = [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                chars.append(len(text))
                tokens.append(counter.text(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_tokens bigint")
