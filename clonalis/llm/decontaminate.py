"""Benchmark decontamination with suffix arrays over the training text.

The training documents are cut into shards, each a word sequence with separators between documents.
A shard's suffix array is built by prefix doubling, every test window (the suffixes of the test items,
as far as a window reaches) is looked up in it by binary search, and the suffixes in its interval are
the verbatim occurrences. A shard needs nothing but its own text and the test windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import filesystem, lean, new_path, write_atomically
from .textvec import ALNUM, utf8_chunks, words_of

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20  # of test text that is read at a time
TESTS_KEPT = 4  # blocks of tests that a worker keeps
_BITS = 20  # of a position in a shard
_DROP = np.uint64(64 - 44)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """44 leading bits of the word hashes, never 0 (which separates documents)."""
    return np.maximum(hashes >> _DROP, np.uint64(1))


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the word sequences that start there, compared over ``depth`` words at
    least. Each doubling round sorts one packed integer a position: rank, rank further on, position."""
    n, bits = len(keys), np.uint64(_BITS)
    if n >= 1 << _BITS:
        raise ValueError("a shard has too many words")
    at = np.arange(n, dtype=np.uint64)
    order = np.sort((keys << bits) | at)
    mask = np.uint64((1 << _BITS) - 1)
    rank = np.zeros(n, dtype=np.uint64)
    reach = 1
    while True:
        sa, group = order & mask, order >> bits
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, dtype=bool)
        if reach >= depth or new.all():
            return sa.astype(np.int64)
        rank[sa] = np.cumsum(new, dtype=np.uint64)
        later = np.zeros(n, dtype=np.uint64)
        later[: max(0, n - reach)] = rank[reach:]
        order = np.sort((rank << (bits + bits)) | (later << bits) | at)
        reach *= 2


def _below(keys: np.ndarray, at: np.ndarray, patterns: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether the suffixes at ``at`` are before the patterns (or start with them, if or_equal)."""
    undecided, below = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for j in range(patterns.shape[1]):
        live = np.flatnonzero(undecided)
        if not len(live):
            break
        place = at[live] + j
        have = np.where(place < len(keys), keys[np.minimum(place, len(keys) - 1)], np.uint64(0))
        want = patterns[live, j]
        below[live[have < want]] = True
        undecided[live[have != want]] = False
    return below | undecided if or_equal else below


def _bound(keys: np.ndarray, sa: np.ndarray, patterns: np.ndarray, upper: bool, low: np.ndarray | None = None) -> np.ndarray:
    low = np.zeros(len(patterns), dtype=np.int64) if low is None else low.copy()
    high = np.full(len(patterns), len(sa), dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        below = _below(keys, sa[mid], patterns[open_], upper)
        low[open_] = np.where(below, mid + 1, low[open_])
        high[open_] = np.where(below, high[open_], mid)
    return low


def intervals(keys: np.ndarray, sa: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: sa[low:high] are the suffixes that start with each pattern."""
    low = _bound(keys, sa, patterns, False)
    high = low.copy()
    found = np.flatnonzero(low < len(sa))
    found = found[_below(keys, sa[low[found]], patterns[found], True)]
    high[found] = _bound(keys, sa, patterns[found], True, low[found])
    return low, high


class Tests(NamedTuple):
    """A block of test windows: of each length the distinct windows; window w is in items[w]."""

    by_length: list[tuple[np.ndarray, np.ndarray]]  # window numbers, word hashes
    items: list[list[str]]
    names: list[str]
    first: np.ndarray  # window w stands at places[first[w]:first[w + 1]]
    places: np.ndarray  # (item, word) of each


def make_tests(ids: list[str], texts: list[bytes], window: int) -> Tests:
    words = words_of(texts, ALNUM)
    number: dict[bytes, int] = {}
    items: list[list[str]] = []
    hashes: dict[int, list[np.ndarray]] = {}
    numbers: dict[int, list[int]] = {}
    stands: list[tuple[int, int, int]] = []
    for i, name in enumerate(ids):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        size = min(window, len(own))
        for p in range(len(own) - size + 1 if size else 0):
            piece = own[p : p + size]
            w = number.setdefault(piece.tobytes(), len(items))
            if w == len(items):
                items.append([])
                hashes.setdefault(size, []).append(piece)
                numbers.setdefault(size, []).append(w)
            if name not in items[w][-1:]:
                items[w].append(name)
            stands.append((w, i, p))
    table = np.array(sorted(stands), dtype=np.int64).reshape(-1, 3)
    first = np.searchsorted(table[:, 0], np.arange(len(items) + 1))
    return Tests([(np.array(numbers[k]), np.array(hashes[k])) for k in sorted(hashes)], items, list(ids), first, table[:, 1:])


def _save_tests(tests: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Test items in files of about BLOCK_BYTES in the shared folder, streamed through the driver, so
    that neither it nor a task ever holds more than a block however many items there are."""
    root, paths, rows, size = new_path(tests.sparkSession, "tests"), [], [], 0

    def flush() -> None:
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.binary())})
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        paths.append(f"{root}/{len(paths)}.arrow")
        write_atomically(paths[-1], [sink.getvalue()])
        rows.clear()

    for name, text in tests.select(id_col, text_col).toLocalIterator():
        rows.append(("null" if name is None else str(name), (text or "").encode()))
        size += len(rows[-1][1])
        if size >= BLOCK_BYTES:
            flush()
            size = 0
    if rows:
        flush()
    return paths


@lru_cache(maxsize=TESTS_KEPT)
def _load_tests(path: str, window: int) -> Tests:
    files, name = filesystem(path)
    with files.open_input_file(name) as source:
        table = pa.ipc.open_file(source).read_all()
    return make_tests(table["id"].to_pylist(), table["text"].to_pylist(), window)


class Found(NamedTuple):
    n_words: np.ndarray
    n_hit: np.ndarray
    items: dict[int, set[str]]  # by text
    spans: dict[int, list[tuple[int, int]]]  # hit word ranges by text
    longest: dict[int, tuple[int, int]]  # words of the longest verbatim match, and its first word
    origin: dict[int, tuple[str, int]]  # the item, and the word there


def search(texts: list, blocks, window: int) -> Found:
    """Occurrences of the test windows in texts. blocks: yields Tests."""
    words = words_of(texts, ALNUM)
    n_texts, n = len(texts), len(words.hashes)
    place = np.arange(n) + words.text  # a separator after each text
    full = np.zeros(n + n_texts, dtype=np.uint64)
    full[place] = words.hashes
    keys = np.zeros(len(full), dtype=np.uint64)
    keys[place] = _keys(words.hashes)
    owner = np.repeat(np.arange(n_texts), np.diff(words.bounds) + 1)
    first = words.bounds[:-1] + np.arange(n_texts)
    change = np.zeros(len(full) + 1, dtype=np.int32)
    items: dict[int, set[str]] = {}
    longest: dict[int, tuple[int, int]] = {}
    origin: dict[int, tuple[str, int]] = {}
    stood: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}  # by block and length: places of windows, and which
    most = (1 << _BITS) - 1 - window
    for cut in range(0, max(1, len(full)), most):  # parts that overlap by a window less a word
        part = keys[cut : cut + most + window - 1]
        sa = suffix_array(part, window)
        for block, tests in enumerate(blocks()):
            for numbers, hashes in tests.by_length:
                low, high = intervals(part, sa, _keys(hashes))
                many = high - low
                which = np.repeat(np.arange(len(many)), many)
                at = sa[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())] if len(which) else np.empty(0, np.int64)
                same = np.ones(len(at), dtype=bool)
                for j in range(hashes.shape[1]):
                    same &= full[at + cut + j] == hashes[which, j]
                at, which = at[same], which[same]
                np.add.at(change, at + cut, 1)
                np.add.at(change, at + cut + hashes.shape[1], -1)
                for key in np.unique(owner[at + cut] * np.int64(1 << 32) + numbers[which]).tolist():
                    items.setdefault(key >> 32, set()).update(tests.items[key & 0xFFFFFFFF])
                once = at < most  # the others are found again in the next part
                stood.setdefault((block, hashes.shape[1]), []).append((at[once] + cut, numbers[which[once]]))
    for block, tests in enumerate(blocks() if any(len(a) for found in stood.values() for a, _ in found) else ()):
        for size in (k for b, k in stood if b == block):
            _longest(longest, origin, *(np.concatenate(x) for x in zip(*stood[block, size], strict=True)), size, owner, first, tests)
    covered = np.cumsum(change[:-1]) > 0
    n_hit = np.bincount(owner[covered], minlength=n_texts)
    spans: dict[int, list[tuple[int, int]]] = {}
    edges = np.flatnonzero(np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        t = int(owner[a])
        spans.setdefault(t, []).append((a - int(first[t]), b - int(first[t])))
    return Found(np.diff(words.bounds), n_hit, items, spans, longest, origin)


def _longest(longest, origin, at, numbers, size, owner, first, tests) -> None:
    """Joins windows that stand one word apart both in a document and in one item: they lie on a diagonal, where the
    places in both differ by the same. Each run of neighbouring windows of a document is worked on for itself."""
    order = np.argsort(at)
    at, numbers = at[order], numbers[order]
    for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
        if not len(run):
            continue
        t = int(owner[at[run[0]]])
        if len(run) + size - 1 <= longest.get(t, (0,))[0]:
            continue
        many = np.diff(tests.first)[numbers[run]]
        here = np.repeat(at[run], many)
        rows = np.repeat(tests.first[numbers[run]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, word = tests.places[rows].T
        order = np.lexsort((here, here - word, item))
        here, item, word = here[order], item[order], word[order]
        cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(item) != 0) | (np.diff(here - word) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(here)]])
        k = int(np.argmax(ends - starts))
        length = int(ends[k] - starts[k]) + size - 1
        if length > longest.get(t, (0,))[0]:
            k = int(starts[k])
            longest[t], origin[t] = (length, int(here[k] - first[t])), (tests.names[int(item[k])], int(word[k]))


def _found_in(batch: pa.RecordBatch, text_col: str, paths: list[str], window: int) -> Iterator[tuple[int, Found]]:
    for start, texts in utf8_chunks(batch.column(text_col), SHARD_BYTES):
        yield start, search(texts, lambda: (_load_tests(p, window) for p in paths), window)


SPANS = "array<struct<start:bigint,end:bigint>>"


def find_contamination(
    docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences of test windows), n_items,
    items_sha256 (of the item ids with occurrences, sorted as strings, comma-joined), contaminated,
    spans (word ranges hit), longest_match (words of the longest verbatim match with one item, if it has a
    window at least), longest_start (its first word), longest_item and longest_item_start (where it stands).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A test window is
    ``window`` consecutive words of an item; an item of fewer words is one window, one of none has none.
    Null or empty texts have no words and no hits; a null item id counts as the string null; items that
    share an id count once; repeated documents each get a row; without items nothing is contaminated;
    an empty table of documents gives no rows; other columns are ignored. Of equally
    long matches the first in the document counts.
    """
    paths = _save_tests(tests, item_col, item_text_col)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    fields = [source.schema["doc_id"]]
    for name, kind in (("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"), ("spans", SPANS), ("longest_match", "bigint"), ("longest_start", "bigint"), ("longest_item", "string"), ("longest_item_start", "bigint")):
        fields.append(T.StructField(name, T._parse_datatype_string(kind)))
    schema = T.StructType(fields)

    def rows(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for start, f in _found_in(batch, "text", paths, window):
                n = len(f.n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, n),
                        pa.array(f.n_words.astype(np.int64)),
                        pa.array(f.n_hit.astype(np.int64)),
                        pa.array([len(f.items.get(i, ())) for i in range(n)], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(f.items.get(i, ()))).encode()).hexdigest() for i in range(n)]),
                        pa.array(f.n_hit > 0),
                        pa.array([[{"start": a, "end": b} for a, b in f.spans.get(i, ())] for i in range(n)], span),
                        pa.array([f.longest.get(i, (0, 0))[0] for i in range(n)], pa.int64()),
                        pa.array([f.longest[i][1] if i in f.longest else None for i in range(n)], pa.int64()),
                        *(pa.array([f.origin[i][k] if i in f.origin else None for i in range(n)], kind) for k, kind in ((0, pa.string()), (1, pa.int64()))),
                    ],
                    names=schema.names,
                )

    return source.mapInArrow(lean(rows), schema)


def remove_contaminated(
    docs: DataFrame, tests: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The rows of docs without an occurrence of a test window, all columns as they are (see
    find_contamination for words, windows and nulls). Rows are filtered where they are read."""
    paths = _save_tests(tests, item_col, item_text_col)

    def rows(batches):
        for batch in batches:
            for start, f in _found_in(batch, text_col, paths, window):
                yield batch.slice(start, len(f.n_hit)).filter(pa.array(f.n_hit == 0))

    return docs.mapInArrow(lean(rows), docs.schema)
