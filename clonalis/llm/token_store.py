"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code, and its reader.

Ids are ranked by their frequency over the whole corpus, so that the 256 most frequent take one byte.
A block of documents holds the ranks' lengths, two bits each, in control bytes, and apart from these
the ranks' bytes. A control byte stands for four ranks: a 256-row table gives their lengths, running
sums give their places, and numpy gathers all ranks of a block at once.

File (little-endian): ``SVB1``, then blocks: uint32 documents, uint64 ids, uint64 control bytes,
uint64 data bytes; uint8 a document (1: it has an id), int64 its doc_id, uint64 its number of ids;
control bytes; data bytes. ``vocab.bin`` beside the files holds uint32 ids by rank.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, filesystem, lean, new_path, remove, write_atomically

MAGIC = b"SVB1"
_HEAD = "<IQQQ"
#: Kept pieces at which the younger half of a worker's cache becomes the older: about 250 bytes each.
CACHE_ENTRIES = 400_000
#: Text that a worker encodes at once.
LOT_BYTES = 4 << 20
#: Byte values that the two bits stand for: 1, 2, 3 or 4 bytes.
LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= code[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of encode_ranks."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    if n and ends[-1] != len(data):
        raise ValueError("control and data bytes do not fit")
    starts, source = ends - lengths, np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        has = np.flatnonzero(lengths > k)
        out[has] |= source[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Block(NamedTuple):
    doc_ids: list[int | None]
    sizes: np.ndarray
    ids: np.ndarray


def write_block(block: Block, rank: np.ndarray) -> bytes:
    control, data = encode_ranks(rank[block.ids])
    has = np.array([d is not None for d in block.doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in block.doc_ids], dtype="<i8")
    return b"".join([struct.pack(_HEAD, len(names), len(block.ids), len(control), len(data)), has.tobytes(), names.tobytes(), block.sizes.astype("<u8").tobytes(), control, data])


def read_blocks(path: str, vocabulary: np.ndarray) -> Iterator[Block]:
    """Blocks of a file, one in memory at a time."""
    files, name = filesystem(path)
    with files.open_input_stream(name) as source:
        if source.read(4) != MAGIC:
            raise ValueError(f"{path} is no token file")
        while head := source.read(struct.calcsize(_HEAD)):
            docs, n, n_control, n_data = struct.unpack(_HEAD, head)
            has, names = source.read(docs), np.frombuffer(source.read(8 * docs), dtype="<i8")
            sizes = np.frombuffer(source.read(8 * docs), dtype="<u8").astype(np.int64)
            ranks = decode_ranks(source.read(n_control), source.read(n_data), n)
            yield Block([int(d) if h else None for h, d in zip(has, names, strict=True)], sizes, vocabulary[ranks])


#: Texts in which white space other than line ends stands before a space, or is not ASCII, are not cut.
_NOT_CUT = r"[\x09-\x0D\x1C-\x20] |[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_IS_SPACE, _IS_LETTER, _IS_MARK = (np.isin(np.arange(256), list(members)) for members in (b" \t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
#: Longer pieces are not kept.
_LONGEST_KEPT = 64
#: Pieces without other white space: a word after a space, and one that is not.
_SPACED = re.compile(r" [^\s\x1c-\x1f]{1,63}")
_PLAIN = re.compile(r"[^\s\x1c-\x1f]{1,64}")


class _Encoder:
    """ids of texts by the tokenizers library, each text as if encoded whole.

    A byte-level BPE whose pre-tokenizer is the usual pattern never joins across a space that follows
    a character other than white space, across a line end between two such characters, or from a
    letter to punctuation other than an apostrophe. Texts are cut there, at places that numpy finds in
    their bytes; Arrow finds the distinct pieces of a lot, each is encoded once while it is kept, and
    numpy gathers the ids. Texts with other white space, and those in which an added token's string
    occurs, are encoded whole.
    """

    def __init__(self, path: str, most: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.added = [t["content"] for t in kind.get("added_tokens", ())]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(names.values(), default=0) + 1, dtype=bool)  # ids whose bytes start with a space
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), 1)
        self.dtype = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.line_end = self._encode(["\n"])[0]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[str], by_line: bool) -> list[bytes]:
        """ids of pieces, all in one call: of a space and a word each, cut where an id begins with a space, or by_line of words alone,
        put on lines and cut at the line ends."""
        size = self.dtype.itemsize
        if by_line and len(self.line_end) != size:
            return self._encode(pieces)
        joined = "\n" + "\n".join(pieces) if by_line else "".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(ids == np.frombuffer(self.line_end, self.dtype)[0] if by_line else self.opens[ids]) * size
        if len(cuts) != len(pieces) or cuts[0]:
            return self._encode(pieces)
        data, skip = ids.tobytes(), size if by_line else 0
        return [data[a:b] for a, b in zip((cuts + skip).tolist(), [*cuts[1:].tolist(), len(data)], strict=True)]

    def _entries(self, pieces: list[str]) -> list[bytes]:
        """ids of distinct pieces; new ones without other white space go to the library many in a call."""
        if len(self.kept) > self.most:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        new = [p for p in pieces if p not in kept]
        if older:
            again = {p: f for p in new if (f := older.get(p)) is not None}
            kept.update(again)
            new = [p for p in new if p not in again]
        spaced = list(filter(_SPACED.fullmatch, new))
        plain = list(filter(_PLAIN.fullmatch, new))
        for some, by_line in ((spaced, False), (plain, True)):
            for k in range(0, len(some), 1024):
                kept.update(zip(some[k : k + 1024], self._encode_joined(some[k : k + 1024], by_line), strict=True))
        if len(spaced) + len(plain) < len(new):
            rest = [p for p in new if p not in kept]
            own = dict(zip(rest, self._encode(rest), strict=True))
            kept.update((p, f) for p, f in own.items() if len(p) <= _LONGEST_KEPT)
            return [kept[p] if p in kept else own[p] for p in pieces]
        return list(map(kept.__getitem__, pieces))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded whole."""
        if not self.by_piece:
            return np.ones(len(texts), dtype=bool)
        out = pc.match_substring_regex(texts, _NOT_CUT)
        for added in self.added:
            out = pc.or_(out, pc.match_substring(texts, added))
        return out.to_numpy(zero_copy_only=False)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Places at which pieces begin: the texts, and those inside texts that are not encoded whole."""
        cut = data == 32
        if len(data) > 2:
            cut[1:] |= _IS_LETTER[data[:-1]] & _IS_MARK[data[1:]]
            lines = np.flatnonzero(data[1:-1] == 10) + 1
            starts = np.zeros(len(data), dtype=bool)
            starts[bounds[:-1][bounds[:-1] < len(data)]] = True
            lines = lines[~(_IS_SPACE[data[lines - 1]] | _IS_SPACE[data[lines + 1]] | starts[lines] | starts[lines + 1])]
            cut[lines] = cut[lines + 1] = True
        for i in np.flatnonzero(whole).tolist():
            cut[bounds[i] : bounds[i + 1]] = False
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.lot(pa.array(texts, pa.large_string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]

    def lot(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their numbers a text), each text's followed by those in end."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        whole = self._whole(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        cuts = self._cuts(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8), bounds - bounds[0], whole)
        places = pa.py_buffer(np.append(cuts + bounds[0], bounds[-1]))
        pieces = pa.LargeStringArray.from_buffers(len(cuts), places, data if data is not None else pa.py_buffer(b"")).dictionary_encode()
        entries = self._entries(pieces.dictionary.to_pylist())
        code = pieces.indices.to_numpy().astype(np.int64)
        bounds = np.searchsorted(cuts, bounds - bounds[0])
        code = np.insert(code, bounds[1:], len(entries))
        entries.append(end)
        data = np.frombuffer(b"".join(entries), dtype=self.dtype)
        length = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // self.dtype.itemsize
        start = np.cumsum(length) - length
        many = length[code]
        before = np.cumsum(many) - many
        total = int(many.sum())
        ids = data[np.repeat(start[code] - before, many) + np.arange(total)]
        ends = np.append(before, total)[bounds[1:] + np.arange(1, len(texts) + 1)]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=1)
def _encoder(path: str, most: int = CACHE_ENTRIES) -> _Encoder:
    return _Encoder(path, most)


def _lots(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Rows in lots of about LOT_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        base = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, base + LOT_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


_FRAME = "<IQQQ"  # documents, ids, plain bytes, packed bytes


def _stage(root: str, path: str, end_id: int, most: int) -> Callable:
    """Tokenizes a sorted partition into a staging file; yields its place, size and id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, codec = TaskContext.get().partitionId(), _encoder(path, most), pa.Codec("zstd")
        narrow = end_id < 1 << (8 * encoder.dtype.itemsize)
        dtype = encoder.dtype if narrow else np.dtype("<u4")
        counts, docs = np.zeros(max(encoder.size, end_id + 1), dtype=np.int64), 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes() if narrow else np.zeros(1, dtype=encoder.dtype).tobytes()

        def parts() -> Iterator[bytes]:
            nonlocal docs
            for batch in batches:
                for lot in _lots(batch, "text"):
                    names = lot.column("doc_id")
                    ids, sizes = encoder.lot(lot.column("text"), end)
                    if not narrow:
                        ids = ids.astype(dtype)
                        ids[np.cumsum(sizes) - 1] = end_id
                    counts[:] += np.bincount(ids, minlength=len(counts))
                    docs += len(sizes)
                    has = names.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                    plain = b"".join([has.tobytes(), pc.fill_null(names, 0).to_numpy().astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), ids.tobytes()])
                    packed = codec.compress(plain, asbytes=True)
                    yield struct.pack(_FRAME, len(sizes), len(ids), len(plain), len(packed))
                    yield packed

        name = f"{root}/staged/{shard:08d}.ids"
        write_atomically(name, parts())
        if docs:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "path": pa.array([name]), "itemsize": pa.array([dtype.itemsize], pa.int32()),
                "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([int(counts.sum())], pa.int64()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
            })

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("counts"):
            own = np.frombuffer(value.as_buffer(), dtype="<i8")
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def _staged_blocks(path: str, itemsize: int) -> Iterator[Block]:
    files, name = filesystem(path)
    codec, dtype = pa.Codec("zstd"), np.dtype(f"<u{itemsize}")
    with files.open_input_stream(name) as source:
        while head := source.read(struct.calcsize(_FRAME)):
            docs, n, plain_size, packed_size = struct.unpack(_FRAME, head)
            plain = codec.decompress(source.read(packed_size), plain_size, asbytes=True)
            has, names, sizes = plain[:docs], np.frombuffer(plain, "<i8", docs, docs), np.frombuffer(plain, "<u8", docs, 9 * docs)
            yield Block([int(d) if h else None for h, d in zip(has, names, strict=True)], sizes.astype(np.int64), np.frombuffer(plain, dtype, n, 17 * docs))


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> np.ndarray:
    """Token ids by rank."""
    files, name = filesystem(path)
    with files.open_input_stream(name) as source:
        return np.frombuffer(source.read(), dtype="<u4")


def _encode_shards(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary = read_vocabulary(f"{root}/vocab.bin")
                rank = np.zeros(int(vocabulary.max(initial=0)) + 1, dtype=np.uint32)
                rank[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)

                def parts(row=row, rank=rank) -> Iterator[bytes]:
                    yield MAGIC
                    for block in _staged_blocks(row["path"], row["itemsize"]):
                        yield write_block(block, rank)

                name = f"{root}/tokens-{row['shard']:08d}.svb"
                size = write_atomically(name, parts())
                yield pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in (("shard", row["shard"]), ("path", name), ("n_docs", row["n_docs"]), ("n_ids", row["n_ids"]), ("n_bytes", size))})

    return run


def write_token_files(
    docs: DataFrame, *, tokenizer_path: str, end_id: int, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE_ENTRIES,
) -> tuple[str, DataFrame]:
    """Writes all documents' ids, each document's followed by end_id, in ascending order of the id.

    Returns the folder (root, or a new one in the shared folder) and the manifest: shard, path, n_docs,
    n_ids, n_bytes, in whose order the files follow each other. Ids are integers; null ids come first
    and are kept as null; rows that share an id stand in the order of their texts; null texts are empty;
    an empty table writes no file; other columns are ignored.

    One range shuffle sorts the texts, by their first characters too, so that rows that share an id, or
    have none, need not be in one task; a task tokenizes its range into a staging file and returns how
    often each id of the vocabulary occurs. About the square root of n tasks add these vectors up, the
    driver adds up theirs, and with the ids ranked each staging file becomes a token file. cache_entries
    bounds what a worker keeps of pieces it has encoded; it changes time and memory, not results.
    """
    spark = docs.sparkSession
    root = (root or new_path(spark, "tokens")).rstrip("/")
    scratch = Scratch(spark, "token-manifests")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    staged = scratch.save(ordered.mapInArrow(
        lean(_stage(root, tokenizer_path, end_id, cache_entries)), "shard bigint, path string, itemsize int, n_docs bigint, n_ids bigint, counts binary"
    ), "staged")
    few = staged.select("counts").repartition(max(1, int(n**0.5))).mapInArrow(_add_up, "counts binary")
    sums = sum((np.frombuffer(r["counts"], dtype="<i8") for r in few.toLocalIterator()), np.zeros(1, dtype=np.int64))
    used = np.flatnonzero(sums)
    write_atomically(f"{root}/vocab.bin", [used[np.lexsort((used, -sums[used]))].astype("<u4").tobytes()])
    shards = staged.select("shard", "path", "itemsize", "n_docs", "n_ids").repartitionByRange(n, "shard")
    manifest = scratch.save(shards.mapInArrow(lean(_encode_shards(root)), "shard bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")
    remove(spark, f"{root}/staged")
    return root, manifest


def read_token_files(root: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 of the
    ids as little-endian unsigned 32-bit integers, and with keep_ids the ids themselves."""
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.select("shard", "path", "n_ids").collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["path"], base))
        base += r["n_ids"]
    n = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = spark.createDataFrame(rows, "shard bigint, path string, base bigint").repartitionByRange(n, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"]
                for block in read_blocks(row["path"], read_vocabulary(f"{root}/vocab.bin")):
                    ends = np.cumsum(block.sizes)
                    starts = ends - block.sizes
                    own = block.ids.astype("<u4")
                    view = memoryview(own).cast("B") if len(own) else memoryview(b"")
                    columns = [
                        pa.array(block.doc_ids, pa.int64()), pa.array(at + starts), pa.array(block.sizes),
                        pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(own.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at += len(own)

    return files.mapInArrow(lean(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if keep_ids else ""))
