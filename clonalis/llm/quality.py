"""Quality classifier learned from trusted positives and unlabelled web text.

The non-negative unbiased risk of positive-unlabelled learning is minimised,
prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), with the squared loss l(z) = (1 - z)^2 and g
linear in a fixed basis: numbers that describe a text's bytes and words, hashed words and character
trigrams, and random hidden units of the former. With that loss the risk needs of the unlabelled rows
only the basis' sums and sums of products, so it is taken over all of them, however many there are: each
task adds up its rows, and the driver holds one matrix of the basis' size. The class prior is estimated
for the unlabelled rows from their mean, between those of labelled positives and negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, lean, release
from .textvec import NON_SPACE, Words, mix, utf8_chunks, words_of

#: Text described at once.
LOT_BYTES = 1 << 19
#: Bound of the sample of labelled rows, those of least hash; the parameter max_labelled.
LABELLED = 20_000
#: Labelled rows whose basis the driver has at once.
LOT_ROWS = 1000
HIDDEN, STEPS, RATE, SEED = 128, 1500, 0.02, 9
#: Weights of the squared coefficients: of the numbers that describe a text, and of hashed features and hidden units with
#: RIDGE_ROWS trusted positives; the latter two fall with more of them. DOUBT: labelled rows that the labelled share is worth.
RIDGE, RIDGE_HASHED, RIDGE_HIDDEN, RIDGE_ROWS, DOUBT = 1e-2, 0.3, 0.1, 300, 30
#: Step of the ascent taken while the estimated negative risk is below zero.
ASCENT = 1.0
#: Buckets of hashed words and of hashed trigrams of bytes.
WORDS, TRIGRAMS = 128, 128
_BYTES = np.zeros(256, dtype=np.int64)  # class of each lower-cased byte
for _class, _members in enumerate(
    [b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), b" ", b"\n", b"\t\v\f\r", *[bytes([b]) for b in b".,;:!?'\"-_/\\|()[]{}<>@#$%^&*+=~`"]], start=1
):
    for _b in _members:
        _BYTES[_b] = _class
CLASSES = int(_BYTES.max()) + 1
_SPACE = int(_BYTES[32])
N_DENSE = CLASSES + 16
N_FEATURES = N_DENSE + WORDS + TRIGRAMS


def _shares(words: Words, key: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct (text, key) pairs of each text over its number of pairs."""
    order = np.lexsort((key, of))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])]) if len(key) else np.empty(0, bool)
    distinct = np.bincount(of[order][new], minlength=n)
    return distinct / np.maximum(1, np.bincount(of, minlength=n))


def features(texts: list) -> np.ndarray:
    """One row of N_FEATURES numbers a text; an empty text's are all 0."""
    n = len(texts)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    words = words_of(texts, NON_SPACE)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(n), sizes + 1)
    kind = _BYTES[words.buffer]
    counts = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    counts[:, _SPACE] -= 1  # the byte that joins texts
    upper = np.bincount(owner, weights=(raw != words.buffer), minlength=n)
    n_words = np.diff(words.bounds)
    per_byte, per_word = np.maximum(1, sizes)[:, None], np.maximum(1, n_words)
    length = words.end - words.start
    mean = np.bincount(words.text, weights=length, minlength=n) / per_word
    square = np.bincount(words.text, weights=length.astype(np.float64) ** 2, minlength=n) / per_word
    same_text = words.text[1:] == words.text[:-1]
    repeat = np.bincount(words.text[1:], weights=same_text & (words.hashes[1:] == words.hashes[:-1]), minlength=n)
    last = words.buffer[np.maximum(words.end - 1, 0)] if len(words.end) else np.empty(0, np.uint8)
    first = raw[words.start] if len(words.start) else np.empty(0, np.uint8)
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    stop = (last == 46) | (last == 33) | (last == 63)
    starts_upper = (first >= 65) & (first <= 90)
    capitals = np.cumsum(np.concatenate([[0], raw != words.buffer]), dtype=np.int32)
    all_upper = np.bincount(words.text, weights=capitals[words.end] - capitals[words.start] >= 2, minlength=n)
    share = lambda flag: np.bincount(words.text, weights=flag, minlength=n) / per_word
    pair = words.hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[:-1]
    line = np.cumsum(raw == 10, dtype=np.int32)[words.start]
    at_line = np.concatenate([[True], (line[1:] != line[:-1]) | ~same_text])[: len(line)]
    extra = np.stack(
        [
            upper / per_byte[:, 0], np.log1p(n_words) / 10, mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 10, _shares(words, words.hashes, words.text, n),
            _shares(words, pair[same_text], words.text[1:][same_text], n), repeat / per_word, share(~letter), share(stop), share(starts_upper), all_upper / per_word,
            share(length <= 2), share(length >= 15), share(at_line), _shares(words, words.hashes[at_line], words.text[at_line], n), np.minimum(1, n_words / 20),
        ],
        axis=1,
    )
    out = np.concatenate([np.sqrt(np.maximum(0, counts) / per_byte), extra, _hashed(words, owner, sizes, n)], axis=1)
    out[sizes == 0] = 0
    return out.astype(np.float32)


def _hashed(words: Words, owner: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Signed counts of words and of trigrams of lower-cased bytes in buckets, over the root of their number, cut at 1."""
    out = []
    grams = words.buffer.astype(np.uint64)
    grams = mix(grams[:-2] << np.uint64(16) | grams[1:-1] << np.uint64(8) | grams[2:]) if len(grams) > 2 else np.empty(0, np.uint64)
    inside = owner[:-2] == owner[2:] if len(owner) > 2 else np.empty(0, bool)
    inside &= (np.arange(len(inside)) + 2 < (np.cumsum(sizes + 1) - 1)[owner[: len(inside)]]) if len(inside) else inside
    for keys, of, buckets in ((words.hashes, words.text, WORDS), (grams[inside], owner[: len(inside)][inside], TRIGRAMS)):
        place = of * buckets + (keys >> np.uint64(40)).astype(np.int64) % buckets
        sign = np.where(keys & np.uint64(1), 1.0, -1.0)
        sums = np.bincount(place, weights=sign, minlength=n * buckets).reshape(n, buckets)
        many = np.maximum(1, np.bincount(of, minlength=n))[:, None]
        out.append(np.sign(sums) * np.sqrt(np.abs(sums) / many))
    return np.concatenate(out, axis=1)


class Model(NamedTuple):
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        """1, the standardised features, and hidden units of the dense ones."""
        z = np.clip((x - self.shift) / self.scale, -4, 4)
        return np.concatenate([np.ones((len(z), 1)), z, np.tanh(z[:, : len(self.w1)] @ self.w1 + self.b1)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        g = self.basis(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip(4 * g, -30, 30)))


class Sums(NamedTuple):
    """Of rows of a basis: how many, their sum, and the sum of their products."""

    n: float
    first: np.ndarray
    second: np.ndarray


def sums_of(basis: np.ndarray) -> Sums:
    return Sums(float(len(basis)), basis.sum(axis=0), basis.T @ basis)


def moments(lots: Callable[[], Iterator[np.ndarray]], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns of all lots, which are read twice; 0 and 0 without rows."""
    n, total = 0, np.zeros(d)
    for x in lots():
        n, total = n + len(x), total + x.sum(axis=0)
    mean, square = total / max(1, n), np.zeros(d)
    for x in lots():
        square += ((x - mean) ** 2).sum(axis=0)
    return mean, np.sqrt(square / max(1, n))


def blank_model(sample: np.ndarray, dense: int | None = None) -> Model:
    """A model without weights, standardised by a sample; hidden units see the first ``dense`` features."""
    d = sample.shape[1]
    return standardised(*((sample.mean(axis=0), sample.std(axis=0) + 1e-2) if len(sample) else (np.zeros(d), np.ones(d))), dense)


def standardised(shift: np.ndarray, scale: np.ndarray, dense: int | None = None) -> Model:
    d = len(shift)
    rng = np.random.default_rng(SEED)
    dense = d if dense is None else dense
    return Model(shift, scale, rng.normal(0, 1.5 / np.sqrt(dense), (dense, HIDDEN)), rng.uniform(-1, 1, HIDDEN), np.zeros(1 + d + HIDDEN), 0.5)


def ridges(model: Model, n_positive: float, hashed: int) -> np.ndarray:
    """Weight of each squared coefficient of the basis, whose last features, ``hashed`` of them, are hashed."""
    few = RIDGE_ROWS / max(1.0, n_positive)
    dense = len(model.shift) - hashed
    return np.concatenate([[0.0], np.full(dense, RIDGE), np.full(hashed, RIDGE_HASHED * few), np.full(HIDDEN, RIDGE_HIDDEN * few)])


def minimise(positive: Sums, unlabelled: Sums, prior: float, ridge: np.ndarray) -> np.ndarray:
    """Weights of the least non-negative risk, from sums alone. Its steps are conditioned by the unlabelled rows' products."""
    a_u, b_u = unlabelled.second / unlabelled.n, unlabelled.first / unlabelled.n
    a_p, b_p = positive.second / positive.n, positive.first / positive.n
    d = len(b_u)
    ridge = np.diag(ridge)
    ahead = np.linalg.inv(a_u + prior * a_p + ridge + 1e-6 * np.eye(d))
    w, best, least = np.zeros(d), np.zeros(d), np.inf
    for step in range(STEPS):
        # risks: E_p[(1 - g)^2], and E_u[(1 + g)^2] - prior * E_p[(1 + g)^2]
        pa, pb, ua, ub = a_p @ w, b_p @ w, a_u @ w, b_u @ w
        negative = (1 + 2 * ub + w @ ua) - prior * (1 + 2 * pb + w @ pa)
        risk = prior * (1 - 2 * pb + w @ pa) + max(0.0, negative) + w @ ridge @ w
        if risk < least:
            least, best = risk, w
        grad_negative = 2 * (b_u + ua) - 2 * prior * (b_p + pa)
        grad = 2 * prior * (pa - b_p) + grad_negative + 2 * ridge @ w if negative >= 0 else -ASCENT * grad_negative
        w = w - RATE * (1 - step / STEPS) * 5 * (ahead @ grad)
    return best


def estimated_prior(unlabelled: Sums, positive: np.ndarray, negative: np.ndarray, otherwise: float, ridge: float = 0.05) -> float:
    """Share of positives among the unlabelled rows: where their mean lies between the labelled classes' means.

    Half of the labelled rows choose the direction that parts the classes, in the metric of the unlabelled
    rows, the other half tell the means along it, and the other way round. With few labelled rows, or
    classes that no direction parts, the share of labelled rows, ``otherwise``, is kept or drawn near."""
    if min(len(positive), len(negative)) < 20:
        return otherwise
    mean = unlabelled.first / unlabelled.n
    metric = unlabelled.second / unlabelled.n - np.outer(mean, mean) + ridge * np.eye(len(mean))
    shares = []
    for half in (0, 1):
        p, q, own_p, own_q = positive[half::2], negative[half::2], positive[1 - half :: 2], negative[1 - half :: 2]
        way = np.linalg.solve(metric, p.mean(axis=0) - q.mean(axis=0))
        top, low = own_p @ way, own_q @ way
        if top.mean() - low.mean() > 0.5 * (top.std() + low.std()):
            shares.append((mean @ way - low.mean()) / (top.mean() - low.mean()))
    if not shares:
        return otherwise
    n = min(len(positive), len(negative))
    return float(np.clip((n * np.mean(shares) + DOUBT * otherwise) / (n + DOUBT), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """A model of plain arrays; without positives or unlabelled rows every score is the prior."""
    if not len(positive) or not len(unlabelled):
        return constant(positive.shape[1], prior)
    model = blank_model(unlabelled)
    return model._replace(weights=minimise(sums_of(model.basis(positive)), sums_of(model.basis(unlabelled)), prior, ridges(model, len(positive), 0)), prior=prior)


def constant(d: int, prior: float) -> Model:
    model = blank_model(np.zeros((0, d)))
    model.weights[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) / 4
    return model._replace(prior=prior)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of every whole text as float32 bytes."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in utf8_chunks(batch.column("text"), LOT_BYTES):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return source.mapInArrow(lean(rows), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x binary")


def _lots(rows: pa.Table, label: int) -> Iterator[np.ndarray]:
    """The features of the rows with this label (1, or 0 for any other), LOT_ROWS rows or fewer at once."""
    for batch in rows.to_batches(max_chunksize=LOT_ROWS):
        own = batch.filter(pa.array((batch.column("_label").to_numpy() == 1) == bool(label)))
        if own.num_rows:
            yield np.frombuffer(b"".join(own.column("x").to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _least_hashed(rows: DataFrame, bound: int, salt: str) -> DataFrame:
    """At most bound rows of (doc_id, ...), those of least hash of the id. A threshold on the hash
    leaves few more than these before they are put in order."""
    spread = 1 << 30
    rows = rows.withColumn("_o", F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), F.lit(spread)))
    n = rows.count()
    share = min(1.0, (bound + 6 * bound**0.5) / max(1, n))
    return rows.filter(F.col("_o") < int(share * spread)).orderBy("_o", "doc_id").limit(bound).drop("_o")


def _sums(docs: DataFrame, text_col: str, model: Model, scratch: Scratch) -> Sums | None:
    """Sums over all rows: a row of sums a task, added up by about the square root of the tasks, in a fixed order."""
    d = len(model.weights)
    upper = np.triu_indices(d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            for _, texts in utf8_chunks(batch.column(0), LOT_BYTES):
                basis = model.basis(features(texts).astype(np.float64)).astype(np.float32)
                n, first = n + len(basis), first + basis.sum(axis=0, dtype=np.float64)
                second += basis.T @ basis
        if n:
            value = np.concatenate([[float(n)], first, second[upper]])
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([value.astype("<f8").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(value.as_buffer(), dtype="<f8")
                total, part = (own.copy(), k) if total is None else (total + own, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part bigint, sums binary"
    each = scratch.save(docs.select(text_col).mapInArrow(lean(rows), kind), "sums")
    few = max(1, int(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    added = each.repartitionByRange(few, "part").sortWithinPartitions("part").mapInArrow(lean(add), kind)
    total = sum((np.frombuffer(r["sums"], dtype="<f8") for r in added.orderBy("part").toLocalIterator()), np.zeros(1 + d + len(upper[0])))
    scratch.drop(each)
    if not total[0]:
        return None
    second = np.zeros((d, d))
    second[upper] = total[1 + d :]
    return Sums(float(total[0]), total[1 : 1 + d], second + np.triu(second, 1).T)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = LABELLED) -> Model:
    """A model from rows that are not held out. At most max_labelled labelled rows, those of least hash, are
    described for the driver, as Arrow rows of which it takes LOT_ROWS at once: the positives are trusted, and the means of both classes give the prior. The
    unlabelled rows are all that are not held out, labelled ones too: their sums are taken over all."""
    scratch = Scratch(docs.sparkSession, "quality")
    seen = docs.filter(~held_out(docs[id_col]))
    ids = seen.select(docs[id_col].alias("doc_id")).distinct()
    named = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = scratch.save(_least_hashed(ids.join(named, F.col("doc_id") == F.col("_id")).select("doc_id", "_label"), max_labelled, "l").select(F.col("doc_id").alias("_chosen"), "_label"), "chosen")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    own = texts.join(chosen.select(F.col("_chosen").alias("doc_id")), "doc_id", "left_semi")
    rows = describe(own).groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, F.col("doc_id") == F.col("_chosen")).orderBy("doc_id").select("x", "_label").toArrow()
    labelled = rows.column("_label").to_numpy() == 1
    share = float(labelled.mean()) if len(labelled) else 0.5
    if not labelled.any():
        return constant(N_FEATURES, share)
    shift, scale = moments(lambda: (x for label in (1, 0) for x in _lots(rows, label)), N_FEATURES)
    model = standardised(shift, scale + 1e-2, N_DENSE)
    dense, d = slice(1, 1 + N_DENSE), len(model.weights)
    positive, ends = Sums(0.0, np.zeros(d), np.zeros((d, d))), ([np.zeros((0, N_DENSE))], [np.zeros((0, N_DENSE))])
    for label in (1, 0):
        for x in _lots(rows, label):
            basis = model.basis(x)
            ends[label].append(basis[:, dense].copy())
            if label:
                positive = Sums(*(a + b for a, b in zip(positive, sums_of(basis), strict=True)))
    del rows
    unlabelled = _sums(seen, text_col, model, scratch)
    negatives, positives = (np.concatenate(e) for e in ends)
    prior = estimated_prior(Sums(unlabelled.n, unlabelled.first[dense], unlabelled.second[dense, dense]), positives, negatives, share)
    model = model._replace(weights=minimise(positive, unlabelled, prior, ridges(model, positive.n, WORDS + TRIGRAMS)), prior=prior)
    release()
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Only the text enters a score. Null and empty texts have all features 0 and a score like any other;
    repeated rows get equal scores; a null id is held out; without usable labels every score is the
    prior (0.5 with no label at all); an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in utf8_chunks(batch.column("text"), LOT_BYTES):
                score = model.score(features(texts).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(lean(rows), f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the classifier does not reject (predicted 1), with all columns as they are.
    Rows are scored and filtered where they are read."""
    model = train(docs, labels, id_col, text_col, label_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in utf8_chunks(batch.column(text_col), LOT_BYTES):
                good = model.score(features(texts).astype(np.float64)) >= 0.5
                yield batch.slice(start, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(lean(rows), docs.schema)
