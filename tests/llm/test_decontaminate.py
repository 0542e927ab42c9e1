import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from clonalis.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add("null" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for k in sizes:
            for p in range(len(words) - k + 1):
                if own := windows.get(tuple(words[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= own
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def random_case(seed, vocabulary, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aBé1"), rng.integers(1, vocabulary)))
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(k))
    items = [(i, text(rng.integers(0, 25))) for i in range(12)]
    docs = []
    for i in range(n):
        t = text(rng.integers(0, 120))
        for _ in range(rng.integers(0, 3)):
            source = items[rng.integers(len(items))][1].split(" ")
            a = rng.integers(0, len(source))
            t += " " + " ".join(source[a : a + 14]).upper() + " " + text(5)
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (2, 3), (3, 4)])
def test_against_brute_force(spark, seed, vocabulary):
    docs, items = random_case(seed, vocabulary, 60)
    docs += [(100, None), (101, ""), (102, "!!! ..."), (3, docs[3][1]), (103, " ".join(t for _, t in docs))]
    items += [(50, None), (51, "..."), (5, "x y"), (7, "q r s t u v w x y z a")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, n_hit string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in dc.find_contamination(d, b).collect()]
    assert sorted(got) == sorted(brute(docs, items))
    kept = dc.remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.find_contamination(d, b).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (2, None)], "doc_id long, text string")
    assert [r.contaminated for r in dc.find_contamination(d, b.limit(0)).collect()] == [False, False]
    assert {r.doc_id: r.n_hit for r in dc.find_contamination(d, b).collect()} == {None: 3, 2: 0}


def test_longest_match_and_spans(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "start " + " ".join(f"w{i}" for i in range(5, 25)) + " between " + " ".join(f"w{i}" for i in range(0, 12)) + " end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = dc.find_contamination(d, b).first()
    assert [tuple(s) for s in row.spans] == [(1, 21), (22, 34)]
    assert (row.longest_match, row.longest_start) == (20, 1)


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    keys = rng.integers(1, 4, 500).astype(np.uint64)
    for depth in (1, 3, 16):
        sa = dc.suffix_array(keys, depth)
        rows = [tuple(keys[p : p + depth]) for p in sa]
        assert rows == sorted(rows) and sorted(sa) == list(range(500))


def test_parts_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(dc, "_BITS", 6)
    items = [(1, " ".join(f"w{i}" for i in range(12)))]
    docs = [(0, ("a b c d e f g " + items[0][1] + " ") * 20)]
    blocks = dc.make_tests(["1"], [items[0][1].encode()], 10)
    found = dc.search([docs[0][1].encode()], lambda: iter([blocks]), 10)
    assert (int(found.n_words[0]), int(found.n_hit[0])) == brute(docs, items)[0][1:3]


def test_longest_match_over_parts(monkeypatch):
    words = [f"w{i}" for i in range(90)]
    items = dc.make_tests(["a", "b"], [" ".join(words).encode(), b"x y z"], 10)
    texts = pa.array([" ".join(["o"] * k + words[:m] + ["x", "y", "z"] * 9) for k, m in ((0, 90), (7, 60), (21, 45), (3, 10), (50, 9))])
    whole = dc.search(next(dc.utf8_chunks(texts))[1], lambda: iter([items]), 10)
    assert [whole.longest[t] for t in range(5)] == [(90, 0), (60, 7), (45, 21), (10, 3), (3, 59)]
    for bits in (5, 6, 7):
        monkeypatch.setattr(dc, "_BITS", bits)
        parts = dc.search(next(dc.utf8_chunks(texts))[1], lambda: iter([items]), 10)
        assert parts.longest == whole.longest and parts.items == whole.items and parts.spans == whole.spans


def longest_common(doc, items):
    """(length) of the longest run of doc's words that stands in one item, by brute force."""
    best = 0
    for item in items:
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                    k += 1
                best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_longest_match_within_one_item(spark, seed):
    import random

    rng = random.Random(seed)
    items = [[rng.choice("abc") + str(rng.randrange(3)) for _ in range(rng.randrange(10, 24))] for _ in range(8)]
    items += [items[0][3:14] + items[1][:11], items[2][:6] * 4]
    docs = []
    for _ in range(12):
        words = []
        for _ in range(4):
            own = rng.choice(items)
            a = rng.randrange(len(own) - 8)
            words += own[a : a + rng.randrange(8, 16)] + ["x"] * rng.randrange(2)
        docs.append(words)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for r in dc.find_contamination(d, t).collect():
        want = longest_common(docs[r.doc_id], items)
        assert r.longest_match == (want if want >= 10 else 0)
        if r.longest_match:
            own = items[int(r.longest_item)][r.longest_item_start :][: r.longest_match]
            assert docs[r.doc_id][r.longest_start :][: r.longest_match] == own
