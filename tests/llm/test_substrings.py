import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_texts import ODD

from graticule.llm import substrings
from graticule.llm.sufsort import common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(text):
    order = sorted(range(len(text)), key=lambda k: text[k:])
    assert suffix_array(text) == order
    for r, h in enumerate(common_prefixes(text, order)):
        if r:
            a, b = text[order[r - 1] :], text[order[r] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert h == n


def brute(texts, width=200):
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(x[k : k + width] for x in raw for k in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1):
            if seen[x[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def run(docs, texts, width=200):
    got = sorted(substrings.without_repeats(docs(texts), width).collect(), key=lambda r: r["doc_id"])
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got]


def family(n, seed, size=900):
    """Copies with changes, passages in other surroundings, repeats inside a text, boundaries at all offsets."""
    rnd = random.Random(seed)
    fresh = lambda k: "".join(rnd.choice("abcdé ") for _ in range(k))
    core, passage = fresh(size), fresh(230)
    out = []
    for k in range(n):
        t = list(core)
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(size)] = rnd.choice("xyz")
        t = "".join(t)
        kind = k % 4
        if kind == 1:
            t = fresh(rnd.randrange(300)) + passage[: rnd.randrange(190, 231)] + fresh(rnd.randrange(300))
        if kind == 2:
            t = t[rnd.randrange(300) :] + t[:250]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families(docs, seed):
    texts = family(40, seed)
    assert run(docs, texts) == brute(texts)


def test_odd_rows(docs):
    texts = ODD + ["ab" * 100, "ab" * 100, "z" * 199, "z" * 199, "q" * 200, "r" * 201, "\x00" * 250, "k\x00" * 150]
    assert run(docs, texts) == brute(texts)
    assert run(docs, []) == []


def test_long_texts_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    texts = family(12, 3, 1700)
    assert run(docs, texts) == brute(texts)


def test_large_groups_are_counted(docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    texts = family(40, 4)
    assert run(docs, texts) == brute(texts)


def test_small_chunks(docs, monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 4)
    texts = family(30, 5)
    assert run(docs, texts) == brute(texts)


def test_groups_stay_together(monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 10)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        g = rng.integers(0, 8, rng.integers(1, 60))
        parts = list(substrings.together(g))
        assert sorted(np.concatenate(parts)) == list(range(len(g)))
        assert all(len(p) <= 10 or len(set(g[p])) == 1 for p in parts)
        assert sum(len(set(g[p])) for p in parts) == len(set(g))


def test_query(spark, sf):
    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(substrings.op7_substrings(spark, sf).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute([t for _, t in rows])


def test_repeated_rows(spark):
    text = family(1, 6)[0]
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (2, "short"), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.without_repeats(df).collect())
    assert got == [(0, len(text.encode())), (1, len(text.encode())), (1, len(text.encode())), (2, 0), (2, 0)]


def test_one_line_in_every_document(docs):
    """A line of 230 bytes in 400 texts, in surroundings of their own."""
    rnd = random.Random(7)
    line = "".join(rnd.choice("abcdef ") for _ in range(230))
    texts = ["".join(rnd.choice("ghijkl ") for _ in range(rnd.randrange(150))) + line + "".join(rnd.choice("mnop ") for _ in range(rnd.randrange(150))) for _ in range(400)]
    assert run(docs, texts) == brute(texts)


def test_more_surroundings_than_one_task_compares(docs):
    """Forty thousand of them, so that strings are counted."""
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdef ") for _ in range(208))
    texts = [f"{rnd.randrange(10**9):09d}{line}{rnd.randrange(10**9):09d}" for _ in range(40_000)]
    assert substrings.HOT < len(texts)
    assert run(docs, texts) == brute(texts)


def test_rows_are_told_apart_by_both_keys():
    a, b = np.array([1, 1, 2, 1]), np.array([5, 6, 5, 5])
    assert {k: v.tolist() for k, v in substrings._split(a, b)} == {(1, 5): [0, 3], (1, 6): [1], (2, 5): [2]}
    assert list(substrings._split(np.zeros(0, int), np.zeros(0, int))) == []
