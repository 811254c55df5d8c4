import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_texts import ODD

from graticule.llm import attention, lm


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").lower()) + [None]


def base(rows):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows}


def check(got, rows):
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) < 1e-6 and np.isfinite(r["score"]) and r["score"] < 0


def test_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op5_language_model(spark, sf).collect()
    check(got, rows)


@pytest.mark.parametrize("size, gain", [("sf0.01", 0.0), ("sf0.1", 0.04)])
def test_held_out_texts_score_better_than_the_base(spark, sf, size, gain):
    """The base gives each unknown word the same, however many there are; the model spells them."""
    got = [r for r in lm.op5_language_model(spark, sf.replace("sf0.001", size)).collect() if r["held_out"]]
    base = sum(r["base_score"] for r in got)
    assert sum(r["score"] for r in got) > base * (1 - gain)


def test_every_training_window_is_used_once(spark, sf, monkeypatch):
    """Over all rounds and tasks, in a table large enough for one epoch."""
    subwords = lm.Subwords(open(lm.VOCABULARY, "rb").read())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    table = lm.blocks(spark.read.parquet(f"{sf}/documents.parquet"), subwords)
    rows = np.zeros(subwords.end + 1, np.int32)
    seen, model = Counter(), attention.Attention(2)
    low = 0.0
    blocks = [r.asDict() for r in table.collect()]
    for share, _ in lm.ROUNDS:
        for row in blocks:
            block = lm._Block(row, rows)
            _, _, first, size = block.stream(np.flatnonzero(~np.array(row["held"])))
            n = len(model.windows(first, size)[0])
            order = lm.shuffled(n, row["block"], 0)
            seen.update((row["block"], int(k)) for k in order[round(low * n) : round((low + share) * n)])
        low += share
    assert set(seen.values()) == {1} and low == 1.0
    assert len({r["block"] for r in blocks}) == len(blocks) > 1
    total = sum(len(model.windows(*lm._Block(r, rows).stream(np.flatnonzero(~np.array(r["held"])))[2:])[0]) for r in blocks)
    assert len(seen) == total


def test_spelling_probabilities_add_up():
    """Words of up to three of five subwords and a stop, two of which begin a word; without hash collisions."""
    rng = np.random.default_rng(8)
    starts = np.array([True, True, False, False, False, True])  # the last one is the end
    words = [[int(rng.integers(0, 2)), *rng.integers(2, 5, rng.integers(0, 3)).tolist()] for _ in range(50)]
    counts = np.zeros(2 * 7 + 2 * lm.SLOTS)
    before, after, _ = lm._spelled(np.concatenate(words).astype(np.int64), np.array([len(w) for w in words]), 5)
    counts[:7], counts[7:14] = np.bincount(after, minlength=7), np.bincount(before, minlength=7)
    for x in lm._slots(before, after):
        counts[14:] += np.bincount(x, minlength=2 * lm.SLOTS)
    spelling = lm.Spelling(counts, starts, back_off=2.0)
    for b in range(6):
        x, y = np.full(7, b), np.arange(7)
        seen = np.minimum(*(spelling.pairs[s] for s in lm._slots(x, y)))
        alone = (spelling.first if b == 5 else spelling.later)[y]
        assert abs(((seen + 2.0 * alone) / (spelling.context[b] + 2.0)).sum() - 1) < 1e-9
    one = spelling.log10(np.array([0, 3]), np.array([2]))[0]
    parts = [(5, 0), (0, 3), (3, 6)]
    want = 0.0
    for b, a in parts:
        c = sum(1 for w in words for p, q in zip([5, *w], [*w, 6]) if (p, q) == (b, a))
        alone = (spelling.first if b == 5 else spelling.later)[a]
        want += math.log10((c + 2.0 * alone) / (spelling.context[b] + 2.0))
    assert abs(one - want) < 1e-9


def test_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    rows = list(enumerate([*ODD, "a\u00a0b \u2003c", "\u0085 x"]))
    check(lm.score(docs([t for _, t in rows])).collect(), rows)
    assert lm.score(docs([])).count() == 0


def test_all_held_out(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    rows = [(k, "some words here") for k in ids]
    check(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def small(words=40, seed=0):
    """A model and words of one to three of 12 subwords."""
    rng = np.random.default_rng(seed + 10)
    lens = rng.integers(1, 4, words)
    m = attention.Attention(12, d=5, h=4, mix=6, back=5, step=7, seed=seed)
    return m, attention.Lexicon(rng.integers(0, 12, int(lens.sum())), lens)


def tables(m, lexicon):
    rows = [lexicon.rows[a : a + n] for a, n in zip(lexicon.at, lexicon.lens)]
    x = np.stack([m.spell[r, : m.d].sum(0) / np.sqrt(len(r)) for r in rows])
    return x, np.stack([m.spell[r, m.d :].sum(0) for r in rows])


def test_scores_equal_plain_attention():
    """Each token once, with the context its window gives it, one token at a time."""
    m, lexicon = small()
    rng = np.random.default_rng(1)
    size = np.array([1, 30, 7, 8, 3])
    first = np.cumsum(size) - size
    last, target = rng.integers(0, 40, 49), rng.integers(0, 40, 49)
    log_z = rng.normal(0, 0.3, 6)
    ratio = m.score(lexicon, last, target, first, size, log_z, batch=3)
    x, f = tables(m, lexicon)
    for s, n in zip(first, size):
        for k in range(n):
            low = max(0, (k // m.step) * m.step - m.back)
            keys = last[s + low : s + k + 1]
            q = x[last[s + k]] @ m.query / 2
            w = np.exp([q @ (x[y] @ m.key) + m.bias[k - low - j] for j, y in enumerate(keys)])
            z = (w / w.sum()) @ (x[keys] @ m.value) @ m.out + x[last[s + k]] @ m.last + m.prior
            z = np.exp(z) / np.exp(z).sum()
            assert abs(ratio[s + k] / (z @ np.exp(f[target[s + k]] - log_z)) - 1) < 1e-4


def test_probabilities_add_up():
    """Frequencies times ratios, with the normalisers of those frequencies."""
    m, lexicon = small()
    rng = np.random.default_rng(2)
    last, often = rng.integers(0, 40, 12), rng.dirichlet(np.ones(40))
    log_z = np.log(often @ np.exp(tables(m, lexicon)[1]))
    total = sum(often[v] * m.score(lexicon, last, np.full(12, v), np.array([0]), np.array([12]), log_z) for v in range(40))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradient():
    rng = np.random.default_rng(3)
    m, lexicon = small()
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    last, target = rng.integers(0, 40, 40), rng.integers(0, 40, 40)
    at = m.windows(np.array([0, 17]), np.array([17, 23]))
    _, grad, _ = m.gradient(lexicon, last, target, *at)
    for k in m.NAMES:
        w = getattr(m, k)
        ix = tuple(np.unravel_index(np.abs(grad[k]).argmax(), w.shape))
        old, e = w[ix], 1e-4
        w[ix] = old + e
        up = m.gradient(lexicon, last, target, *at)[0]
        w[ix] = old - e
        down = m.gradient(lexicon, last, target, *at)[0]
        w[ix] = old
        assert abs((up - down) / (2 * e) - grad[k][ix]) < 1e-6 + 1e-3 * abs(grad[k][ix])


def test_training_learns_an_order():
    """After an even word the next one follows, after an odd one any."""
    rng = np.random.default_rng(4)
    seq = [0]
    for _ in range(4000):
        seq.append(seq[-1] + 1 if seq[-1] % 2 == 0 else int(rng.integers(0, 20)))
    seq = np.array(seq)
    m = attention.Attention(21, mix=24)
    lexicon, optimiser = attention.Lexicon(np.arange(21), np.ones(21)), attention.Adam(m)
    start, low, high = m.windows(np.array([0]), np.array([len(seq) - 1]))
    losses = []
    for t in range(400):
        pick = rng.integers(0, len(start), 32)
        loss, grad, _ = m.gradient(lexicon, seq[:-1], seq[1:], start[pick], low[pick], high[pick])
        optimiser.step(grad, 0.02 * min(1, 2 * (1 - t / 400)))
        losses.append(loss)
    # beside the frequencies, whose loss is about 2.9; the entropy of the order is about 0.55 * log(20) = 1.6
    assert np.mean(losses[-40:]) < -0.8


def test_very_long_words_are_summed_whole():
    rng = np.random.default_rng(9)
    lens = np.array([1, 40, 17, 16, 2])
    lexicon, table = attention.Lexicon(rng.integers(0, 9, int(lens.sum())), lens), rng.normal(size=(9, 3))
    words, (place,) = lexicon.used(np.arange(5))
    got = lexicon.summed(table, words)[place]
    assert np.allclose(got, [table[lexicon.rows[a : a + n]].sum(0) for a, n in zip(lexicon.at, lens)])
