import zlib

import numpy as np
from odd_texts import ODD

from graticule.llm import toxicity


def exact(u, step, start):
    """Marginals of one chain by plain forward-backward."""
    a = [np.array([start[0], start[1] * np.exp(u[0])])]
    for x in u[1:]:
        z = a[-1] @ step
        a.append(np.array([z[0], z[1] * np.exp(x)]))
        a[-1] /= a[-1].sum()
    b = [np.ones(2)]
    for x in u[:0:-1]:
        z = step @ (np.array([1, np.exp(x)]) * b[-1])
        b.append(z / z.sum())
    return np.array([x[1] * y[1] / (x @ y) for x, y in zip(a, b[::-1])])


def test_marginals_equal_forward_backward():
    rng = np.random.default_rng(0)
    for sizes in ([1], [5, 1, 200, 64, 3], [128, 64], [700]):
        u = rng.normal(0, 3, sum(sizes))
        first = np.zeros(len(u), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        step, start = np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
        want = np.concatenate([exact(x, step, start) for x in np.split(u, np.cumsum(sizes)[:-1])])
        assert np.abs(toxicity.marginals(u, first, step, start) - want).max() < 1e-9


def test_gradient():
    rng = np.random.default_rng(2)
    u, y = rng.normal(size=(4, 6)), rng.integers(0, 2, (4, 6)).astype(float)
    mask = np.arange(6) < np.array([6, 3, 1, 5])[:, None]
    step, start = rng.normal(size=(2, 2)), rng.normal(size=2)

    def loss(u, step, start):
        total = 0.0
        for k in range(4):
            n = int(mask[k].sum())
            paths = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T

            def score(p):
                return start[p[0]] + sum(step[a, b] for a, b in zip(p[:-1], p[1:])) + sum(u[k, t] for t in range(n) if p[t])

            total += np.log(np.exp([score(p) for p in paths]).sum()) - score(y[k, :n].astype(int))
        return total

    by_word, by_step, by_start = toxicity._gradient(u, y, mask, step, start)
    e = 1e-5
    for k, t in ((0, 0), (0, 5), (1, 2), (3, 1)):
        d = np.zeros_like(u)
        d[k, t] = e
        assert abs((loss(u + d, step, start) - loss(u - d, step, start)) / (2 * e) - by_word[k, t]) < 1e-5
    for i in (0, 1):
        d = np.zeros(2)
        d[i] = e
        assert abs((loss(u, step, start + d) - loss(u, step, start - d)) / (2 * e) - by_start[i]) < 1e-5
        for j in (0, 1):
            d = np.zeros((2, 2))
            d[i, j] = e
            assert abs((loss(u, step + d, start) - loss(u, step - d, start)) / (2 * e) - by_step[i, j]) < 1e-5


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "he", "in") for b in ("st", "ed", "nd", "ti", "es", "or")]
    bad = ["blorgan", "blorgest", "blorgish", "snarfle", "snarflen"]
    texts, labels = [], []
    for k in range(n):
        w = list(rng.choice(plain, rng.integers(20, 60)))
        y = k % 4 == 0
        for _ in range(3 * y):
            w[rng.integers(len(w))] = rng.choice(bad)
        texts.append(" ".join(w).capitalize() + ".")
        labels.append(int(y))
    return texts, labels


def test_spans_and_held_out_accuracy(spark, docs):
    texts, labels = corpus(400, 1)
    field = toxicity.fit(texts, labels)
    fresh, truth = corpus(200, 2)
    got = sorted(toxicity.score(docs(fresh), field).collect())
    assert np.mean([(r["score"] >= 0.5) == y for r, y in zip(got, truth)]) >= 0.99
    for r, y, t in zip(got, truth, fresh):
        found = {w for s in r["spans"] for w in t[s["start"] : s["end"]].lower().split()}
        assert all(w.startswith(("blorg", "snarf")) for w in found)
        assert bool(found) == bool(y)
    # a spelling not seen in training, by its beginning
    assert toxicity.score(docs(["thst blorgify ered " * 3]), field).first()["score"] >= 0.5


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    train = [d for d in truth if d in got and not got[d]["held_out"]]
    assert np.mean([got[d]["predicted"] == truth[d] for d in train]) >= 0.9


def test_held_out_labels(spark, sf):
    """On labelled documents that the field has not seen, of the thousand."""
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, sf).collect() if r["held_out"]}
    own = [d for d in got if d in truth]
    assert len(own) > 50
    assert np.mean([got[d]["predicted"] == truth[d] for d in own]) >= 0.95
    assert np.mean([got[d]["predicted"] for d in own if truth[d] == 0]) <= 0.03


def test_every_window_of_the_sample_is_trained_on():
    """A word that stands only far from the first of its document's words, and apart from marked ones, has a weight of its own."""
    texts = [" ".join(["aaa"] * 100 + ["zzyzx"] + ["bbb"] * 100), " ".join(["aaa", "blorg", "blorgan"] * 3 + ["ccc"] * 90)] * 40
    field = toxicity.fit(texts, [0, 1] * 40)
    assert field.weights[toxicity.feature_ids("zzyzx")].sum() < len(toxicity.feature_ids("zzyzx")) * -0.2


def test_odd_rows_and_labels(spark, docs):
    texts, labels = corpus(80, 4)
    df = docs(texts + ODD)
    lab = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)] + [(80, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    field = toxicity.learn(df, lab)
    got = toxicity.score(df, field).collect()
    assert len(got) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    empty = {round(r["score"], 9) for r in got if r["doc_id"] in (80, 81, 82)}
    assert len(empty) == 1 and empty.pop() < 0.5
    kept = toxicity.reject(df.withColumnRenamed("source", "score"), field)
    assert "score" in kept.columns and kept.count() < df.count()
    assert toxicity.score(docs([]), field).count() == 0
    none = toxicity.learn(df, lab.limit(0))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}
    one = toxicity.learn(df, lab.where("toxic = 1"))
    assert {r["score"] for r in toxicity.score(df, one).collect()} == {1.0}
