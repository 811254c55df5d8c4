import tracemalloc

import numpy as np
from odd_texts import ODD

from graticule.llm import mixing

TEXTS = {"a": "the and of to in that with ", "b": "le la les des une est pour ", "c": "der die und das ein nicht "}


def corpus(spark, n=90):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(n):
        d = "aaabbc"[k % 6]
        words = (TEXTS[d] * 20).split()
        rows.append((k, " ".join(rng.permutation(words)[: rng.integers(20, 100)]), d))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_rates_reach_targets(spark):
    docs = corpus(spark)
    model = mixing.learn(docs, docs.select("doc_id", "domain"), ["a", "b", "c"])
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.rates(docs, model, targets).collect()
    assert len(got) == 90 and all(r["rate"] >= 0 for r in got)
    truth = {r[0]: r[2] for r in docs.collect()}
    p = np.array([r["posterior"] for r in got])
    assert np.mean([["a", "b", "c"][k] == truth[r["doc_id"]] for r, k in zip(got, p.argmax(1))]) == 1.0
    t, r = np.array([g["n_tokens"] for g in got], float), np.array([g["rate"] for g in got])
    share = (p * (t * r)[:, None]).sum(0) / t.sum()
    assert np.abs(share - [0.2, 0.3, 0.5]).max() <= 1.1e-3
    assert all(x["n_tokens"] == len(y["text"].split()) for x, y in zip(sorted(got), sorted(docs.collect())))


def test_replay_equals_plain_projected_gradient():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 50)
    steps = [rng.normal(size=3) * 0.3 for _ in range(12)]
    r = np.ones(50)
    for g in steps:
        r = np.array([max(0.0, x - float(q @ g)) for x, q in zip(r, p)])
    assert np.allclose(mixing._replay(p, steps), r)


def test_odd_rows(spark, docs):
    from pyspark.sql import functions as F

    df = docs(ODD)
    labels = spark.createDataFrame([(3, "en"), (4, None), (77, "en"), (6, "fr")], "doc_id long, domain string")
    model = mixing.learn(df, labels, ["en", "fr"])
    got = sorted(mixing.rates(df, model, {"en": 0.5, "xx": 0.5}).collect())
    assert len(got) == len(ODD) and all(np.isfinite(r["rate"]) and r["rate"] >= 0 for r in got)
    assert got[0]["posterior"] == got[1]["posterior"] == got[2]["posterior"] == [0.5, 0.5]
    bare = mixing.learn(df, labels.limit(0), ["en", "fr"])
    assert all(r["posterior"] == [0.5, 0.5] for r in mixing.rates(df, bare, {}).collect())
    assert mixing.rates(docs([]), model, {"en": 1.0}).count() == 0
    assert {r["rate"] for r in mixing.rates(docs([None, ""]), model, {"en": 1.0}).collect()} == {1.0}
    clash = df.withColumn("posterior", F.lit(1)).withColumn("rate", F.lit(2))
    assert mixing.rates(clash, model, {"en": 1.0}).count() == len(ODD)


def test_query(spark, sf):
    got = mixing.op4_mixing(spark, sf)
    rows = {r["doc_id"]: r for r in got.collect()}
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert rows.keys() == truth.keys()
    assert np.mean([max("de en es fr".split(), key=lambda d: rows[k][f"p_{d}"]) == v for k, v in truth.items()]) >= 0.98
    t = sum(r["n_tokens"] for r in rows.values())
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r["n_tokens"] * r["rate"] * r[f"p_{d}"] for r in rows.values()) / t - share) <= 0.002


def shares_of(p, t, steps):
    return (p * (t * mixing._replay(p, steps))[:, None]).sum(0) / t.sum()


def posteriors(spark, p, t):
    return spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, posterior array<double>")


def test_rare_domain_reaches_its_target(spark):
    rng = np.random.default_rng(3)
    own = rng.choice(4, 2000, p=[0.01, 0.02, 0.27, 0.7])
    p = 0.97 * np.eye(4)[own] + 0.03 * rng.dirichlet(np.ones(4), 2000)
    t, target = rng.integers(50, 150, 2000).astype(float), np.array([0.1, 0.2, 0.5, 0.2])
    steps = mixing.solve(posteriors(spark, p, t), target)
    assert np.abs(shares_of(p, t, steps) - target).max() <= 1e-3


def test_targets_out_of_reach_are_told(spark):
    p, t = np.array([[0.6, 0.4], [0.7, 0.3]]), np.array([10.0, 20.0])
    with np.testing.assert_warns(UserWarning):
        steps = mixing.solve(posteriors(spark, p, t), np.array([0.1, 0.9]))
    best = min(np.abs(shares_of_rates(p, t, r) - [0.1, 0.9]) @ np.abs(shares_of_rates(p, t, r) - [0.1, 0.9]) for r in ((a, b) for a in np.linspace(0, 6, 241) for b in np.linspace(0, 3, 121)))
    assert ((shares_of(p, t, steps) - [0.1, 0.9]) ** 2).sum() <= best + 1e-4


def shares_of_rates(p, t, r):
    return (p * (t * np.array(r))[:, None]).sum(0) / t.sum()


def test_features_keep_byte_pairs_apart():
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    pairs = [bytes((a, b)) for a in letters for b in letters]
    places = {int(np.flatnonzero(mixing.features(x)[0])[0]) for x in pairs}
    assert len(places) == len(pairs)


def test_no_targets(spark, docs):
    assert mixing.solve(posteriors(spark, np.zeros((2, 0)), np.array([3.0, 4.0])), np.zeros(0)) == []
    model = mixing.fit([], [], [])
    got = mixing.rates(docs(["some words", None]), model, {}).collect()
    assert len(got) == 2 and {r["rate"] for r in got} == {1.0}


def test_rates_are_the_nearest_to_one(spark):
    """Against a fine search over two rates that meet the targets."""
    p, t, target = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]]), np.array([10.0, 30.0, 20.0]), np.array([0.5, 0.5])
    r = mixing._replay(p, mixing.solve(posteriors(spark, p, t), target, close=1e-9))
    assert np.abs((p * (t * r)[:, None]).sum(0) / t.sum() - target).max() < 1e-6
    best = np.inf
    for c in np.linspace(0, 3, 3001):  # two equations leave one rate free
        a, b = np.linalg.solve((p[:2] * t[:2, None]).T, target * t.sum() - p[2] * t[2] * c)
        if a >= 0 and b >= 0:
            best = min(best, t @ (np.array([a, b, c]) - 1) ** 2)
    assert t @ (r - 1) ** 2 <= best + 1e-4


def test_fit_holds_few_full_rows():
    """The fit keeps of each text what the text has: memory far below a row of all features for each."""
    texts = [f"{w} number {k}" for k in range(1500) for w in ("eins zwei drei", "one two three")]
    labels = ["de", "en"] * 1500
    tracemalloc.start()
    model = mixing.fit(texts, labels, ["de", "en"], 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(texts) * mixing.SIZE * 4 / 2
    x = np.stack([mixing.features(t.encode())[0] for t in texts])
    # full-batch gradient on all rows at once gives the same
    w, b, vw, vb, y = np.zeros((mixing.SIZE, 2)), np.zeros(2), 0.0, 0.0, np.eye(2)[[0, 1] * 1500]
    for _ in range(5):
        z = np.exp(x @ w + b)
        d = (z / z.sum(1, keepdims=True) - y) / len(x)
        vw, vb = 0.9 * vw - 4.0 * (x.T @ d + 1e-5 * w), 0.9 * vb - 4.0 * d.sum(0)
        w, b = w + vw, b + vb
    assert np.allclose(model.weights, w, atol=1e-4) and np.allclose(model.bias, b, atol=1e-4)
