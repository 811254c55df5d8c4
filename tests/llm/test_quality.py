import numpy as np
from odd_texts import ODD

from graticule.llm import quality


def test_votes_for_faults():
    k = quality.LABELLERS.index
    clean = "The quick and plain words of a text. They end as they should, and go on for a while.\n" * 1
    assert 0 not in quality.votes(clean.encode())
    assert quality.votes(("WORDS!! SHOUTED!! " * 20).encode())[k("capitals")] == 0
    assert quality.votes(("again " * 50).encode())[k("repeats")] == 0
    assert quality.votes(("some%%% words*** here### " * 20).encode())[k("marks")] == 0
    assert quality.votes(("cell | next | " * 20).encode())[k("bars")] == 0
    assert all(len(quality.votes((t or "").encode("utf-8", "surrogatepass"))) == len(quality.LABELLERS) for t in ODD)


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn from known accuracies; the hidden quality is found again."""
    rng = np.random.default_rng(0)
    n, labellers = 20_000, len(quality.LABELLERS)
    state = rng.choice(1 + len(quality.FAULTS), n, p=[0.84, 0.04, 0.04, 0.04, 0.04])
    votes = np.full((n, labellers), 2)
    for j in range(labellers):
        if j in quality.FAULTS:
            hit = rng.random(n) < np.where(state == 1 + quality.FAULTS.index(j), 0.95, 0.005)
            votes[hit, j] = 0
        else:
            speak = rng.random(n) < 0.8
            right = rng.random(n) < 0.85
            votes[speak, j] = np.where((state == 0) == right, 1, 0)[speak]
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, weight.astype(float))
    assert np.mean((model.posterior(votes) >= 0.5) == (state == 0)) >= 0.97
    found = model.accuracies()
    for j, name in enumerate(quality.LABELLERS):
        if j not in quality.FAULTS:
            assert abs(found[name] - 0.85) < 0.04


def test_query_against_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[d]["keep"] for d, y in truth.items() if y == 1 and d in got]
    bad = [not got[d]["keep"] for d, y in truth.items() if y == 0 and d in got]
    assert np.mean(good) >= 0.95 and np.mean(bad) >= 0.8


def test_odd_rows(spark, docs):
    df = docs(ODD).withColumnRenamed("source", "votes")
    got = quality.score(df).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (0, 1)}
    assert len(same) == 1
    assert quality.score(docs([])).count() == 0
