"""Quality by a weak-label model: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Heuristics vote good, bad or nothing on each text.  Expectation-maximisation estimates each labeller's vote
probabilities given the hidden quality from the counts of vote patterns over all documents; no label is read.  The
posteriors of a bounded sample then train a linear scorer on hashed features, which scores every whole text.

Edge cases: null and empty texts get no vote but the length labeller's, and are scored like any other; repeated rows vote and are scored
alike; of several texts of one id the least one is fitted on, and all are scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 8192
LABELLERS = ("length", "symbols", "capitals", "repeats", "marks", "bars", "lines", "endings")
MARK = re.compile(rb"[%$#*&!|]{3,}|[!?]{2,}")
REPEAT = re.compile(rb"(?:^|[ \n])([^ \n]+)(?: \1){3,}(?=[ \n]|$)")


def votes(text: bytes) -> list[int]:
    """Each labeller's vote: 1 good, 0 bad, 2 nothing."""
    words = common.space_words(text)
    n = len(words)
    if n < 3:
        return [0, 2, 2, 2, 2, 2, 2, 2]
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()

    def three(x: float, good: float, bad: float) -> int:
        """Good up to `good`, bad from `bad` on."""
        return 1 if x <= good else 0 if x >= bad else 2

    repeats = sum(m.end() - m.start() for m in REPEAT.finditer(text)) / len(text)
    marks = len(MARK.findall(text)) / n
    bars = counts[124] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?"))
    return [
        1 if n >= 5 else 2,
        three(symbols / max(1, letters + symbols), 0.06, 0.15),
        # these four only ever vote bad: a text without one fault may have another
        three(counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum()), -1.0, 0.3),
        three(repeats, -1.0, 0.05),
        three(marks, -1.0, 0.02),
        three(bars, -1.0, 0.02),
        three(1 - len(set(lines)) / max(1, len(lines)), 0.05, 0.3),
        1 if ends / max(1, len(lines)) >= 0.5 else 0 if ends / max(1, len(lines)) < 0.2 else 2,
    ]


def hashed(text: bytes) -> np.ndarray:
    """Hashed features: runs of three bytes with letters, digits and capitals folded to classes, so that form counts and not vocabulary."""
    out = np.zeros(SIZE, np.float32)
    raw = np.frombuffer(text, np.uint8)
    if len(raw) > 2:
        c = FORM[raw].astype(np.int64)
        code = (c[:-2] * 64 + c[1:-1]) * 64 + c[2:]
        out = np.bincount(code * 0x9E3779B1 % (1 << 32) >> 19, minlength=SIZE).astype(np.float32)
        out = np.sqrt(out)
        # short texts say little about their form
        out *= len(raw) / (len(raw) + 60) / np.sqrt((out * out).sum())
    return out


#: Classes of bytes: signs count as themselves, letters and digits by kind.
FORM = np.zeros(256, np.uint8)
FORM[33:48], FORM[58:65], FORM[91:97], FORM[123:127] = range(8, 23), range(23, 30), range(30, 36), range(36, 40)
FORM[48:58], FORM[65:91], FORM[97:123], FORM[128:], FORM[32], FORM[9:14] = 1, 2, 3, 4, 5, 6


#: Labellers that only ever vote bad; each names a kind of fault.
FAULTS = tuple(LABELLERS.index(x) for x in ("capitals", "repeats", "marks", "bars"))


class LabelModel:
    """Vote probabilities given a hidden state: good, bad in general, or one kind of fault each.  Labellers are independent given it."""

    def __init__(self, share: np.ndarray, table: np.ndarray):
        self.share, self.table = share, table  # table[state, labeller, vote]; state 0 is good

    def states(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table[:, np.arange(v.shape[1]), v]).sum(2) + np.log(self.share)[:, None]
        p = np.exp(log - log.max(0))
        return p / p.sum(0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self.states(v)[0]

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        by = self.share[:, None, None] * self.table
        right = by[0, :, 1] + by[1:, :, 0].sum(0)
        return dict(zip(LABELLERS, (right / by[:, :, :2].sum((0, 2))).tolist()))


def expectation_maximisation(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit by vote patterns (rows) and how often each occurs, from labellers that are mostly right."""
    good = np.tile([0.05, 0.6, 0.35], (len(LABELLERS), 1))
    bad = np.tile([0.45, 0.25, 0.3], (len(LABELLERS), 1))
    tables = [good, bad]
    for j in FAULTS:
        own = np.tile([0.2, 0.45, 0.35], (len(LABELLERS), 1))
        own[j] = 0.9, 0.02, 0.08
        tables.append(own)
    prior = np.stack(tables)
    share = np.array([0.75, *[0.25 / (len(tables) - 1)] * (len(tables) - 1)])
    model = LabelModel(share, prior)
    if not len(patterns):
        return model
    last = None
    for _ in range(rounds):
        y = model.states(patterns) * weight
        table = np.stack([np.stack([(y * (patterns[:, j] == v)).sum(1) for v in (0, 1, 2)], 1) for j in range(len(LABELLERS))], 1)
        table = table + 2 * prior  # two pseudo-counts
        share = y.sum(1) + 1
        model = LabelModel(share / share.sum(), table / table.sum(2, keepdims=True))
        if last is not None and np.abs(model.table - last).max() < 1e-6:
            break
        last = model.table
    return model


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, votes): one digit for each labeller."""

    def run(batches):
        for batch in (part for batch in batches for part in common.small_slices(batch)):
            got = ["".join(map(str, votes(common.utf8(t.as_py())))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes string")


def _digits(patterns: list[str]) -> np.ndarray:
    return np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(-1, len(LABELLERS))


def fit_votes(table: DataFrame) -> LabelModel:
    """There are at most 3 ** labellers patterns, however many documents."""
    got = table.groupBy("votes").count().collect()
    return expectation_maximisation(_digits([r[0] for r in got]), np.array([r[1] for r in got], float))


def fit_scorer(texts: list[bytes], target: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear scorer by logistic regression on posterior labels, both halves weighing the same: what a text's form says beside the share of good ones."""
    if not len(texts):
        return np.zeros(SIZE, np.float32), 0.0
    x = np.empty((len(texts), SIZE), np.float32)
    for row, t in zip(x, texts):
        row[:] = hashed(t)
    bad, good = max(1e-6, float((1 - target).sum())), max(1e-6, float(target.sum()))
    weight = (target / good + (1 - target) / bad).astype(np.float32) / 2
    w, b, vw, vb = np.zeros(SIZE, np.float32), 0.0, np.zeros(SIZE, np.float32), 0.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * weight
        vw, vb = 0.9 * vw - 8.0 * (x.T @ d + 1e-5 * w), 0.9 * vb - 8.0 * float(d.sum())
        w, b = (w + vw).astype(np.float32), b + vb
    return w, b


def learn(docs: DataFrame, most_docs: int = 3000) -> tuple[LabelModel, np.ndarray, float, DataFrame]:
    """The label model on all documents, and the scorer on at most `most_docs` documents of either posterior class, those whose ids hash lowest."""
    table = common.stored(vote_table(docs), "votes")
    model = fit_votes(table)
    patterns = [r[0] for r in table.select("votes").distinct().collect()]
    q = dict(zip(patterns, model.posterior(_digits(patterns)).tolist()))
    texts, target = [], []
    for side in (True, False):
        own = [p for p in patterns if (q[p] >= 0.5) == side]
        some = table.where(F.col("votes").isin(own)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).select("doc_id").distinct()
        rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        for r in rows.orderBy("doc_id").select("text").collect():
            texts.append(common.utf8(r[0]))
            target.append(q["".join(map(str, votes(texts[-1])))])
    w, b = fit_scorer(texts, np.array(target, np.float32))
    del texts
    common.give_back()
    good = float(model.share[0])
    return model, w, b + float(np.log(good / (1 - good))), table


def score(docs: DataFrame, most_docs: int = 3000, least: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for every row; keep where the scorer gives at least `least`."""
    model, w, b, _ = learn(docs, most_docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, w, b))

    def run(batches):
        model, w, b = shared.value
        for batch in (part for batch in batches for part in common.small_slices(batch)):
            raw = [common.utf8(t.as_py()) for t in batch.column(1)]
            got = ["".join(map(str, votes(t))) for t in raw]
            z = np.array([float(hashed(t) @ w) + b for t in raw])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string()), pa.array(model.posterior(_digits(got))), pa.array(s), pa.array(s >= least)], names=["doc_id", "votes", "posterior", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep boolean")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
