"""Mixing sources to target weights with soft domain membership.

A softmax classifier on hashed byte pairs, fitted on a labelled table, gives every document a posterior over
domains.  Document rates r >= 0 minimise the squared distance between the expected share of tokens of each domain,
sum of r * tokens * posterior over all tokens, and the target shares; of all such rates those next to 1 are taken, by Newton's
method on the dual.  Each step needs one small sum over the documents; the rates are a function of a document's posterior and of
one vector, so they are replayed and never stored.  Targets that no rates reach are warned of.

Edge cases: null and empty texts have no tokens and a uniform posterior; their rate follows from it but moves nothing; null domains are not
used for fitting, and of several texts of one id the least one is; targets are scaled to add up to one, domains without a target count as zero; no labelled rows, no
tokens or no targets at all leave all rates at one; an empty table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 4096
#: Documents whose features the fit holds as full rows at a time.
ROWS = 512


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Hashed byte pairs as shares of their root sum of squares, and the number of words."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(SIZE, np.float32), 0
    # letters in either case and all white space alike
    raw = FOLD[raw]
    pair = (raw[:-1].astype(np.int32) * 263 + raw[1:]) % SIZE
    count = np.sqrt(np.bincount(pair, minlength=SIZE)).astype(np.float32)
    words = int(np.count_nonzero((raw[1:] != 32) & (raw[:-1] == 32))) + int(raw[0] != 32)
    return count / max(1e-9, float(np.sqrt((count * count).sum()))), words


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


class Classifier:
    """Softmax regression on `features`."""

    def __init__(self, domains: list[str], weights: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posterior(self, x: np.ndarray, empty: np.ndarray) -> np.ndarray:
        k = len(self.domains)
        if self.weights is None:
            return np.full((len(x), k), 1 / max(k, 1))
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        p = (z / z.sum(1, keepdims=True)).astype(np.float64)
        p[empty] = 1 / k
        return p


def fit(texts: list[str], labels: list[str], domains: list[str], rounds: int = 60) -> Classifier:
    if not labels:
        return Classifier(domains)
    place, share = [], []  # of each text only the features that it has
    for t in texts:
        row = features(common.utf8(t))[0]
        place.append(np.flatnonzero(row).astype(np.uint16))
        share.append(row[place[-1]])
    x = np.zeros((min(ROWS, len(texts)), SIZE), np.float32)
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(d) for d in labels]]
    w, b = np.zeros((SIZE, len(domains)), np.float32), np.zeros(len(domains), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):  # full-batch gradient with momentum; features have length one
        slope, slope_b = 1e-5 * w, np.zeros_like(b)
        for at in range(0, len(texts), ROWS):
            part = x[: len(y[at : at + ROWS])]
            for row, on, values in zip(part, place[at : at + ROWS], share[at : at + ROWS]):
                row[on] = values
            z = part @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - y[at : at + ROWS]) / len(texts)
            slope, slope_b = slope + part.T @ d, slope_b + d.sum(0)
            for row, on in zip(part, place[at : at + ROWS]):
                row[on] = 0
        vw, vb = 0.9 * vw - 4.0 * slope, 0.9 * vb - 4.0 * slope_b
        w, b = w + vw, b + vb
    return Classifier(domains, w, b)


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], most_docs: int = 1500) -> Classifier:
    """Fit on at most `most_docs` labelled rows (doc_id, domain) of each domain, those whose ids hash lowest."""
    got = common.labelled_sample(docs, labelled.select("doc_id", F.col("domain").alias("label")), domains, most_docs)
    model = fit([t for t, _ in got], [d for _, d in got], domains)
    del got
    common.give_back()
    return model


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.domains)

    def run(batches):
        for batch in batches:
            for part in common.small_slices(batch, 2 << 20):
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    got = [features(common.utf8(t.as_py())) for t in some.column(1)]
                    n = np.array([g[1] for g in got], np.int64)
                    p = shared.value.posterior(np.stack([g[0] for g in got]), n == 0)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(k)), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), flat], names=["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def _expected(table: DataFrame, k: int, tried: list[np.ndarray]) -> list[np.ndarray]:
    """For each of some `tried` steps sums over all documents of tokens times: rate * posterior, rate squared, posterior * posterior' where the rate is not zero; then all tokens."""
    each = k + 1 + k * k

    def run(batches):
        total = np.zeros(len(tried) * each + 1)
        for batch in batches:
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, step in enumerate(tried):
                r = _replay(p, [step])
                own = p[r > 0]
                sums = np.concatenate(((r * t) @ p, [(r * r) @ t], ((own * t[r > 0, None]).T @ own).ravel()))
                total[at * each : (at + 1) * each] += sums
            total[-1] += t.sum()
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "x": total})

    got = table.select("n_tokens", "posterior").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(len(tried) * each + 1)
    for r in got.collect():
        out[r[0]] = r[1]
    return [*out[:-1].reshape(len(tried), each), out[-1]]


def solve(table: DataFrame, target: np.ndarray, close: float = 1e-3, soft: float = 1e-8, rounds: int = 200) -> list[np.ndarray]:
    """The step x that makes the rates max(0, 1 - posterior . x) meet the target shares, or come as near as rates can, which is warned of.

    x minimises half the mean squared rate + target . x + soft / 2 * |x|^2, which is strictly convex, by Newton's method with halved
    steps; its gradient is target - shares + soft * x.  Each pass over the documents looks at a step and its halves.
    """
    k = len(target)
    if not k:
        return []
    x = np.zeros(k)

    def look(tried):
        *sums, n = _expected(table, k, tried)
        if not n:
            return None
        out = []
        for z, s in zip(tried, sums):
            value = s[k] / n / 2 + target @ z + soft / 2 * z @ z
            out.append((value, z, s[:k] / n, target - s[:k] / n + soft * z, s[k + 1 :].reshape(k, k) / n + soft * np.eye(k)))
        return out

    now = look([x])
    if now is None:
        return []
    value, x, shares, slope, second = now[0]
    for _ in range(rounds):
        if np.abs(shares - target).max() <= close:
            return [x]
        if np.abs(slope).max() <= close / 100:
            warnings.warn(f"target shares {target.round(4).tolist()} are out of reach; the nearest are {shares.round(4).tolist()}", stacklevel=2)
            return [x]
        way = -np.linalg.solve(second, slope)
        for halves in (range(8), range(8, 40)):
            better = [g for g, h in zip(look([x + way * 0.5**h for h in halves]), halves) if g[0] <= value + 1e-4 * 0.5**h * (slope @ way)]
            if better:
                break
        else:
            raise RuntimeError(f"rates did not settle: shares {shares.tolist()}, targets {target.tolist()}")
        value, x, shares, slope, second = min(better, key=lambda g: g[0])
    raise RuntimeError(f"rates did not settle in {rounds} rounds: shares {shares.tolist()}, targets {target.tolist()}")


def rates(docs: DataFrame, model: Classifier, targets: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate) for every row of `docs`."""
    target = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    target = target / target.sum() if target.sum() else np.full(len(target), 1 / max(1, len(target)))
    table = common.stored(memberships(docs, model), "memberships")
    steps, k = solve(table, target), len(target)

    def run(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_replay(p, steps))], names=["doc_id", "n_tokens", "posterior", "rate"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double")


#: Domains of the query and their target shares of tokens.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Rates for the languages of `targets`; the labelled table is the languages of the rows that `labels` marks as good."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")
    domains = sorted(targets)
    model = learn(docs, labelled, domains)
    found = rates(docs, model, targets)
    shares = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(domains)]
    return found.select("doc_id", "n_tokens", *shares, "rate")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixed(docs, labels)
