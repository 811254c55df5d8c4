"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) along the words of a text.  The score of a word comes from hashed features of its
spelling; transitions and the start are weights as well.  Tokens for training are labelled from labelled
documents: a small cover of spellings that occur in toxic documents and hardly in others marks
words of toxic documents; all words of clean documents are clean.  Forward-backward marginals give the
offending spans; their maximum and sum give the document's score by a logistic fit.

The field is fitted on the driver on at most `most_docs` labelled documents of either class (those whose ids hash lowest).

Edge cases: null and empty texts have no words and get the score of no toxic word; null labels are not used;
several labels of a document all count; of several texts of one id the least one is fitted on, and all are scored; without labels of both classes the score is the share of toxic labels (0 without any); repeated
rows are scored alike; rows without an id are not held out; an empty table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
SIZE = 1 << 16
#: Words whose scores a Python worker keeps at most.
KEEP = 400_000
#: Steps of the scan that are vectorised over blocks.
BLOCK = 64
#: Windows whose gradient is taken at a time.
CHUNK = 8192


def spellings(word: str) -> list[str]:
    """Spelling features of a word: itself, its beginnings and its endings."""
    w = word.lower()
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), *(f"{w[-k:]}$" for k in (3, 5) if len(w) > k)]


def feature_ids(word: str) -> list[int]:
    return [crc32(s.encode("utf-8", "surrogatepass")) % SIZE for s in spellings(word)]


def marginals(u: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(toxic) of each word of texts laid end to end.

    u: each word's log-odds; first: True at the first word of a text; step[i, j]: weight of state j after i; start[j]: of the
    first state.  The chain restarts at each text.  Products over blocks of words are taken for all blocks at a time, joined one
    block after the other, and carried back into the blocks.
    """
    n = len(u)
    if not n:
        return np.zeros(0)
    e = np.exp(np.clip(u, -30, 30))
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    e = np.concatenate((e, np.ones(pad))).reshape(rows, BLOCK).T
    f = np.concatenate((first, np.ones(pad, bool))).reshape(rows, BLOCK).T
    m00, m01 = np.where(f, start[0], step[0, 0]), np.where(f, start[1], step[0, 1]) * e
    m10, m11 = np.where(f, start[0], step[1, 0]), np.where(f, start[1], step[1, 1]) * e
    a, b, c, d = m00[0], m01[0], m10[0], m11[0]
    for t in range(1, BLOCK):
        a, b, c, d = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t], c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        if t % 4 == 0:
            z = a + b + c + d
            a, b, c, d = a / z, b / z, c / z, d / z
    z = a + b + c + d
    whole = np.stack((a / z, b / z, c / z, d / z), 1).tolist()
    left, x = np.empty((2, rows)), (0.5, 0.5)
    for k, (p, q, r, s) in enumerate(whole):  # what reaches each block from the left
        left[:, k] = x
        y0, y1 = x[0] * p + x[1] * r, x[0] * q + x[1] * s
        x = (y0 / (y0 + y1), y1 / (y0 + y1))
    right, x = np.empty((2, rows)), (0.5, 0.5)
    for k in range(rows - 1, -1, -1):  # and from the right
        right[:, k] = x
        p, q, r, s = whole[k]
        y0, y1 = p * x[0] + q * x[1], r * x[0] + s * x[1]
        x = (y0 / (y0 + y1), y1 / (y0 + y1))
    alpha = np.empty((BLOCK, 2, rows))
    x0, x1 = left
    for t in range(BLOCK):
        x0, x1 = x0 * m00[t] + x1 * m10[t], x0 * m01[t] + x1 * m11[t]
        z = x0 + x1
        x0, x1 = x0 / z, x1 / z
        alpha[t] = x0, x1
    p = np.empty((BLOCK, rows))
    x0, x1 = right
    for t in range(BLOCK - 1, -1, -1):
        toxic = alpha[t, 1] * x1
        p[t] = toxic / (toxic + alpha[t, 0] * x0)
        x0, x1 = m00[t] * x0 + m01[t] * x1, m10[t] * x0 + m11[t] * x1
        z = x0 + x1
        x0, x1 = x0 / z, x1 / z
    return p.T.ravel()[:n]


class _Odds(dict):
    """Words' log-odds, worked out when first asked for."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = self[word] = float(self.weights[feature_ids(word)].sum())
        return found


class Field:
    """A fitted field: weights, transitions, and the logistic fit of document scores."""

    def __init__(self):
        self.weights = np.zeros(SIZE)
        self.step, self.start = np.zeros((2, 2)), np.zeros(2)
        self.document: np.ndarray | None = None
        self.constant = 0.0
        self._kept: _Odds | None = None

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    def odds(self, words: list[str]) -> list[float]:
        if self._kept is None or len(self._kept) > KEEP:
            self._kept = _Odds(self.weights)
        return list(map(self._kept.__getitem__, words))

    def tag(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's word marginals, and its score."""
        words = [WORD.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        u = np.array([x for w in words for x in self.odds(w)])
        ends = np.cumsum(sizes)
        first = np.zeros(len(u) + 1, bool)
        first[(ends - sizes)[sizes > 0]] = True
        p = marginals(u, first[:-1], np.exp(self.step), np.exp(self.start))
        parts = np.split(p, ends[:-1]) if len(texts) else []
        return parts, self.score(parts)

    def score(self, parts: list[np.ndarray]) -> np.ndarray:
        if self.document is None:
            return np.full(len(parts), self.constant)
        x = np.array([_summary(p) for p in parts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def _summary(p: np.ndarray) -> tuple[float, float, float]:
    return (1.0, float(p.max()), float(np.log1p(p.sum()))) if len(p) else (1.0, 0.0, 0.0)


def _spelled(types: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's spellings (a row each, -1 for none), the same numbered from 0, each number's length, and whether it is a whole word."""
    rows, sizes = np.full((len(types), 7), -1, np.int64), np.zeros((len(types), 7), np.int64)
    for k, w in enumerate(types):
        own = spellings(w)
        rows[k, : len(own)] = [crc32(s.encode("utf-8", "surrogatepass")) for s in own]
        sizes[k, : len(own)] = [len(s) for s in own]
    names, number = np.unique(rows, return_inverse=True)
    number = number.reshape(rows.shape) - 1 if len(names) and names[0] < 0 else number.reshape(rows.shape)
    n = int(number.max()) + 1 if len(types) else 0
    length, whole = np.zeros(n, np.int64), np.zeros(n, bool)
    on = number >= 0
    length[number[on]] = sizes[on]
    whole[number[:, 0]] = True
    return rows, number, length, whole


def _cover(toxic: list[np.ndarray], in_clean: np.ndarray, n_clean: int, length: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which spellings mark toxic words: greedily the one that occurs in most toxic documents not yet explained and hardly in clean ones.

    toxic: each toxic document's spellings; in_clean: clean documents with each spelling.
    """
    in_toxic = np.zeros(len(in_clean), np.int64)
    for d in toxic:
        in_toxic[d] += 1
    able = (in_toxic >= 2) & (in_clean <= max(1.0, 0.002 * n_clean)) & (in_clean * 20 <= in_toxic)
    docs = [d[able[d]] for d in toxic]
    owner, flat = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs) if docs else np.zeros(0, np.int64)
    by = np.argsort(flat, kind="stable")
    owner, starts = owner[by], np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(in_clean)))))
    gain, done = np.where(able, in_toxic, 0), np.zeros(len(docs), bool)
    marks, least = np.zeros(len(in_clean), bool), max(3, len(docs) // 100)
    while len(gain):
        # of equal gain the shorter spelling, as it covers more words not yet seen
        s = int(np.argmax(gain * 1000 - np.minimum(length, 999)))
        if gain[s] < least:
            break
        marks[s] = True
        for k in owner[starts[s] : starts[s + 1]]:
            if not done[k]:
                done[k] = True
                gain[docs[k]] -= 1
    # whole words that only toxic documents hold, and many of them, stand beside those that explain them
    return marks | (whole & able & (in_clean == 0) & (in_toxic >= max(least, 5, 0.02 * len(docs))))


def fit(texts: list[str], labels: list[int], rounds: int = 100) -> Field:
    """Fit a field on labelled documents."""
    field = Field()
    if not labels:
        return field
    field.constant = sum(labels) / len(labels)
    if not 0 < field.constant < 1:
        return field
    types: dict[str, int] = {}
    docs = [np.array([types.setdefault(w, len(types)) for w in WORD.findall(t)], np.int32) for t in texts]
    rows, number, length, whole = _spelled(list(types))
    types.clear()
    in_clean, toxic = np.zeros(len(length), np.int64), []
    for d, y in zip(docs, labels):
        own = np.unique(number[np.unique(d)])
        own = own[own >= 0]
        if y:
            toxic.append(own)
        else:
            in_clean[own] += 1
    marks = np.append(_cover(toxic, in_clean, len(labels) - len(toxic), length, whole), False)
    marked = marks[number].any(1)
    del toxic, number
    # windows of words: all words of all documents in turn, and others around marked words, which thus stand in the middle of one
    span, begins, of = 24, [], []
    for k, (own, y) in enumerate(zip(docs, labels)):
        t = np.flatnonzero(marked[own]) if y else []
        at = sorted({max(0, min(int(x) - span // 2, len(own) - span)) for x in t} | set(range(0, len(own), span)))
        begins += at
        of += [k] * len(at)
    if not begins:
        return field
    words, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    del docs
    first, of, begins = np.cumsum(sizes) - sizes, np.array(of), np.array(begins)
    mask = np.arange(span) < (sizes[of] - begins)[:, None]
    ids = words[np.minimum((first[of] + begins)[:, None] + np.arange(span), len(words) - 1)]
    ids[~mask] = 0
    y = marked[ids] & mask & (np.array(labels)[of] == 1)[:, None]
    del words, of, begins
    on = rows >= 0
    owner, flat, n_types = np.nonzero(on)[0], rows[on] % SIZE, len(rows)
    theta = np.concatenate((np.full(SIZE, -0.2), np.zeros(6)))  # weights, step, start
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = mask.sum()
    for r in range(1, rounds + 1):
        odds = np.clip(np.bincount(owner, theta[flat], n_types), -30, 30)
        by_type, shared = np.zeros(n_types), np.zeros(6)
        for at in range(0, len(ids), CHUNK):
            some = slice(at, at + CHUNK)
            g = _gradient(odds[ids[some]], y[some].astype(float), mask[some], theta[SIZE : SIZE + 4].reshape(2, 2), theta[SIZE + 4 :])
            by_type += np.bincount(ids[some].ravel(), (g[0] * mask[some]).ravel(), n_types)
            shared += np.concatenate((g[1].ravel(), g[2]))
        grad = np.concatenate((np.bincount(flat, by_type[owner], SIZE), shared)) / total + 1e-7 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        theta = theta - 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-9)
    field.weights, field.step, field.start = theta[:SIZE], theta[SIZE : SIZE + 4].reshape(2, 2), theta[SIZE + 4 :]
    # the document's score from its marginals
    field._kept = None
    x = np.array([_summary(p) for at in range(0, len(texts), 256) for p in field.tag(texts[at : at + 256])[0]]).reshape(-1, 3)
    field._kept = None
    w, target = np.zeros(3), np.array(labels, float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - target) + 0.05 * w)
    field.document = w
    return field


def _gradient(u, y, mask, step, start):
    """Of the negative log-likelihood: by each word's log-odds, by transitions, by the start."""
    n, t_max = u.shape
    e, t_w, s_w = np.exp(u), np.exp(step), np.exp(start)
    alpha, beta = np.zeros((t_max, 2, n)), np.ones((t_max, 2, n))
    alpha[0, 0], alpha[0, 1] = s_w[0], s_w[1] * e[:, 0]
    alpha[0] /= alpha[0].sum(0)
    for t in range(1, t_max):
        a = np.stack((alpha[t - 1, 0] * t_w[0, 0] + alpha[t - 1, 1] * t_w[1, 0], (alpha[t - 1, 0] * t_w[0, 1] + alpha[t - 1, 1] * t_w[1, 1]) * e[:, t]))
        alpha[t] = a / a.sum(0)
    for t in range(t_max - 2, -1, -1):
        b1 = beta[t + 1, 1] * e[:, t + 1]
        b = np.stack((t_w[0, 0] * beta[t + 1, 0] + t_w[0, 1] * b1, t_w[1, 0] * beta[t + 1, 0] + t_w[1, 1] * b1))
        beta[t] = np.where(mask[:, t + 1], b / b.sum(0), 0.5)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    by_word = p[:, 1].T - y
    by_step = np.zeros((2, 2))
    for t in range(1, t_max):
        on = mask[:, t]
        joint = np.stack([np.stack([alpha[t - 1, i] * t_w[i, j] * (e[:, t] if j else 1.0) * beta[t, j] for j in (0, 1)]) for i in (0, 1)])
        joint /= joint.sum((0, 1))
        was, now = y[:, t - 1], y[:, t]
        for i in (0, 1):
            for j in (0, 1):
                seen = (was if i else 1 - was) * (now if j else 1 - now)
                by_step[i, j] += ((joint[i, j] - seen) * on).sum()
    by_start = np.array([(p[0, 0] - (1 - y[:, 0])).sum(), (p[0, 1] - y[:, 0]).sum()])
    return by_word, by_step, by_start


def learn(docs: DataFrame, labels: DataFrame, most_docs: int = 2000) -> Field:
    """Fit on labelled documents outside the held-out fifth (crc32 of the id's text modulo 5 is 0)."""
    ids = labels.select("doc_id", F.col("toxic").alias("label")).where("label in (0, 1)").where(common.crc_rest(F.col("doc_id"), 5) != 0)
    seen = dict.fromkeys(common.labelled_sample(docs, ids, [0, 1], most_docs))  # copies of a text count once
    texts, found = [t for t, _ in seen], [int(y) for _, y in seen]
    del seen
    field = fit(texts, found)
    del texts
    common.give_back()
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans) for every row; spans are [start, end) in code points with the words' mean marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in common.small_slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                p, scores = shared.value.tag(texts)
                spans = [offending(t, q) for t, q in zip(texts, p)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")


def offending(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words whose marginal reaches `least`."""
    hot = np.flatnonzero(p >= least)
    if not len(hot):
        return []
    at = [m.span() for m in WORD.finditer(text)]
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    return [{"start": at[r[0]][0], "end": at[r[-1]][1], "p": float(p[r].mean())} for r in runs]


def reject(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """The rows of `docs` with all their columns whose score is below `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in common.small_slices(batch):
                _, scores = shared.value.tag([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(scores < least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, learn(docs, labels))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", F.coalesce(common.crc_rest(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"),
    )
