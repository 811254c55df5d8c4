"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Base spans come from three fixed patterns.  Other runs of key-like characters are scored by the
log-likelihood ratio of two first-order character models, one trained on labelled secrets, one on labelled
ordinary identifiers; runs over the threshold are added as spans of kind `markov`.

Edge cases: null texts are empty; repeated rows are scanned alike; spans at one place are ordered
by kind; an empty training set gives flat models, which add nothing; an empty table gives an empty result;
other columns are carried along or ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the character models look at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Their alphabet, with one more sign for start and end.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
EDGE = len(ALPHABET)
CODE = np.full(256, EDGE, np.uint8)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(EDGE)
SIGNS = EDGE + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the fixed patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list) -> list[tuple[int, int, str]]:
    """Runs of key-like characters that touch no base span."""
    out, k, covered = [], 0, []
    for s, e in sorted((s, e) for s, e, *_ in base):  # stretches that do not touch
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    for m in RUN.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            out.append((m.start(), m.end(), m[0]))
    return out


def pairs_of(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character pairs of all strings, edges included, as one number each, and the string each is from."""
    flat = np.frombuffer(("\n" + "\n".join(values) + "\n").encode("ascii", "replace"), np.uint8)
    codes = CODE[flat].astype(np.int64)
    owner = np.cumsum(flat == 10)[:-1] - 1
    return codes[:-1] * SIGNS + codes[1:], owner


class Models:
    """Two character models as one table of log-likelihood ratios (natural logarithm)."""

    def __init__(self, secret: np.ndarray, plain: np.ndarray, back_off: float = 20.0, per_char: float = 0.5, least: float = 10.0):
        rows = []
        for counts in (secret, plain):
            c = counts.reshape(SIGNS, SIGNS).astype(float)
            # pairs that are rare lean on how often the second character occurs at all
            alone = (c.sum(0) + 0.5) / (c.sum() + 0.5 * SIGNS)
            rows.append(np.log((c + back_off * alone) / (c.sum(1, keepdims=True) + back_off)))
        self.ratio = (rows[0] - rows[1]).ravel() if secret.any() and plain.any() else np.zeros(SIGNS * SIGNS)
        self.per_char, self.least = per_char, least

    def scores(self, values: list[str]) -> np.ndarray:
        pairs, owner = pairs_of(values)
        return np.bincount(owner, self.ratio[pairs], len(values))[: len(values)]

    def is_secret(self, values: list[str]) -> np.ndarray:
        if not values:
            return np.zeros(0, bool)
        size = np.array([len(v) for v in values])
        return self.scores(values) >= np.maximum(self.least, self.per_char * size)


def _counted(total: np.ndarray):
    at = np.flatnonzero(total.ravel())
    return pa.RecordBatch.from_pydict({"i": at, "n": total.ravel()[at]})


def _add(total: np.ndarray, kind: int, values: list[str]) -> None:
    if values:
        total[kind] += np.bincount(pairs_of(values)[0], minlength=SIGNS * SIGNS)


def _models(counts: DataFrame) -> Models:
    total = np.zeros(2 * SIGNS * SIGNS, np.int64)
    for i, n in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[i] = n
    return Models(total[SIGNS * SIGNS :], total[: SIGNS * SIGNS])


def fit(samples: DataFrame) -> Models:
    """Models from labelled samples (value string, secret boolean): distributed pair counts, a fixed-size table each."""

    def run(batches):
        total = np.zeros((2, SIGNS * SIGNS), np.int64)
        for batch in batches:
            values, label = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (0, 1):
                _add(total, k, [v for v, y in zip(values, label) if v and y is not None and bool(y) == bool(k)])
        yield _counted(total)

    return _models(samples.select("value", "secret").mapInArrow(run, "i long, n long"))


def fit_on_base(docs: DataFrame) -> Models:
    """Models from what the documents label themselves: values of base spans are secrets, other key-like runs are not."""

    def run(batches):
        total = np.zeros((2, SIGNS * SIGNS), np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    base = base_spans(t)
                    _add(total, 1, [x[3] for x in base])
                    _add(total, 0, [x[2] for x in candidates(t, base)])
        yield _counted(total)

    return _models(docs.select("text").mapInArrow(run, "i long, n long"))


def spans_of(text, models: Models) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind number) of one text, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    rest = candidates(text, base)
    found = models.is_secret([x[2] for x in rest])
    return sorted([x[:3] for x in base] + [(s, e, 3) for (s, e, _), y in zip(rest, found) if y], key=lambda x: (x[0], x[2]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in (part for batch in batches for part in common.small_slices(batch)):
            got = [spans_of(t.as_py(), shared.value) for t in batch.column(1)]
            columns = {"doc_id": batch.column(0)}
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(x[2] == k for x in g) for g in got], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(x for x in g if x[2] < 3).encode()).hexdigest() for g in got], pa.string())
            columns["spans"] = pa.array([joined(g) for g in got], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, models: Models, mark: str = "<SECRET>") -> DataFrame:
    """The rows of `docs` with all their columns; every span in the text becomes `mark`, n_chars (if there) follows."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in (part for batch in batches for part in common.small_slices(batch)):
            texts, changed = batch.column(at).to_pylist(), False
            sizes = batch.column(chars).to_pylist() if chars is not None else None
            for k, t in enumerate(texts):
                if spans := spans_of(t, shared.value):
                    out, done = [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            out += [t[done:s], mark]
                        done = max(done, e)
                    texts[k], changed = "".join([*out, t[done:]]), True
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if sizes is not None:
                    batch = batch.set_column(chars, batch.schema.field(chars), pa.array(sizes, pa.int64()))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit_on_base(docs))
