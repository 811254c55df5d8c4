import hashlib
import re

import numpy as np
from odd_texts import ODD

from graticule.llm import secrets


def brute(text):
    """The base scan as the contract words it, character by character where that matters."""
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, m.end()))
    spans.sort()
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(k == x for _, k, _ in spans) for x in range(3)], hashlib.sha256(joined.encode()).hexdigest()


HEX = "0123456789abcdef0123456789abcdef"
PLANTED = [
    f'ü password = "hunter2x" and api_key:{HEX} PassWD: short',
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAKIA" + "9" * 12,
    f"{HEX} token=token=abcdef secret : ' x",
    "paſſword = notascii1 Key TOKEN='a.b-c_d/e+f='",
    "password password=abc password: defghi",
] + ODD


def test_base_scan(spark, docs):
    got = secrets.scan(docs(PLANTED), secrets.Models(np.zeros(secrets.SIGNS**2), np.zeros(secrets.SIGNS**2))).collect()
    assert len(got) == len(PLANTED)
    for r in got:
        n, digest = brute(PLANTED[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n, PLANTED[r["doc_id"]]
        assert r["base_sha256"] == digest


def test_query(spark, sf):
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op2_secrets(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == brute(rows[r["doc_id"]])


def random_strings(n, seed, size=28):
    rng = np.random.default_rng(seed)
    signs = np.array(list(secrets.ALPHABET[:62]))
    return ["".join(rng.choice(signs, size)) for _ in range(n)]


def identifiers(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["get", "set", "user", "name", "Count", "Index", "value", "list", "Table", "row", "Buffer", "config", "thread", "number"]
    return ["_".join(rng.choice(parts, 4)) + "_handler" for _ in range(n)]


def test_models_tell_random_strings_from_identifiers(spark):
    train = [(s, True) for s in random_strings(400, 1)] + [(s, False) for s in identifiers(400, 2)] + [(None, True), ("x", None), ("", False)]
    models = secrets.fit(spark.createDataFrame(train, "value string, secret boolean"))
    assert models.is_secret(random_strings(200, 3)).mean() >= 0.95
    assert models.is_secret(identifiers(200, 4)).mean() <= 0.02


def test_added_spans_and_redaction(spark, docs):
    train = [(s, True) for s in random_strings(400, 1)] + [(s, False) for s in identifiers(400, 2)]
    models = secrets.fit(spark.createDataFrame(train, "value string, secret boolean"))
    hidden, plain = random_strings(1, 9)[0], identifiers(1, 9)[0]
    text = f"ä {hidden} then {plain} and password=abcdef1 end"
    row = secrets.scan(docs([text]), models).first()
    assert row["n_markov"] == 1 and row["spans"].startswith(f"markov:2:{2 + len(hidden)},assign:")
    out = secrets.redact(docs([text, None, "fine"]), models).collect()
    assert out[0]["text"] == f"ä <SECRET> then {plain} and <SECRET> end" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] is None and out[2]["text"] == "fine"


def test_without_samples_nothing_is_added(spark, docs):
    models = secrets.fit_on_base(docs([None, "", "nothing of note"]))
    assert models.is_secret(random_strings(3, 5)).tolist() == [False] * 3
    assert secrets.scan(docs([]), models).count() == 0


def test_candidates_against_all_spans():
    """Runs that touch no base span, in texts full of both."""
    rng = np.random.default_rng(5)
    parts = ["password=hunter22", "deadbeef" * 4, "AKIA" + "Z" * 20, "Xk9/" * 6, "plain words", "token: abc123def", "q" * 18, "\n"]
    for _ in range(60):
        text = " ".join(rng.choice(parts, 40)) + "".join(rng.choice(parts, 5))
        base = secrets.base_spans(text)
        want = [(m.start(), m.end(), m[0]) for m in secrets.RUN.finditer(text) if not any(s < m.end() and e > m.start() for s, e, *_ in base)]
        assert secrets.candidates(text, base) == want


def test_time_in_proportion_to_a_text():
    import time

    unit = "token=abc123def456 " + "Zk3" * 8 + " words between them "
    took = []
    for n in (2_000, 40_000):
        text = unit * n
        began = time.process_time()
        found = secrets.candidates(text, secrets.base_spans(text))
        took.append(time.process_time() - began)
        assert len(found) == n
    assert took[1] < 60 * max(took[0], 0.01)


def test_query_spans_against_models_one_by_one(spark, sf):
    """The models' spans, counted and scored one string at a time."""
    rows = [(r[0], r[1] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = np.zeros((2, secrets.SIGNS, secrets.SIGNS))
    for _, t in rows:
        base = secrets.base_spans(t)
        for kind, values in ((1, [b[3] for b in base]), (0, [c[2] for c in secrets.candidates(t, base)])):
            for v in values:
                codes = [secrets.EDGE, *[secrets.ALPHABET.index(c) for c in v], secrets.EDGE]
                for a, b in zip(codes, codes[1:]):
                    counts[kind, a, b] += 1
    logs = []
    for c in counts[::-1]:
        alone = (c.sum(0) + 0.5) / (c.sum() + 0.5 * secrets.SIGNS)
        logs.append(np.log((c + 20 * alone) / (c.sum(1, keepdims=True) + 20)))
    got = {r["doc_id"]: r for r in secrets.op2_secrets(spark, sf).collect()}
    for d, t in rows:
        base, own = secrets.base_spans(t), []
        for s, e, v in secrets.candidates(t, base):
            codes = [secrets.EDGE, *[secrets.ALPHABET.index(c) for c in v], secrets.EDGE]
            ratio = sum(logs[0][a, b] - logs[1][a, b] for a, b in zip(codes, codes[1:]))
            if ratio >= max(10, 0.5 * len(v)):
                own.append((s, e, 3))
        assert got[d]["spans"] == secrets.joined(sorted([b[:3] for b in base] + own, key=lambda x: (x[0], x[2])))
