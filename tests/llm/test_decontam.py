import hashlib
import re

from odd_texts import ODD

from graticule.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(item)
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run(spark, docs, items):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.hits(d, b)
    return sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0).collect())


ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(3, ITEM), (10, ITEM), (7, "short item"), (8, ""), (9, None), (11, "...")]
DOCS = [
    (0, "say ONE, two-three four five six\nseven eight nine ten! more words"),
    (1, "one two three four five six seven eight nine and ten"),
    (2, "a Short  item short item, item"),
    (3, "two three four five six seven eight nine ten eleven twelve one two three four five six seven eight nine ten eleven twelve"),
    (4, "überone two three four five six seven eight nine ten"),
] + list(enumerate(ODD, 10))


def test_planted_windows(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert run(spark, DOCS, []) == brute(DOCS, [])
    assert run(spark, [], ITEMS) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 4)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_query(spark, sf):
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute_fast(docs, items)
    got = sorted(tuple(r) for r in decontam.op3_decontamination(spark, sf).collect())
    assert got == want and any(r[5] for r in got)


def brute_fast(docs, items):
    """As brute, with windows in a dictionary."""
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for b in range(len(w) - n + 1):
                if own := windows.get(tuple(w[b : b + n])):
                    hit.update(range(b, b + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_removal_keeps_other_columns(spark):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in DOCS], "doc_id long, text string, spans string, n_words int")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns
    clean = {r[0] for r in brute(DOCS, ITEMS) if not r[5]}
    assert {r[0] for r in left.collect()} == clean
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(d, b, cut=True).collect()}
    assert cut[0] == "say ! more words" and cut[1] == DOCS[1][1] and cut[10] is None
    assert all(not r[5] for r in brute([(k, t) for k, t in cut.items() if k != 3], ITEMS))
