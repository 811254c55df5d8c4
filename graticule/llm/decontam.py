"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items become windows of `n` consecutive words (an item of fewer words is one window).
Their hashes are broadcast; every document's word windows are looked up, hits are verified word by word, and
spans or whole documents are removed.  Items are cut into overlapping pieces; a benchmark too large for one broadcast is dealt into
blocks of bounded size, and the documents pass one block after the other, each pass written before the next one.

Edge cases: null texts have no words; items without words have no window; repeated items
and documents are all kept; items with a null id hit, but are not listed; an empty benchmark hits nothing;
other columns are carried along or ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of benchmark text in one broadcast.
BLOCK_WORDS = 2_000_000
#: Words of an item in one piece, besides those that overlap with the next one.
PIECE_WORDS = 100_000
#: Windows that are looked up at a time.
STEP = 200_000


def words_of(text) -> list[bytes]:
    return common.ALNUM_WORD.findall(common.utf8(text).lower())


class Windows:
    """The windows of some items: word ids, window hashes, and the items they come from."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found[size][tuple(ids[at : at + size])].add(item)
        rng = np.random.default_rng(7)
        self.power = rng.integers(1, 1 << 62, max(n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_size = {}
        for size, windows in found.items():
            ids = np.array(list(windows), np.int64).reshape(-1, size)
            owners = list(windows.values())
            order = np.argsort(h := self._hash(ids), kind="stable")
            self.by_size[size] = (h[order], ids[order], [owners[k] for k in order])

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * self.power[: ids.shape[1]]).sum(1, dtype=np.uint64)

    def find(self, ids: np.ndarray):
        """(size, positions, owners of each) of every window that occurs in a sequence of word ids; 0 is any other word."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, windows, owners) in self.by_size.items():
            if len(ids) < size:
                continue
            able = np.flatnonzero(unknown[size:] == unknown[:-size])
            for at in np.split(able, range(STEP, len(able), STEP)):
                own = ids[at[:, None] + np.arange(size)]
                h = self._hash(own)
                k = np.searchsorted(hashes, h)
                while len(at):  # equal hashes of different windows stand side by side
                    some = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h)
                    at, own, h, k = at[some], own[some], h[some], k[some]
                    same = (windows[k] == own).all(1)
                    yield size, at[same], [owners[x] for x in k[same]]
                    at, own, h, k = at[~same], own[~same], h[~same], k[~same] + 1


def _pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, text, words): items as pieces of their words that hold each window once."""

    def run(batches):
        for batch in batches:
            out = {"item_id": [], "text": [], "words": []}
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                for at in range(0, max(1, len(words) - n + 1) if words else 0, PIECE_WORDS):
                    own = words[at : at + PIECE_WORDS + n - 1]
                    out["item_id"].append(item.as_py())
                    out["text"].append(b" ".join(own))
                    out["words"].append(len(own))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], pa.string()), "text": pa.array(out["text"], pa.binary()), "words": pa.array(out["words"], pa.int64())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return common.stored(items.mapInArrow(run, "item_id string, text binary, words long"), "items")


def _passes(benchmark: DataFrame, n: int):
    """(broadcast windows, whether more follow) of blocks of about BLOCK_WORDS words each."""
    spark, pieces = benchmark.sparkSession, _pieces(benchmark, n)
    volume = pieces.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // BLOCK_WORDS))
    for b in range(blocks):
        some = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(Windows([(r[0], bytes(r[1])) for r in some.select("item_id", "text").collect()], n)), b + 1 < blocks


def _scan(texts: list, windows: Windows) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each text: its words, the word spans that occurring windows cover, their items."""
    words = [words_of(t) for t in texts]
    sizes = [len(w) for w in words]
    # a 0 after each text keeps windows inside it
    ids = np.fromiter(chain.from_iterable(chain(map(windows.vocab.get, w, repeat(0)), (0,)) for w in words), np.int64, sum(sizes) + len(sizes))
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    spans, items = defaultdict(list), defaultdict(set)
    for size, at, owners in windows.find(ids):
        text = np.searchsorted(starts, at, side="right") - 1
        for t, a, own in zip(text.tolist(), (at - starts[text]).tolist(), owners):
            spans[t].append((a, a + size))
            items[t] |= own
    return [(size, merged(spans.get(t, [])), items.get(t, set())) for t, size in enumerate(sizes)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): spans are [start, end) word numbers, items their ids sorted as strings."""
    shape = "doc_id long, text string, n_words long, items array<string>, spans array<struct<start:long,end:long>>"
    found = docs.select("doc_id", "text").withColumns({
        "n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:long,end:long>>")
    })

    def through(windows):
        def run(batches):
            for batch in batches:
                for part in common.small_slices(batch):
                    got = _scan(part.column(1).to_pylist(), windows.value)
                    old_items, old_spans = part.column(3).to_pylist(), part.column(4).to_pylist()
                    items = [sorted({*a, *(x for x in own if x is not None)}) for (_, _, own), a in zip(got, old_items)]
                    spans = [[{"start": s, "end": e} for s, e in merged([*sp, *((x["start"], x["end"]) for x in a)])] for (_, sp, _), a in zip(got, old_spans)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                        names=["doc_id", "text", "n_words", "items", "spans"],
                    )

        return run

    for windows, more in _passes(benchmark, n):
        found = found.mapInArrow(through(windows), shape)
        found = common.stored(found, "hits") if more else found
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, cut: bool = False) -> DataFrame:
    """The rows of `docs` with all their columns: contaminated ones left out, or with `cut` their hit words blanked out of the text."""
    at, name = docs.columns.index("text"), docs.schema

    def through(windows):
        def run(batches):
            for batch in batches:
                for part in common.small_slices(batch):
                    texts = part.column(at).to_pylist()
                    got = _scan(texts, windows.value)
                    if not cut:
                        yield part.filter(pa.array([not g[1] for g in got], pa.bool_()))
                        continue
                    texts = [without(t, g[1]) if g[1] else t for t, g in zip(texts, got)]
                    yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

        return run

    for windows, more in _passes(benchmark, n):
        docs = docs.mapInArrow(through(windows), name)
        docs = common.stored(docs, "decontaminated") if more else docs
    return docs


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the given spans of words and what stands between their words."""
    raw = common.utf8(text)
    at = [(m.start(), m.end()) for m in common.ALNUM_WORD.finditer(raw)]
    out, done = [], 0
    for s, e in spans:
        out.append(raw[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = hits(docs, bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM i),
a AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT a.r, a.n, a.p, g.item_id FROM a JOIN g ON g.n = a.n AND g.g = list_slice(a.w, a.p, a.p + a.n - 1)),
k AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
