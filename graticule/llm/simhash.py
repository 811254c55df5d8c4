"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are split into groups of correlated bits.  Each group gets its own error
threshold; the thresholds plus one add up to the radius plus one, so a pair within the
radius is within the threshold of at least one group.  A dynamic programme chooses
the thresholds that make probes and expected candidates cheapest.  Each fingerprint is filed
under its value in a group and probes all values within that group's threshold; whatever meets
is verified on all 64 bits.

Edge cases: null and empty texts have no words and fingerprint zero, which links like
any other; texts of fewer words than a shingle are one shingle; repeated rows of an id stay
repeated; ties of a bit (exactly half) give 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Members of one probe value that are compared in one task; larger groups are cut into tiles.
TILE = 60_000


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint of one text (lower-cased A-Z, XXH64 with seed 42)."""
    found = common.space_words(text.lower())
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(sizes) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(common.utf8(t.as_py()), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are both set: 64 x 64 sums."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": np.arange(64 * 64 + 1), "x": np.append(total.ravel(), n)})

    got = fps.select("fp").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    x = got["x"].to_numpy() if len(got) else np.zeros(64 * 64 + 1)
    return int(x[-1]), x[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into `parts` equal groups, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(64)), []
    for g in range(parts):
        size = (64 - 64 * g // parts) - (64 - 64 * (g + 1) // parts)
        own = [left.pop(int(np.argmax([corr[b, left].sum() for b in left])))]
        while len(own) < size:
            own.append(left.pop(int(np.argmax([corr[b, own].mean() for b in left]))))
        out.append(sorted(own))
    return out


def allocate(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) groups: a dynamic programme for each number of groups.

    The cost of a group at threshold t is its probes, plus the pairs expected within t
    differing bits, from every bit's share of ones (a Poisson binomial); a row that moves costs as much as 3000 comparisons, as disk and network are dearer than a popcount.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts in range(2, 9):
        groups = group_bits(n, both, parts)
        costs = []
        for bits in groups:
            dist = np.array([1.0])
            for b in bits:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(min(radius, len(bits)) + 1):
                probes = sum(comb(len(bits), e) for e in range(t + 1))
                row.append(3000.0 * n * (1 + probes) + 1.0 * n * n * dist[: t + 1].sum() if probes < 5000 else np.inf)
            costs.append(row)
        # spent[e]: cheapest way to give the groups so far thresholds with sum(t + 1) = e
        spent = {0: (0.0, [])}
        for row in costs:
            step = {}
            for e, (c, ts) in spent.items():
                for k, more in enumerate(row):
                    if e + k <= radius + 1 and c + more < step.get(e + k, (np.inf,))[0]:
                        step[e + k] = (c + more, [*ts, k - 1])
            spent = step
        if radius + 1 in spent and spent[radius + 1][0] < best[0]:
            best = (spent[radius + 1][0], [(g, t) for g, t in zip(groups, spent[radius + 1][1]) if t >= 0])
    return best[1]


def _keys(x: np.ndarray, plan) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position) that fingerprints are filed under or probe."""
    keys, rows = [], []
    for g, (bits, t) in enumerate(plan):
        mask = np.uint64(sum(1 << b for b in bits))
        for e in range(t + 1):
            for flips in combinations(bits, e):
                value = (x & mask) ^ np.uint64(sum(1 << b for b in flips))
                keys.append((value ^ np.uint64((g + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93))
                rows.append(np.arange(len(x)))
    return np.concatenate(keys), np.concatenate(rows)


def _across(x: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, limit: int, same: bool = False):
    """(left rows, right rows, bits that differ in all lanes) of the links between rows of x, some rows at a time; of one set with itself each pair once."""
    found = []
    step = max(1, 2_000_000 // max(1, len(right)))
    ahead = np.ascontiguousarray(x[right, 0])
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        r, c = np.nonzero(np.bitwise_count(x[rows, 0][:, None] ^ (ahead[k:] if same else ahead)[None]) <= radius)
        if same:
            r, c = r[c > r], c[c > r] + k
        a, b = rows[r], right[c]
        total = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
        on = total <= limit
        found.append((a[on], b[on], total[on]))
    return [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def _grown(x: np.ndarray, at: np.ndarray, radius: int, limit: int) -> list:
    """Links that connect a large group.

    Where the row next to the majority of bits links with a good part of the others, it stands for them: it grows over what it
    reaches, step by step, and only what is not reached is compared among itself.
    """
    out, left = [], at
    while len(left) > 64:
        bits = np.unpackbits(np.ascontiguousarray(x[left, 0]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(0) > len(left), bitorder="little").view(np.uint64)[0]
        hub = left[np.lexsort((x[left, 0], np.bitwise_count(x[left, 0] ^ middle)))[:1]]
        rest = left[left != hub[0]]
        star = _across(x, hub, rest, radius, limit)
        if len(star[1]) < 0.1 * len(left):
            break
        out.append(star)
        front, left = star[1], np.setdiff1d(rest, star[1], assume_unique=True)
        while len(front) and len(left):
            a, b, w = _across(x, front, left, radius, limit)
            _, first = np.unique(b, return_index=True)
            out.append([v[first] for v in (a, b, w)])
            front, left = b[first], np.setdiff1d(left, b[first], assume_unique=True)
    out.append(_across(x, left, left, radius, limit, same=True))
    return out


def _forest(x: np.ndarray, groups: list[tuple[int, np.ndarray]], radius: int, limit: int) -> np.ndarray:
    """Pairs of rows of x: a minimum spanning forest, by bits that differ, of the links within groups.

    groups: (size, positions), positions being a row for each group of that size.
    """
    found = []
    for size, rows in groups:
        if size > 16:
            for at in rows:
                found += _grown(x, at, radius, limit)
            continue
        for some in np.array_split(rows, len(rows) * size * size // 4_000_000 + 1):
            block = x[some, 0]
            for i in range(size - 1):
                r, c = np.nonzero(np.bitwise_count(block[:, i + 1 :] ^ block[:, i : i + 1]) <= radius)
                if len(r):
                    a, b = some[r, i], some[r, i + 1 + c]
                    total = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
                    on = total <= limit
                    found.append((a[on], b[on], total[on]))
    found = [f for f in found if len(f[0])]
    if not found:
        return np.zeros((0, 2), np.int64)
    a, b, w = (np.concatenate(v).astype(np.int64) for v in zip(*found))
    _, first = np.unique(np.minimum(a, b) * len(x) + np.maximum(a, b), return_index=True)
    a, b, w = a[first], b[first], w[first]
    forest, out = common.Forest(len(x)), []
    for k in np.argsort(w, kind="stable").tolist():
        if forest.join(int(a[k]), int(b[k])):
            out.append((a[k], b[k]))
    return np.array(out, np.int64).reshape(-1, 2)


def _dealt(fps: DataFrame, radius: int, lanes: tuple[str, ...], name: str) -> DataFrame:
    """(key, lanes, bucket): rows that are within `radius` bits in the first lane, fp, meet under a key at least once."""
    n, both = _moments(fps)
    plan = allocate(n, both, radius)
    per_row = sum(comb(len(bits), e) for bits, t in plan for e in range(t + 1))
    buckets = max(16, -(-n * per_row // 200_000))
    shape = "key long, " + ", ".join(f"{c} long" for c in lanes)

    def spread(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).view(np.uint64)
            step = max(1, 400_000 // max(per_row, 1))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                keys, rows = _keys(np.ascontiguousarray(part[:, 0]), plan)
                yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64)} | {c: part[rows, k].view(np.int64) for k, c in enumerate(lanes)})

    filed = fps.select(*lanes).mapInArrow(spread, shape)
    hot = filed.groupBy("key").count().where(F.col("count") > TILE).withColumn("tiles", F.ceil(F.col("count") / F.lit(TILE // 2)))
    hot = common.checkpointed(hot.select("key", "tiles"))
    dealt = filed
    if hot.limit(1).count():
        tile = F.pmod(F.xxhash64(name), F.col("tiles"))
        cut = filed.join(hot, "key").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        cut = cut.select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), *lanes)
        dealt = filed.join(hot, "key", "left_anti").unionByName(cut)
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _grouped(key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first place of each name, and (size, rows) of the groups of names with one key; rows number the names."""
    _, first, row = np.unique(name, return_index=True, return_inverse=True)
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
    key, row = key[fresh], row[fresh]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    return first, [(int(s), row[starts[sizes == s][:, None] + np.arange(s)]) for s in np.unique(sizes[sizes > 1])]


def links(fps: DataFrame, radius: int = 4, more: tuple[str, ...] = (), limit: int | None = None, name: str = "fp") -> DataFrame:
    """Edges (a, b) between rows, called by their `name`, that connect all those within `radius` bits of fp.

    With `more` columns of further fingerprints, only those count whose bits that differ are at most `limit` in all.
    """
    limit = radius if limit is None else limit
    lanes = ("fp", *more)

    def verify(table: pa.Table) -> pa.Table:
        names = table.column(name).to_numpy().view(np.uint64)
        x = np.stack([table.column(c).to_numpy() for c in lanes], 1).view(np.uint64)
        first, groups = _grouped(table.column("key").to_numpy(), names)
        x, names = x[first], names[first].view(np.int64)
        e = _forest(x, groups, radius, limit)
        ends = np.sort(names[e], 1) if len(e) else np.zeros((0, 2), np.int64)
        return pa.table({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})

    dealt = _dealt(fps, radius, tuple(dict.fromkeys((*lanes, name))), name)
    return dealt.groupBy("bucket").applyInArrow(verify, "a long, b long").distinct()


def classes(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    own = common.stored(fingerprints(docs, words), "simhash")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    fps = common.checkpointed(fps)
    comps = common.connected_components(links(fps, radius))
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classes(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
