"""Exact substring removal with suffix arrays by linear grouping.

Strings count as equal if 128-bit hashes of them, or of all bytes around their anchor that they could lie in, are equal; where
that is not so, bytes are compared.  Every `width`-byte string holds at least one anchor: the least hash among its `GRAM`-byte strings, a choice that
depends on those bytes alone.  Equal strings hold equal anchors at equal places, so only places around one anchor are
ever compared.

1. Each text's anchors are filed by their hash, with a hash of all that a string around them could reach.
2. Anchors that occur once fall out.  Places that are equal in full reach are covered in full.
3. For the rest, one text for each distinct reach is fetched.  On either side of an anchor, what a
   group shares is cut where its texts part; each piece is a symbol.  One suffix array over the symbols
   of many groups, built by linear grouping, and its common prefixes give the longest repeat that starts at each cut.
4. Texts lose the bytes that repeats cover.

A group too large for one task is instead settled by counting the hashes of its strings, dealt by hash.

Edge cases: null texts are empty; texts shorter than `width` lose nothing; rows are told apart by 128 bits of hashes of id and text; repeated rows of one id and text
are documents of their own; texts of any length are read in overlapping pieces; ties of the least hash are all anchors; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sufsort import common_prefixes, suffix_array

GRAM = 64
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20
#: Distinct reaches of one anchor that one task compares.
HOT = 30_000
#: Reaches that one suffix array holds, if an anchor has no more.
TOGETHER = 1_500
#: Bytes of text, anchors, and reaches in one group of rows that a task holds.
PART_BYTES, BUCKET_ANCHORS, BUCKET_REACHES = 12 << 20, 600_000, 20_000

_RNG = np.random.default_rng(20)
CODES, MORE_CODES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASE, MORE_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Polynomial hashes of any substring of some bytes, modulo 2 ** 64 over random codes of bytes; `more` gives others of the same kind."""

    _powers: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, more: bool = False):
        n = len(raw)
        size, base = 1 << max(16, (n + 1).bit_length()), MORE_BASE if more else BASE
        if self._powers.get(base, (0,))[0] != size:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            self._powers[base] = size, *both
        _, up, self.down = self._powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((MORE_CODES if more else CODES)[raw] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        x = take(x[:-k], x[k:])
        k *= 2
    return x if k == width else take(x[: len(x) - (width - k)], x[width - k :])


def anchors(raw: np.ndarray, first: np.ndarray, width: int):
    """(position, hash, first and last start of its strings) of the anchors of texts laid end to end, and the hashes of the bytes.

    first: where each text starts, and the end.  An anchor's strings are those of which it is the least; they follow on one another.
    """
    hashes = Hashes(raw)
    if len(raw) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), hashes
    h = np.maximum(hashes.grams(GRAM), np.uint64(1))
    reach = width - GRAM + 1
    least = _sliding(h, reach, np.minimum)  # of the strings that start at each place
    whole = np.ones(len(raw) + 1, bool)
    for f in first[1:-1]:
        whole[max(0, f - width + 1) : f] = False
    least[~whole[: len(least)]] = 0
    pad = np.zeros(reach - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), reach, np.maximum) == h)
    # runs of strings with one least hash; an anchor's run is the nearest one before it that has its hash
    runs = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(runs[1:], len(least)) - 1
    own = np.searchsorted(runs, np.minimum(at, len(least) - 1), side="right") - 1
    while (other := least[runs[own]] != h[at]).any():
        own[other] -= 1
    return (at, h[at], np.maximum(runs[own], at - reach + 1), np.minimum(last[own], at)), hashes


def _reaches(found, hashes: Hashes, raw: np.ndarray, width: int):
    """(position, anchor, bytes of its reach to the left, to the right, two hashes of the reach)."""
    at, h, low, high = found
    left, right = at - low, high + width - at - GRAM
    place = left.astype(np.uint64) * np.uint64(BASE)
    full, more = (x.of(low, high + width) ^ place if len(at) else np.zeros(0, np.uint64) for x in (hashes, Hashes(raw, more=True)))
    return at, h, left.astype(np.uint16), right.astype(np.uint16), full, more


def _places(texts: list[bytes], width: int):
    """(text number, position, anchor, left, right, hashes of its reach) of all anchors, piece by piece."""
    batch, numbers, size = [], [], 0

    def flush():
        first = np.concatenate(([0], np.cumsum([len(t) for t in batch])))
        raw = np.frombuffer(b"".join(batch), np.uint8)
        at, *rest = _reaches(*anchors(raw, first, width), raw, width)
        own = np.searchsorted(first, at, side="right") - 1
        return np.array(numbers, np.int64)[own], at - first[own], *rest

    for k, t in enumerate(texts):
        if len(t) < width:
            continue
        if len(t) > PIECE:  # strings that start in each piece
            for at in range(0, len(t) - width + 1, PIECE):
                span = np.frombuffer(t, np.uint8)[at : at + PIECE + width - 1]
                place, *rest = _reaches(*anchors(span, np.array([0, len(span)]), width), span, width)
                yield np.full(len(place), k), place + at, *rest
            continue
        if size + len(t) > PIECE and batch:
            yield flush()
            batch, numbers, size = [], [], 0
        batch.append(t)
        numbers.append(k)
        size += len(t)
    if batch:
        yield flush()


#: What is known of an anchor, as arrays of bytes.
PLACE = {"key": np.int64, "key2": np.int64, "at": np.int64, "left": np.uint16, "right": np.uint16, "a": np.uint64}


def _columns(table: pa.Table, kinds: dict) -> list[np.ndarray]:
    """Arrays that a table holds as bytes, of all rows together."""
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in kinds.items()]


def _split(*keys: np.ndarray):
    """(key, positions) of each run of equal keys, a number or, of several arrays, a tuple of them."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    cuts = np.flatnonzero(np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)) + 1 if len(order) else []
    for run in np.split(order, cuts):
        if len(run):
            own = tuple(int(k[run[0]]) for k in keys)
            yield own if len(keys) > 1 else own[0], run


def _paths(groups: np.ndarray, texts: list[bytes], numbers: int):
    """What each text shares with others of its group, as a path in the trie of the group's texts, from the deepest branch up.

    Returns a start for each row and, for each branch, the next one up (-1 at the top), its depth, and a number from `numbers` on.
    """
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    width = max(1, int(size.max()) if n else 1)
    packed = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), f"S{width}")
    order = np.lexsort((size, packed, groups))  # a text that another goes on is the smaller
    x = packed.view(np.uint8).reshape(n, width)[order]
    own = size[order]
    differ = x[1:] != x[:-1]
    share = np.where(differ.any(1), differ.argmax(1), width)
    share = np.minimum(share, np.minimum(own[1:], own[:-1]))
    share[groups[order][1:] != groups[order][:-1]] = 0
    start, up, depth, open_ = [-1] * n, [], [], []
    for r, h in enumerate([*share.tolist(), 0]):
        below = -1  # the branch that hangs on what comes next; -1 for the row itself
        while open_ and depth[open_[-1]] > h:
            top = open_.pop()
            if below < 0:
                start[order[r]] = top
            else:
                up[below] = top
            below = top
        if h and not (open_ and depth[open_[-1]] == h):
            open_.append(len(up))
            up.append(-1)
            depth.append(h)
        if open_:
            if below < 0:
                start[order[r]] = open_[-1]
            else:
                up[below] = open_[-1]
    return start, up, depth, numbers


def repeats(groups: np.ndarray, left: list[bytes], right: list[bytes], single: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bytes to the left of its anchor, bytes to the right after it) of the repeats of `single` rows.

    groups: the anchor of each row; left, right: the text on either side of it.
    """
    n = len(groups)
    _, anchor = np.unique(groups, return_inverse=True)
    first = int(anchor.max()) + 3 if n else 3
    l_start, l_up, l_depth, l_first = _paths(groups, [t[::-1] for t in left], first)
    r_start, r_up, r_depth, r_first = _paths(groups, right, first + len(l_up))
    text, weight, where, begin = [], [], [], []
    for k, g in enumerate((anchor + 2).tolist()):
        begin.append(len(text))
        b = l_start[k]
        while b >= 0:
            nxt = l_up[b]
            text.append(l_first + b)
            weight.append(l_depth[b] - (l_depth[nxt] if nxt >= 0 else 0))
            where.append(l_depth[b])
            b = nxt
        text.append(g)
        weight.append(GRAM)
        where.append(0)
        at, b = len(text), r_start[k]
        while b >= 0:
            nxt = r_up[b]
            text.append(r_first + b)
            weight.append(r_depth[b] - (r_depth[nxt] if nxt >= 0 else 0))
            b = nxt
        text[at:] = text[at:][::-1]
        weight[at:] = weight[at:][::-1]
        where += [-1] * (len(text) - at + 1)
        text.append(1)  # the end of a row
        weight.append(0)
    order = suffix_array(text)
    shared = np.array([*common_prefixes(text, order), 0], np.int64)
    total = np.concatenate(([0], np.cumsum(np.array(weight, np.int64))))
    i = np.array(order, np.int64)
    begin = np.array(begin, np.int64)
    owner = np.searchsorted(begin, i, side="right") - 1
    end = np.append(begin[1:], len(text))[owner] - 1  # where the row's end stands
    reach = total[np.minimum(i + np.maximum(shared[:-1], shared[1:]), end)] - total[i]
    d = np.array(where, np.int64)[i]
    hit = (d >= 0) & (reach >= width) & np.asarray(single)[owner]
    # all repeats of a row hold its anchor, so together they are one stretch
    to_left, to_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    np.maximum.at(to_left, owner[hit], d[hit])
    np.maximum.at(to_right, owner[hit], (reach - d - GRAM)[hit])
    rows = np.flatnonzero(to_left >= 0)
    return rows, to_left[rows], to_right[rows]


def together(groups: np.ndarray):
    """Positions of rows, whole groups at a time, about TOGETHER of them or one group."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    ends, at = np.append(cuts, len(order)), 0
    while at < len(order):
        stop = ends[np.searchsorted(ends, at, side="right")]
        more = ends[np.searchsorted(ends, at + TOGETHER, side="right") - 1] if len(ends) and ends[0] <= at + TOGETHER else stop
        stop = max(int(stop), int(more))
        yield order[at:stop]
        at = stop


def spans(docs: DataFrame, width: int = 200) -> tuple:
    """Keyed documents (part, key, doc_id, text), sifted anchors, and the other repeats (part, key, start, end)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", F.lit(7), "doc_id")})
    volume = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()[0]
    parts, buckets = max(16, -(-volume // PART_BYTES)), max(16, -(-volume // (60 * BUCKET_ANCHORS)))
    keyed = keyed.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))

    def file(batches):
        for batch in batches:
            for slice_ in common.small_slices(batch, 16 << 20):
                keys, more = slice_.column(0).to_numpy(), slice_.column(1).to_numpy()
                found = list(_places([common.utf8(t.as_py()) for t in slice_.column(2)], width))
                if not found:
                    continue
                own, at, a, left, right, c, c2 = (np.concatenate(x) for x in zip(*found))
                bucket = (a >> np.uint64(8)) % np.uint64(buckets)
                for b, run in _split(bucket):
                    blobs = (keys[own[run]], more[own[run]], at[run].astype(np.int64), left[run], right[run], a[run], c[run], c2[run])
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip((*PLACE, "c", "c2"), blobs)}})

    place = ", ".join(f"{n} binary" for n in PLACE)
    filed = keyed.select("key", "key2", "text").mapInArrow(file, f"bucket int, {place}, c binary, c2 binary")

    def sift(table: pa.Table) -> pa.Table:
        columns = _columns(table, PLACE | {"c": np.uint64, "c2": np.uint64})
        order = np.lexsort((columns[2], columns[1], columns[0], columns[7], columns[6], columns[5]))
        key, key2, at, left, right, a, c, c2 = (x[order] for x in columns)
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new_c = new_a | np.concatenate(([True], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])))
        of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        n_c = np.bincount(of_c)  # rows of each reach
        kinds = np.bincount(of_a[new_c])  # reaches of each anchor
        full = n_c[of_c] > 1
        several = kinds[of_a] > 1
        # 0: covered in full; 1: to be compared; 2: covered, and stands for its reach in comparisons; 3, 4: as 1, 2 in a very large group
        hot = np.where(kinds[of_a] > HOT, 2, 0)
        status = np.where(full, np.where(new_c & several, 2 + hot, 0), np.where(several, 1 + hot, -1))
        keep = status >= 0
        part = key[keep] % parts  # as pmod: Python and numpy round down
        rows = {n: [] for n in ("part", *PLACE, "status")}
        for p, run in _split(part):
            rows["part"].append(p)
            for n, x in zip((*PLACE, "status"), (key, key2, at, left, right, a, status.astype(np.int8))):
                rows[n].append(x[keep][run].tobytes())
        kinds_ = {"part": pa.int32()}
        return pa.table({n: pa.array(x, kinds_.get(n, pa.binary())) for n, x in rows.items()})

    sifted = common.stored(filed.groupBy("bucket").applyInArrow(sift, f"part int, {place}, status binary"), "anchors")

    def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        columns = _columns(wanted, PLACE | {"status": np.int8})
        key, key2, at, before, after, a, status = (x[columns[6] > 0] for x in columns)
        place = {k: r for r, k in enumerate(zip(texts.column("key").to_pylist(), texts.column("key2").to_pylist()))}
        out = {n: [] for n in ("a", "key", "key2", "at", "status", "left", "right")}
        column = texts.column("text")
        for k, run in _split(key, key2):
            raw = common.utf8(column[place[k]].as_py())
            for r in run:
                p = int(at[r])
                out["left"].append(raw[p - int(before[r]) : p])
                out["right"].append(raw[p + GRAM : p + GRAM + int(after[r])])
            out["key"].append(np.full(len(run), k[0]))
            out["key2"].append(np.full(len(run), k[1]))
            out["at"].append(at[run])
            out["a"].append(a[run].view(np.int64))
            out["status"].append(status[run])
        flat = {n: pa.array(np.concatenate(out[n]) if out[n] else np.zeros(0, t), pa.from_numpy_dtype(t)) for n, t in (("a", np.int64), ("key", np.int64), ("key2", np.int64), ("at", np.int64), ("status", np.int8))}
        return pa.table(flat | {n: pa.array(out[n], pa.binary()) for n in ("left", "right")})

    texts = keyed.select("part", "key", "key2", "text")
    reaches = texts.groupBy("part").cogroup(sifted.groupBy("part")).applyInArrow(fetch, "a long, key long, key2 long, at long, status byte, left binary, right binary")
    reaches = common.stored(reaches, "reaches")
    kinds = {r[0]: r[1] for r in reaches.groupBy((F.col("status") > 2).alias("hot")).count().collect()}
    n_buckets = max(16, -(-kinds.get(False, 0) // BUCKET_REACHES))

    def compare(table: pa.Table) -> pa.Table:
        key, key2, at, a, single = (table.column(n).to_numpy() for n in ("key", "key2", "at", "a", "status"))
        left, right, found = table.column("left"), table.column("right"), []
        for rows in together(a):
            k, before, after = repeats(a[rows], left.take(pa.array(rows)).to_pylist(), right.take(pa.array(rows)).to_pylist(), single[rows] == 1, width)
            k = rows[k]
            found.append(((key[k] % parts).astype(np.int32), key[k], key2[k], at[k] - before, at[k] + GRAM + after))
        return pa.table(dict(zip(("part", "key", "key2", "start", "end"), (np.concatenate(x) for x in zip(*found)))))

    shape = "part int, key long, key2 long, start long, end long"
    near = reaches.where("status < 3").withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(n_buckets)))
    found = near.groupBy("bucket").applyInArrow(compare, shape)
    if kinds.get(True):
        found = found.unionByName(_counted(reaches.where("status > 2"), width, parts, shape))
    return keyed, sifted, found


def _counted(reaches: DataFrame, width: int, parts: int, shape: str) -> DataFrame:
    """Repeats in very large groups: the hash of every string around an anchor, counted wherever it falls."""

    def strings(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lo = r["at"] - len(r["left"])
                raw = r["left"] + b"\0" * GRAM + r["right"]  # the anchor is the group's and goes into the hash by `a`
                h, h2 = (Hashes(np.frombuffer(raw, np.uint8), more).grams(width) if len(raw) >= width else np.zeros(0, np.uint64) for more in (False, True))
                start = lo + np.arange(len(h))
                yield pa.RecordBatch.from_pydict({
                    "a": np.full(len(h), r["a"]), "h": h.view(np.int64), "h2": h2.view(np.int64), "part": np.full(len(h), r["key"] % parts, np.int32),
                    "key": np.full(len(h), r["key"]), "key2": np.full(len(h), r["key2"]), "start": start, "end": start + width, "off": r["at"] - start,
                })

    rows = reaches.mapInArrow(strings, f"a long, h long, h2 long, {shape}, off long")
    twice = rows.groupBy("a", "h", "h2", "off").agg(F.count("*").alias("n")).where("n > 1").select("a", "h", "h2", "off")
    return rows.join(twice, ["a", "h", "h2", "off"], "left_semi").select("part", "key", "key2", "start", "end")


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row; kept is what stays of the text, as bytes."""
    keyed, sifted, found = spans(docs, width)

    def blobs(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part").slice(0, 1), **{n: pa.array([table.column(n).to_numpy().tobytes()], pa.binary()) for n in ("key", "key2", "start", "end")}})

    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    sure = sifted.select("part", *PLACE, "status", *none("start", "end"))
    more = found.groupBy("part").applyInArrow(blobs, "part int, key binary, key2 binary, start binary, end binary")
    covered = sure.unionByName(more.select("part", "key", "key2", *none("at", "left", "right", "a", "status"), "start", "end"))

    def cut(texts: pa.Table, table: pa.Table) -> pa.Table:
        anchored = table.column("status").is_valid()
        columns = _columns(table.filter(anchored), PLACE | {"status": np.int8})
        key, key2, at, left, right = (x[np.isin(columns[6], (0, 2, 4))].astype(np.int64) for x in columns[:5])
        other, other2, start, end = _columns(table.filter(pa.compute.invert(anchored)), {"key": np.int64, "key2": np.int64, "start": np.int64, "end": np.int64})
        starts, ends = np.concatenate((at - left, start)), np.concatenate((at + GRAM + right, end))
        of = dict(_split(np.concatenate((key, other)), np.concatenate((key2, other2))))
        out = {n: [] for n in ("kept", "n_bytes", "n_removed", "n_spans")}
        for k, t in zip(zip(texts.column("key").to_pylist(), texts.column("key2").to_pylist()), texts.column("text")):
            raw = common.utf8(t.as_py())
            run, pieces, done, gone, n = of.get(k), [], 0, 0, 0
            if run is not None:
                s, e = starts[run], np.minimum(ends[run], len(raw))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                fresh = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                for a, b in zip(s[fresh].tolist(), e[np.append(fresh[1:] - 1, len(e) - 1)].tolist()):
                    pieces.append(raw[done:a])
                    gone, n, done = gone + b - a, n + 1, b
            out["kept"].append(b"".join([*pieces, raw[done:]]) if n else raw)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(gone)
            out["n_spans"].append(n)
        return pa.table({"doc_id": texts.column("doc_id"), "kept": pa.array(out["kept"], pa.binary()), **{n: pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")}})

    texts = keyed.select("part", "key", "key2", "doc_id", "text")
    return texts.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes by its md5; two hexadecimal digits stand for a byte.
SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t WHERE length(h) >= 400)),
x AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200 AS fresh FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
n AS (SELECT r, i, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM x),
u AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY r, run),
v AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM u),
k AS (SELECT v.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(t.h, CAST(2 * done + 1 AS BIGINT), CAST(2 * (a - done) AS BIGINT)), '' ORDER BY a) AS front FROM v JOIN t USING (r) GROUP BY v.r)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.front || substring(t.h, CAST(2 * k.last + 1 AS BIGINT)), t.h))) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
