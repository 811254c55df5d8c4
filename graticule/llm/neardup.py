"""One document of each group of near copies, by SimHash candidates and exact similarity.

Texts are equal if their lower-cased words are.  Each distinct text gets several 64-bit fingerprints of its set of shingles.
Fingerprints within `radius` bits in one lane (see `simhash`) and `limit` bits in that and the next one are candidates; what they
connect is a cluster.  Within a cluster the sets of shingles decide: pairs of a Jaccard similarity of at least `least` are linked,
and components of links are groups.  A cluster is compared in one task, or, if it is large, in blocks that meet two at a time; no
pairs are written but the links of a spanning forest.  Fingerprints are random: two texts right at a similarity of 0.8 are
within 11 bits of 64 in about three lanes of four.

Edge cases: null and empty texts are equal to one another; rows without an id belong to no group and stay; of repeated rows of an
id and a text one stays, and rows of one id with different texts are documents of their own; of a group the row with the smallest id, then the smallest hash of
its words, stays; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common
from .simhash import links

LANES = 3
#: Bytes of shingles, and texts, that one side of a comparison holds.
PART_BYTES, PART_ROWS = 8 << 20, 2000
#: Bits in all lanes together beyond which sets are not compared: at a similarity of 0.8 about 29 of 192 differ, with a deviation of 5.
FAR = 64
#: Columns of shingles that are multiplied at a time.
COLUMNS = 2048


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The XXH64 hash of every shingle of `size` words, of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of their own for each fingerprint (a splitmix step)."""
    if lane:
        h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def _sketch(h: np.ndarray) -> list[int]:
    out = []
    for lane in range(LANES):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(_lane(h[at : at + (1 << 16)], lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return out


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, fp0, ...): key is a 128-bit hash of the words."""

    def run(batches):
        for batch in batches:
            keys, fps = [], []
            for t in batch.column(1):
                words = common.space_words(common.utf8(t.as_py()).lower())
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fps.append(_sketch(np.unique(shingle_hashes(words, size))))
            lanes = np.array(fps, np.int64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(lanes[:, k])) for k in range(LANES))], names=["doc_id", "key", *(f"fp{k}" for k in range(LANES))])

    shape = "doc_id long, key binary, " + ", ".join(f"fp{k} long" for k in range(LANES))
    return common.stored(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, shape), "signatures")


def candidates(nodes: DataFrame, radius: int, limit: int) -> DataFrame:
    """(a, b): pairs of nodes (node, fp0, ...) that connect all within `radius` bits in a lane and `limit` bits in that and the next one.

    One lane is worked out after the other, so that the driver and the disk hold the stages and shuffles of one at a time.
    """
    found = None
    for lane in range(LANES):
        more = f"fp{(lane + 1) % LANES}"
        own = nodes.select("node", F.col(f"fp{lane}").alias("fp"), F.col(more).alias("more"))
        fps = common.checkpointed(own.groupBy("fp", "more").agg(F.min("node").alias("node")))
        pairs = links(fps, radius, ("more",), limit, "node").select(F.col("a").alias("x"), F.col("b").alias("y"))
        same = own.join(fps.withColumnRenamed("node", "least"), ["fp", "more"]).where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y"))
        pairs = common.checkpointed(pairs.unionByName(same))
        del own, fps, same
        common.settle(nodes.sparkSession)
        found = pairs if found is None else found.unionByName(pairs)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of all lanes differ, for all rows of x and y."""
    total = np.zeros((len(x), len(y)), np.uint8)
    for lane in range(x.shape[1]):
        total += np.bitwise_count(x[:, lane][:, None] ^ y[:, lane][None])
    return total


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    return int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)) if len(s) else 0


def _products(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Each set's elements that others have too, numbered, as (element number, set); and how many there are."""
    flat = np.concatenate([sets[k] for k in np.union1d(left, right)])
    owner = np.repeat(np.union1d(left, right), [len(sets[k]) for k in np.union1d(left, right)])
    names, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    rank = np.cumsum(several) - 1
    on = several[number]
    order = np.argsort(rank[number[on]], kind="stable")
    return np.stack((rank[number[on]][order], owner[on][order])), int(several.sum())


def linked(sets: list[np.ndarray], fps: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between some sets and others; left and right are the same, or have none in common."""
    size = np.array([len(s) for s in sets], np.float64)
    same = len(left) == len(right) and (left == right).all()
    forest, out = common.Forest(len(sets)), []

    def near():
        found = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            w = _far(fps[rows], fps[right])
            on = (w <= FAR) & (np.minimum(size[rows][:, None], size[right]) >= least * np.maximum(size[rows][:, None], size[right])) & (size[right] > 0)
            if same:
                on &= right[None] > rows[:, None]
            i, j = np.nonzero(on)
            found.append((rows[i], right[j], w[i, j]))
        return [np.concatenate(x) for x in zip(*found)]

    def look(pairs) -> None:
        for i, j in pairs:
            if forest.find(i) != forest.find(j):
                both = _common(sets[i], sets[j])
                if both >= least * (size[i] + size[j] - both):
                    forest.join(i, j)
                    out.append((i, j))

    i, j, w = near()
    order = np.argsort(w, kind="stable")
    i, j = i[order], j[order]
    # the nearest pair of each set first, then all pairs whose ends are still apart
    first = np.zeros(len(i), bool)
    first[np.unique(i, return_index=True)[1]] = True
    first[np.unique(j, return_index=True)[1]] = True
    look(zip(i[first].tolist(), j[first].tolist()))
    root = np.array([forest.find(k) for k in range(len(sets))])
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    if len(i) < 4 * (len(left) + len(right)):
        look(zip(i.tolist(), j.tolist()))
        return out
    (column, owner), columns = _products(sets, left, right)
    if len(i) * size.mean() * 40e-9 < len(left) * len(right) * columns * 1e-10:
        look(zip(i.tolist(), j.tolist()))
        return out
    both = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, place in ((x, place_l), (y, place_r)):
            on = place[owner[a:b]] >= 0
            m[place[owner[a:b]][on], column[a:b][on] - at] = 1
        both += x @ y.T
    hit = both >= least * (size[left][:, None] + size[right][None] - both)
    on = hit[place_l[i], place_r[j]]
    i, j = i[on], j[on]
    # links of the parts found so far; each pass joins a part with one that it links to
    while len(i):
        _, first = np.unique(root[i], return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            if forest.join(x, y):
                out.append((x, y))
        root = np.array([forest.find(k) for k in range(len(sets))])
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return out


def _clustered(docs: DataFrame, own: DataFrame, nodes: DataFrame, comps: DataFrame, size: int) -> DataFrame:
    """(cluster, node, fp0, ..., shingles) of all nodes that are candidates: their sets as sorted 64-bit hashes."""
    named = nodes.join(comps.withColumnRenamed("component", "cluster"), "node")
    ids = named.select("least").distinct().withColumnRenamed("least", "doc_id")

    def run(batches):
        for batch in batches:
            for part in common.small_slices(batch):
                keys, sets = [], []
                for t in part.column(0):
                    words = common.space_words(common.utf8(t.as_py()).lower())
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sets.append(np.unique(shingle_hashes(words, size)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    sets = docs.join(ids, "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key binary, shingles binary")
    lanes = [f"fp{k}" for k in range(LANES)]
    found = sets.join(named.select("key", "cluster", "node", *lanes), "key").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cluster", *lanes, "shingles")))
    return common.stored(found.select("cluster", "node", *lanes, "shingles"), "shingles")


def verified(table: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of nodes that connect all pairs within a cluster whose sets are similar; table: (cluster, node, fp0, ..., shingles)."""
    lanes = [f"fp{k}" for k in range(LANES)]
    volume = F.sum(F.octet_length("shingles"))
    sizes = table.groupBy("cluster").agg(volume.alias("bytes"), F.count("*").alias("rows"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("bytes") / PART_BYTES), F.ceil(F.col("rows") / PART_ROWS)))
    sizes = common.checkpointed(sizes.select("cluster", "bytes", "parts"))
    total = sizes.where("parts = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(16, -(-total // PART_BYTES))
    large = sizes.where("parts > 1").select("cluster", "parts")
    dealt = table.join(large, "cluster", "left_anti").select(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("side"), "cluster", "node", *lanes, "shingles")
    if large.limit(1).count():
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        cut = table.join(large, "cluster").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        # a bucket of its own for each two blocks; negative, so that none is one of the others
        name = -F.lit(1) - F.shiftrightunsigned(F.xxhash64("cluster", low, high), 2)
        cut = cut.select(name.alias("bucket"), F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"), F.xxhash64("cluster", low, high).alias("cluster"), "node", *lanes, "shingles")
        dealt = dealt.unionByName(cut)

    def run(rows: pa.Table) -> pa.Table:
        cluster, side, node = (rows.column(c).to_numpy() for c in ("cluster", "side", "node"))
        fps = np.stack([rows.column(c).to_numpy() for c in lanes], 1).view(np.uint64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
        order = np.argsort(cluster, kind="stable")
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            own = [sets[k] for k in at]
            left, right = np.flatnonzero(side[at] < 2), np.flatnonzero(side[at] != 1)
            if len(left) and len(right):
                found += [(node[at[x]], node[at[y]]) for x, y in linked(own, fps[at], left, right, least)]
        e = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": np.ascontiguousarray(e[:, 0]), "b": np.ascontiguousarray(e[:, 1])})

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 11, limit: int = 30) -> DataFrame:
    """(doc_id, key, group) for every row with an id; key is a hash of its words, group is one of the near copies' group, the smallest doc_id of one text in it."""
    own = _signatures(docs, size)
    nodes = own.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(f"fp{k}").alias(f"fp{k}") for k in range(LANES)))
    nodes = common.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    clusters = common.checkpointed(common.connected_components(common.checkpointed(candidates(nodes, radius, limit)), contract=True))
    common.settle(docs.sparkSession)
    links_ = common.checkpointed(verified(_clustered(docs, own, nodes, clusters, size), least))
    del clusters
    common.settle(docs.sparkSession)
    comps = common.connected_components(links_, contract=True)
    common.settle(docs.sparkSession)
    named = nodes.join(comps, "node", "left").select("key", F.coalesce("component", "node").alias("group"))
    return own.select("doc_id", "key").join(named, "key")


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 11, limit: int = 30) -> DataFrame:
    """The rows of `docs` with all their columns: one of each group, the one with the smallest id, then the smallest key."""
    found = groups(docs, size, least, radius, limit)
    kept = found.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("k")).select("k.doc_id", "k.key")
    kept = common.checkpointed(kept)
    # ids of several rows need their texts looked at again
    several = common.checkpointed(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    keep = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    if several.limit(1).count():
        at, columns = docs.columns.index("text"), docs.columns

        def keyed(batches):
            for batch in batches:
                keys = [xxhash.xxh3_128_digest(b" ".join(common.space_words(common.utf8(t.as_py()).lower()))) for t in batch.column(at)]
                yield batch.append_column(name, pa.array(keys, pa.binary()))

        name = "key"
        while name in columns:
            name += "_"
        rows = keep.join(several, "doc_id", "left_semi").select(columns)
        rows = rows.mapInArrow(keyed, StructType([*rows.schema.fields, StructField(name, BinaryType())])).join(kept.withColumnRenamed("key", name), ["doc_id", name], "left_semi")
        # partial aggregates keep one row of each id and text, however many there are
        one = rows.groupBy("doc_id", name).agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("r")).select("r.*")
        keep = keep.join(several, "doc_id", "left_anti").select(columns).unionByName(one)
    return keep.unionByName(docs.where("doc_id is null"))
