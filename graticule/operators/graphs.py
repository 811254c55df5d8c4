"""Graph operators on edge tables: components, spanning forests, pooling over neighbours, seed votes, optimum paths."""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; where that is unset in an own one, if all runs on this machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graticule-"))
    return df.checkpoint()


#: Edges that one task contracts to stars before the rounds.
CONTRACT = 500_000


def _stars(batches):
    """The edges of a partition (hi, lo) as stars around the least node of each part that they connect."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    both = pd.concat(frames)
    ids, at = np.unique(both.to_numpy().ravel(), return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:  # each node takes the least label among its neighbours, then labels are followed to their ends
        new = root.copy()
        np.minimum.at(new, at[:, 0], root[at[:, 1]])
        np.minimum.at(new, at[:, 1], root[at[:, 0]])
        np.minimum.at(new, root[at[:, 0]], new[at[:, 0]])
        np.minimum.at(new, root[at[:, 1]], new[at[:, 1]])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    on = root != np.arange(len(ids))
    yield pd.DataFrame({"hi": ids[on], "lo": ids[root[on]]})


def components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.

    Where nodes are numbers, what a partition's edges connect becomes a star first, so that no more edges than nodes of a partition go on.  Then large and small
    stars in turn: each node's larger neighbours are hung on its least one, then
    its smaller ones, until nothing changes; a logarithmic number of rounds, two joins each.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = cut_lineage(e.distinct())
    loops = e.where("hi = lo").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    e, last = e.where("hi <> lo"), None
    n = e.count() if dict(e.dtypes)["hi"] == "bigint" else 0
    if n:
        e = cut_lineage(e.coalesce(max(1, -(-n // CONTRACT))).mapInPandas(_stars, "hi long, lo long").distinct())
    for _ in range(rounds):
        h = F.xxhash64("hi", "lo")
        now = tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 34))).first())
        if now == last or not now[0]:
            break
        last = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        e = cut_lineage(small.where("hi <> lo").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    found = e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
    # nodes of loops alone
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def marker_components(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, component) of seeds, connected through edges between seeds whatever their labels."""
    own = seeds.select("node").distinct()
    inside = edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = components(inside.select("src", "dst"))
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def spanning_forest(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The minimum spanning forest (src, dst, w): in each round every component takes its cheapest edge outwards, ties by (src, dst)."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src <> dst")
    e = cut_lineage(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    tree, owner = None, None
    for _ in range(rounds):
        if owner is None:
            open_ = e.withColumn("cu", F.col("src")).withColumn("cv", F.col("dst"))
        else:
            own = owner.withColumnRenamed("node", "n")
            open_ = e.join(own.select(F.col("n").alias("src"), F.col("component").alias("cu")), "src").join(own.select(F.col("n").alias("dst"), F.col("component").alias("cv")), "dst").where("cu <> cv")
        ends = open_.select("src", "dst", "w", F.explode(F.array("cu", "cv")).alias("c"))
        best = ends.groupBy("c").agg(F.min(F.struct("w", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.w").distinct()
        best = cut_lineage(best)
        if not best.limit(1).count():
            break
        tree = best if tree is None else cut_lineage(tree.unionByName(best))
        owner = cut_lineage(components(tree))
    return e.limit(0) if tree is None else tree.select("src", "dst", "w")


def pooled(activation: DataFrame, neighbours: DataFrame, size: int) -> DataFrame:
    """(node, avg, max) over neighbours (node, neighbour, the node itself not among them).

    The average is of the node and its neighbours by `size`, whatever their number; the maximum leaves out the node and is
    -infinity without neighbours.
    """
    joined = neighbours.join(activation.withColumnRenamed("node", "neighbour").withColumnRenamed("v", "nv"), "neighbour")
    sums = joined.groupBy("node").agg(F.sum("nv").alias("s"), F.max("nv").alias("m"))
    got = activation.join(sums, "node", "left")
    return got.select("node", ((F.col("v") + F.coalesce("s", F.lit(0.0))) / size).alias("avg"), F.coalesce("m", F.lit(float("-inf"))).alias("max"))


def seed_votes(seeds: DataFrame, region: str = "region", label: str = "label") -> DataFrame:
    """Per region 1 where more of its seeds are labelled 1 than not, else 0 (ties too)."""
    fg = F.sum(F.when(F.col(label) == 1, 1).otherwise(-1))
    return seeds.groupBy(region).agg((fg > 0).cast("int").alias("vote"))


def ring_neighbours(nodes: DataFrame, edges: DataFrame, k: int, dilation: int = 1) -> DataFrame:
    """(graph_id, node, rank, neighbour): each node's k nearest in feature space along the graph, itself first.

    Rings are expanded from what the last ring kept: of a ring's nodes, as many as still lack are kept, the nearest to the origin
    by squared distance, then by number; rings before a multiple of `dilation` are only stepped over.
    One task per graph: the search is sequential within one.
    """

    def run(key, nd: pd.DataFrame, ed: pd.DataFrame) -> pd.DataFrame:
        feat = {int(n): np.array(f, float) for n, f in zip(nd["node"], nd["feat"])}
        around: dict[int, set[int]] = {n: set() for n in feat}
        for s, d in zip(ed["src"], ed["dst"]):
            if int(s) in around and int(d) in feat and s != d:
                around[int(s)].add(int(d))
        rows = []
        for origin, f in feat.items():
            kept, seen, front, ring = [(0.0, origin)], {origin}, [origin], 0
            while front and len(kept) < k:
                ring += 1
                found = sorted((float(((feat[q] - f) ** 2).sum()), q) for q in {q for p in front for q in around[p]} - seen)
                if ring % dilation:
                    front = [q for _, q in found]
                    seen.update(front)
                    continue
                best = found[: k - len(kept)]
                kept += best
                front = [q for _, q in best]
                seen.update(front)
            rows += [(key[0], origin, r, q) for r, (_, q) in enumerate(sorted(kept, key=lambda x: (x[1] != origin, x)))]
        return pd.DataFrame(rows, columns=["graph_id", "node", "rank", "neighbour"])

    return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, "graph_id string, node long, rank int, neighbour long")


def watershed(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(graph_id, node, label, cost): seeds compete for nodes along paths whose cost is their largest arc (difference of feature vectors).

    One task per graph; ties go to the seed reached first, then to the smaller node.
    """
    tagged = nodes.join(seeds.select("graph_id", "node", "label"), ["graph_id", "node"], "left")

    def run(key, nd: pd.DataFrame, ed: pd.DataFrame) -> pd.DataFrame:
        feat = {int(n): np.array(f, float) for n, f in zip(nd["node"], nd["feat"])}
        label = {int(n): int(x) for n, x in zip(nd["node"], nd["label"]) if x == x and x is not None}
        around: dict[int, list[int]] = {n: [] for n in feat}
        for s, d in zip(ed["src"], ed["dst"]):
            around[int(s)].append(int(d))
        cost, heap, done, turn = {n: 0.0 for n in label}, [(0.0, i, n) for i, n in enumerate(sorted(label))], set(), len(label)
        heapq.heapify(heap)
        while heap:
            c, _, p = heapq.heappop(heap)
            if p in done:
                continue
            done.add(p)
            for q in sorted(around[p]):
                new = max(c, float(np.sqrt(((feat[p] - feat[q]) ** 2).sum())))
                if q not in done and new < cost.get(q, np.inf):
                    cost[q], label[q], turn = new, label[p], turn + 1
                    heapq.heappush(heap, (new, turn, q))
        rows = [(key[0], n, label.get(n), cost.get(n)) for n in feat]
        return pd.DataFrame(rows, columns=["graph_id", "node", "label", "cost"]).astype({"label": "Int64"})

    return tagged.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, "graph_id string, node long, label long, cost double")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def sorted_arcs(arcs: DataFrame, weight: str = "w") -> DataFrame:
    """Each source's arcs numbered by weight."""
    return arcs.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(weight, "dst")))
