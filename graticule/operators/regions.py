"""Features of labelled regions and nodes of region graphs: moments, histograms, orientations, edits of graphs, pixels and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import by_maximum


def moments(px: DataFrame, bands: list[Column], by: str = "label") -> DataFrame:
    """(by, feat, size): mean, deviation and signed cube root of the third moment of each band over a region, and the region's share of all pixels."""
    parts = []
    for b in bands:
        parts += [F.avg(b), F.stddev_pop(b), F.signum(F.skewness(b)) * F.pow(F.abs(F.coalesce(F.skewness(b), F.lit(0.0))), F.lit(1 / 3)) * F.stddev_pop(b)]
    total = px.agg(F.count("*").alias("_all"))
    own = px.groupBy(by).agg(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]).alias("feat"), F.count("*").alias("_n"))
    return own.join(F.broadcast(total)).select(by, "feat", (F.col("_n") / F.col("_all")).alias("size"))


def mean_deviation_size(px: DataFrame, bands: list[Column], by: str = "label") -> DataFrame:
    """(by, feat): mean and deviation of each band over a region, and its share of all pixels."""
    total = px.agg(F.count("*").alias("_all"))
    own = px.groupBy(by).agg(F.array(*[f(b) for b in bands for f in (F.avg, F.stddev_pop)]).alias("feat"), F.count("*").alias("_n"))
    return own.join(F.broadcast(total)).select(by, F.concat("feat", F.array(F.col("_n") / F.col("_all"))).alias("feat"))


def histograms(px: DataFrame, bands: list[Column], bins: int, low: list[float], high: list[float], by: str = "label") -> DataFrame:
    """(by, bin, share): each region's shares in joint bins of its bands, numbered with the first band first."""
    bin_ = F.lit(0)
    for k, (b, lo, hi) in enumerate(zip(bands, low, high)):
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((b - lo) / ((hi - lo) / bins))))
        bin_ = bin_ + at * bins**k
    own = px.groupBy(by, bin_.cast("long").alias("bin")).agg(F.count("*").alias("_n"))
    size = px.groupBy(by).agg(F.count("*").alias("_all"))
    return own.join(size, by).select(by, "bin", (F.col("_n") / F.col("_all")).alias("share"))


def border_interior(px: DataFrame, bin_: Column, by: str = "label") -> DataFrame:
    """(by, bin, border, interior): a region's pixels (x, y) by bin, those with a neighbour on one of four sides that has another bin, and the others."""
    own = px.select(by, "x", "y", bin_.alias("bin"))
    sides = own.select(by, "bin", "x", "y", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s"))
    other = own.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("bin").alias("_b"))
    seen = sides.select(by, "bin", "x", "y", F.col("s.x").alias("_x"), F.col("s.y").alias("_y")).join(other, ["_x", "_y"], "left")
    per = seen.groupBy(by, "bin", "x", "y").agg(F.max(F.coalesce(F.col("_b") != F.col("bin"), F.lit(False))).alias("on"))
    return per.groupBy(by, "bin").agg(F.count_if("on").alias("border"), F.count_if(~F.col("on")).alias("interior"))


def oriented_gradients(lines: DataFrame, cell: int = 8, bins: int = 9) -> DataFrame:
    """(image, cy, cx, feat): sums of gradient lengths by orientation over cells, at length one over 2 x 2 cells; one image to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack([np.asarray(x, float) for x in pdf.sort_values("y")["line"]])
        gy, gx = np.gradient(a) if min(a.shape) > 1 else (np.zeros_like(a), np.zeros_like(a))
        size, turn = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi)
        at = np.minimum((turn / np.pi * bins).astype(int), bins - 1)
        ny, nx = a.shape[0] // cell, a.shape[1] // cell
        h = np.zeros((ny, nx, bins))
        for y in range(ny):
            for x in range(nx):
                box = slice(y * cell, (y + 1) * cell), slice(x * cell, (x + 1) * cell)
                h[y, x] = np.bincount(at[box].ravel(), size[box].ravel(), bins)
        out = []
        for y in range(max(0, ny - 1)):
            for x in range(max(0, nx - 1)):
                f = h[y : y + 2, x : x + 2].ravel()
                out.append((pdf["image"].iloc[0], y, x, (f / max(1e-7, float(np.sqrt(f @ f)))).tolist()))
        return pd.DataFrame(out, columns=["image", "cy", "cx", "feat"])

    return lines.select("image", "y", "line").groupBy("image").applyInPandas(run, "image string, cy int, cx int, feat array<double>")


def brightness(lines: DataFrame) -> DataFrame:
    """(image, feat): all values of an image, row by row, over the largest one."""
    rows = lines.groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"])).alias("feat"))
    return rows.select("image", by_maximum(F.col("feat")).alias("feat"))


# --- region graphs: nodes (graph_id, node, num_pixels, feat), edges (graph_id, src, dst), both ways


def with_node(nodes: DataFrame, edges: DataFrame, node: DataFrame, neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with more nodes, and with edges both ways to neighbours (graph_id, src, dst)."""
    both = neighbours.unionByName(neighbours.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes.unionByName(node), edges.unionByName(both).distinct()


def without_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes (graph_id, node) and their edges."""
    left = nodes.join(gone, ["graph_id", "node"], "left_anti")
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("node", end), ["graph_id", end], "left_anti")
    return left, kept.select(edges.columns)


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, fault) of edges to nodes that are not there, of loops, and of edges that lead one way only."""
    own = nodes.select("graph_id", F.col("node").alias("n")).distinct()
    there = lambda end: own.select("graph_id", F.col("n").alias(end), F.lit(True).alias(f"_{end}"))
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_back")).distinct()
    got = edges.join(there("src"), ["graph_id", "src"], "left").join(there("dst"), ["graph_id", "dst"], "left").join(back, ["graph_id", "src", "dst"], "left")
    fault = F.when(F.col("src") == F.col("dst"), "loop").when(F.col("_src").isNull() | F.col("_dst").isNull(), "no node").when(F.col("_back").isNull(), "one way")
    return got.select("graph_id", "src", "dst", fault.alias("fault")).where("fault is not null")


def on_pixels(nodes: DataFrame, px: DataFrame) -> DataFrame:
    """(graph_id, x, y, feat): each pixel (graph_id, x, y, label) with the features of its node."""
    return px.join(nodes.select("graph_id", F.col("node").alias("label"), "feat"), ["graph_id", "label"]).select("graph_id", "x", "y", "feat")


def disjoint_sets(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """(element, root): sets of elements after pairs (a, b) have been joined; the root is the least element."""
    from .graphs import components

    found = components(pairs, "a", "b")
    return elements.select("element").distinct().join(found.withColumnRenamed("node", "element"), "element", "left").select("element", F.coalesce("component", "element").alias("root"))


def in_files(lines: DataFrame, text: str) -> DataFrame:
    """(path, found) of lines of files (path, value): whether any of them holds a text."""
    return lines.groupBy("path").agg(F.max(F.contains("value", F.lit(text))).alias("found"))
