"""Raster operators on scanline tables (image, y, line).

Local operators work on bands of rows with a halo of rows from the bands beside them: a row is sent to
at most three bands, each band is one numpy computation, and bands are independent.  Global ones are
plain aggregations over pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


Taps = Sequence[tuple[int, int]]
#: Rows of a band.
BAND = 256


def rectangle(width: int, height: int, dilation: int = 1) -> list[tuple[int, int]]:
    """Offsets of a rectangle, the centre first, then in raster order; even sizes grow by one."""
    offsets = [(dx * dilation, dy * dilation) for dy in range(-(height // 2), height // 2 + 1) for dx in range(-(width // 2), width // 2 + 1)]
    return [(0, 0)] + [o for o in offsets if o != (0, 0)]


def circle(radius: float) -> list[tuple[int, int]]:
    """Offsets within a radius, nearest first."""
    r = int(radius)
    offsets = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]
    return sorted(offsets, key=lambda o: (o[0] ** 2 + o[1] ** 2, o[1], o[0]))


def stacked(a: np.ndarray, taps: Taps) -> np.ndarray:
    """One layer per tap: the value at that offset, NaN outside."""
    h, w = a.shape
    out = np.full((len(taps), h, w), np.nan)
    for k, (dx, dy) in enumerate(taps):
        ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        if ys.start < ys.stop and xs.start < xs.stop:
            out[k, ys, xs] = a[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero; what differs from a half in its last digits alone counts as one."""
    return np.sign(x) * np.floor(np.round(np.abs(x), 9) + 0.5)


def banded(lines: DataFrame, fn: Callable[[np.ndarray], np.ndarray], halo: int, band: int = BAND) -> DataFrame:
    """fn over each band of rows with `halo` more rows on either side; (image, y, line) of its result.

    Missing rows are NaN.  fn sees the rows from top to bottom and returns as many.
    """
    assert halo <= band
    around = F.array_distinct(F.array(*[F.floor((F.col("y") + d) / band) for d in ((-halo, 0, halo) if halo else (0,))]))
    dealt = lines.select("image", "y", "line", F.explode(around).alias("band"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        image, b = key
        ys = pdf["y"].to_numpy()
        own = (ys >= b * band) & (ys < (b + 1) * band)
        if not own.any():
            return pdf.iloc[:0][["image", "y", "line"]]
        low, width = int(ys.min()), max(map(len, pdf["line"]))
        a = np.full((int(ys.max()) - low + 1, width), np.nan)
        for y, line in zip(ys, pdf["line"]):
            a[y - low, : len(line)] = line
        got = fn(a)
        at = np.sort(ys[own])
        return pd.DataFrame({"image": image, "y": at, "line": [got[y - low].tolist() for y in at]})

    return dealt.groupBy("image", "band").applyInPandas(run, "image string, y long, line array<double>")


def _valid(fn):
    """fn over layers, and NaN where the centre is."""

    def run(layers: np.ndarray, a: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.isnan(a), np.nan, fn(layers))

    return run


def _median(s: np.ndarray) -> np.ndarray:
    n = (~np.isnan(s)).sum(0)
    return np.take_along_axis(np.sort(s, 0), np.minimum(n // 2, len(s) - 1)[None], 0)[0]


def _mode(s: np.ndarray) -> np.ndarray:
    count = np.stack([(s == layer).sum(0) for layer in s])
    count[np.isnan(s)] = -1
    return np.take_along_axis(s, count.argmax(0)[None], 0)[0]


def stencil(lines: DataFrame, taps: Taps, fn: Callable[[np.ndarray], np.ndarray], times: int = 1) -> DataFrame:
    """fn over the layers of `taps` for each pixel."""
    halo = max(abs(dy) for _, dy in taps) * times
    whole = _valid(fn)
    return banded(lines, lambda a: whole(stacked(a, taps), a), halo)


def dilate(lines: DataFrame, taps: Taps) -> DataFrame:
    return stencil(lines, taps, lambda s: np.nanmax(s, 0))


def erode(lines: DataFrame, taps: Taps) -> DataFrame:
    return stencil(lines, taps, lambda s: np.nanmin(s, 0))


def _twice(lines: DataFrame, taps: Taps, first, second) -> DataFrame:
    """Two stencils in one pass, with a halo for both."""
    halo = 2 * max(abs(dy) for _, dy in taps)
    one, two = _valid(first), _valid(second)

    def run(a):
        b = one(stacked(a, taps), a)
        return two(stacked(b, taps), b)

    return banded(lines, run, halo)


def opened(lines: DataFrame, taps: Taps) -> DataFrame:
    """Dilation of the erosion."""
    return _twice(lines, taps, lambda s: np.nanmin(s, 0), lambda s: np.nanmax(s, 0))


def closed(lines: DataFrame, taps: Taps) -> DataFrame:
    """Erosion of the dilation."""
    return _twice(lines, taps, lambda s: np.nanmax(s, 0), lambda s: np.nanmin(s, 0))


def morphological_gradient(lines: DataFrame, taps: Taps) -> DataFrame:
    return stencil(lines, taps, lambda s: np.nanmax(s, 0) - np.nanmin(s, 0))


def mean_filter(lines: DataFrame, taps: Taps) -> DataFrame:
    return stencil(lines, taps, lambda s: rounded(np.nansum(s, 0) / (~np.isnan(s)).sum(0)))


def median_filter(lines: DataFrame, taps: Taps) -> DataFrame:
    """The value number n // 2 of the n valid ones in order."""
    return stencil(lines, taps, _median)


def mode_filter(lines: DataFrame, taps: Taps) -> DataFrame:
    """The most frequent value; the first in the order of taps wins ties."""
    return stencil(lines, taps, _mode)


def linear_filter(lines: DataFrame, taps: Taps, weights: Sequence[float], whole: bool = True) -> DataFrame:
    """The weighted sum over valid taps, rounded unless `whole` is off."""
    w = np.array(weights)[:, None, None]
    return stencil(lines, taps, lambda s: rounded(np.nansum(s * w, 0)) if whole else np.nansum(s * w, 0))


# The horizontal gradient kernel, in raster order.
SOBEL_X = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}


def sobel_x(lines: DataFrame) -> DataFrame:
    return linear_filter(lines, list(SOBEL_X), list(SOBEL_X.values()))


def sobel_y(lines: DataFrame) -> DataFrame:
    return linear_filter(lines, [(y, x) for x, y in SOBEL_X], list(SOBEL_X.values()))


def sobel_magnitude(lines: DataFrame) -> DataFrame:
    """The rounded root of the squared gradients."""
    taps = list(SOBEL_X) + [(y, x) for x, y in SOBEL_X]
    w = np.array(list(SOBEL_X.values()))[:, None, None]
    return stencil(lines, taps, lambda s: rounded(np.sqrt(rounded(np.nansum(s[:6] * w, 0)) ** 2 + rounded(np.nansum(s[6:] * w, 0)) ** 2)))


def gaussian_weights(taps: Taps, stdev: float) -> list[float]:
    w = [float(np.exp(-(dx * dx + dy * dy) / (2 * stdev * stdev))) for dx, dy in taps]
    return [x / sum(w) for x in w]


def gaussian_filter(lines: DataFrame, radius: float, stdev: float) -> DataFrame:
    taps = circle(radius)
    return linear_filter(lines, taps, gaussian_weights(taps, stdev))


def basins(lines: DataFrame, taps: Taps) -> DataFrame:
    """The sum of absolute differences to neighbours, weighted by inverse distance over all taps."""
    ring = [t for t in taps if t != (0, 0)]
    w = np.array([1 / np.hypot(*t) for t in ring])
    w = (w / w.sum())[:, None, None]

    return stencil(lines, [(0, 0), *ring], lambda s: rounded(np.nansum(np.abs(s[1:] - s[0]) * w, 0)))


def local_binary_pattern(lines: DataFrame, taps: Taps) -> DataFrame:
    """Bit i - 1 is set where neighbour i is greater than the centre."""
    return stencil(lines, taps, lambda s: sum(((s[i] > s[0]) * 2.0 ** (i - 1) for i in range(1, len(s))), np.zeros(s.shape[1:])))


def subsample(lines: DataFrame, stride: int) -> DataFrame:
    """Rows and columns whose number is a multiple of `stride`."""
    if stride == 1:
        return lines
    keep = F.transform(F.sequence(F.lit(0), F.size("line") - 1, F.lit(stride)), lambda k: F.col("line")[k])
    return lines.where(F.col("y") % stride == 0).select("image", (F.col("y") / stride).cast("long").alias("y"), keep.alias("line"))


def max_pool(lines: DataFrame, taps: Taps, stride: int = 1) -> DataFrame:
    return subsample(dilate(lines, taps), stride)


def min_pool(lines: DataFrame, taps: Taps, stride: int = 1) -> DataFrame:
    return subsample(erode(lines, taps), stride)


def average_pool(lines: DataFrame, taps: Taps, stride: int = 1) -> DataFrame:
    """The sum over valid taps by the number of all taps, also at borders."""
    return subsample(stencil(lines, taps, lambda s: np.nansum(s, 0) / len(s)), stride)


def power_pool(lines: DataFrame, taps: Taps, alpha: float) -> DataFrame:
    """(sum of v ** alpha) ** (1 / alpha) over the frame; only where the whole frame is valid."""
    return stencil(lines, taps, lambda s: np.where(np.isnan(s).any(0), np.nan, (s**alpha).sum(0) ** (1 / alpha)))


def box_sums(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Sums over boxes that end at each pixel, by running sums along and across rows; 0 where the box leaves the raster."""
    line = F.col("line")
    sums = F.transform(line, lambda v, k: F.aggregate(F.slice(line, F.greatest(F.lit(1), k - width + 2), F.least(F.lit(width), k + 1)), F.lit(0.0), lambda s, x: s + x))
    w = W.partitionBy("image").orderBy("y").rowsBetween(1 - height, 0)
    rows = lines.select("image", "y", sums.alias("s")).withColumn("all", F.collect_list("s").over(w))
    column = F.aggregate("all", F.transform("s", lambda v: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    whole = F.transform(column, lambda v, k: F.when((F.size("all") == height) & (k >= width - 1), v).otherwise(0.0))
    return rows.select("image", "y", whole.alias("line"))


def integral(lines: DataFrame) -> DataFrame:
    """Two-dimensional running sums.  Bands of rows are summed first, so no task sees more than a band of them and the bands' last rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        a = np.cumsum(np.cumsum(np.stack([np.asarray(x, float) for x in pdf["line"]]), 1), 0)
        return pd.DataFrame({"image": pdf["image"].to_numpy(), "y": pdf["y"].to_numpy(), "band": pdf["band"].to_numpy(), "line": list(a), "last": pdf["y"].to_numpy() == pdf["y"].max()})

    own = lines.select("image", "y", "line", F.floor(F.col("y") / BAND).alias("band")).groupBy("image", "band").applyInPandas(run, "image string, y long, band long, line array<double>, last boolean")
    cells = own.select("image", "y", "band", "last", F.posexplode("line").alias("x", "v"))
    totals = cells.where("last").select("image", "band", "x", F.col("v").alias("t"))
    before = totals.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy("image", "x").orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    joined = cells.join(before.select("image", "band", "x", "before"), ["image", "band", "x"])
    return joined.select("image", "x", "y", (F.col("v") + F.col("before")).alias("val"))


def histogram(values: DataFrame, column: str, bins: int, largest: float) -> DataFrame:
    """(bin, n) of non-empty bins: bin = trunc(v / max((largest + 1) / bins, 1))."""
    size = max((largest + 1) / bins, 1.0)
    return values.groupBy((F.col(column) / size).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Running sums of a histogram, as counts and shares; a histogram is small."""
    w = W.orderBy("bin")
    return hist.select("bin", "n", F.sum("n").over(w).alias("acc"), (F.sum("n").over(w) / F.sum("n").over(W.partitionBy())).alias("share"))


def histogram_summary(hist: DataFrame, exclude_zero: bool = False) -> DataFrame:
    """(mode, mean, median): first arg-max, weighted mean, and the last filled bin with at most half of all before it."""
    h = hist.where("bin <> 0") if exclude_zero else hist
    c = h.withColumn("total", F.sum("n").over(W.partitionBy())).withColumn("before", F.sum("n").over(W.orderBy("bin")) - F.col("n"))
    return c.agg(
        F.min_by("bin", F.struct(-F.col("n"), "bin")).alias("mode"),
        (F.sum(F.col("bin") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))).alias("mean"),
        F.max(F.when(F.col("before") <= F.col("total") / 2, F.col("bin"))).alias("median"),
    )


def otsu(hist: DataFrame) -> DataFrame:
    """(threshold): the cut T in 1..max-1 with the largest p1 p2 (m1 - m2)^2 / (p1 s1 + p2 s2), the first of equal ones.

    Values up to T are one side.  Histograms are small: the running moments are one window over their bins.
    """
    w = W.orderBy("bin")
    n, b = F.col("n").cast("double"), F.col("bin").cast("double")
    c = hist.where("n > 0")
    for name, x in (("c", n), ("s", n * b), ("q", n * b * b)):
        c = c.withColumn(f"{name}1", F.sum(x).over(w)).withColumn(f"{name}2", F.sum(x).over(W.partitionBy()) - F.col(f"{name}1"))
    m1, m2 = F.col("s1") / F.col("c1"), F.col("s2") / F.col("c2")
    spread = (F.col("q1") - F.col("s1") * m1) + (F.col("q2") - F.col("s2") * m2)  # (p1 s1 + p2 s2) times the number of values
    all_ = F.col("c1") + F.col("c2")
    # relative to the squares, what is left by rounding is zero
    flat = spread <= 1e-9 * (F.col("q1") + F.col("q2"))
    j = F.when(F.col("c2") <= 0, 0.0).when(flat, float("inf")).otherwise(F.col("c1") * F.col("c2") * (m1 - m2) * (m1 - m2) / (all_ * spread))
    # between two filled bins all cuts are alike, so the first is the lower bin, 1 at least
    return c.withColumn("j", j).agg(F.min_by(F.greatest(F.col("bin"), F.lit(1)), F.struct(-F.round("j", 9), "bin")).alias("threshold"))


def regions(values: DataFrame, label: str, value: str) -> DataFrame:
    """Per label: area, bounding box, integer centroid, mean, population deviation, least and largest value."""
    return values.groupBy(label).agg(
        F.count("*").alias("area"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.floor(F.sum("x") / F.count("*")).alias("cx"), F.floor(F.sum("y") / F.count("*")).alias("cy"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("largest"),
    )


def adjacency(px: DataFrame, label: str = "label") -> DataFrame:
    """(src, dst) of labels that touch in the four directions, src < dst.  Along a row it is array work, across rows one self-join."""
    wide = px.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col(label).alias("l")))).alias("cells"))
    right = wide.select(F.explode(F.zip_with(F.slice("cells", 1, F.greatest(F.size("cells") - 1, F.lit(0))), F.slice("cells", 2, F.size("cells")), lambda a, b: F.struct(a["l"].alias("a"), b["l"].alias("b"), (b["x"] - a["x"]).alias("gap")))).alias("e"))
    right = right.where("e.gap = 1").select("e.a", "e.b").distinct()
    below = px.select("image", "x", (F.col("y") + 1).alias("y"), F.col(label).alias("a")).join(px.select("image", "x", "y", F.col(label).alias("b")), ["image", "x", "y"]).select("a", "b")
    both = right.unionByName(below).where("a <> b")
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def tiles(width: int, height: int, tile: int, stride: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(tile, x0, y0, x1, y1): tumbling tiles, sliding ones for a stride below the size."""
    stride = stride or tile
    spots = [(x, y) for y in range(0, height, stride) for x in range(0, width, stride)]
    return [(k, x, y, min(x + tile, width) - 1, min(y + tile, height) - 1) for k, (x, y) in enumerate(spots)]


def tile_of(x: Column, y: Column, tile: int, per_row: int) -> Column:
    """The number of a pixel's tumbling tile."""
    return F.floor(y / tile) * per_row + F.floor(x / tile)


def flood_components(lines: DataFrame, connect: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of equal values over eight neighbours: (image, y, x, val, component), the component's number being its first pixel in raster order.

    Bands are labelled on their own; seams between bands become edges, and `graphs.components` joins what they connect.
    """
    from .graphs import components

    def label(a: np.ndarray, first: int, width: int) -> np.ndarray:
        h, w = a.shape
        up = np.arange(h * w)

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            ys, xs = slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))
            here, there = a[ys, xs], a[dy:, max(0, dx) : w + min(0, dx)]
            at = np.arange(h * w).reshape(h, w)
            for p, q in zip(at[ys, xs][here == there], at[dy:, max(0, dx) : w + min(0, dx)][here == there]):
                p, q = find(p), find(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
        root = np.array([find(k) for k in range(h * w)]).reshape(h, w)
        return (first + root // w) * width + root % w

    top = lines.agg(F.max(F.size("line"))).first()[0] or 0
    keyed = lines.withColumn("band", F.floor(F.col("y") / BAND))

    def run(key, pdf):
        pdf = pdf.sort_values("y")
        out, ys = [], pdf["y"].to_numpy()
        for part in np.split(np.arange(len(ys)), np.flatnonzero(np.diff(ys) != 1) + 1):
            a = np.full((len(part), top), np.nan)
            for r, k in enumerate(part):
                line = pdf["line"].iloc[k]
                a[r, : len(line)] = line
            got = label(a, int(ys[part[0]]), top)
            out.append(pd.DataFrame({"image": key[0], "y": ys[part], "line": list(a), "label": list(got)}))
        return pd.concat(out)

    part = keyed.groupBy("image", "band").applyInPandas(run, "image string, y long, line array<double>, label array<long>")
    edge = part.where((F.col("y") % BAND).isin(0, BAND - 1))
    low = edge.where(F.col("y") % BAND == BAND - 1).select("image", (F.col("y") + 1).alias("y"), F.col("line").alias("l1"), F.col("label").alias("k1"))
    seam = low.join(edge.where(F.col("y") % BAND == 0), ["image", "y"])
    pairs = None
    for d in (-1, 0, 1):
        e = seam.select("image", F.posexplode(F.arrays_zip("l1", "k1")).alias("x", "a"), "line", "label").select("image", "a", F.try_element_at("line", F.col("x") + 1 + d).alias("v"), F.try_element_at("label", F.col("x") + 1 + d).alias("k"), (F.col("x") + d).alias("x2"))
        e = e.where("x2 >= 0 and v is not null and a.l1 = v").select("image", F.col("a.k1").alias("p"), F.col("k").alias("q"))
        pairs = e if pairs is None else pairs.unionByName(e)
    ids = pairs.select(F.struct("image", "p").alias("src"), F.struct(F.col("image"), F.col("q").alias("p")).alias("dst"))
    comps = components(ids, "src", "dst").select(F.col("node.image").alias("image"), F.col("node.p").alias("label"), F.col("component.p").alias("component"))
    cells = part.select("image", "y", F.posexplode(F.arrays_zip("line", "label")).alias("x", "c")).select("image", "y", "x", F.col("c.line").alias("val"), F.col("c.label").alias("label"))
    return cells.where(~F.isnan("val")).join(comps, ["image", "label"], "left").select("image", "y", "x", "val", F.coalesce("component", "label").alias("component"))


# --- radiometry of pixel tables (x, y, val)


def region_normalised(px: DataFrame, region: Column, low: float, high: float, name: str = "val") -> DataFrame:
    """val to low..high, truncated, by the least and the largest value where `region` is true."""
    ends = px.agg(F.min(F.when(region, F.col("val"))).alias("_lo"), F.max(F.when(region, F.col("val"))).alias("_hi"))
    scaled = (high - low) * (F.col("val") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) + low
    return px.join(F.broadcast(ends)).withColumn(name, F.round(scaled, 9).cast("int")).drop("_lo", "_hi")


def standardised(px: DataFrame, mean: float, stdev: float, largest: int, name: str = "val") -> DataFrame:
    """Values moved to a mean, and as far from it as the root of the ratio of deviations says; truncated, within 0..largest."""
    own = px.agg(F.avg("val").alias("_m"), F.stddev_pop("val").alias("_s"))
    away = F.abs(F.col("val") - F.col("_m")) * F.sqrt(stdev / F.col("_s"))
    moved = F.when(F.col("val") > F.col("_m"), F.least(F.lit(float(largest)), mean + away)).otherwise(F.greatest(F.lit(0.0), mean - away))
    return px.join(F.broadcast(own)).withColumn(name, F.round(moved, 6).cast("int")).drop("_m", "_s")


def _shares(px: DataFrame) -> pd.DataFrame:
    """(val, acc) of integer values: the share of pixels up to each; as many rows as grey levels, at most 65,536."""
    got = px.groupBy("val").agg(F.count("*").alias("n")).orderBy("val").limit(65_537).toPandas()
    if len(got) > 65_536:
        raise ValueError("more than 65,536 grey levels")
    got["acc"] = got["n"].cumsum() / max(1, got["n"].sum())
    return got[["val", "acc"]]


def without_outliers(px: DataFrame, low: int, high: int, share: float) -> DataFrame:
    """Integer values to low..high by the least value and the first one above `share` of the pixels; larger ones to high."""
    levels = _shares(px)
    if levels.empty:
        return px
    above = levels[levels["acc"] > share]["val"]
    first, top = int(levels["val"].iloc[0]), int(above.iloc[0] if len(above) else levels["val"].iloc[-1])
    scaled = F.round((high - low) * (F.col("val") - first) / float(max(1, top - first)) + low, 9).cast("long")
    return px.withColumn("val", F.when(F.col("val") <= top, scaled).otherwise(F.lit(high).cast("long")))


def histogram_matched(px: DataFrame, reference: DataFrame) -> DataFrame:
    """Each integer value becomes the reference's value whose share of pixels up to it is nearest; the lesser of equal ones."""
    own, other = _shares(px), _shares(reference)
    if own.empty or other.empty:
        return px
    acc, values = other["acc"].to_numpy(), other["val"].to_numpy()
    right = np.clip(np.searchsorted(acc, own["acc"].to_numpy()), 0, len(acc) - 1)
    left = np.maximum(right - 1, 0)
    gap = lambda k: np.round(np.abs(acc[k] - own["acc"].to_numpy()), 12)
    to = np.where(gap(left) <= gap(right), values[left], values[right])
    table = px.sparkSession.createDataFrame(pd.DataFrame({"val": own["val"].astype("int64"), "to": to.astype("int64")}))
    return px.withColumn("val", F.col("val").cast("long")).join(F.broadcast(table), "val").withColumn("val", F.col("to")).drop("to")


def equalised(px: DataFrame, levels: int) -> DataFrame:
    """The rank of each pixel, by value, row and column, over the size of one of `levels` equal buckets.

    Ranks are added up from counts of values, of rows within a value, and places within a row, so that no task holds more than a row.
    """
    n = px.count()
    size = max(1, n // levels)
    rows = px.groupBy("val", "y").agg(F.count("*").alias("n"))
    by_value = rows.groupBy("val").agg(F.sum("n").alias("n"))
    before = by_value.withColumn("b", F.sum("n").over(W.orderBy("val")) - F.col("n")).drop("n")
    rows = rows.withColumn("r", F.sum("n").over(W.partitionBy("val").orderBy("y")) - F.col("n")).drop("n")
    at = F.row_number().over(W.partitionBy("val", "y").orderBy("x")) - 1
    ranked = px.withColumn("at", at).join(rows, ["val", "y"]).join(before, "val")
    return ranked.withColumn("val", F.floor((F.col("at") + F.col("r") + F.col("b")) / size)).drop("at", "r", "b")
