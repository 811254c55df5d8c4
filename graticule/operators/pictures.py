"""Operators that see a whole image at once: distance transforms, reconstruction, extrema, attribute openings, superpixels, spectra, descriptors.

An image is the unit of parallelism: these are sequential or global within one, so a task holds one image, and images
spread over tasks.  Scanline tables go in and come out; missing pixels are NaN and stay so.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import stacked

RING4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]
RING8 = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def per_image(lines: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn over each image as a matrix; (image, y, line) of its result, row by row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        a = np.full((len(pdf), max(map(len, pdf["line"]))), np.nan)
        for r, line in enumerate(pdf["line"]):
            a[r, : len(line)] = line
        got = np.asarray(fn(a), float)
        return pd.DataFrame({"image": pdf["image"].to_numpy(), "y": pdf["y"].to_numpy(), "line": list(got)})

    return lines.select("image", "y", "line").groupBy("image").applyInPandas(run, "image string, y long, line array<double>")


def _squared_distances(a: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest zero: along columns by two sweeps, along rows by trying every offset that can still be nearer."""
    h, w = a.shape
    far = float((h + w) ** 2)
    column = np.where(a == 0, 0.0, np.inf)
    for y in range(1, h):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    column = np.where(np.isinf(column), far, column**2)
    out = column.copy()
    for d in range(1, w):
        if d * d >= out.max():
            break
        out[:, d:] = np.minimum(out[:, d:], column[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], column[:, d:] + d * d)
    return np.where(out >= far, np.inf, out)


def distance_transform(lines: DataFrame) -> DataFrame:
    """Of every non-zero pixel the squared distance to the nearest zero one; infinity without any."""
    return per_image(lines, _squared_distances)


def _reconstruct(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The marker raised below the mask (or the other way round, with signs turned) until nothing changes."""
    out = np.minimum(marker, mask)
    while True:
        grown = np.fmin(np.nanmax(stacked(out, [(0, 0), *RING4]), 0), mask)
        if np.array_equal(grown, out, equal_nan=True):
            return out
        out = grown


def reconstruct_by_dilation(lines: DataFrame, drop: float) -> DataFrame:
    """Of an image lowered by `drop`, its reconstruction under the image: peaks lower than that go."""
    return per_image(lines, lambda a: _reconstruct(a - drop, a))


def reconstruct_by_erosion(lines: DataFrame, rise: float) -> DataFrame:
    """Of an image raised by `rise`, its reconstruction above the image: basins shallower than that fill."""
    return per_image(lines, lambda a: -_reconstruct(-a - rise, -a))


def closed_holes(lines: DataFrame) -> DataFrame:
    """Basins that do not reach the border are filled."""

    def run(a: np.ndarray) -> np.ndarray:
        marker = np.full_like(a, np.nanmax(a))
        marker[0], marker[-1], marker[:, 0], marker[:, -1] = a[0], a[-1], a[:, 0], a[:, -1]
        return -_reconstruct(-marker, -a)

    return per_image(lines, run)


def _plateaus(a: np.ndarray, ring) -> np.ndarray:
    """A number for each connected plateau of equal values."""
    h, w = a.shape
    label = np.full((h, w), -1)
    n = 0
    for start in zip(*np.nonzero(~np.isnan(a))):
        if label[start] >= 0:
            continue
        stack = [start]
        label[start] = n
        while stack:
            y, x = stack.pop()
            for dx, dy in ring:
                p, q = y + dy, x + dx
                if 0 <= p < h and 0 <= q < w and label[p, q] < 0 and a[p, q] == a[y, x]:
                    label[p, q] = n
                    stack.append((p, q))
        n += 1
    return label


def regional_maxima(lines: DataFrame) -> DataFrame:
    """1 on plateaus without a higher neighbour, else 0."""

    def run(a: np.ndarray) -> np.ndarray:
        label = _plateaus(a, RING8)
        with np.errstate(invalid="ignore"):
            higher = (stacked(a, RING8) > a).any(0)
        spoiled = np.unique(label[higher])
        return np.where(np.isnan(a), np.nan, ~np.isin(label, spoiled))

    return per_image(lines, run)


def regional_minima(lines: DataFrame) -> DataFrame:
    return regional_maxima(lines.withColumn("line", F.transform("line", lambda v: -v)))


def area_opening(lines: DataFrame, area: int) -> DataFrame:
    """Bright parts of fewer than `area` pixels sink to the level at which they have as many: a component tree, built from the brightest pixel down."""

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        flat = a.ravel()
        order = [k for k in np.argsort(-flat, kind="stable") if flat[k] == flat[k]]
        up, size, level, seen = list(range(h * w)), [0] * (h * w), flat.copy(), [False] * (h * w)

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        parent = list(range(h * w))
        for k in order:
            seen[k], size[k] = True, 1
            for dx, dy in RING4:
                y, x = k // w + dy, k % w + dx
                if 0 <= y < h and 0 <= x < w and seen[y * w + x]:
                    r = find(y * w + x)
                    if r != k:
                        up[r], parent[r] = k, k
                        size[k] += size[r]
        for k in reversed(order):
            p = parent[k]
            # the last pixel of a level stands for its whole part
            level[k] = level[p] if flat[p] == flat[k] and p != k else flat[k] if size[k] >= area or p == k else level[p]
        return level.reshape(h, w)

    return per_image(lines, run)


def superpixels(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Superpixel labels from 1 by iterated forests.

    Seeds on a grid of about `first`; each round trees compete for pixels along paths whose cost is the largest difference of a
    pixel to the running mean of the tree; of n seeds max(n * (1 - last / first), last) stay, those of
    the largest area times least difference to a neighbouring tree, until a round has started with `last` or fewer.
    """

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        step = max(1, int(np.sqrt(h * w / max(first, 1))))
        seeds = [(y, x) for y in range(step // 2, h, step) for x in range(step // 2, w, step) if a[y, x] == a[y, x]]
        while seeds:
            n = len(seeds)
            label, cost = np.zeros((h, w), int), np.full((h, w), np.inf)
            total, count, heap, done, beside = [0.0] * (n + 1), [0] * (n + 1), [], np.zeros((h, w), bool), [set() for _ in range(n + 1)]
            for k, (y, x) in enumerate(seeds, 1):
                label[y, x], cost[y, x] = k, 0.0
                heapq.heappush(heap, (0.0, k, y, x))
            turn = n
            while heap:
                c, _, y, x = heapq.heappop(heap)
                if done[y, x]:
                    continue
                done[y, x] = True
                k = label[y, x]
                total[k] += a[y, x]
                count[k] += 1
                mean = total[k] / count[k]
                for dx, dy in RING4:
                    p, q = y + dy, x + dx
                    if 0 <= p < h and 0 <= q < w and a[p, q] == a[p, q]:
                        if done[p, q]:
                            if label[p, q] != k:
                                beside[k].add(label[p, q])
                                beside[label[p, q]].add(k)
                            continue
                        new = max(c, abs(a[p, q] - mean))
                        if new < cost[p, q]:
                            cost[p, q], label[p, q], turn = new, k, turn + 1
                            heapq.heappush(heap, (new, turn, p, q))
            if n <= last:
                return np.where(label > 0, label, np.nan)
            means = [t / c if c else 0.0 for t, c in zip(total, count)]
            worth = sorted(range(1, n + 1), key=lambda k: (-count[k] / (h * w) * min((abs(means[k] - means[j]) for j in beside[k]), default=0.0), k))
            stay = min(n - 1, max(int(n * (1 - last / first)), last))
            seeds = [seeds[k - 1] for k in sorted(worth[:stay])]
        return np.full((h, w), np.nan)

    return per_image(lines, run)


def spectrum(lines: DataFrame) -> DataFrame:
    """Magnitude of the two-dimensional Fourier transform; missing pixels count as 0."""
    return per_image(lines, lambda a: np.abs(np.fft.fft2(np.nan_to_num(a))))


def rescaled(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear resampling to a size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        a = np.stack([np.asarray(x, float) for x in pdf["line"]])
        y, x = np.linspace(0, a.shape[0] - 1, height), np.linspace(0, a.shape[1] - 1, width)
        y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
        y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None]
        got = (1 - fy) * ((1 - fx) * a[y0][:, x0] + fx * a[y0][:, x1]) + fy * ((1 - fx) * a[y1][:, x0] + fx * a[y1][:, x1])
        return pd.DataFrame({"image": pdf["image"].iloc[0], "y": np.arange(height), "line": list(got)})

    return lines.select("image", "y", "line").groupBy("image").applyInPandas(run, "image string, y long, line array<double>")


def flipped_x(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.reverse("line"))


def flipped_y(lines: DataFrame) -> DataFrame:
    last = lines.groupBy("image").agg(F.max("y").alias("last"))
    return lines.join(last, "image").withColumn("y", F.col("last") - F.col("y")).drop("last")


def transposed(lines: DataFrame) -> DataFrame:
    cells = lines.select("image", "y", F.posexplode("line").alias("x", "v"))
    return cells.groupBy("image", F.col("x").cast("long").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda r: r["v"]).alias("line")).withColumnRenamed("x", "y")


def border_interior(lines: DataFrame, bins: int, largest: float) -> DataFrame:
    """(image, bin, border, interior): pixels per bin that have a neighbour of another bin on one of four sides, and those that have not."""
    from .raster import stencil

    size = max((largest + 1) / bins, 1.0)
    quantised = lines.withColumn("line", F.transform("line", lambda v: F.floor(v / size).cast("double")))

    def mark(s: np.ndarray) -> np.ndarray:
        # the bin, with a half added on a border
        return s[0] + 0.5 * ((s[1:] != s[0]) & ~np.isnan(s[1:])).any(0)

    marked = stencil(quantised, [(0, 0), *RING4], mark).select("image", F.explode("line").alias("m")).where(~F.isnan("m"))
    border = F.col("m") != F.floor("m")
    return marked.groupBy("image", F.floor("m").cast("int").alias("bin")).agg(F.count_if(border).alias("border"), F.count_if(~border).alias("interior"))


def grid_seeds(lines: DataFrame, spacing: int) -> DataFrame:
    """(image, x, y) of a grid over the non-zero pixels of a mask."""
    cells = lines.where(F.col("y") % spacing == spacing // 2).select("image", "y", F.posexplode("line").alias("x", "v"))
    return cells.where((F.col("x") % spacing == spacing // 2) & (F.col("v") != 0)).select("image", F.col("x").cast("long").alias("x"), "y")


def window_level(v: Column, width: float, level: float, least: float, largest: float, top: float) -> Column:
    """Values of a window of a width around a level, kept within the image's range, stretched to 0..top."""
    from ..functions.scalars import linear_stretch

    return linear_stretch(v, max(level - width / 2, least), min(level + width / 2, largest), 0.0, top)

