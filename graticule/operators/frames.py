"""Frames (lists of offsets), more local filters of scanline tables, resampling along lines, kernels and spectra of lines.

Offsets are (dx, dy) or (dx, dy, dz, ...), the centre first.  Local filters run on bands with a halo, as those of `raster`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import Taps, _median, banded, closed, opened, rectangle, rounded, stacked, stencil

# --- frames


def _first(offsets) -> list[tuple[int, ...]]:
    """The centre before the others."""
    zero = tuple([0] * len(offsets[0]))
    return [zero] + [o for o in offsets if o != zero]


def cuboid(nx: int, ny: int, nz: int, dilation: tuple[int, int, int] = (1, 1, 1)) -> list[tuple[int, int, int]]:
    """A box, in raster order behind the centre; even sizes grow by one."""
    axes = [range(-(n // 2), n // 2 + 1) for n in (nz, ny, nx)]
    return _first([(dx * dilation[0], dy * dilation[1], dz * dilation[2]) for dz, dy, dx in product(*axes)])


def ball(radius: float, dims: int = 3) -> list[tuple[int, ...]]:
    """Offsets within a radius in so many dimensions, nearest first."""
    r = int(radius)
    inside = [o[::-1] for o in product(*[range(-r, r + 1)] * dims) if sum(v * v for v in o) <= radius * radius]
    return sorted(inside, key=lambda o: (sum(v * v for v in o), o[::-1]))


def box(sizes: Sequence[int]) -> list[tuple[int, ...]]:
    """A box in any number of dimensions."""
    return _first([o[::-1] for o in product(*[range(-(n // 2), n // 2 + 1) for n in sizes[::-1]])])


def cross(nx: int, ny: int) -> list[tuple[int, int]]:
    return _first([(dx, 0) for dx in range(-(nx // 2), nx // 2 + 1)] + [(0, dy) for dy in range(-(ny // 2), ny // 2 + 1) if dy])


def half_ball(radius: float, axis: int, side: int, dims: int = 3) -> list[tuple[int, ...]]:
    """The part of a ball on one side of the centre along an axis, with the plane between."""
    return [o for o in ball(radius, dims) if o[axis] * side >= 0]


def clockwise(radius: float) -> list[tuple[int, int]]:
    """A disk by angle, then by distance, behind the centre; angles start at the left and grow as y does."""

    def angle(o):
        a = np.degrees(np.arctan2(-o[1], -o[0]))
        return (float(a + 360 if a < 0 else a), o[0] ** 2 + o[1] ** 2)

    r = int(radius)
    disk = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= int(radius * radius + 0.5)]
    return [(0, 0)] + sorted((o for o in disk if o != (0, 0)), key=angle)


def one_way(offsets: Sequence[tuple[int, ...]], radius: float) -> list[tuple[int, ...]]:
    """Of each two opposite offsets the one that comes later in raster order: so that an edge counts once."""
    return [o for o in offsets if sum(v * (2 * radius + 1) ** k for k, v in enumerate(o)) >= 0]


def shell(offsets: Sequence[tuple[int, ...]], low: float, high: float, centre: bool = False) -> list[tuple[int, ...]]:
    """Offsets whose length is from low to high, with the centre in front if it is asked for."""
    own = [o for o in offsets if low * low <= sum(v * v for v in o) <= high * high]
    zero = tuple([0] * len(offsets[0]))
    return [zero, *[o for o in own if o != zero]] if centre and zero in offsets else own


def rim(offsets: Sequence[tuple[int, ...]], near: Sequence[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Offsets with a neighbour that is not one of them."""
    own = set(offsets)
    return [o for o in offsets if any(tuple(a + b for a, b in zip(o, n)) not in own for n in near)]


def layer_frame(kernel: tuple[int, int], dilation: tuple[int, int], atrous: int = 1) -> list[tuple[int, int]]:
    """The frame of a layer's kernel, its dilation times the factor of the layers before."""
    return [(dx * dilation[0] * atrous, dy * dilation[1] * atrous) for dx, dy in rectangle(*kernel)]


# --- kernels: (offsets, weights)


def uniform_kernel(offsets):
    return list(offsets), [1.0] * len(offsets)


def gaussian_kernel(radius: float, stdev: float, dims: int = 2):
    offsets = ball(radius, dims)
    w = np.exp(-np.array([sum(v * v for v in o) for o in offsets]) / (2 * stdev * stdev))
    return offsets, (w / w.sum()).tolist()


def gabor_kernel(offsets, width: float, height: float, frequency: float, angle: float, phase: float, centre: tuple[float, float] = (0.0, 0.0)):
    """The real part of a wave under a Gaussian envelope."""
    o = np.array([t[:2] for t in offsets], float)
    envelope = np.exp(-np.pi * (o[:, 0] ** 2 / width**2 + o[:, 1] ** 2 / height**2))
    x, y = np.trunc(o[:, 0] + centre[0]), np.trunc(o[:, 1] + centre[1])
    wave = np.cos(2 * np.pi * frequency * (x * np.cos(angle) + y * np.sin(angle)) + phase)
    return list(offsets), (envelope * wave).tolist()


# --- local filters


def gradient_magnitude(lines: DataFrame, taps: Taps) -> DataFrame:
    """The truncated length of the sum of differences along the taps, weighted down with distance."""
    ring = [t for t in taps if t != (0, 0)]
    d = np.array(ring, float)
    length = np.hypot(d[:, 0], d[:, 1])
    far = 2.0 * (max(abs(d[:, 0])) ** 2 + max(abs(d[:, 1])) ** 2) / 9
    w = d * (np.exp(-length / far) / length)[:, None]

    def fn(s: np.ndarray) -> np.ndarray:
        diff = s[1:] - s[0]
        gx, gy = (np.nansum(diff * w[:, k][:, None, None], 0) for k in (0, 1))
        return np.floor(np.round(np.sqrt(gx * gx + gy * gy), 6))

    return stencil(lines, [(0, 0), *ring], fn)


def domes(basins: DataFrame, top: float) -> DataFrame:
    """The complement of basins."""
    return basins.withColumn("line", F.transform("line", lambda v: F.lit(float(top)) - v))


def open_close(lines: DataFrame, taps: Taps) -> DataFrame:
    return closed(opened(lines, taps), taps)


def close_open(lines: DataFrame, taps: Taps) -> DataFrame:
    return opened(closed(lines, taps), taps)


def dilate_by(lines: DataFrame, taps: Taps, heights: Sequence[float]) -> DataFrame:
    """The largest sum of a value and its tap's height."""
    h = np.array(heights, float)[:, None, None]
    return stencil(lines, taps, lambda s: np.nanmax(s + h, 0))


def erode_by(lines: DataFrame, taps: Taps, heights: Sequence[float]) -> DataFrame:
    """The least difference of a value and its tap's height."""
    h = np.array(heights, float)[:, None, None]
    return stencil(lines, taps, lambda s: np.nanmin(s - h, 0))


def _mirrored(taps: Taps) -> list[tuple[int, int]]:
    return [(-dx, -dy) for dx, dy in taps]


def open_by(lines: DataFrame, taps: Taps, heights: Sequence[float]) -> DataFrame:
    return dilate_by(erode_by(lines, taps, heights), _mirrored(taps), heights)


def close_by(lines: DataFrame, taps: Taps, heights: Sequence[float]) -> DataFrame:
    return erode_by(dilate_by(lines, taps, heights), _mirrored(taps), heights)


def convolved(lines: DataFrame, taps: Taps, weights: Sequence[float]) -> DataFrame:
    """The weighted sum over the taps turned round."""
    w = np.array(weights, float)[:, None, None]
    return stencil(lines, _mirrored(taps), lambda s: np.nansum(s * w, 0))


def in_region(filtered: DataFrame, lines: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """A filter's values where a pixel of `lines` is in the region, its own value elsewhere."""
    own = lines.select("image", "y", F.col("line").alias("_own"))
    pick = F.zip_with("line", "_own", lambda a, b: F.when(keep(b), a).otherwise(b))
    return filtered.join(own, ["image", "y"]).select("image", "y", pick.alias("line"))


def filtered_bank(lines: DataFrame, taps: Taps, bank: Sequence[Sequence[float]]) -> DataFrame:
    """(image, y, x, feat): a band for each kernel of a bank over one frame."""
    parts = None
    for k, weights in enumerate(bank):
        w = np.array(weights, float)[:, None, None]
        own = stencil(lines, taps, lambda s, w=w: np.nansum(s * w, 0)).select("image", "y", F.col("line").alias(f"_{k}"))
        parts = own if parts is None else parts.join(own, ["image", "y"])
    bands = [F.col(f"_{k}") for k in range(len(bank))]
    cells = F.arrays_zip(*bands)
    return parts.select("image", "y", F.posexplode(cells).alias("x", "b")).select("image", "y", "x", F.array(*[F.col(f"b._{k}") for k in range(len(bank))]).alias("feat"))


def bilateral(lines: DataFrame, taps: Taps, spatial: float, tonal: float) -> DataFrame:
    """Means weighted by distance in place and in value."""
    near = np.exp(-np.array([dx * dx + dy * dy for dx, dy in taps]) / (2 * spatial * spatial))[:, None, None]

    def fn(s: np.ndarray) -> np.ndarray:
        w = near * np.exp(-((s - s[0]) ** 2) / (2 * tonal * tonal))
        return np.nansum(w * s, 0) / np.nansum(w, 0)

    return stencil(lines, _with_centre(taps), fn)


def _with_centre(taps: Taps) -> list[tuple[int, int]]:
    if taps[0] != (0, 0):
        raise ValueError("the centre comes first")
    return list(taps)


def locally_normalised(lines: DataFrame, taps: Taps) -> DataFrame:
    """A value over the root of the sum of squares in its frame; 0 where that is 0."""

    def fn(s: np.ndarray) -> np.ndarray:
        n = np.sqrt(np.nansum(s * s, 0))
        return np.where(n > 0, s[0] / np.where(n > 0, n, 1), 0.0)

    return stencil(lines, _with_centre(taps), fn)


def divisively_normalised(lines: DataFrame, taps: Taps, top: int) -> DataFrame:
    """A value over the root of the sum of squares of its neighbours, times `top`, truncated; 0 where that is 0."""

    def fn(s: np.ndarray) -> np.ndarray:
        n = np.sqrt(np.nansum(s[1:] * s[1:], 0))
        return np.where(n > 0, np.trunc(np.round(s[0] / np.where(n > 0, n, 1) * top, 6)), 0.0)

    return stencil(lines, _with_centre(taps), fn)


def normalised_by_frame(lines: DataFrame, taps: Taps, top: int) -> DataFrame:
    """As `locally_normalised`, with whole roots, scaled to 0..top over each image and truncated."""

    def fn(s: np.ndarray) -> np.ndarray:
        n = np.floor(np.round(np.sqrt(np.nansum(s * s, 0)), 6))
        return np.where(n > 0, s[0] / np.where(n > 0, n, 1), np.nan)

    shares = stencil(lines, _with_centre(taps), fn)
    v = F.filter("line", lambda x: ~F.isnan(x))
    ends = shares.groupBy("image").agg(F.min(F.array_min(v)).alias("lo"), F.max(F.array_max(v)).alias("hi"))
    scaled = F.transform("line", lambda x: F.when(F.isnan(x), 0.0).otherwise(F.floor(F.round(top * (x - F.col("lo")) / (F.col("hi") - F.col("lo")), 6)).cast("double")))
    return shares.join(ends, "image").select("image", "y", scaled.alias("line"))


def at_pixel(px: DataFrame, x: int, y: int, taps: Taps) -> DataFrame:
    """(least, median, largest) in the frame of one pixel; the median is the value at n / 2."""
    spots = [(x + dx, y + dy) for dx, dy in taps]
    here = px.where(" or ".join(f"(x = {a} and y = {b})" for a, b in spots))
    values = F.array_sort(F.collect_list("val"))
    return here.agg(F.min("val").alias("least"), F.element_at(values, F.floor(F.count("*") / 2).cast("int") + 1).alias("median"), F.max("val").alias("largest"))


def frame_features(lines: DataFrame, taps: Taps, place: bool = False) -> DataFrame:
    """(image, y, x, feat): each pixel's own value and those of its frame, its own where the frame leaves the image; with x and y behind them if `place`."""
    halo = max(abs(dy) for _, dy in taps)
    parts = None
    for k, t in enumerate(taps):

        def fn(a: np.ndarray, t=t) -> np.ndarray:
            s = stacked(a, [t])[0]
            return np.where(np.isnan(s), a, s)

        own = banded(lines, fn, halo).select("image", "y", F.col("line").alias(f"_{k}"))
        parts = own if parts is None else parts.join(own, ["image", "y"])
    cells = parts.select("image", "y", F.posexplode(F.arrays_zip(*[F.col(f"_{k}") for k in range(len(taps))])).alias("x", "b"))
    feat = F.array(*[F.col(f"b._{k}") for k in range(len(taps))], *([F.col("x").cast("double"), F.col("y").cast("double")] if place else []))
    return cells.select("image", "y", "x", feat.alias("feat"))


def median_of_bands(lines: DataFrame, taps: Taps) -> DataFrame:
    return stencil(lines, taps, _median)


# --- resampling of scanlines


def value_at(px: DataFrame, points: DataFrame) -> DataFrame:
    """(p, val): the image between four pixels, rounded, at points (p, px, py); the pixel up left where one of the four is missing, 0 beyond the image."""
    own = points.withColumns({"x0": F.floor("px").cast("long"), "y0": F.floor("py").cast("long")})
    corners = own.select("p", "px", "py", "x0", "y0", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    corners = corners.withColumns({"x": F.col("x0") + F.col("c.a"), "y": F.col("y0") + F.col("c.b")})
    found = corners.join(px.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "val"), ["x", "y"], "left")
    v = {(a, b): F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("val"))) for a in (0, 1) for b in (0, 1)}
    got = found.groupBy("p", "px", "py", "x0", "y0").agg(*[e.alias(f"v{a}{b}") for (a, b), e in v.items()], F.count("val").alias("n"))
    dx, dy = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    top, low = F.col("v00") + dx * (F.col("v10") - F.col("v00")), F.col("v01") + dx * (F.col("v11") - F.col("v01"))
    return got.select("p", F.when(F.col("n") == 4, F.round(F.round(top + dy * (low - top), 9))).otherwise(F.coalesce("v00", F.lit(0.0))).alias("val"))


def nearest_value(px: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """(p, val) at the pixel next to each point, kept inside the image."""
    x = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.round("px"))).cast("long")
    y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.round("py"))).cast("long")
    return points.select("p", x.alias("x"), y.alias("y")).join(px.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "val"), ["x", "y"]).select("p", "val")


def transformed(px: DataFrame, width: int, height: int, matrix: np.ndarray, to: tuple[int, int]) -> DataFrame:
    """(x, y, val) of the image moved by a 3 x 3 matrix: each pixel of the new image is looked up where the inverse puts it; 0 beyond."""
    m = np.linalg.inv(matrix)
    rows = px.sparkSession.range(to[1]).select(F.col("id").alias("ny")).withColumn("nx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(to[0] - 1).cast("long"))))
    at = rows.select(
        F.struct("nx", "ny").alias("p"), (float(m[0, 0]) * F.col("nx") + float(m[0, 1]) * F.col("ny") + float(m[0, 2])).alias("px"), (float(m[1, 0]) * F.col("nx") + float(m[1, 1]) * F.col("ny") + float(m[1, 2])).alias("py")
    )
    at = at.withColumns({"px": F.round("px", 9), "py": F.round("py", 9)})
    inside = at.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") <= width - 1) & (F.col("py") <= height - 1))
    got = value_at(px, inside)
    return at.join(got, "p", "left").select("p.nx", "p.ny", F.coalesce("val", F.lit(0.0)).alias("val")).toDF("x", "y", "val")


def rotated(px: DataFrame, width: int, height: int, degrees: float) -> DataFrame:
    """The image turned about its centre, in a frame that holds all of it."""
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    nx, ny = (int(np.ceil(np.round(abs(a * c) + abs(b * s), 9))) for a, b in ((width, height), (height, width)))
    shift = lambda a, b: np.array([[1, 0, a], [0, 1, b], [0, 0, 1.0]])
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    return transformed(px, width, height, shift((nx - 1) / 2, (ny - 1) / 2) @ turn @ shift(-(width - 1) / 2, -(height - 1) / 2), (nx, ny))


def scaled(px: DataFrame, width: int, height: int, sx: float, sy: float) -> DataFrame:
    return transformed(px, width, height, np.diag([sx, sy, 1.0]), (int(np.ceil(sx * width)), int(np.ceil(sy * height))))


def profile(px: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """(k, x, y, val) along the line between two pixels, one for each step of the longer side."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    k = px.sparkSession.range(n + 1).select(F.col("id").alias("k"))
    at = k.select("k", *[F.round(F.round(F.lit(float(p)) + F.col("k") * (float(q - p) / max(1, n)), 9)).cast("long").alias(c) for c, p, q in zip("xy", a, b)])
    return at.join(px.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "val"), ["x", "y"]).select("k", "x", "y", "val")


# --- spectra


def line_spectrum(lines: DataFrame) -> DataFrame:
    """(image, y, re, im): the discrete Fourier transform of each row, in JVM expressions."""
    n, line = F.size("line"), F.col("line")

    def part(f):
        return F.transform(line, lambda _, k: F.aggregate(F.transform(line, lambda v, j: v * f(2 * np.pi * ((k * j) % n) / n)), F.lit(0.0), lambda s, v: s + v))

    return lines.select("image", "y", part(F.cos).alias("re"), F.transform(part(F.sin), lambda v: -v).alias("im"))


def _grid(shape) -> list[np.ndarray]:
    return [np.fft.fftfreq(n) * n for n in shape]


def butterworth(shape: tuple[int, ...], order: int, cut: float) -> np.ndarray:
    """Weights of a low pass for a spectrum whose origin is its first cell; cut is a share of half the diagonal."""
    far = cut * np.sqrt(sum((n // 2) ** 2 for n in shape))
    d = np.sqrt(sum(g**2 for g in np.meshgrid(*_grid(shape), indexing="ij")))
    return 1 / (1 + 0.414 * (d / far) ** (2 * order))


def low_passed(a: np.ndarray, order: int, cut: float) -> np.ndarray:
    """An image or volume without its high frequencies."""
    return np.fft.ifftn(np.fft.fftn(a) * butterworth(a.shape, order, cut)).real


def smoothed(lines: DataFrame, radius: float, stdev: float, keep: Callable[[Column], Column]) -> DataFrame:
    """Gaussian means where a pixel is in a region; others keep their values."""
    taps, weights = gaussian_kernel(radius, stdev)
    w = np.array(weights)[:, None, None]
    soft = stencil(lines, taps, lambda s: rounded(np.nansum(s * w, 0)))
    return in_region(soft, lines, keep)
