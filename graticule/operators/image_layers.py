"""Feature learning from markers on images of pixels, layer by layer.

An image is rows of scanlines (image, y, line), a line holding the bands of its pixels one pixel after the other.  Layers run on bands
of rows with a halo, so an image is as parallel as it is tall; learning moves only the patches at markers (image, x, y, marker).
Outside an image patches hold 0, which is the markers' mean once features are scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.formats import Architecture, Layer
from . import graphs, layers
from .raster import BAND, Taps, banded, rectangle


def from_pixels(px: DataFrame) -> DataFrame:
    """Scanlines of pixels (image, x, y, feat) without gaps."""
    rows = px.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("x", "feat"))).alias("r"))
    return rows.select("image", F.col("y").cast("long").alias("y"), F.flatten(F.transform("r", lambda p: p["feat"])).alias("line"))


def to_pixels(lines: DataFrame, bands: int) -> DataFrame:
    """(image, x, y, feat)."""
    at = F.explode(F.sequence(F.lit(0), (F.size("line") / bands).cast("int") - 1)).alias("x")
    return lines.select("image", "y", "line", at).select("image", "x", "y", F.slice("line", F.col("x") * bands + 1, bands).alias("feat"))


def _shifted(x: np.ndarray, dx: int, dy: int, fill: float) -> np.ndarray:
    """x (rows, columns, bands) at an offset."""
    h, w, _ = x.shape
    out = np.full_like(x, fill)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = x[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def convolved(lines: DataFrame, mean: np.ndarray, stdev: np.ndarray, taps: Taps, bank: np.ndarray, relu: bool = True, band: int = BAND) -> DataFrame:
    """Lines of as many bands as the bank has kernels (a kernel per row, tap by tap): scored features times kernels, negatives to 0 with `relu`."""
    b = len(mean)

    def fn(a: np.ndarray) -> np.ndarray:
        x = (a.reshape(len(a), -1, b) - mean) / stdev
        x = np.where(np.isnan(x), 0.0, x)
        out = np.zeros((*x.shape[:2], len(bank)))
        for k, (dx, dy) in enumerate(taps):
            out += _shifted(x, dx, dy, 0.0) @ bank[:, k * b : (k + 1) * b].T
        return (np.maximum(out, 0) if relu else out).reshape(len(a), -1)

    return banded(lines, fn, max(abs(dy) for _, dy in taps), band)


def pooled(lines: DataFrame, bands: int, kind: str, taps: Taps, stride: int = 1, band: int = BAND) -> DataFrame:
    """The largest value of each band over a frame, or the sum by the frame's size, at every `stride`th row and column."""
    if kind not in ("max_pool", "avg_pool"):
        return lines

    def fn(a: np.ndarray) -> np.ndarray:
        x = a.reshape(len(a), -1, bands)
        fill = -np.inf if kind == "max_pool" else 0.0
        x = np.where(np.isnan(x), fill, x)
        out = np.full(x.shape, fill)
        for dx, dy in taps:
            s = _shifted(x, dx, dy, fill)
            out = np.maximum(out, s) if kind == "max_pool" else out + s
        return (out if kind == "max_pool" else out / len(taps)).reshape(len(a), -1)

    got = banded(lines, fn, max(abs(dy) for _, dy in taps), band)
    if stride == 1:
        return got
    width = (F.size("line") / bands).cast("int")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), width - 1, F.lit(stride)), lambda k: F.slice("line", k * bands + 1, bands)))
    return got.where(F.col("y") % stride == 0).select("image", (F.col("y") / stride).cast("long").alias("y"), kept.alias("line"))


def marker_patches(lines: DataFrame, bands: int, markers: DataFrame, taps: Taps) -> DataFrame:
    """(image, marker, node, patch) of the pixels of markers: features tap by tap, zeros outside."""
    own = markers.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("long").alias("y"), "marker").distinct()
    spots = F.posexplode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in taps])).alias("tap", "o")
    wanted = own.select("image", "marker", "x", "y", spots).select("image", "marker", F.col("x").alias("mx"), F.col("y").alias("my"), "tap", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    found = wanted.join(lines, ["image", "y"], "left")
    inside = (F.col("x") >= 0) & (F.col("x") * bands < F.size("line"))
    none = F.array_repeat(F.lit(0.0), bands)
    feat = F.when(F.col("line").isNotNull() & inside, F.slice("line", F.greatest(F.col("x"), F.lit(0)) * bands + 1, bands)).otherwise(none)
    rows = found.select("image", "marker", "mx", "my", "tap", feat.alias("feat")).groupBy("image", "marker", "mx", "my").agg(F.array_sort(F.collect_list(F.struct("tap", "feat"))).alias("r"))
    return rows.select("image", "marker", F.xxhash64("my", "mx").alias("node"), F.flatten(F.transform("r", lambda t: t["feat"])).alias("patch"))


def marker_statistics(lines: DataFrame, bands: int, markers: DataFrame, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation + factor of the features of all markers of all images."""
    own = marker_patches(lines, bands, markers, [(0, 0)]).select(F.posexplode("patch").alias("dim", "v"))
    rows = own.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("dim").collect()
    return np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows]) + factor


def scored(lines: DataFrame, mean: np.ndarray, stdev: np.ndarray) -> DataFrame:
    """Lines of scored features, in JVM expressions."""
    b = len(mean)
    m, s = (F.array(*map(F.lit, map(float, v))) for v in (mean, stdev))
    return lines.withColumn("line", F.transform("line", lambda v, k: (v - F.element_at(m, (k % b) + 1)) / F.element_at(s, (k % b) + 1)))


class TrainedImageLayer:
    """One layer's statistics, its bank, its frame and its pooling."""

    def __init__(self, layer: Layer, mean: np.ndarray, stdev: np.ndarray, bank: np.ndarray, atrous: int = 1, keep_size: bool = False):
        self.layer, self.mean, self.stdev, self.bank = layer, mean, stdev, bank
        self.taps = [(dx * atrous, dy * atrous) for dx, dy in _frame(layer)]
        self.ring = [(dx * atrous, dy * atrous) for dx, dy in rectangle(*layer.pool_size[:2])]
        self.stride = 1 if keep_size else layer.stride

    def forward(self, lines: DataFrame, pool: bool = True, band: int = BAND) -> DataFrame:
        got = convolved(lines, self.mean, self.stdev, self.taps, self.bank, self.layer.relu, band)
        return pooled(got, len(self.bank), self.layer.pool, self.ring, self.stride, band) if pool else got


def _frame(layer: Layer) -> list[tuple[int, int]]:
    sx, sy = layer.dilation[0], layer.dilation[1] if len(layer.dilation) > 1 else layer.dilation[0]
    return [(dx * sx, dy * sy) for dx, dy in rectangle(*layer.kernel_size[:2])]


def learn_bank(lines: DataFrame, bands: int, markers: DataFrame, layer: Layer, mean: np.ndarray, stdev: np.ndarray, taps: Taps, choice: str = "") -> np.ndarray:
    """A bank from the markers of all images; `choice` picks kernels of it, as `layers.selected` reads them."""
    rows = marker_patches(scored(lines, mean, stdev), bands, markers, taps).withColumnRenamed("image", "graph_id")
    kernels = layers.marker_kernels(rows, layer.kernels_per_marker, layer.kernels_per_image).orderBy("graph_id", "marker")
    bank = layers.consensus(np.array([r["w"] for r in kernels.collect()]), layer.channels)  # as many kernels as markers have prototypes
    return layers.selected(bank, choice) if choice else bank


def axes_bank(lines: DataFrame, bands: int, markers: DataFrame, layer: Layer, mean: np.ndarray, stdev: np.ndarray, taps: Taps) -> np.ndarray:
    """A bank of the principal axes of all marker patches."""
    from . import samples

    rows = marker_patches(scored(lines, mean, stdev), bands, markers, taps).select(F.col("patch").alias("feat"))
    return samples.principal_axes(rows, layer.channels).T


def train(lines: DataFrame, bands: int, markers: DataFrame, arch: Architecture, by_axes: bool = False) -> tuple[list[TrainedImageLayer], DataFrame]:
    """All layers learned in turn, and the last layer's features; each layer's output is checkpointed.

    With the architecture's `atrous`, images keep their size and frames grow by the strides before them.
    """
    out, atrous = [], 1
    for layer in arch.layers:
        mean, stdev = marker_statistics(lines, bands, markers, arch.stdev_factor)
        taps = [(dx * atrous, dy * atrous) for dx, dy in _frame(layer)]
        bank = (axes_bank if by_axes else learn_bank)(lines, bands, markers, layer, mean, stdev, taps)
        out.append(TrainedImageLayer(layer, mean, stdev, bank, atrous, arch.atrous))
        lines, bands = graphs.cut_lineage(out[-1].forward(lines)), len(bank)
        if arch.atrous:
            atrous *= layer.stride
        elif layer.stride > 1:
            markers = markers.withColumns({c: F.floor(F.col(c) / layer.stride) for c in "xy"})
    return out, lines


def extract(lines: DataFrame, trained: list[TrainedImageLayer], first: int = 1, last: int | None = None, pool_last: bool = True) -> DataFrame:
    """Features of new images after layer number `last` (from 1), beginning with `first`; images spread over tasks, whatever their number."""
    last = len(trained) if last is None else last
    for k in range(first, last + 1):
        lines = trained[k - 1].forward(lines, pool=pool_last or k < last)
    return lines


def activations(lines: DataFrame, bands: int, band: int, top: int = 255) -> DataFrame:
    """(image, x, y, val) of one band, scaled to 0..top over its image, truncated."""
    px = to_pixels(lines, bands).select("image", "x", "y", F.col("feat")[band].alias("v"))
    ends = px.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor(F.round(top * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 9))).otherwise(0)
    return px.join(ends, "image").select("image", "x", "y", scaled.alias("val"))


def batch_size(free_mb: float, width: int, height: int, trained: list[TrainedImageLayer]) -> int:
    """How many images fit a share of memory at the layer that needs most, 8 bytes a value, patches and results together."""
    most = max(width * height * (len(t.taps) * len(t.mean) + len(t.bank)) * 8 / 2**20 for t in trained)
    return int(np.floor(0.85 * free_mb / most))
