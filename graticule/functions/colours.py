"""Colour conversions back and forth, and colour tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scalars as S


def within(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


# Weights of Y, Cb, Cr in R, G, B.
BACK = ((1.164383562, 0.0, 1.596026786), (1.164383562, -0.39176229, -0.812967647), (1.164383562, 2.017232143, 0.0))


def rgb_of_ycbcr(y: Column, cb: Column, cr: Column, top: int = 255) -> list[Column]:
    """Integers, truncated and kept within 0..top."""
    low, mid = 16.0 / 255 * top, 128.0 / 255 * top
    return [within((a * (y - low) + b * (cb - mid) + c * (cr - mid)).cast("int"), 0, top) for a, b, c in BACK]


# Luma weights, chroma divisors and ranges of the wide-gamut transform (8 bits; more bits are multiples).
WIDE, WIDE_CB, WIDE_CR = (0.2627, 0.6780, 0.0593), 1.8814, 1.4746
WIDE_LOW, WIDE_MID, WIDE_LUMA, WIDE_CHROMA = 16, 128, 219, 224


def wide_ycbcr(r: Column, g: Column, b: Column, rgb_bits: int = 8, bits: int = 10) -> list[Column]:
    """Integer Y, Cb, Cr of wide-gamut colours of `rgb_bits`, at `bits`."""
    unit, top = 1 << (bits - 8), float((1 << rgb_bits) - 1)
    r, g, b = (c / top for c in (r, g, b))
    y = WIDE[0] * r + WIDE[1] * g + WIDE[2] * b
    cb, cr = (within((c - y) / w, -0.5, 0.5) for c, w in ((b, WIDE_CB), (r, WIDE_CR)))
    whole = [(within(y, 0.0, 1.0) * WIDE_LUMA * unit).cast("int") + WIDE_LOW * unit]
    return whole + [(c * WIDE_CHROMA * unit).cast("int") + WIDE_MID * unit for c in (cb, cr)]


def rgb_of_wide_ycbcr(y: Column, cb: Column, cr: Column, bits: int = 10, rgb_bits: int = 8) -> list[Column]:
    unit, top = 1 << (bits - 8), float((1 << rgb_bits) - 1)
    y = (y - WIDE_LOW * unit) / (WIDE_LUMA * unit)
    cb, cr = ((c - WIDE_MID * unit) / (WIDE_CHROMA * unit) for c in (cb, cr))
    r, b = cr * WIDE_CR + y, cb * WIDE_CB + y
    g = (y - WIDE[0] * r - WIDE[2] * b) / WIDE[1]
    return [(within(c, 0.0, 1.0) * top).cast("int") for c in (r, g, b)]


# XYZ to linear RGB.
RGB_OF_XYZ = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def rgb_of_lab(light: Column, a: Column, b: Column, top: int = 255) -> list[Column]:
    """Integers, truncated; colours that R, G, B cannot hold lie outside 0..top."""

    def straight(t: Column) -> Column:
        return F.when(t >= 6 / 29, t * t * t).otherwise(108 / 841 * (t - 4 / 29))

    y = (light + 16) / 116
    xyz = [w * straight(t) for w, t in zip(S.WHITE, (y + a / 500, y, y - b / 200))]
    return [((p * xyz[0] + q * xyz[1] + s * xyz[2]) * top).cast("int") for p, q, s in RGB_OF_XYZ]


def quantised_lab(light: Column, a: Column, b: Column, top: int = 255) -> list[Column]:
    return [((v + low) / span * top).cast("int") for v, (low, span) in zip((light, a, b), S.LAB_RANGE)]


def lab_of_quantised(light: Column, a: Column, b: Column, top: int = 255) -> list[Column]:
    return [v / top * span - low for v, (low, span) in zip((light, a, b), S.LAB_RANGE)]


def rgb_of_hsv(h: Column, s: Column, v: Column, top: int = 255) -> list[Column]:
    """Hue in degrees, saturation and value 0..top to integers 0..top, truncated."""
    h, s, v = h / 60, s / top, v / top
    i = F.floor(h)
    f = h - i
    f = F.when(i % 2 == 0, 1 - f).otherwise(f)
    m, n = v * (1 - s), v * (1 - s * f)
    # what each sector of the circle takes
    sectors = ((v, n, m), (n, v, m), (m, v, n), (m, n, v), (n, m, v), (v, m, n))
    out = []
    for band in range(3):
        value = F.when(s == 0, v)
        for k, sector in enumerate(sectors):
            value = value.when(i % 6 == k, sector[band])
        out.append((F.round(value * top, 9)).cast("int"))
    return out


def ycbcr_to_lab(y: Column, cb: Column, cr: Column, top: int = 255) -> list[Column]:
    return S.lab(*(c / top for c in rgb_of_ycbcr(y, cb, cr, top)))


def ycbcr_to_lab_scaled(y: Column, cb: Column, cr: Column, top: int = 255) -> list[Column]:
    return S.lab_scaled(*(c / top for c in rgb_of_ycbcr(y, cb, cr, top)))


def converted(bands: list[Column], source: str, to: str, top: int = 255) -> list[Column]:
    """Three bands from one colour space to another by way of R, G, B: rgb, ycbcr, lab, lab_scaled, hsv, gray."""
    if source == to:
        return bands
    back = {
        "rgb": lambda b: b, "ycbcr": lambda b: rgb_of_ycbcr(*b, top), "lab": lambda b: rgb_of_lab(*b, top), "hsv": lambda b: rgb_of_hsv(*b, top), "gray": lambda b: [b[0]] * 3,
        "lab_scaled": lambda b: rgb_of_lab(*(v * span - low for v, (low, span) in zip(b, S.LAB_RANGE)), top),
    }
    ahead = {
        "rgb": lambda b: b, "ycbcr": lambda b: S.ycbcr(*b), "lab": lambda b: S.lab(*(c / top for c in b)), "lab_scaled": lambda b: S.lab_scaled(*(c / top for c in b)), "hsv": lambda b: S.hsv(*b, top),
        "gray": lambda b: [S.luma(*b)],
    }
    return ahead[to](back[source](bands))


def largest_of(depth: Column) -> Column:
    """The least of 1, 255, 4095, 65535 and 2^32 - 1 that a value does not exceed; null beyond and below 0."""
    out = F.lit(None).cast("long")
    for top in (4294967295, 65535, 4095, 255, 1):
        out = F.when(depth <= top, F.lit(top).cast("long")).otherwise(out)
    return F.when(depth >= 0, out)


def quantised(v: Column, low: float, high: float, bins: int) -> Column:
    """The middle of the bin that a value within low..high falls into."""
    width = (high - low) / bins
    k = within(F.floor((v - low) / width), 0, bins - 1)
    return low + (k + 0.5) * width


# --- colour tables: (n, r, g, b), as many rows as colours

# The colours that a perceptually even table passes through, and those of a cyclic one.
VIRIDIS = ("480054", "4f307f", "435b8d", "347f8e", "22a287", "3dc36c", "93db35", "f3e91c")
GRAY = ("000000", "FFFFFF")
# Blue, green, yellow, red.
BLUE_TO_RED = ((0, 183, 255), (0, 169, 6), (255, 255, 0), (173, 0, 20))

TABLE = "n int, r int, g int, b int"


def _line(a, b, n: int) -> list[tuple[int, int, int]]:
    """n colours from a to b, both included."""
    return [tuple(int(x + (y - x) * k / max(1, n - 1)) for x, y in zip(a, b)) for k in range(n)]


def gradient(spark: SparkSession, stops: tuple[str, ...], n: int) -> DataFrame:
    """n colours through the stops (six hex digits each), in stretches of equal length that share their ends."""
    points = [tuple(int(s[k : k + 2], 16) for k in (0, 2, 4)) for s in stops]
    each, out = math.ceil(n / (len(points) - 1)), []
    for k, (a, b) in enumerate(zip(points, points[1:])):
        size = n - len(out) if k == len(points) - 2 else each
        out += _line(a, b, size)
        if k < len(points) - 2:
            out.pop()
    return spark.createDataFrame([(k, *c) for k, c in enumerate(out)], TABLE)


def blue_to_red(spark: SparkSession, n: int) -> DataFrame:
    """At least seven colours from blue over green and yellow to red."""
    at = (0, n // 3, 2 * n // 3, n - 1)
    out = []
    for (a, b), (p, q) in zip(zip(BLUE_TO_RED, BLUE_TO_RED[1:]), zip(at, at[1:])):
        out += [tuple(int(x + (y - x) * k / (q - p)) for x, y in zip(a, b)) for k in range(q - p)]
    return spark.createDataFrame([(k, *c) for k, c in enumerate([*out, BLUE_TO_RED[-1]])], TABLE)


def drawn(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n colours drawn by seed."""
    from .maths import integer

    key = F.col("n")
    return spark.range(n).select(F.col("id").cast("int").alias("n")).select("n", *[integer(key, seed + k, 0, 255).cast("int").alias(c) for k, c in enumerate("rgb")])


def coloured(px: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels (..., val) with r, g, b of the table's row number val; tables are short and broadcast."""
    return px.join(F.broadcast(table), F.col("val").cast("int") == F.col("n")).drop("n")
