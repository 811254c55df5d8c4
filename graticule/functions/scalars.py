"""Scalar functions: rounding, radiometric maps, colour, strings, paths, JSON, number theory, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column) -> Column:
    """Round to the nearest integer, halves away from zero."""
    return F.round(x)


def safe_mod(a: Column, n: int) -> Column:
    """The remainder that is never negative."""
    return F.pmod(a, F.lit(n))


def logarithm(x: Column, base: float) -> Column:
    return F.log(x) / math.log(base)


def sigmoid(x: Column, alpha: float) -> Column:
    return 1 / (1 + F.exp(-alpha * x))


def gauss_pdf(x: Column, mean: float, stdev: float) -> Column:
    z = (x - mean) / stdev
    return F.exp(-z * z / 2) / (stdev * math.sqrt(2 * math.pi))


def almost_zero(x: Column, eps: float = 1e-7) -> Column:
    return F.abs(x) < eps


def is_prime(n: Column, most: int) -> Column:
    """Whether n (at most `most`) is prime, by trial division."""
    divisors = [d for d in range(2, math.isqrt(most) + 1) if all(d % p for p in range(2, math.isqrt(d) + 1))]
    return (n > 1) & ~F.exists(F.array(*map(F.lit, divisors or [2])), lambda d: (n % d == 0) & (n != d))


def linear_stretch(v: Column, f1: float, f2: float, g1: float, g2: float) -> Column:
    """f1..f2 to g1..g2; what lies beyond is clamped."""
    inside = half_away((g2 - g1) / (f2 - f1) * (v - f1) + g1) if f1 != f2 else F.lit(float(g1))
    return F.when(v < f1, F.lit(float(g1))).when(v > f2, F.lit(float(g2))).otherwise(inside)


def exponential_stretch(v: Column, f1: float, f2: float, g1: float, g2: float) -> Column:
    """f1..f2 to g1..g2 along an exponential curve, truncated; what lies beyond is clamped."""
    low = math.exp(-1)
    inside = (g2 * (F.exp((v - f2) / (f2 - f1)) - low) + g1 + low).cast("int") if f1 != f2 else F.lit(int(g2))
    return F.when(v < f1, int(g1)).when(v > f2, int(g2)).otherwise(inside)


def threshold(v: Column, low: float, high: float, value: int = 1) -> Column:
    return F.when((v >= low) & (v <= high), value).otherwise(0)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return half_away(alpha * a + (1 - alpha) * b)


# Weights of the luma and chroma transform.
YCBCR = ((0.256789062, 0.504128906, 0.09790625, 16), (-0.148222656, -0.290992187, 0.439214844, 128), (0.439214844, -0.367789063, -0.071425781, 128))


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """Integer Y, Cb, Cr of 8-bit R, G, B, truncated and kept within 0..255; sums are of whole multiples of 1e-9, so that greys keep a chroma of 128."""
    whole = [[float(round(w * 1e9)) for w in row] for row in YCBCR]
    return [F.greatest(F.lit(0), F.least(F.lit(255), ((wr * r + wg * g + wb * b + c) / 1e9).cast("int"))) for wr, wg, wb, c in whole]


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column, top: int = 255) -> list[Column]:
    """Integer hue in degrees, saturation and value of integers 0..top; the value of a colour is its luma, of a grey itself."""
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    span = high - low
    hue = F.when(r == low, 3 - (g - b) / span).when(g == low, 5 - (b - r) / span).otherwise(1 - (r - g) / span)
    whole = lambda x: F.round(x, 9).cast("int")
    return [F.when(span == 0, F.lit(0)).otherwise(whole(v)) for v in (60.0 * hue, top * 1.0 * span / high)] + [F.when(span == 0, high).otherwise(whole(luma(r, g, b)))]


# Linear RGB to XYZ, the white point, and the ranges of L, a, b.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
LAB_RANGE = ((0.0, 99.998337), (86.182236, 184.44085), (107.867744, 202.349426))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of R, G, B within 0..1."""

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    x, y, z = ((wr * r + wg * g + wb * b) / w for (wr, wg, wb), w in zip(XYZ, WHITE))
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return [light, 500 * (bent(x) - bent(y)), 200 * (bent(y) - bent(z))]


def lab_scaled(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b scaled to 0..1 by their ranges."""
    return [(v + low) / span for v, (low, span) in zip(lab(r, g, b), LAB_RANGE)]


def split_at(text: Column, sep: str, at: int) -> Column:
    """The part number `at` (from 0; negative counts from the end); null beyond."""
    parts = F.split(text, "\\Q" + sep + "\\E")
    return F.try_element_at(parts, F.lit(at + 1 if at >= 0 else at))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def json_path(doc: Column, path: str) -> Column:
    """The value at keys separated by `:`."""
    return F.get_json_object(doc, "$." + path.replace(":", "."))
