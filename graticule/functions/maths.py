"""Special functions, densities, test functions, repeatable random numbers and sequences as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


def erf(x: Column, terms: int = 160) -> Column:
    """The error function by its series of positive terms; one beyond 6, to a double's last digits."""
    z = F.abs(x).cast("double")
    step = lambda s, k: F.struct((s["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (s["sum"] + s["t"] * 2 * z * z / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(z.alias("t"), z.alias("sum")), step, lambda s: s["sum"])
    inside = 2 / math.sqrt(math.pi) * F.exp(-z * z) * total
    return F.signum(x) * F.when(z > 6, 1.0).otherwise(F.least(inside, F.lit(1.0)))


def gauss_cdf(x: Column, mean: float, stdev: float) -> Column:
    return 0.5 * (1 + erf((x - mean) / (stdev * math.sqrt(2))))


# Lanczos coefficients of the gamma function (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(x: Column) -> Column:
    """The gamma function of positive numbers."""
    y = F.when(x < 0.5, 1 - x).otherwise(x) - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    value = math.sqrt(2 * math.pi) * F.pow(t, y + 0.5) * F.exp(-t) * total
    return F.when(x < 0.5, math.pi / (F.sin(math.pi * x) * value)).otherwise(value)


def beta(x: Column, y: Column) -> Column:
    return gamma(x) * gamma(y) / gamma(x + y)


def f_density(x: Column, d1: float, d2: float) -> Column:
    top = F.pow(d1 * x, F.lit(d1)) * d2**d2 / F.pow(d1 * x + d2, F.lit(d1 + d2))
    return F.sqrt(top) / (x * (math.gamma(d1 / 2) * math.gamma(d2 / 2) / math.gamma((d1 + d2) / 2)))


def pearson4_density(x: Column, m: float, v: float, a: float, place: float, k: float) -> Column:
    z = (x - place) / a
    return k * F.pow(1 + z * z, F.lit(-m)) * F.exp(-v * F.atan(z))


def gamma_ratio(x: Column, y: Column, terms: int = 200) -> Column:
    """|gamma(x + iy) / gamma(x)| squared, as the product of 1 / (1 + y^2 / (x + n)^2) with its tail by the series of logarithms."""
    part = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), F.lit(0.0), lambda s, n: s + F.log1p(y * y / ((x + n) * (x + n))))
    z = x + terms
    # the rest of the sum by Euler and Maclaurin; f(t) = log(1 + y^2 / t^2)
    f = F.log1p(y * y / (z * z))
    integral = 2 * y * (math.pi / 2 - F.atan(z / y)) - z * f
    slope = -2 * y * y / (z * (z * z + y * y))
    return F.exp(-(part + integral + f / 2 - slope / 12))


def power(base: Column, n: int) -> Column:
    return F.pow(base, F.lit(n))


def factorial(n: Column) -> Column:
    """n! as a double, so that it does not overflow until 170."""
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(1.0), lambda s, k: F.when(k > 1, s * k).otherwise(s))


# --- test functions of optimisers, over arrays


def sphere(x: Column) -> Column:
    return V.total(x, lambda v: v * v)


def rosenbrock(x: Column) -> Column:
    ahead = F.slice(x, 2, F.size(x) - 1)
    return V.total2(F.slice(x, 1, F.size(x) - 1), ahead, lambda a, b: 100 * (b - a * a) * (b - a * a) + (a - 1) * (a - 1))


def ackley(x: Column) -> Column:
    n = F.size(x)
    return -20 * F.exp(-0.2 * F.sqrt(sphere(x) / n)) - F.exp(V.total(x, lambda v: F.cos(2 * math.pi * v)) / n) + 20 + math.e


def griewank(x: Column) -> Column:
    waves = F.aggregate(F.transform(x, lambda v, k: F.cos(v / F.sqrt(k + 1))), F.lit(1.0), lambda s, v: s * v)
    return sphere(x) / 4000 - waves + 1


def rastrigin(x: Column) -> Column:
    return 10 * F.size(x) + V.total(x, lambda v: v * v - 10 * F.cos(2 * math.pi * v))


# --- random numbers that are the same wherever they are drawn


def uniform(key: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) from the md5 of the seed and a key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8)
    return low + (high - low) * F.conv(digits, 16, 10).cast("double") / 4294967296.0


def integer(key: Column, seed: int, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (low + F.floor(uniform(key, seed) * (high - low + 1))).cast("long")


def normal(key: Column, seed: int, mean: float = 0.0, variance: float = 1.0) -> Column:
    """A normal number by Box and Muller from two uniform ones."""
    u, v = 1 - uniform(key, seed), uniform(key, seed + 1)
    return mean + math.sqrt(variance) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


# --- sequences


def geometric(begin: float, end: float, factor: float) -> Column:
    """begin, begin * factor, ... up to end."""
    n = int(math.floor(math.log(end / begin) / math.log(factor) + 1e-9)) if factor > 1 and end >= begin else 0
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(float(begin)) * F.pow(F.lit(float(factor)), k))


def stepped(begin: float, end: float, step: float) -> Column:
    n = int(math.floor((end - begin) / step + 1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: begin + step * k)


def repeated(value: Column, times: int) -> Column:
    return F.array_repeat(value, times)


# --- arrays


def shuffled(values: Column, seed: int) -> Column:
    """The elements in an order drawn by seed and position."""
    keyed = F.transform(values, lambda v, k: F.struct(uniform(k, seed).alias("u"), k.alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def variance(a: Column) -> Column:
    return V.let(V.mean(a), lambda m: V.total(a, lambda x: (x - m) * (x - m))) / F.size(a)


def median(a: Column) -> Column:
    """The element at n / 2 of the sorted array."""
    return F.element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)


def weighted_mean(a: Column, w: Column) -> Column:
    return V.total2(a, w, lambda x, y: x * y) / V.total(w)


def weighted_median(a: Column, w: Column) -> Column:
    """The least element up to which at least half of the weight lies."""
    pairs = F.array_sort(F.zip_with(a, w, lambda x, y: F.struct(x.alias("x"), y.alias("w"))))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def found(half: Column) -> Column:
        step = lambda s, p: F.struct((s["sum"] + p["w"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + p["w"] >= half, p["x"])).alias("at"))
        return F.aggregate(pairs, state, step, lambda s: s["at"])

    return V.let(V.total(w) / 2, found)


def mean_of_others(a: Column) -> Column:
    """The mean of the elements that are not zero; zero without any."""
    on = F.filter(a, lambda x: x != 0)
    return F.when(F.size(on) > 0, V.mean(on)).otherwise(0.0)
