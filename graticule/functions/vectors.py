"""Distances and norms of feature vectors as column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight that logarithmic distances are scaled by, and the small number that keeps divisions finite.
MAX_WEIGHT = 4095.0
EPSILON = 1e-7


def total(a: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def total2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, and not again for each element that a lambda in the body looks at."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squared_euclidean(a: Column, b: Column) -> Column:
    return total2(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def euclidean_log(a: Column, b: Column) -> Column:
    return MAX_WEIGHT * F.log(euclidean(a, b) + 1)


def power_sum(a: Column, b: Column, alpha: float = 1.0) -> Column:
    """Sum of |a - b| to the power alpha."""
    return total2(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(alpha)))


def power_sum_log(a: Column, b: Column, alpha: float = 1.0) -> Column:
    return MAX_WEIGHT * F.log(power_sum(a, b, alpha) + 1)


def saturating(a: Column, b: Column) -> Column:
    return 1 - F.exp(-euclidean(a, b) / 20)


def half_cosine(a: Column, b: Column) -> Column:
    """0.5 - <a, b> / 2: the cosine distance of vectors of length one."""
    return 0.5 - total2(a, b, lambda x, y: x * y) / 2


def minkowski(a: Column, b: Column, p: float = 0.5) -> Column:
    """Sum of |a - b| to the power p, for values within [-1, 1]."""
    return total2(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))


def _moments(a: Column, b: Column):
    ma, mb = mean(a), mean(b)
    va = total(a, lambda x: x * x) / F.size(a) - ma * ma
    vb = total(b, lambda x: x * x) / F.size(b) - mb * mb
    cov = total2(a, b, lambda x, y: x * y) / F.size(a) - ma * mb
    return va, vb, cov


def correlation(a: Column, b: Column) -> Column:
    va, vb, cov = _moments(a, b)
    return cov / F.sqrt(va * vb)


def correlation_distance(a: Column, b: Column) -> Column:
    return 1 - F.abs(correlation(a, b))


def information_compression(a: Column, b: Column) -> Column:
    """Twice the smaller eigenvalue of the 2 x 2 covariance of a and b."""
    va, vb, cov = _moments(a, b)
    rho2 = cov * cov / (va * vb)
    root = F.sqrt((va + vb) * (va + vb) - 4 * va * vb * (1 - rho2))
    return va + vb - root


def chi_square(a: Column, b: Column) -> Column:
    return total2(a, b, lambda x, y: (x - y) * (x - y) / (x + y + EPSILON))


def hellinger(a: Column, b: Column) -> Column:
    return F.sqrt(total2(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))) * 0.707106781


def bhattacharyya(a: Column, b: Column) -> Column:
    return total2(a, b, lambda x, y: F.sqrt(x * y))


def l1(a: Column, b: Column) -> Column:
    return total2(a, b, lambda x, y: F.abs(x - y))


def l1_mean(a: Column, b: Column) -> Column:
    return l1(a, b) / F.size(a)


def signed_manhattan(a: Column, b: Column) -> Column:
    return total2(a, b, lambda x, y: y - x)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = total2(a, b, lambda x, y: x * y)
    return (1 - dot / F.sqrt(total(a, lambda x: x * x) * total(b, lambda x: x * x))) / 2


def running_differences(a: Column, b: Column) -> Column:
    """Sum of the running sums of a - b (signed, so not an earth mover's distance in the strict sense)."""
    state = F.aggregate(
        F.zip_with(a, b, lambda x, y: x - y),
        F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, v: F.struct((s["run"] + v).alias("run"), (s["sum"] + s["run"] + v).alias("sum")),
    )
    return state["sum"]


def kullback_leibler(a: Column, b: Column) -> Column:
    """Divergence of a from b, each scaled to add up to one."""
    sums = F.struct(total(a).alias("a"), total(b).alias("b"))
    return let(sums, lambda s: total2(a, b, lambda x, y: x / s["a"] * F.log(x / s["a"] / (y / s["b"]))))


#: Numbered distance functions (fixed numbering).
NUMBERED: dict[int, Callable[[Column, Column], Column]] = {
    1: euclidean,
    2: euclidean_log,
    3: power_sum,
    4: power_sum_log,
    5: saturating,
    6: half_cosine,
    7: minkowski,
    8: correlation_distance,
    9: information_compression,
    10: chi_square,
    11: hellinger,
    12: bhattacharyya,
}


def numbered(number: int) -> Callable[[Column, Column], Column]:
    """The numbered distance; any other number gives the first."""
    return NUMBERED.get(number, euclidean)


def norm(a: Column) -> Column:
    return F.sqrt(total(a, lambda x: x * x))


def unit(a: Column, least: float = 0.001) -> Column:
    """a at length one; a vector no longer than `least` stays as it is."""
    return let(norm(a), lambda n: F.when(n > least, F.transform(a, lambda x: x / n)).otherwise(a))


def by_maximum(a: Column) -> Column:
    return let(F.array_max(a), lambda top: F.transform(a, lambda x: x / top))


def _squares(a: Column, m: Column) -> Column:
    return total(a, lambda x: (x - m) * (x - m))


def standardised(a: Column) -> Column:
    """(x - mean) / population deviation inside one vector."""
    return let(mean(a), lambda m: let(F.sqrt(_squares(a, m) / F.size(a)), lambda dev: F.transform(a, lambda x: (x - m) / dev)))


def contrast(a: Column) -> Column:
    """(x - mean) / sqrt((sum of squares + 0.1) / (n - 1)) inside one vector."""
    return let(mean(a), lambda m: let(F.sqrt((_squares(a, m) + 0.1) / (F.size(a) - 1)), lambda dev: F.transform(a, lambda x: (x - m) / dev)))


def norm_one(a: Column) -> Column:
    """a scaled to add up to one in absolute value."""
    return let(total(a, F.abs), lambda n: F.transform(a, lambda x: x / n))
