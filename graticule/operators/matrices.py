"""Matrices and tensors as tables of cells, and small dense matrices as arrays of rows.

A table of cells is (m, i, j, v): matrix, row, column, value, both from 0; cells that are not there are 0.  A tensor's cells are
(t, index array<int>, v).  What needs a whole matrix at once takes one row for each matrix, (m, rows array<array<double>>), so that
a matrix must fit a task and any number of them are handled side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["m", "i", "j"]

#: Operations by their signs.
SIGNS: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


def transposed(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows times columns of matrices of one name: a join on the inner index and partial sums."""
    left = a.select("m", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select("m", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, ["m", "k"]).groupBy(*CELL).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def chain(*matrices: DataFrame) -> DataFrame:
    return reduce(product, matrices)


def pointwise(a: DataFrame, b: DataFrame, sign: str) -> DataFrame:
    """Cell by cell of matrices of one name and shape."""
    return a.join(b.select(*CELL, F.col("v").alias("w")), CELL).select(*CELL, SIGNS[sign](F.col("v"), F.col("w")).alias("v"))


def with_scalar(a: DataFrame, scalar: float, sign: str, first: bool = False) -> DataFrame:
    """Each cell and a number, which comes first if `first`."""
    x, y = (F.lit(scalar), F.col("v")) if first else (F.col("v"), F.lit(scalar))
    return a.withColumn("v", SIGNS[sign](x, y))


def with_vector(a: DataFrame, vector: DataFrame, sign: str, by_row: bool = True) -> DataFrame:
    """Each cell and the vector's element (m, k, w) of its column, or, if not `by_row`, of its row."""
    key = "j" if by_row else "i"
    return a.join(vector.withColumnRenamed("k", key), ["m", key]).select(*CELL, SIGNS[sign](F.col("v"), F.col("w")).alias("v"))


def powers(a: DataFrame, power: float) -> DataFrame:
    return a.withColumn("v", F.pow("v", F.lit(power)))


def logarithms(a: DataFrame, least: float = 1e-7) -> DataFrame:
    """Natural logarithms; below `least` minus infinity, negative cells stay."""
    return a.withColumn("v", F.when(F.col("v") < 0, F.col("v")).when(F.col("v") < least, F.lit(float("-inf"))).otherwise(F.log("v")))


def saturated(a: DataFrame, bound: float, upper: bool = True) -> DataFrame:
    return a.withColumn("v", F.least("v", F.lit(bound)) if upper else F.greatest("v", F.lit(bound)))


def part(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Rows and columns from the first up to, without, the second number, counted from 0 again."""
    own = a.where((F.col("i") >= rows[0]) & (F.col("i") < rows[1]) & (F.col("j") >= columns[0]) & (F.col("j") < columns[1]))
    return own.withColumns({"i": F.col("i") - rows[0], "j": F.col("j") - columns[0]})


def reshaped(a: DataFrame, columns: int, to: int) -> DataFrame:
    """The cells of matrices of so many columns, row by row, in `to` columns."""
    at = F.col("i") * columns + F.col("j")
    return a.withColumns({"i": F.floor(at / to).cast("int"), "j": (at % to).cast("int")})


def extended(a: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Matrices of a shape in a larger one; new cells on the main diagonal are 1."""
    ones = a.select("m").distinct().withColumn("i", F.explode(F.sequence(F.lit(min(shape)), F.lit(max(min(shape), min(to) - 1))))).where((F.col("i") < min(to)) & (F.col("i") >= min(shape)))
    return a.select(*CELL, "v").unionByName(ones.select("m", "i", F.col("i").alias("j"), F.lit(1.0).alias("v")))


def resized(a: DataFrame, rows: int, columns: int) -> DataFrame:
    return a.where((F.col("i") < rows) & (F.col("j") < columns))


def diagonal(a: DataFrame, as_row: bool = True) -> DataFrame:
    own = a.where("i = j")
    return own.withColumn("i", F.lit(0)) if as_row else own.withColumn("j", F.lit(0))


def from_diagonal(vector: DataFrame) -> DataFrame:
    """(m, k, w) on the main diagonal."""
    return vector.select("m", F.col("k").alias("i"), F.col("k").alias("j"), F.col("w").alias("v"))


def identity(names: DataFrame, n: int) -> DataFrame:
    """The identity of n columns for each name (m)."""
    own = names.select("m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return own.select("m", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def ramp(names: DataFrame, rows: int, columns: int, mean: float, span: float) -> DataFrame:
    """Cells that rise evenly from `mean` by `span`, row by row."""
    cells = names.select("m", F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1))).alias("k"))
    return cells.select("m", F.floor(F.col("k") / columns).cast("int").alias("i"), (F.col("k") % columns).alias("j"), (F.col("k") / (rows * columns) * span + mean).alias("v"))


def sums(a: DataFrame, by: str | None = None, how: str = "sum") -> DataFrame:
    """(m, by, v): sum, mean (avg) or largest value (max) of a matrix, of its rows (i) or of its columns (j)."""
    return a.groupBy("m", *([by] if by else [])).agg(getattr(F, how)("v").alias("v"))


def frobenius(a: DataFrame) -> DataFrame:
    """(m, v): the root of the sum of squares."""
    return a.groupBy("m").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def normalised(a: DataFrame) -> DataFrame:
    """Cells over the Frobenius norm; a matrix of zeros stays."""
    own = a.join(frobenius(a).withColumnRenamed("v", "n"), "m")
    return own.select(*CELL, F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(F.col("v")).alias("v"))


def in_range(a: DataFrame, low: float, high: float) -> DataFrame:
    ends = a.groupBy("m").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return a.join(ends, "m").select(*CELL, ((high - low) * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) + low).alias("v"))


def unit_columns(a: DataFrame, least: float = 1e-7) -> DataFrame:
    """Columns at length one; those no longer than `least` become 0."""
    norm = a.groupBy("m", "j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return a.join(norm, ["m", "j"]).select(*CELL, F.when(F.col("n") > least, F.col("v") / F.col("n")).otherwise(0.0).alias("v"))


def centred_columns(a: DataFrame) -> DataFrame:
    mean = a.groupBy("m", "j").agg(F.avg("v").alias("n"))
    return a.join(mean, ["m", "j"]).select(*CELL, (F.col("v") - F.col("n")).alias("v"))


def polynomials(feat: Column) -> Column:
    """1, the elements, and the products of each element with itself and those after it."""
    pairs = F.flatten(F.transform(feat, lambda x, k: F.transform(F.slice(feat, k + 1, F.size(feat)), lambda y: x * y)))
    return F.concat(F.array(F.lit(1.0)), feat, pairs)


# --- small dense matrices


def as_rows(a: DataFrame) -> DataFrame:
    """(m, rows) of matrices without missing cells."""
    line = a.groupBy("m", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("line"))
    return line.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda c: c["line"]).alias("rows"))


def as_cells(dense: DataFrame, column: str = "rows") -> DataFrame:
    line = dense.select("m", F.posexplode(column).alias("i", "line"))
    return line.select("m", "i", F.posexplode("line").alias("j", "v"))


def _dense(dense: DataFrame, fn: Callable[[np.ndarray], dict[str, object]], shape: str) -> DataFrame:
    """fn of each matrix, many matrices to a batch."""

    def run(frames):
        for pdf in frames:
            rows = [fn(np.array([list(r) for r in x], float)) for x in pdf["rows"]]
            yield pd.DataFrame({"m": pdf["m"], **{k: [r[k] for r in rows] for k in (rows[0] if rows else [])}})

    return dense.select("m", "rows").mapInPandas(run, f"m {dict(dense.dtypes)['m']}, {shape}")


def inverse(dense: DataFrame) -> DataFrame:
    """(m, rows); a singular matrix raises an error."""
    return _dense(dense, lambda x: {"rows": np.linalg.inv(x).tolist()}, "rows array<array<double>>")


def pseudo_inverse(dense: DataFrame) -> DataFrame:
    return _dense(dense, lambda x: {"rows": np.linalg.pinv(x).tolist()}, "rows array<array<double>>")


def determinant(dense: DataFrame) -> DataFrame:
    return _dense(dense, lambda x: {"v": float(np.linalg.det(x))}, "v double")


def cofactors(dense: DataFrame) -> DataFrame:
    def fn(x: np.ndarray) -> dict:
        n = len(x)
        minor = lambda i, j: np.linalg.det(np.delete(np.delete(x, i, 0), j, 1)) if n > 1 else 1.0
        return {"rows": [[float((-1) ** (i + j) * minor(i, j)) for j in range(n)] for i in range(n)]}

    return _dense(dense, fn, "rows array<array<double>>")


def singular_values(dense: DataFrame) -> DataFrame:
    """(m, u, s, vt); the component of each left vector largest in size is positive."""

    def fn(x: np.ndarray) -> dict:
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        return {"u": (u * sign).tolist(), "s": s.tolist(), "vt": (vt * sign[:, None]).tolist()}

    return _dense(dense, fn, "u array<array<double>>, s array<double>, vt array<array<double>>")


def eigenvalues(dense: DataFrame) -> DataFrame:
    """(m, s): real parts, the largest first."""
    return _dense(dense, lambda x: {"s": sorted(np.linalg.eigvals(x).real.tolist(), reverse=True)}, "s array<double>")


# --- affine transforms: 4 x 4 matrices as plain lists of rows


def rotation(axis: str, degrees: float) -> np.ndarray:
    """About x, y or z, counter-clockwise seen from its tip."""
    k = "xyz".index(axis)
    a, b = (k + 1) % 3, (k + 2) % 3
    out, t = np.eye(4), np.deg2rad(degrees)
    out[a, a] = out[b, b] = np.cos(t)
    out[a, b], out[b, a] = -np.sin(t), np.sin(t)
    return out


def translation(x: float, y: float, z: float) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = x, y, z
    return out


def scaling(x: float, y: float, z: float) -> np.ndarray:
    return np.diag([x, y, z, 1.0])


def moved(points: DataFrame, matrix: np.ndarray, whole: bool = False) -> DataFrame:
    """Points (..., x, y, z) by an affine matrix, in column expressions; `whole` rounds to voxels."""
    place = [sum((float(matrix[r, c]) * F.col(n) for c, n in enumerate("xyz")), F.lit(float(matrix[r, 3]))) for r in range(3)]
    return points.withColumns({n: F.round(F.round(p, 9)).cast("int") if whole else p for n, p in zip("xyz", place)})


# --- tensors of cells (t, index, v)


def tensor(cells: DataFrame, shape: tuple[int, ...], column: str = "k") -> DataFrame:
    """Cells (t, k, v) numbered row by row as a tensor."""
    index, rest = [], F.col(column)
    for n in reversed(shape):
        index.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return cells.select("t", F.array(*reversed(index)).alias("index"), "v")


def flat(index: Column, shape: tuple[int, ...]) -> Column:
    return reduce(lambda s, k: s * shape[k] + index[k], range(len(shape)), F.lit(0))


def tensor_reshaped(a: DataFrame, shape: tuple[int, ...], to: tuple[int, ...]) -> DataFrame:
    return tensor(a.withColumn("k", flat(F.col("index"), shape)), to)


def tensor_part(a: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Cells whose indices are from the first up to, without, the second number of each axis, counted from 0 again."""
    keep = reduce(lambda x, y: x & y, [(F.col("index")[k] >= lo) & (F.col("index")[k] < hi) for k, (lo, hi) in enumerate(bounds)])
    return a.where(keep).withColumn("index", F.array(*[F.col("index")[k] - lo for k, (lo, _) in enumerate(bounds)]))


def tensor_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums over the last axis of a and the first of b."""
    left = a.select("t", F.slice("index", 1, F.size("index") - 1).alias("p"), F.element_at("index", -1).alias("k"), F.col("v").alias("x"))
    right = b.select("t", F.col("index")[0].alias("k"), F.slice("index", 2, F.size("index") - 1).alias("q"), F.col("v").alias("y"))
    return left.join(right, ["t", "k"]).groupBy("t", F.concat("p", "q").alias("index")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def ranked_rows(a: DataFrame) -> DataFrame:
    """(m, i, v, rank): rows by their sums, the largest first."""
    return sums(a, "i").withColumn("rank", F.row_number().over(W.partitionBy("m").orderBy(F.desc("v"), "i")))
