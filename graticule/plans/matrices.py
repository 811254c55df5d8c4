"""Matrix and tensor operators as queries: each sample's 64 features are a matrix of 8 x 8 cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import matrices as A
from .queries import LONG, query, r4

MC = LONG + ", mc AS (SELECT id AS m, dim // 8 AS i, dim % 8 AS j, v FROM c)"
#: The same cells with numbers above zero, and a second matrix: its transposed.
MP = MC + ", mp AS (SELECT m, i, j, abs(v) + 0.01 AS v FROM mc), tr AS (SELECT m, j AS i, i AS j, v FROM mp)"


def _cells(spark, sf) -> DataFrame:
    long = T.components(T.samples(spark, sf))
    return long.select(F.col("id").alias("m"), F.floor(F.col("dim") / 8).cast("long").alias("i"), (F.col("dim") % 8).cast("long").alias("j"), "v")


def _positive(spark, sf) -> DataFrame:
    return _cells(spark, sf).withColumn("v", F.abs("v") + 0.01)


def _out(df: DataFrame) -> DataFrame:
    return df.select("m", *[F.col(c).cast("long").alias(c) for c in ("i", "j") if c in df.columns], r4("v").alias("v"))


def _vector(cells: DataFrame) -> DataFrame:
    return cells.where("i = 0").select("m", F.col("j").alias("k"), F.col("v").alias("w"))


_R = "round({0}, 4) + 0.0 AS v"
CELLWISE: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "matrix_transposed": (A.transposed, f"SELECT m, j AS i, i AS j, {_R.format('v')} FROM mp"),
    "matrix_square": (lambda a: A.product(a, A.transposed(a)), f"SELECT a.m, a.i, b.j, {_R.format('sum(a.v * b.v)')} FROM mp a JOIN tr b ON a.m = b.m AND a.j = b.i GROUP BY ALL"),
    "matrix_chain": (lambda a: A.chain(a, a, a), f", p AS (SELECT a.m, a.i, b.j, sum(a.v * b.v) AS v FROM mp a JOIN mp b ON a.m = b.m AND a.j = b.i GROUP BY ALL) SELECT a.m, a.i, b.j, {_R.format('sum(a.v * b.v)')} FROM p a JOIN mp b ON a.m = b.m AND a.j = b.i GROUP BY ALL"),
    **{f"matrix_{n}": (lambda a, s=s: A.pointwise(a, A.transposed(a), s), f"SELECT m, i, j, {_R.format(f'a.v {s} b.v')} FROM mp a JOIN tr b USING (m, i, j)") for n, s in (("added", "+"), ("subtracted", "-"), ("multiplied", "*"), ("divided", "/"))},
    "matrix_scalar": (lambda a: A.with_scalar(A.with_scalar(a, 2.0, "/", first=True), 3.0, "-"), f"SELECT m, i, j, {_R.format('2 / v - 3')} FROM mp"),
    "matrix_row_vector": (lambda a: A.with_vector(a, _vector(a), "/"), f"SELECT a.m, a.i, a.j, {_R.format('a.v / b.v')} FROM mp a JOIN mp b ON a.m = b.m AND a.j = b.j AND b.i = 0"),
    "matrix_column_vector": (lambda a: A.with_vector(a, _vector(a), "*", by_row=False), f"SELECT a.m, a.i, a.j, {_R.format('a.v * b.v')} FROM mp a JOIN mp b ON a.m = b.m AND a.i = b.j AND b.i = 0"),
    "matrix_powers": (lambda a: A.powers(a, 1.5), f"SELECT m, i, j, {_R.format('pow(v, 1.5)')} FROM mp"),
    "matrix_logarithms": (A.logarithms, f"SELECT m, i, j, {_R.format('ln(v)')} FROM mp"),
    "matrix_saturated": (lambda a: A.saturated(A.saturated(a, 0.12), 0.05, upper=False), f"SELECT m, i, j, {_R.format('greatest(0.05, least(0.12, v))')} FROM mp"),
    "matrix_part": (lambda a: A.part(a, (2, 5), (1, 7)), f"SELECT m, i - 2 AS i, j - 1 AS j, {_R.format('v')} FROM mp WHERE i BETWEEN 2 AND 4 AND j BETWEEN 1 AND 6"),
    "matrix_reshaped": (lambda a: A.reshaped(a, 8, 16), f"SELECT m, (i * 8 + j) // 16 AS i, (i * 8 + j) % 16 AS j, {_R.format('v')} FROM mp"),
    "matrix_extended": (lambda a: A.extended(a, (8, 8), (10, 11)), f"SELECT m, i, j, {_R.format('v')} FROM mp UNION ALL SELECT m, d, d, 1.0 FROM (SELECT DISTINCT m FROM mp), range(8, 10) t(d)"),
    "matrix_resized": (lambda a: A.resized(a, 3, 20), f"SELECT m, i, j, {_R.format('v')} FROM mp WHERE i < 3"),
    "matrix_diagonal": (A.diagonal, f"SELECT m, 0 AS i, j, {_R.format('v')} FROM mp WHERE i = j"),
    "matrix_from_diagonal": (lambda a: A.from_diagonal(_vector(a)), f"SELECT m, j AS i, j, {_R.format('v')} FROM mp WHERE i = 0"),
    "matrix_identity": (lambda a: A.identity(a.select("m").distinct(), 3), "SELECT m, d AS i, d AS j, 1.0 AS v FROM (SELECT DISTINCT m FROM mp), range(0, 3) t(d)"),
    "matrix_ramp": (lambda a: A.ramp(a.select("m").distinct(), 4, 5, 1.0, 2.0), f"SELECT m, d // 5 AS i, d % 5 AS j, {_R.format('d / 20.0 * 2 + 1')} FROM (SELECT DISTINCT m FROM mp), range(0, 20) t(d)"),
    "matrix_total": (A.sums, f"SELECT m, {_R.format('sum(v)')} FROM mp GROUP BY m"),
    "matrix_row_sums": (lambda a: A.sums(a, "i"), f"SELECT m, i, {_R.format('sum(v)')} FROM mp GROUP BY m, i"),
    "matrix_column_sums": (lambda a: A.sums(a, "j"), f"SELECT m, j, {_R.format('sum(v)')} FROM mp GROUP BY m, j"),
    "matrix_column_means": (lambda a: A.sums(a, "j", "avg"), f"SELECT m, j, {_R.format('avg(v)')} FROM mp GROUP BY m, j"),
    "matrix_row_maxima": (lambda a: A.sums(a, "i", "max"), f"SELECT m, i, {_R.format('max(v)')} FROM mp GROUP BY m, i"),
    "matrix_column_maxima": (lambda a: A.sums(a, "j", "max"), f"SELECT m, j, {_R.format('max(v)')} FROM mp GROUP BY m, j"),
    "matrix_frobenius": (A.frobenius, f"SELECT m, {_R.format('sqrt(sum(v * v))')} FROM mp GROUP BY m"),
    "matrix_normalised": (A.normalised, f"SELECT m, i, j, {_R.format('v / sqrt(sum(v * v) OVER (PARTITION BY m))')} FROM mp"),
    "matrix_in_range": (lambda a: A.in_range(a, -1.0, 1.0), f"SELECT m, i, j, {_R.format('2 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) - 1')} FROM mp WINDOW w AS (PARTITION BY m)"),
    "matrix_unit_columns": (A.unit_columns, f"SELECT m, i, j, {_R.format('v / sqrt(sum(v * v) OVER (PARTITION BY m, j))')} FROM mp"),
    "matrix_centred": (A.centred_columns, f"SELECT m, i, j, {_R.format('v - avg(v) OVER (PARTITION BY m, j)')} FROM mp"),
}


def _cellwise(fn) -> Callable:
    return lambda spark, sf: _out(fn(_positive(spark, sf)))


for _name, (_fn, _sql) in CELLWISE.items():
    query(_name, f"WITH {MP}{_sql if _sql.startswith(',') else ' ' + _sql}")(_cellwise(_fn))


@query("matrix_polynomials", f"WITH {LONG}, f AS (SELECT id, list(v ORDER BY dim) AS f FROM c WHERE dim < 4 GROUP BY id), p AS (SELECT id, list_concat([1.0], f, [f[1] * f[1], f[1] * f[2], f[1] * f[3], f[1] * f[4], f[2] * f[2], f[2] * f[3], f[2] * f[4], f[3] * f[3], f[3] * f[4], f[4] * f[4]]) AS p FROM f) SELECT id, unnest(range(0, 15)) AS k, round(unnest(p), 6) + 0.0 AS v FROM p")
def _(spark, sf):
    p = A.polynomials(F.slice("feat", 1, 4))
    return T.samples(spark, sf).select("id", F.posexplode(p).alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), (F.round("v", 6) + 0.0).alias("v"))


def _dense(spark, sf) -> DataFrame:
    """The upper left 3 x 3 cells, with more on the diagonal so that they can be inverted."""
    a = _positive(spark, sf).where("i < 3 and j < 3")
    return A.as_rows(a.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))


_D = MP + ", d AS (SELECT m, i, j, v + CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM mp WHERE i < 3 AND j < 3), w AS (SELECT m, " + ", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS v{i}{j}" for i in range(3) for j in range(3)) + " FROM d GROUP BY m)"


def _minor(i: int, j: int) -> str:
    (a, b), (c, d) = [[f"v{r}{k}" for k in range(3) if k != j] for r in range(3) if r != i]
    return f"{'-' if (i + j) % 2 else ''}({a} * {d} - {b} * {c})"


_DET = "(" + " + ".join(f"v0{j} * {_minor(0, j)}" for j in range(3)) + ")"


def _nine(cell: Callable[[int, int], str]) -> str:
    return " UNION ALL ".join(f"SELECT m, {i} AS i, {j} AS j, round({cell(i, j)}, 4) + 0.0 AS v FROM w" for i in range(3) for j in range(3))


@query("matrix_determinant", f"WITH {_D} SELECT m, round({_DET}, 4) + 0.0 AS v FROM w")
def _(spark, sf):
    return A.determinant(_dense(spark, sf)).select("m", r4("v").alias("v"))


@query("matrix_cofactors", f"WITH {_D} {_nine(_minor)}")
def _(spark, sf):
    return _out(A.as_cells(A.cofactors(_dense(spark, sf))))


@query("matrix_inverse", f"WITH {_D} {_nine(lambda i, j: _minor(j, i) + ' / ' + _DET)}")
def _(spark, sf):
    return _out(A.as_cells(A.inverse(_dense(spark, sf))))


@query("matrix_pseudo_inverse", f"WITH {_D} {_nine(lambda i, j: _minor(j, i) + ' / ' + _DET)}")
def _(spark, sf):
    return _out(A.as_cells(A.pseudo_inverse(_dense(spark, sf))))


@query("matrix_singular_values", f"WITH {_D} SELECT m, round(sqrt((SELECT sum(v * v) FROM d WHERE d.m = w.m)), 3) AS norm, round(abs({_DET}), 3) AS volume FROM w")
def _(spark, sf):
    """The root of the sum of squares, and the product, of singular values, which are the norm and the determinant's size."""
    s = A.singular_values(_dense(spark, sf))
    return s.select("m", F.round(F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, v: t + v * v)), 3).alias("norm"), F.round(F.aggregate("s", F.lit(1.0), lambda t, v: t * v), 3).alias("volume"))


@query("matrix_eigenvalues", f"WITH {_D} SELECT m, round(v00 + v11 + v22, 3) AS trace FROM w")
def _(spark, sf):
    """The sum of the eigenvalues, which is the trace."""
    return A.eigenvalues(_dense(spark, sf)).select("m", F.round(F.aggregate("s", F.lit(0.0), lambda t, v: t + v), 3).alias("trace"))


_c, _s = float(np.cos(np.deg2rad(30))), float(np.sin(np.deg2rad(30)))


@query("points_moved", f"SELECT o_orderkey, round(2 * ({_c!r} * (o_custkey % 90) - {_s!r} * (o_custkey % 70)) + 5, 4) + 0.0 AS x, round(3 * ({_s!r} * (o_custkey % 90) + {_c!r} * (o_custkey % 70)) - 1, 4) + 0.0 AS y, round(0.5 * (o_custkey % 11) + 2, 4) + 0.0 AS z FROM orders")
def _(spark, sf):
    o = T.read(spark, sf, "orders").select("o_orderkey", *[(F.col("o_custkey") % k).cast("double").alias(n) for n, k in (("x", 90), ("y", 70), ("z", 11))])
    return A.moved(o, A.translation(5, -1, 2) @ A.scaling(2, 3, 0.5) @ A.rotation("z", 30)).select("o_orderkey", *[r4(n).alias(n) for n in "xyz"])


@query("voxels_moved", "SELECT o_orderkey, CAST(o_custkey % 70 AS INTEGER) * -1 + 4 AS x, CAST(o_custkey % 90 AS INTEGER) AS y, CAST(o_custkey % 11 AS INTEGER) AS z FROM orders")
def _(spark, sf):
    o = T.read(spark, sf, "orders").select("o_orderkey", *[(F.col("o_custkey") % k).cast("double").alias(n) for n, k in (("x", 90), ("y", 70), ("z", 11))])
    return A.moved(o, A.translation(4, 0, 0) @ A.rotation("z", 90), whole=True)


TN = LONG + ", tn AS (SELECT id AS t, dim // 16 AS a, dim // 4 % 4 AS b, dim % 4 AS c, v FROM c)"


def _tensor(spark, sf) -> DataFrame:
    return A.tensor(T.components(T.samples(spark, sf)).select(F.col("id").alias("t"), F.col("dim").alias("k"), "v"), (4, 4, 4))


def _axes(df: DataFrame, names: str) -> DataFrame:
    return df.select("t", *[F.col("index")[k].cast("long").alias(n) for k, n in enumerate(names)], r4("v").alias("v"))


@query("tensor_cells", f"WITH {TN} SELECT t, a, b, c, round(v, 4) + 0.0 AS v FROM tn")
def _(spark, sf):
    return _axes(_tensor(spark, sf), "abc")


@query("tensor_reshaped", f"WITH {LONG} SELECT id AS t, dim // 32 AS a, dim % 32 AS b, round(v, 4) + 0.0 AS v FROM c")
def _(spark, sf):
    return _axes(A.tensor_reshaped(_tensor(spark, sf), (4, 4, 4), (2, 32)), "ab")


@query("tensor_part", f"WITH {TN} SELECT t, a - 1 AS a, b, c - 2 AS c, round(v, 4) + 0.0 AS v FROM tn WHERE a BETWEEN 1 AND 2 AND c >= 2")
def _(spark, sf):
    return _axes(A.tensor_part(_tensor(spark, sf), [(1, 3), (0, 4), (2, 4)]), "abc")


@query("tensor_product", f"WITH {TN} SELECT x.t, x.a, x.b, y.b AS c, y.c AS d, round(sum(x.v * y.v), 4) + 0.0 AS v FROM tn x JOIN tn y ON x.t = y.t AND x.c = y.a GROUP BY ALL")
def _(spark, sf):
    one = _tensor(spark, sf)
    return _axes(A.tensor_product(one, one), "abcd")


@query("rows_by_sum", f"WITH {MP}, s AS (SELECT m, i, sum(v) AS v FROM mp GROUP BY m, i) SELECT m, i, row_number() OVER (PARTITION BY m ORDER BY v DESC, i) AS rank FROM s")
def _(spark, sf):
    return A.ranked_rows(_positive(spark, sf)).select("m", "i", F.col("rank").cast("long").alias("rank"))
