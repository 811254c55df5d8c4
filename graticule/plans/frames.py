"""Frames, local filters, resampling and spectra as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import frames as R
from ..operators import pictures, raster
from .queries import BOX, CROSS, DISK, PX, _lines, _over, _px, _stencil_sql, _taps, query, r4

_HEIGHTS = [0.0, -5.0, -3.0, -5.0, -3.0, -3.0, -5.0, -3.0, -5.0]
_LOP = [(0, 0), (1, 0), (2, 0), (0, 1), (-1, -1)]
_LOPW = [0.5, 1.0, -2.0, 0.25, 3.0]

_d = np.array(BOX[1:], float)
_len = np.hypot(_d[:, 0], _d[:, 1])
_gw = np.exp(-_len / (4 / 9)) / _len
_GX = " + ".join(f"coalesce(max(q.val - p.val) FILTER (t.i = {k + 1}), 0) * {float(_d[k, 0] * _gw[k])!r}" for k in range(8))
_GY = " + ".join(f"coalesce(max(q.val - p.val) FILTER (t.i = {k + 1}), 0) * {float(_d[k, 1] * _gw[k])!r}" for k in range(8))
_BL = "exp(-(t.dx * t.dx + t.dy * t.dy) / 4.5) * exp(-(q.val - p.val) * (q.val - p.val) / 20000.0)"
_OPEN = _over("min", "px", "a1") + _over("max", "a1", "a2")
_CLOSE = _over("max", "px", "a1") + _over("min", "a1", "a2")
_own = lambda q: q.replace("GROUP BY p.x, p.y", "GROUP BY p.x, p.y, p.val")

LOCAL = {
    "frame_gradient": (lambda r: R.gradient_magnitude(r, BOX), _own(_stencil_sql(BOX, f"floor(round(sqrt(pow({_GX}, 2) + pow({_GY}, 2)), 6))"))),
    "frame_domes": (lambda r: R.domes(raster.basins(r, BOX), 1000.0), None),
    "frame_open_close": (lambda r: R.open_close(r, BOX), _stencil_sql(BOX, "min(q.val)", source="a3", prefix=_OPEN + _over("max", "a2", "a3"))),
    "frame_close_open": (lambda r: R.close_open(r, BOX), _stencil_sql(BOX, "max(q.val)", source="a3", prefix=_CLOSE + _over("min", "a2", "a3"))),
    "frame_dilate_by": (lambda r: R.dilate_by(r, BOX, _HEIGHTS), _stencil_sql(BOX, "max(q.val + t.w)", _HEIGHTS)),
    "frame_erode_by": (lambda r: R.erode_by(r, BOX, _HEIGHTS), _stencil_sql(BOX, "min(q.val - t.w)", _HEIGHTS)),
    "frame_open_by": (lambda r: R.open_by(r, BOX, _HEIGHTS), None),
    "frame_close_by": (lambda r: R.close_by(r, BOX, _HEIGHTS), None),
    "frame_convolved": (lambda r: R.convolved(r, _LOP, _LOPW), _stencil_sql([(-x, -y) for x, y in _LOP], "round(sum(q.val * t.w), 4) + 0.0", _LOPW)),
    "frame_in_region": (lambda r: R.in_region(raster.mean_filter(r, CROSS), r, lambda v: v > 0), _own(_stencil_sql(CROSS, "CASE WHEN p.val > 0 THEN round(sum(q.val) / count(*)) + 0.0 ELSE p.val END"))),
    "frame_bilateral": (lambda r: R.bilateral(r, BOX, 1.5, 100.0), _own(_stencil_sql(BOX, f"round(sum(q.val * {_BL}) / sum({_BL}), 4) + 0.0"))),
    "frame_local_norm": (lambda r: R.locally_normalised(r, BOX), _own(_stencil_sql(BOX, "CASE WHEN sum(q.val * q.val) > 0 THEN round(p.val / sqrt(sum(q.val * q.val)), 4) + 0.0 ELSE 0.0 END"))),
    "frame_divisive_norm": (lambda r: R.divisively_normalised(r, BOX, 255), _own(_stencil_sql(BOX, "CASE WHEN coalesce(sum(q.val * q.val) FILTER (t.i > 0), 0) > 0 THEN trunc(round(p.val / sqrt(sum(q.val * q.val) FILTER (t.i > 0)) * 255, 6)) + 0.0 ELSE 0.0 END"))),
    "frame_scaled_norm": (
        lambda r: R.normalised_by_frame(r, BOX, 255),
        "WITH n AS (" + _own(_stencil_sql(BOX, "CASE WHEN floor(round(sqrt(sum(q.val * q.val)), 6)) > 0 THEN p.val / floor(round(sqrt(sum(q.val * q.val)), 6)) END")) + ") SELECT x, y, coalesce(floor(round(255 * (val - min(val) OVER ()) / (max(val) OVER () - min(val) OVER ()), 6)), 0.0) AS val FROM n",
    ),
    "frame_smoothed": (lambda r: R.smoothed(r, 1.5, 1.0, lambda v: v > 0), None),
}
for _name, (_fn, _sql) in LOCAL.items():
    query(_name, _sql)(_lines(_fn))


@query("frame_offsets", "SELECT * FROM (VALUES ('ball', 19, 0), ('box', 45, 0), ('clockwise', 9, 0), ('cross', 9, 0), ('cuboid', 45, 0), ('half', 14, 5), ('layer', 9, 0), ('one_way', 7, 3), ('rim', 8, 0), ('shell', 8, 0)) t(kind, n, total)")
def _(spark, sf):
    """How many offsets each kind of frame has, and the sum of their first numbers."""
    kinds = {
        "ball": R.ball(1.5), "box": R.box((3, 5, 3)), "clockwise": R.clockwise(1.5), "cross": R.cross(5, 5), "cuboid": R.cuboid(3, 5, 3, (2, 1, 1)), "half": R.half_ball(1.5, 0, 1), "layer": R.layer_frame((3, 3), (2, 2), 2),
        "one_way": R.one_way(raster.circle(2.0), 2.0), "rim": R.rim(raster.circle(2.0), raster.circle(1.0)), "shell": R.shell(raster.circle(2.0), 1.2, 2.0),
    }
    return spark.createDataFrame([(k, len(o), sum(t[0] for t in o)) for k, o in kinds.items()], "kind string, n int, total int")


@query("frame_bank", f"WITH {PX}, {_taps(BOX, [4, 1, 2, 1, 2, 2, 1, 2, 1])} SELECT p.x, p.y, round(sum(q.val * t.w), 4) + 0.0 AS b0, round(sum(q.val * (t.i - 4)), 4) + 0.0 AS b1 FROM px p CROSS JOIN t JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY p.x, p.y")
def _(spark, sf):
    got = R.filtered_bank(T.scanlines(spark, sf), BOX, [[4, 1, 2, 1, 2, 2, 1, 2, 1], [k - 4 for k in range(9)]])
    return got.select(F.col("x").cast("long").alias("x"), "y", r4(F.col("feat")[0]).alias("b0"), r4(F.col("feat")[1]).alias("b1"))


@query("frame_at_pixel", f"WITH {PX}, {_taps(BOX)}, f AS (SELECT q.val FROM t JOIN px q ON q.x = 10 + t.dx AND q.y = 20 + t.dy) SELECT min(val) AS least, list_sort(list(val))[1 + count(*) // 2] AS median, max(val) AS largest FROM f")
def _(spark, sf):
    return R.at_pixel(_px(spark, sf), 10, 20, BOX)


@query("frame_features", f"WITH {PX}, {_taps(CROSS)} SELECT p.x, p.y, CAST(7 AS INTEGER) AS n, round(sum(coalesce(q.val, p.val)), 4) + 0.0 AS v FROM px p CROSS JOIN t LEFT JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY p.x, p.y")
def _(spark, sf):
    got = R.frame_features(T.scanlines(spark, sf), CROSS, place=True)
    own = F.aggregate(F.slice("feat", 1, 5), F.lit(0.0), lambda s, v: s + v)
    return got.select(F.col("x").cast("long").alias("x"), "y", F.size("feat").alias("n"), r4(own).alias("v"))


_POINTS = "pt AS (SELECT o_orderkey AS p, (o_custkey % 640) / 10.0 AS px, (o_custkey % 530) / 10.0 AS py FROM orders)"


def _points(spark, sf):
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("p"), ((F.col("o_custkey") % 640) / 10).alias("px"), ((F.col("o_custkey") % 530) / 10).alias("py"))


_V = "max(q.val) FILTER (q.x = floor(px) + {0} AND q.y = floor(py) + {1})"


@query("values_between", f"WITH {PX}, {_POINTS}, c AS (SELECT p, px, py, {', '.join(f'{_V.format(a, b)} AS v{a}{b}' for a in (0, 1) for b in (0, 1))}, count(q.val) AS n FROM pt LEFT JOIN px q ON q.x BETWEEN floor(px) AND floor(px) + 1 AND q.y BETWEEN floor(py) AND floor(py) + 1 GROUP BY p, px, py), d AS (SELECT *, px - floor(px) AS dx, py - floor(py) AS dy FROM c) SELECT p, CASE WHEN n = 4 THEN round(round(v00 + dx * (v10 - v00) + dy * (v01 + dx * (v11 - v01) - v00 - dx * (v10 - v00)), 9)) + 0.0 ELSE coalesce(v00, 0.0) END AS val FROM d")
def _(spark, sf):
    return R.value_at(_px(spark, sf), _points(spark, sf)).withColumn("val", F.col("val") + 0.0)


@query("values_nearest", f"WITH {PX}, {_POINTS} SELECT p, q.val FROM pt JOIN px q ON q.x = greatest(0, least(63, round(px))) AND q.y = greatest(0, least(63, round(py)))")
def _(spark, sf):
    return R.nearest_value(_px(spark, sf), _points(spark, sf), 64, 64)


def _height(px) -> int:
    return px.agg(F.max("y")).first()[0] + 1


@query("picture_rotated", f"WITH {PX}, h AS (SELECT max(y) AS h FROM px) SELECT h - y AS x, x AS y, val FROM px, h")
def _(spark, sf):
    px = _px(spark, sf)
    return R.rotated(px, 64, _height(px), 90.0)


@query("picture_scaled", f"WITH {PX}, n AS (SELECT a.x AS x, b.y AS y FROM range(0, 32) a(x), range(0, 100000) b(y)) SELECT n.x, n.y, val FROM n JOIN px p ON p.x = 2 * n.x AND p.y = 2 * n.y")
def _(spark, sf):
    px = _px(spark, sf)
    return R.scaled(px, 64, _height(px), 0.5, 0.5)


@query("picture_profile", f"WITH {PX}, k AS (SELECT k, 2 + k AS x, CAST(round(round(5 + k * 20 / 40.0, 9)) AS BIGINT) AS y FROM range(0, 41) t(k)) SELECT k, x, y, val FROM k JOIN px USING (x, y)")
def _(spark, sf):
    return R.profile(_px(spark, sf), (2, 5), (42, 25))


@query("line_spectrum", f"WITH {PX}, k AS (SELECT k FROM range(0, 64) t(k)) SELECT y, k, round(sum(val * cos(2 * pi() * ((k * x) % 64) / 64)), 3) + 0.0 AS re, round(-sum(val * sin(2 * pi() * ((k * x) % 64) / 64)), 3) + 0.0 AS im FROM px, k GROUP BY y, k")
def _(spark, sf):
    got = R.line_spectrum(T.scanlines(spark, sf))
    cells = got.select("y", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    return cells.select("y", F.col("k").cast("long").alias("k"), (F.round("c.re", 3) + 0.0).alias("re"), (F.round("c.im", 3) + 0.0).alias("im"))


@query("low_passed")
def _(spark, sf):
    lines = T.scanlines(spark, sf)
    return T.pixels(pictures.per_image(lines, lambda a: R.low_passed(np.nan_to_num(a), 2, 0.3))).select("x", "y", r4("val").alias("val"))


@query("kernel_weights", f"WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {dx}, {dy})' for i, (dx, dy) in enumerate(DISK))}) u(k, dx, dy)) SELECT CAST(k AS INTEGER) AS k, 1.0 AS uniform, round(exp(-(dx * dx + dy * dy) / 2.0) / sum(exp(-(dx * dx + dy * dy) / 2.0)) OVER (), 6) AS gauss, round(exp(-pi() * (dx * dx / 9.0 + dy * dy / 16.0)) * cos(2 * pi() * 0.2 * (dx * cos(0.5) + dy * sin(0.5)) + 0.3), 6) AS gabor FROM t")
def _(spark, sf):
    gauss = R.gaussian_kernel(1.5, 1.0)[1]
    gabor = R.gabor_kernel(DISK, 3.0, 4.0, 0.2, 0.5, 0.3)[1]
    rows = [(k, 1.0, round(g, 6), round(b, 6)) for k, (g, b) in enumerate(zip(gauss, gabor))]
    return spark.createDataFrame(rows, "k int, uniform double, gauss double, gabor double")
