"""Shapes in label images and masks as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import raster
from ..operators import shapes as Z
from .pictures import IM, _cells, _images, _mask
from .queries import CROSS, PX, query, r4

#: Label images: the values of four bins, whose lowest is the background.
LBL = IM + ", lp AS (SELECT image, y, x, CAST(greatest(0, floor(val / 100) + 1) AS BIGINT) AS val FROM ip), sz AS (SELECT image, max(y) AS h FROM lp GROUP BY image)"


def _labels(spark, sf) -> DataFrame:
    return _images(spark, sf).withColumn("line", F.transform("line", lambda v: F.greatest(F.lit(0.0), F.floor(v / 100) + 1)))


def _pixels(spark, sf) -> DataFrame:
    """Blocks of 8 x 8 pixels with a label each, as pixels."""
    px = T.pixels(_images(spark, sf))
    return px.select("image", F.col("x").cast("long").alias("x"), "y", F.when(F.col("val") > -40, F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).otherwise(0).alias("val"))


_RIM = "(x IN (0, 63) OR y = 0 OR y = max(y) OVER (PARTITION BY image))"
BK = IM + ", bk AS MATERIALIZED (SELECT image, x, y, CASE WHEN val > -40 THEN (y // 8) * 8 + x // 8 + 1 ELSE 0 END AS val FROM ip)"
_OTHER = " OR ".join(f"coalesce((SELECT q.val FROM lp q WHERE q.image = p.image AND q.x = p.x + {dx} AND q.y = p.y + {dy}), -1) <> p.val" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@query("shape_borders", f"WITH {LBL} SELECT p.image, p.y, p.x, CASE WHEN p.val <> 0 AND ({_OTHER}) THEN p.val ELSE 0 END + 0.0 AS val FROM lp p")
def _(spark, sf):
    return _cells(Z.object_borders(_labels(spark, sf)))


@query("shape_border_set", f"WITH {LBL} SELECT p.image, p.y, p.x, p.val + 0.0 AS val FROM lp p WHERE p.val <> 0 AND ({_OTHER})")
def _(spark, sf):
    return Z.object_border_set(_labels(spark, sf)).select("image", "y", F.col("x").cast("long").alias("x"), "val")


@query("shape_inside_set", f"WITH {LBL} SELECT p.image, p.y, p.x, p.val + 0.0 AS val FROM lp p WHERE p.val <> 0 AND NOT ({_OTHER})")
def _(spark, sf):
    lines = _labels(spark, sf)
    return Z.inside_set(T.pixels(lines).select("image", "x", "y", "val"), Z.object_border_set(lines)).select("image", "y", F.col("x").cast("long").alias("x"), "val")


@query("shape_rim_set", f"WITH {BK} SELECT image, y, x, val FROM ip QUALIFY {_RIM}")
def _(spark, sf):
    return Z.border_set(_images(spark, sf)).select("image", "y", F.col("x").cast("long").alias("x"), "val")


@query("shape_relabelled", f"WITH {BK} SELECT image, x, y, CASE WHEN val = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY image, val <> 0 ORDER BY val) END AS val FROM bk")
def _(spark, sf):
    return Z.relabelled(_pixels(spark, sf)).withColumn("val", F.col("val").cast("long"))


@query("shape_without_small", f"WITH {BK} SELECT image, x, y, CASE WHEN count(*) OVER (PARTITION BY image, val) >= 40 THEN val ELSE 0 END AS val FROM bk")
def _(spark, sf):
    return Z.without_small(_pixels(spark, sf), 40)


@query("shape_without_border_regions", f"WITH {BK}, r AS (SELECT DISTINCT image, val FROM (SELECT * FROM bk QUALIFY {_RIM})) SELECT image, x, y, CASE WHEN r.val IS NULL THEN bk.val ELSE 0 END AS val FROM bk LEFT JOIN r USING (image, val)")
def _(spark, sf):
    return Z.without_border_regions(_pixels(spark, sf))


_SIDES = " UNION ALL ".join(f"SELECT s.image, s.val, q.val AS o FROM s JOIN l q ON q.image = s.image AND q.x = s.x + {dx} AND q.y = s.y + {dy}" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@query("shape_absorbed", f"WITH {BK}, k AS (SELECT *, count(*) OVER (PARTITION BY image, val) AS n FROM bk), s AS (SELECT * FROM k WHERE n < 40), l AS (SELECT * FROM k WHERE n >= 40), c AS (SELECT image, val, o, count(*) AS n FROM ({_SIDES}) GROUP BY ALL), t AS (SELECT image, val, arg_max(o, (n, -o)) AS o FROM c GROUP BY image, val) SELECT image, x, y, coalesce(t.o, bk.val) AS val FROM bk LEFT JOIN t USING (image, val)")
def _(spark, sf):
    return Z.absorbed(_pixels(spark, sf), 40)


@query("shape_spaced_seeds", f"WITH {BK} SELECT image, x, y, val FROM bk WHERE val <> 0 AND y % 6 = 3 AND (x + CASE WHEN (y // 6) % 2 = 1 THEN 3 ELSE 0 END) % 6 = 3")
def _(spark, sf):
    return Z.spaced_seeds(_pixels(spark, sf), 6, mixed=True)


@query("shape_drawn", f"WITH {BK} SELECT image, x, y, val FROM bk WHERE val <> 0 ORDER BY CAST(('0x' || substr(md5('1:' || image || ',' || x || ',' || y), 1, 8)) AS BIGINT), image, x, y LIMIT 50")
def _(spark, sf):
    return Z.drawn_from_mask(_pixels(spark, sf), 50)


for _name, _fn in {
    "shape_open_rec": lambda r: Z.open_by_reconstruction(r, CROSS),
    "shape_close_rec": lambda r: Z.close_by_reconstruction(r, CROSS),
    "shape_open_domes": lambda r: Z.open_domes(r, CROSS),
    "shape_area_closing": lambda r: Z.area_closing(r, 5),
    "shape_max_tree": Z.max_tree,
    "shape_min_tree": lambda r: Z.max_tree(r, darkest=True),
    "shape_volume_opening": lambda r: Z.volume_opening(r, 200.0),
    "shape_volume_closing": lambda r: Z.volume_closing(r, 200.0),
    "shape_border_distance": lambda r: Z.border_distance(_bins(r)),
    "shape_nearest": lambda r: Z.nearest_in_set(r, lambda a: a > 250),
    "shape_geodesic": lambda r: Z.geodesic_distance(_mask(r), _corner),
    "shape_medial_axis": lambda r: Z.medial_axis(_mask(r)),
    "shape_of_axis": lambda r: Z.shape_of_axis(Z.medial_axis(_mask(r))),
    "shape_flooded": lambda r: Z.flooded(r, _spots),
    "shape_flooded_height": lambda r: Z.flooded(r, _spots, "height"),
    "shape_flooded_rise": lambda r: Z.flooded(r, _spots, "rise"),
    "shape_water_gray": lambda r: Z.water_gray(raster.gaussian_filter(r, 1.5, 1.0), 40.0),
    "shape_dynamic_object": lambda r: Z.dynamic_trees(r, _spots),
    "shape_dynamic_root": lambda r: Z.dynamic_trees(r, _spots, by_object=False),
    "shape_slic": lambda r: Z.slic(r, 40),
}.items():
    query(_name)(lambda spark, sf, fn=_fn: _cells(fn(_images(spark, sf))))


def _bins(r: DataFrame) -> DataFrame:
    return r.withColumn("line", F.transform("line", lambda v: F.greatest(F.lit(0.0), F.floor(v / 100) + 1)))


def _corner(a: np.ndarray) -> np.ndarray:
    out = np.zeros(a.shape, bool)
    out[:4, :4] = True
    return out


def _spots(a: np.ndarray) -> np.ndarray:
    """Two seeds."""
    out = np.zeros(a.shape, int)
    out[a.shape[0] // 4, a.shape[1] // 4], out[3 * a.shape[0] // 4, 3 * a.shape[1] // 4] = 1, 2
    return out


@query("shape_signed_distance", f"WITH {IM}, m AS (SELECT image, x, y, val > -60 AS o FROM ip) SELECT p.image, p.y, p.x, round(CASE WHEN p.o THEN 1 ELSE -1 END * sqrt(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 4) + 0.0 AS val FROM m p JOIN m q ON p.image = q.image AND p.o <> q.o GROUP BY p.image, p.y, p.x, p.o")
def _(spark, sf):
    return _cells(Z.signed_distance(_mask(_images(spark, sf))))


@query("shape_set_distance", f"WITH {IM} SELECT p.image, p.y, p.x, min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) + 0.0 AS val FROM ip p JOIN ip q ON p.image = q.image AND q.val > 250 GROUP BY p.image, p.y, p.x")
def _(spark, sf):
    got = _cells(Z.set_distance(_images(spark, sf), lambda a: a > 250))
    return got.where(F.col("val") < float("inf"))


@query("prior_centre", f"WITH {PX} SELECT x, y, round(exp(-(pow((x - 31.5) / 64, 2) + pow((y - 31.5) / 64, 2)) / 0.09), 4) AS prior FROM px")
def _(spark, sf):
    from .queries import _px

    return _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", r4(Z.centre_prior(F.col("x"), F.col("y"), 64, 64, 0.3)).alias("prior"))


_TL = PX + ", tl AS (SELECT x, y, val, (y // 8) * 8 + x // 8 AS label FROM px)"


def _tl(spark, sf) -> DataFrame:
    from .queries import _px

    return _px(spark, sf).withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long"))


@query("prior_focus", f"WITH {_TL}, s AS (SELECT label, stddev_pop(val) AS s FROM tl GROUP BY label) SELECT label, round(s / max(s) OVER (), 4) AS focus FROM s")
def _(spark, sf):
    return Z.focus_prior(_tl(spark, sf), "label", "val").withColumn("focus", r4("focus"))


@query("prior_ellipse", f"WITH {_TL}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM tl GROUP BY label), d AS (SELECT label, round((vy * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - c * c), 9) AS d, vx * vy - c * c AS det FROM tl JOIN m USING (label)) SELECT label, round(avg(CASE WHEN det > 0 AND d <= 4 THEN 1.0 ELSE 0.0 END), 4) AS fit FROM d GROUP BY label")
def _(spark, sf):
    return Z.ellipse_prior(_tl(spark, sf), "label").withColumn("fit", r4("fit"))
