"""Whole-image operators, learners and the rest of the inventory as queries; each class's samples, one above the other, are an image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scalars as S
from ..operators import graphs, layers, learners, metrics, pictures, raster, samples
from .queries import ABS, CENT, LONG, PAIRS, PRED, PX, RGB, SM, TILE, _predicted, _px, _rgb, _tiled, query, r4

#: The images of the SQL side: y counts the samples of a class.
IM = """im AS (SELECT CAST(label AS VARCHAR) AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
  ip AS (SELECT image, y, unnest(range(0, len(embedding))) AS x, unnest(list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 1000))) AS val FROM im)"""


def _images(spark, sf) -> DataFrame:
    e = T.read(spark, sf, "embeddings")
    y = F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    return e.select(F.col("label").cast("string").alias("image"), y.alias("y"), F.transform("embedding", lambda v: F.round(v.cast("double") * 1000)).alias("line"))


def _cells(df: DataFrame) -> DataFrame:
    return T.pixels(df).select("image", "y", F.col("x").cast("long").alias("x"), r4("val").alias("val"))


def _mask(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.transform("line", lambda v: F.when(v > -60, 1.0).otherwise(0.0)))


@query("picture_distance_transform", f"WITH {IM} SELECT p.image, p.y, p.x, CASE WHEN p.val <= -60 THEN 0.0 ELSE min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) + 0.0 END AS val FROM ip p JOIN ip q ON p.image = q.image AND q.val <= -60 GROUP BY p.image, p.y, p.x, p.val")
def _(spark, sf):
    return _cells(pictures.distance_transform(_mask(_images(spark, sf))))


@query("picture_regional_maxima")
def _(spark, sf):
    return _cells(pictures.regional_maxima(_images(spark, sf)))


@query("picture_regional_minima")
def _(spark, sf):
    return _cells(pictures.regional_minima(_images(spark, sf)))


@query("picture_reconstruct_by_dilation")
def _(spark, sf):
    return _cells(pictures.reconstruct_by_dilation(_images(spark, sf), 50.0))


@query("picture_reconstruct_by_erosion")
def _(spark, sf):
    return _cells(pictures.reconstruct_by_erosion(_images(spark, sf), 50.0))


@query("picture_closed_holes")
def _(spark, sf):
    return _cells(pictures.closed_holes(_images(spark, sf)))


@query("picture_area_opening")
def _(spark, sf):
    return _cells(pictures.area_opening(_images(spark, sf), 6))


@query("picture_superpixels")
def _(spark, sf):
    return _cells(pictures.superpixels(_images(spark, sf), 40, 10))


@query("picture_spectrum")
def _(spark, sf):
    return _cells(pictures.spectrum(_images(spark, sf)))


@query("picture_rescaled")
def _(spark, sf):
    return _cells(pictures.rescaled(_images(spark, sf), 32, 20))


@query("picture_flip_x", f"WITH {IM} SELECT image, y, 63 - x AS x, val FROM ip")
def _(spark, sf):
    return _cells(pictures.flipped_x(_images(spark, sf)))


@query("picture_flip_y", f"WITH {IM} SELECT image, max(y) OVER (PARTITION BY image) - y AS y, x, val FROM ip")
def _(spark, sf):
    return _cells(pictures.flipped_y(_images(spark, sf)))


@query("picture_transposed", f"WITH {IM} SELECT image, x AS y, y AS x, val FROM ip")
def _(spark, sf):
    return _cells(pictures.transposed(_images(spark, sf)))


@query("picture_border_interior", f"""WITH {IM}, b AS (SELECT image, x, y, CAST(floor(abs(val) / 64) AS INTEGER) AS bin FROM ip),
  m AS (SELECT p.image, p.x, p.y, p.bin, max(CASE WHEN q.bin <> p.bin THEN 1 ELSE 0 END) AS edge FROM b p JOIN b q ON p.image = q.image AND abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY ALL)
  SELECT image, bin, count(*) FILTER (edge = 1) AS border, count(*) FILTER (edge = 0) AS interior FROM m GROUP BY image, bin""")
def _(spark, sf):
    rows = _images(spark, sf).withColumn("line", F.transform("line", F.abs))
    return pictures.border_interior(rows, 16, 1023.0)


@query("picture_grid_seeds", f"WITH {IM} SELECT image, x, y FROM ip WHERE val > -60 AND x % 6 = 3 AND y % 6 = 3")
def _(spark, sf):
    return pictures.grid_seeds(_mask(_images(spark, sf)), 6)


@query("raster_window_level", f"WITH {PX}, e AS (SELECT greatest(50 - 100, min(val)) AS lo, least(50 + 100, max(val)) AS hi FROM px) SELECT x, y, CASE WHEN val < lo THEN 0.0 WHEN val > hi THEN 255.0 ELSE round(round(255 / (hi - lo) * (val - lo), 9)) END AS val FROM px, e")
def _(spark, sf):
    px = _px(spark, sf)
    low, high = px.agg(F.min("val"), F.max("val")).first()
    lo, hi = max(-50.0, low), min(150.0, high)
    v = F.col("val")
    inside = F.round(F.round(255 / (hi - lo) * (v - lo), 9))
    return px.select(F.col("x").cast("long").alias("x"), "y", F.when(v < lo, 0.0).when(v > hi, 255.0).otherwise(inside).alias("val"))


@query("raster_mask", f"WITH {PX} SELECT p.x, p.y, CASE WHEN m.val > 0 THEN p.val ELSE 0.0 END AS val, CASE WHEN p.val <> 0 THEN 1 ELSE 0 END AS bin FROM px p JOIN px m ON m.x = p.x AND m.y = p.y + 1")
def _(spark, sf):
    px = _px(spark, sf)
    m = px.select("image", "x", (F.col("y") - 1).alias("y"), F.col("val").alias("m"))
    return px.join(m, ["image", "x", "y"]).select(F.col("x").cast("long").alias("x"), "y", F.when(F.col("m") > 0, F.col("val")).otherwise(0.0).alias("val"), (F.col("val") != 0).cast("int").alias("bin"))


@query("raster_complement", f"WITH {PX} SELECT x, y, max(val) OVER () - val AS val FROM px")
def _(spark, sf):
    px = _px(spark, sf)
    return px.join(F.broadcast(px.agg(F.max("val").alias("top")))).select(F.col("x").cast("long").alias("x"), "y", (F.col("top") - F.col("val")).alias("val"))


@query("raster_region_of_interest", f"WITH {PX} SELECT x - 10 AS x, y - 5 AS y, val FROM px WHERE x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 24")
def _(spark, sf):
    return _px(spark, sf).where("x between 10 and 29 and y between 5 and 24").select((F.col("x") - 10).cast("long").alias("x"), (F.col("y") - 5).alias("y"), "val")


@query("raster_plane", f"WITH {PX} SELECT y, val FROM px WHERE x = 7")
def _(spark, sf):
    return T.scanlines(spark, sf).select("y", F.col("line")[7].alias("val"))


@query("raster_multiband_gradient", f"WITH {PX}, t(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) SELECT p.x, p.y, round(sqrt(sum((q.val - p.val) * (q.val - p.val))) / 5, 4) + 0.0 AS val FROM px p CROSS JOIN t JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY p.x, p.y, p.val")
def _(spark, sf):
    taps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    got = raster.stencil(T.scanlines(spark, sf), taps, lambda s: np.sqrt(np.nansum((s[1:] - s[0]) ** 2, 0)) / 5)
    return T.pixels(got).select(F.col("x").cast("long").alias("x"), "y", r4("val").alias("val"))


@query("region_histograms", f"WITH {TILE} SELECT label, CAST(floor((val + 1000) / 250) AS INTEGER) AS bin, count(*) AS n FROM lb GROUP BY ALL")
def _(spark, sf):
    return _tiled(spark, sf).groupBy("label", F.floor((F.col("val") + 1000) / 250).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("region_modes", f"WITH {TILE}, c AS (SELECT label, val, count(*) AS n FROM lb GROUP BY ALL) SELECT label, arg_max(val, (n, -val)) AS mode FROM c GROUP BY label")
def _(spark, sf):
    c = _tiled(spark, sf).groupBy("label", "val").agg(F.count("*").alias("n"))
    return c.groupBy("label").agg(F.max_by("val", F.struct(F.col("n"), -F.col("val"))).alias("mode"))


@query("region_labels_to_pixels", f"WITH {TILE}, m AS (SELECT label, avg(val) AS m FROM lb GROUP BY label) SELECT x, y, round(m, 4) + 0.0 AS val FROM lb JOIN m USING (label)")
def _(spark, sf):
    px = _tiled(spark, sf)
    means = px.groupBy("label").agg(F.avg("val").alias("m"))
    return px.join(means, "label").select(F.col("x").cast("long").alias("x"), "y", r4("m").alias("val"))


@query("cumulative_threshold", f"WITH {ABS}, h AS (SELECT val AS i, count(*) AS n FROM v GROUP BY val), c AS (SELECT i, sum(n) OVER (ORDER BY i) / sum(n) OVER () AS s FROM h) SELECT min(i) - 1 AS threshold FROM c WHERE i >= 1 AND s > 0.7")
def _(spark, sf):
    v = _px(spark, sf).select(F.abs("val").cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return raster.cumulative(v).where("bin >= 1 and share > 0.7").agg((F.min("bin") - 1).alias("threshold"))


# --- learners


@query("least_squares_classify")
def _(spark, sf):
    return learners.classified(T.samples(spark, sf), "least_squares")


@query("support_vector_classify")
def _(spark, sf):
    return learners.classified(T.samples(spark, sf), "svm")


NEARMEAN = LONG + ", mt AS (SELECT truelabel AS c, dim, avg(v) AS m FROM c WHERE status = 4 GROUP BY ALL)"


@query("nearest_mean_classify", f"WITH {NEARMEAN}, d AS (SELECT c.id, c.truelabel, mt.c AS label, sum((v - m) * (v - m)) AS d FROM c JOIN mt USING (dim) WHERE status = 2 GROUP BY ALL) SELECT id, truelabel, label FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1")
def _(spark, sf):
    return learners.classified(T.samples(spark, sf), "nearest_mean")


FOLDS = PAIRS + """, fo AS (SELECT id, CAST((row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM sm),
  nn AS (SELECT pr.*, a.fold AS fold, row_number() OVER (PARTITION BY pr.id ORDER BY round(d2, 9), nb) AS r FROM pr JOIN fo a ON a.id = pr.id JOIN fo b ON b.id = pr.nb WHERE a.fold <> b.fold QUALIFY r <= 5),
  vt AS (SELECT id, fold, tl, nl, count(*) AS n FROM nn GROUP BY ALL), pd AS (SELECT fold, tl, nl FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, nl) = 1)"""


@query("cross_validation", f"WITH {FOLDS} SELECT fold, round(avg(CASE WHEN tl = nl THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pd GROUP BY fold")
def _(spark, sf):
    return learners.cross_validated(T.samples(spark, sf), 5, 5).select("fold", r4("accuracy").alias("accuracy"))


@query("gaussian_mixture")
def _(spark, sf):
    return learners.mixture(samples.pca(T.samples(spark, sf), 4), 3, rounds=5).select("id", "group", r4("p").alias("p"))


@query("k_medoids")
def _(spark, sf):
    sm = T.samples(spark, sf)
    first = sm.groupBy("truelabel").agg(F.min("id").alias("id")).select(F.col("truelabel").alias("c"), "id")
    return learners.medoids(sm, first, 2)


@query("two_level_clusters")
def _(spark, sf):
    return learners.two_level_clusters(T.samples(spark, sf), 5, 100)


@query("optimum_path_clusters")
def _(spark, sf):
    return learners.optimum_path_clusters(T.samples(spark, sf), 5)


@query("code_book_histogram", f"WITH {CENT}, d AS (SELECT c.id, c.truelabel, ct.c AS word, sum((v - m) * (v - m)) AS d FROM c JOIN ct USING (dim) GROUP BY ALL), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, word) = 1) SELECT truelabel, word, count(*) AS n FROM a GROUP BY ALL")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return learners.code_histogram(sm, samples.class_centroids(sm), "truelabel")


@query("matrix_product", f"WITH {CENT} SELECT c.id AS i, ct.c AS j, round(sum(c.v * ct.m), 4) + 0.0 AS v FROM c JOIN ct USING (dim) GROUP BY ALL")
def _(spark, sf):
    sm = T.samples(spark, sf)
    a = sm.select(F.col("id").alias("i"), F.posexplode("feat").alias("k", "v"))
    b = samples.class_centroids(sm).select(F.col("c").alias("j"), F.posexplode("centre").alias("k", "v"))
    return learners.matrix_product(a, b).select("i", "j", r4("v").alias("v"))


@query("mahalanobis_distance")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return learners.mahalanobis(sm, samples.class_centroids(sm), np.linalg.pinv(samples.covariance(sm))).select("id", "c", r4("d").alias("d"))


@query("metric_error_rates", f"WITH {PRED} SELECT truelabel, count(*) AS n, sum(CASE WHEN truelabel <> label THEN 1 ELSE 0 END) AS wrong FROM pd GROUP BY truelabel")
def _(spark, sf):
    return _predicted(spark, sf).groupBy("truelabel").agg(F.count("*").alias("n"), F.count_if(F.col("truelabel") != F.col("label")).alias("wrong"))


@query("metric_confusion_shares", f"WITH {PRED}, c AS (SELECT truelabel, label, count(*) AS n FROM pd GROUP BY ALL) SELECT truelabel, label, round(n / (sum(n) OVER (PARTITION BY truelabel) + 1e-7), 4) AS share FROM c")
def _(spark, sf):
    share = F.col("n") / (F.sum("n").over(W.partitionBy("truelabel")) + 1e-7)
    return metrics.confusion(_predicted(spark, sf)).select("truelabel", "label", r4(share).alias("share"))


# --- the rest


@query("colour_hsv", f"""WITH {RGB}, q AS (SELECT *, least(r, g, b) AS lo, greatest(r, g, b) AS hi FROM rgb)
  SELECT l_orderkey, l_linenumber, CASE WHEN hi = lo THEN 0 ELSE CAST(trunc(round(60.0 * (CASE WHEN r = lo THEN 3 - (g - b) / (hi - lo) WHEN g = lo THEN 5 - (b - r) / (hi - lo) ELSE 1 - (r - g) / (hi - lo) END), 9)) AS INTEGER) END AS h,
  CASE WHEN hi = lo THEN 0 ELSE CAST(trunc(round(255.0 * (hi - lo) / hi, 9)) AS INTEGER) END AS s, CASE WHEN hi = lo THEN hi ELSE CAST(trunc(round(0.299 * r + 0.587 * g + 0.114 * b, 9)) AS INTEGER) END AS v FROM q""")
def _(spark, sf):
    h, s, v = S.hsv(*(F.col(c) for c in "rgb"))
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", h.alias("h"), s.alias("s"), v.alias("v"))


@query("label_map", f"WITH {RGB} SELECT l_orderkey, l_linenumber, CASE WHEN r > g AND r > b THEN 'r' WHEN g > b THEN 'g' ELSE 'b' END AS channel FROM rgb")
def _(spark, sf):
    c = F.when((F.col("r") > F.col("g")) & (F.col("r") > F.col("b")), "r").when(F.col("g") > F.col("b"), "g").otherwise("b")
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", c.alias("channel"))


@query("dictionary_merge", "SELECT n_nationkey, n_name, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    n, r = T.read(spark, sf, "nation"), T.read(spark, sf, "region")
    first = F.create_map(F.lit("key"), F.col("n_name"), F.lit("name"), F.col("n_name"))
    second = F.create_map(F.lit("name"), F.col("r_name"))
    both = F.map_from_entries(F.map_entries(F.map_zip_with(first, second, lambda k, a, b: F.coalesce(b, a))))
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("m", both).select("n_nationkey", F.col("m")["key"].alias("n_name"), F.col("m")["name"].alias("name"))


@query("array_functions", f"WITH {SM} SELECT id, round(list_sum(feat), 4) + 0.0 AS total, round(list_max(feat), 4) AS top, list_position(feat, list_max(feat)) - 1 AS at, len(list_distinct(list_transform(feat, lambda v: round(v * 10)))) AS kinds FROM sm")
def _(spark, sf):
    f = F.col("feat")
    return T.samples(spark, sf).select("id", r4(F.aggregate(f, F.lit(0.0), lambda s, v: s + v)).alias("total"), r4(F.array_max(f)).alias("top"), (F.array_position(f, F.array_max(f)) - 1).cast("int").alias("at"), F.size(F.array_distinct(F.transform(f, lambda v: F.round(v * 10) + 0.0))).cast("long").alias("kinds"))


@query("top_scores", "SELECT o_custkey, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY o_custkey ORDER BY score DESC, o_custkey LIMIT 10")
def _(spark, sf):
    return T.read(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score")).orderBy(F.desc("score"), "o_custkey").limit(10)


@query("sequence_slice", "SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts < (SELECT min(ts) + INTERVAL 6 HOUR FROM events) GROUP BY user_id")
def _(spark, sf):
    e = T.read(spark, sf, "events")
    end = F.broadcast(e.agg((F.min("ts") + F.expr("INTERVAL 6 HOURS")).alias("stop")))
    return e.join(end, F.col("ts") < F.col("stop")).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("marker_graph_nodes")
def _(spark, sf):
    nodes, edges = layers.superpixel_graph(_tiled(spark, sf).select(F.col("image").alias("image_id"), "x", "y", "label", F.array("val").alias("feat")))
    return graphs.ring_neighbours(nodes, edges, 5)
