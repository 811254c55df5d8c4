"""Projections, clusterings, classifiers, measures, searches and samplings as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import evaluation as E
from ..operators import samples, shapes
from .pictures import IM, _images
from .queries import CENT, CROSS, KNN, LONG, OVER, PAIRS, PER, PRED, PX, RGB, SM, _overlap, _predicted, _px, _rgb, _taps, query, r4


def _long(df: DataFrame) -> DataFrame:
    return T.components(df).select("id", F.col("dim").cast("long").alias("dim"), r4("v").alias("v"))


# --- projections


@query("scale_factor", f"WITH {LONG} SELECT id, dim, round(v * 2.5, 4) + 0.0 AS v FROM c")
def _(spark, sf):
    return _long(E.scaled(T.samples(spark, sf), 2.5))


@query("scale_centred_training", f"WITH {LONG} SELECT id, dim, round(v - avg(v) FILTER (status = 4) OVER (PARTITION BY dim), 4) + 0.0 AS v FROM c")
def _(spark, sf):
    return _long(E.centred_by_training(T.samples(spark, sf)))


@query("axes_and_back", f"WITH {LONG} SELECT id, dim, round(v, 4) + 0.0 AS v FROM c")
def _(spark, sf):
    """All axes of the training samples, there and back."""
    sm = T.samples(spark, sf)
    mean, axes = E.training_axes(sm, 64)
    return _long(E.from_axes(E.on_axes(sm, mean, axes), mean, axes))


@query("axes_lengths", f"WITH {LONG}, m AS (SELECT dim, avg(v) FILTER (status = 4) AS m FROM c GROUP BY dim) SELECT id, round(sqrt(sum((v - m) * (v - m))), 4) AS length FROM c JOIN m USING (dim) GROUP BY id")
def _(spark, sf):
    """Lengths do not change on all axes."""
    sm = T.samples(spark, sf)
    f = F.col("feat")
    return E.on_axes(sm, *E.training_axes(sm, 64)).select("id", r4(F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, v: s + v * v))).alias("length"))


@query("linear_discriminants")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return samples.projected(sm, E.discriminants(sm, 3)).select("id", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


@query("class_mean_axes")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return samples.projected(sm, E.class_axes(sm, 3)).select("id", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


_LM = PAIRS.replace("ON a.id <> b.id", "ON b.id < 3")


@query("kernel_features", f"WITH {_LM} SELECT id, round(exp(-max(d2) FILTER (nb = 0) / 2), 4) AS k0, round(exp(-max(d2) FILTER (nb = 1) / 2), 4) AS k1, round(exp(-max(d2) FILTER (nb = 2) / 2), 4) AS k2 FROM pr GROUP BY id")
def _(spark, sf):
    sm = T.samples(spark, sf)
    got = E.gram(sm, sm.where("id < 3"))
    return got.select("id", *[r4(F.col("feat")[k]).alias(f"k{k}") for k in range(3)])


@query("neighbour_map")
def _(spark, sf):
    return E.neighbour_map(T.samples(spark, sf)).select("id", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


_WD = CENT + ", d AS (SELECT c.id, c.truelabel, ct.c, sum((c.v - ct.m) * (c.v - ct.m)) AS d FROM c JOIN ct USING (dim) GROUP BY ALL)"


@query("soft_words", f"WITH {_WD}, e AS (SELECT *, exp(-d / 0.5) AS s FROM d), f AS (SELECT *, s / sum(s) OVER (PARTITION BY id) AS w FROM e) SELECT truelabel, c AS word, round(sum(w), 3) AS weight FROM f GROUP BY ALL")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return E.soft_words(sm, samples.class_centroids(sm), "truelabel", 0.5).withColumn("weight", F.round("weight", 3))


@query("second_order_words", f"WITH {_WD}, a AS (SELECT id, c FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1), n AS (SELECT truelabel, count(*) AS n FROM sm GROUP BY 1) SELECT c.truelabel, a.c AS word, c.dim, round(sum(c.v - ct.m) / max(n.n), 4) + 0.0 AS first, round(sum((c.v - ct.m) * (c.v - ct.m)) / max(n.n), 4) AS second FROM c JOIN a USING (id) JOIN ct ON ct.c = a.c AND ct.dim = c.dim JOIN n ON n.truelabel = c.truelabel GROUP BY ALL")
def _(spark, sf):
    sm = T.samples(spark, sf)
    got = E.second_order(sm, samples.class_centroids(sm), "truelabel")
    return got.select("truelabel", "word", F.col("dim").cast("long").alias("dim"), r4("first").alias("first"), r4("second").alias("second"))


# --- clustering


@query("k_means_drawn", "SELECT 8 AS n, true AS numbered")
def _(spark, sf):
    return E.drawn_centres(T.samples(spark, sf), 8).agg(F.count("*").cast("int").alias("n"), (F.max("c") == 8).alias("numbered"))


@query("spherical_means")
def _(spark, sf):
    sm = T.samples(spark, sf)
    got = E.spherical_means(sm, samples.class_centroids(sm), 2)
    return got.select("c", F.transform("centre", lambda v: F.round(v, 4)).alias("centre"))


@query("best_k")
def _(spark, sf):
    return E.best_k(T.samples(spark, sf), 4, 6).withColumn("ncut", r4("ncut"))


@query("clusters_exactly")
def _(spark, sf):
    return E.exactly(T.samples(spark, sf), 3, 5)


@query("cluster_hierarchy")
def _(spark, sf):
    return E.hierarchy(T.samples(spark, sf), 5, 3)


@query("density_in_range", f"WITH {KNN}, kk AS (SELECT 2 * max(d2) / 9 AS k FROM kn), rw AS (SELECT id, sum(1 - exp(-d2 / k)) AS raw FROM kn, kk GROUP BY id) SELECT id, round(10 + 90 * (max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()), 3) AS density FROM rw")
def _(spark, sf):
    return E.density_of(samples.knn_graph(T.samples(spark, sf), 5), 10.0, 100.0).withColumn("density", F.round("density", 3))


# --- classification

_PT = PAIRS.replace("ON a.id <> b.id", "ON true") + ", pt AS (SELECT pr.id, pr.nl AS label, min(round(greatest(0.25, sqrt(pr.d2)), 9)) AS cost FROM pr WHERE st = 2 AND nst = 4 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, label) AS r FROM pt)"


@query("classify_certainty", f"WITH {_PT} SELECT a.id, a.label, round(a.cost, 4) AS cost, round(CASE WHEN b.cost IS NULL THEN 1.0 WHEN a.cost + b.cost < 1e-7 THEN 0.5 ELSE b.cost / (a.cost + b.cost) END, 4) AS weight FROM rk a LEFT JOIN rk b ON a.id = b.id AND b.r = 2 WHERE a.r = 1")
def _(spark, sf):
    sm = T.samples(spark, sf)
    train = sm.where("status = 4").select("id", "feat", F.col("truelabel").alias("label"), F.lit(0.25).alias("cost"))
    return E.certainty(sm.where("status = 2"), train).select("id", "label", r4("cost").alias("cost"), r4("weight").alias("weight"))


@query("classify_covered", f"WITH {PAIRS}, t AS (SELECT id, nb, nl, round(sqrt(d2), 9) AS d FROM pr WHERE st = 2 AND nst = 4), f AS (SELECT id, arg_min(nl, nb) AS g FROM t WHERE d <= 1.2 GROUP BY id), n AS (SELECT id, arg_min(nl, (d, nb)) AS g FROM t GROUP BY id) SELECT n.id, coalesce(f.g, n.g) AS \"group\" FROM n LEFT JOIN f USING (id)")
def _(spark, sf):
    sm = T.samples(spark, sf)
    nodes = sm.where("status = 4").select("id", "feat", F.col("truelabel").alias("group"), F.col("id").alias("rank"), F.lit(1.2).alias("radius"))
    return E.covered(sm.where("status = 2"), nodes)


@query("classify_one_class", f"WITH {PAIRS} SELECT id, CASE WHEN min(d2) <= 1.44 THEN 1 ELSE 0 END AS label FROM pr WHERE st = 2 AND nst = 4 AND nl = 2 GROUP BY id")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return E.one_class(sm.where("status = 2"), sm.where("status = 4 and truelabel = 2"), 1.2)


@query("classify_pairwise")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return E.one_against_one(sm.where("status = 4"), sm.where("status = 2"), E.fitted_plane)


@query("classify_spread")
def _(spark, sf):
    return E.spread_labels(T.samples(spark, sf), 2)


# --- measures


@query("metric_by_name", f"WITH {PER} SELECT round(sum(hit) / max(total), 4) + 0.0 AS value FROM pc")
def _(spark, sf):
    return E.by_name(_predicted(spark, sf), "true_positives").withColumn("value", r4("value"))


@query("metric_error_rate", f"WITH {PRED} SELECT round(avg(CASE WHEN truelabel <> label THEN 1.0 ELSE 0.0 END), 4) AS error FROM pd")
def _(spark, sf):
    return E.error_rate(_predicted(spark, sf)).withColumn("error", r4("error"))


@query("metric_matthews", f"WITH {PER}, s AS (SELECT sum(hit) AS c, max(total) AS s, sum(size * claimed) AS pt, sum(claimed * claimed) AS pp, sum(size * size) AS tt FROM pc) SELECT round((c * s - pt) / sqrt((s * s - pp) * CAST(s * s - tt AS DOUBLE)), 4) + 0.0 AS mcc FROM s")
def _(spark, sf):
    return E.matthews(_predicted(spark, sf)).withColumn("mcc", r4("mcc"))


@query("metric_accepts_rejects", f"WITH {PER} SELECT c, round((claimed - hit) / (total - size), 4) + 0.0 AS far, round(CASE WHEN size > 0 THEN (size - hit) / size END, 4) + 0.0 AS frr FROM pc")
def _(spark, sf):
    return E.accepts_and_rejects(_predicted(spark, sf)).select("c", r4("far").alias("far"), r4("frr").alias("frr"))


_MK = PX + ", mk AS (SELECT p.x, p.y, CASE WHEN p.val > 0 THEN 1 ELSE 0 END AS p, CASE WHEN q.val > 0 THEN 1 ELSE 0 END AS t FROM px p JOIN px q ON q.x = 63 - p.x AND q.y = p.y), e AS (SELECT count(*) FILTER (p = 1 AND t = 1) + 0.0 AS tp, count(*) FILTER (p = 1 AND t = 0) + 0.0 AS fp, count(*) FILTER (p = 0 AND t = 1) + 0.0 AS fn, count(*) FILTER (p = 0 AND t = 0) + 0.0 AS tn FROM mk)"


def _masks(spark, sf):
    px = _px(spark, sf).select("x", "y", (F.col("val") > 0).cast("int").alias("val"))
    return px, px.withColumn("x", 63 - F.col("x"))


@query("segmentation_errors", f"WITH {_MK} SELECT tp, fp, fn, tn FROM e")
def _(spark, sf):
    return E.segment_errors(*_masks(spark, sf))


@query("segmentation_f_beta", f"WITH {_MK} SELECT tp, fp, fn, tn, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 4) AS f FROM e")
def _(spark, sf):
    return E.f_beta(E.segment_errors(*_masks(spark, sf)), 0.5).withColumn("f", r4("f"))


@query("segmentation_dice", f"WITH {PX}, l AS (SELECT x, y, CAST(floor(abs(val) / 100) AS BIGINT) AS v FROM px), b AS (SELECT p.v AS p, q.v AS q FROM l p JOIN l q ON q.x = 63 - p.x AND q.y = p.y), e AS (SELECT p AS l, CASE WHEN p = q THEN 1 ELSE 0 END AS hit FROM b UNION ALL SELECT q, 0 FROM b) SELECT l AS label, round(2 * sum(hit) / count(*), 4) + 0.0 AS dice FROM e WHERE l <> 0 GROUP BY l")
def _(spark, sf):
    px = _px(spark, sf).select("x", "y", F.floor(F.abs("val") / 100).alias("val"))
    return E.overlaps(px, px.withColumn("x", 63 - F.col("x"))).withColumn("dice", r4("dice"))


def _borders(spark, sf, low: float) -> DataFrame:
    """Border pixels of what is above a value, of all images side by side."""
    own = _images(spark, sf).withColumn("line", F.transform("line", lambda v: F.when(v > low, 1.0).otherwise(0.0)))
    return shapes.object_border_set(own).select((F.col("x") + 1000 * F.col("image").cast("int")).alias("x"), "y")


def _rim_sql(low: float, name: str) -> str:
    """Border pixels of what is above a value, of all images side by side."""
    other = " OR ".join(f"coalesce((SELECT q.val FROM ip q WHERE q.image = p.image AND q.x = p.x + {dx} AND q.y = p.y + {dy}), -1e9) <= {low}" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return f"{name} AS (SELECT p.x + 1000 * CAST(p.image AS INTEGER) AS x, p.y FROM ip p WHERE p.val > {low} AND ({other}))"


_WAY = "(SELECT min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) FROM {1} b)"


@query("surface_distances", f"WITH {IM}, {_rim_sql(100.0, 's')}, {_rim_sql(150.0, 't')}, u AS (SELECT {_WAY.format('', 't')} AS d FROM s a), v AS (SELECT {_WAY.format('', 's')} AS d FROM t a) SELECT round((SELECT avg(d) FROM u), 4) AS there, round((SELECT avg(d) FROM v), 4) AS back, round(((SELECT sum(d) FROM u) + (SELECT sum(d) FROM v)) / ((SELECT count(*) FROM u) + (SELECT count(*) FROM v)), 4) AS both")
def _(spark, sf):
    got = E.surface_distance(_borders(spark, sf, 100.0), _borders(spark, sf, 150.0))
    return got.select(*[r4(c).alias(c) for c in ("there", "back", "both")])


@query("border_recall", f"WITH {PX}, f AS (SELECT x, y FROM px WHERE val > 200), t AS (SELECT x, y FROM px WHERE val < -200) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE abs(f.x - t.x) <= 1 AND abs(f.y - t.y) <= 1) THEN 1.0 ELSE 0.0 END), 4) AS recall FROM t")
def _(spark, sf):
    px = _px(spark, sf)
    return E.border_recall(px.where("val > 200"), px.where("val < -200"), 1).withColumn("recall", r4("recall"))


@query("metric_leak", f"WITH {OVER}, p AS (SELECT n, sum(n) OVER (PARTITION BY region) AS size FROM o) SELECT round((sum(size) FILTER (n > 0.05 * size) - sum(n)) / sum(n), 4) + 0.0 AS error FROM p")
def _(spark, sf):
    return E.leak(_overlap(spark, sf)).withColumn("error", r4("error"))


_TB = PX + ", tb AS (SELECT x, y, (y // 8) * 8 + x // 8 + CASE WHEN val > 100 THEN 100000 ELSE 0 END AS val FROM px)"


def _tb(spark, sf) -> DataFrame:
    px = _px(spark, sf)
    return px.select(F.col("x").cast("long").alias("x"), "y", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + F.when(F.col("val") > 100, 100000).otherwise(0)).cast("long").alias("val"))


_SIDE = " UNION ALL ".join(f"SELECT p.val, q.val AS o FROM tb p LEFT JOIN tb q ON q.x = p.x + {dx} AND q.y = p.y + {dy}" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@query("region_compactness", f"WITH {_TB}, s AS ({_SIDE}), r AS (SELECT val, count(*) FILTER (o IS NULL OR o <> val) AS p, count(*) / 4 AS a FROM s GROUP BY val) SELECT round(sum(4 * pi() * a * a / (p * p)) / sum(a), 4) AS compactness FROM r")
def _(spark, sf):
    return E.compactness(_tb(spark, sf)).withColumn("compactness", r4("compactness"))


_ARC = "a AS (SELECT p.val AS u, q.val AS v FROM tb p JOIN tb q ON q.x = p.x + 1 AND q.y = p.y UNION ALL SELECT p.val, q.val FROM tb p JOIN tb q ON q.x = p.x AND q.y = p.y + 1)"


@query("region_arcs", f"WITH {_TB}, {_ARC} SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS sides FROM a WHERE u <> v GROUP BY ALL")
def _(spark, sf):
    return E.region_arcs(_tb(spark, sf))


@query("region_topology", f"WITH {_TB}, {_ARC}, d AS (SELECT DISTINCT least(u, v) AS p, greatest(u, v) AS q FROM a WHERE u <> v), n AS (SELECT count(DISTINCT val) AS n FROM tb) SELECT n AS regions, round(2 * (SELECT count(*) FROM d) / n, 4) AS neighbours FROM n")
def _(spark, sf):
    return E.topology(_tb(spark, sf)).withColumn("neighbours", r4("neighbours"))


# --- searches and samplings


@query("grid_search", "SELECT 6 AS n, 'ok' AS kind")
def _(spark, sf):
    """Every setting of two parameters, scored by a distributed sum."""
    li = T.read(spark, sf, "orders")
    score = lambda low, high: li.where(F.col("o_totalprice").between(low, high)).count()
    got = E.searched(spark, E.grid({"low": [0, 1000], "high": [5000, 50000, 500000]}), score)
    return got.agg(F.count("*").cast("int").alias("n"), F.when(F.max("score") > 0, "ok").alias("kind"))


@query("random_search", "SELECT 4 AS n")
def _(spark, sf):
    li = T.read(spark, sf, "orders")
    got = E.searched(spark, E.drawn_settings({"low": (0.0, 5e5)}, 4), lambda low: li.where(F.col("o_totalprice") > low).count())
    return got.agg(F.count("*").cast("int").alias("n"))


@query("scale_search", "SELECT round(avg(o_totalprice) / 1000) AS at FROM orders")
def _(spark, sf):
    """The number next to a mean, by steps of several scales."""
    total = T.read(spark, sf, "orders").agg(F.avg("o_totalprice")).first()[0] / 1000
    x, _ = E.scale_search(lambda p: float((p[0] - total) ** 2), np.array([0.0]), [1.0, 10.0, 100.0], rounds=200)
    return spark.createDataFrame([(float(x[0]),)], "at double")


@query("fold_accuracy", f"WITH {PAIRS}, f AS (SELECT id, (row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 3 AS fold FROM sm), q AS (SELECT pr.*, a.fold FROM pr JOIN f a ON a.id = pr.id JOIN f b ON b.id = pr.nb WHERE a.fold <> b.fold), n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), nb) = 1) SELECT round(avg(v), 4) + 0.0 AS accuracy FROM (SELECT fold, avg(CASE WHEN tl = nl THEN 1.0 ELSE 0.0 END) AS v FROM n GROUP BY fold)")
def _(spark, sf):
    return E.mean_fold_accuracy(T.samples(spark, sf), 3, lambda sm: samples.knn_classified(sm, 1)).withColumn("accuracy", r4("accuracy"))


@query("leave_one_out", f"WITH {KNN}, v AS (SELECT id, tl, nl, count(*) AS n FROM kn WHERE r <= 3 GROUP BY ALL) SELECT id, tl AS truelabel, nl AS label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, nl) = 1")
def _(spark, sf):
    return E.leave_one_out(T.samples(spark, sf), 3)


@query("inverse_folds", "WITH f AS (SELECT vec_id AS id, (row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 4 AS fold FROM embeddings) SELECT CAST(k AS INTEGER) AS fold, id, CASE WHEN fold = k THEN 4 ELSE 2 END AS status FROM f, range(0, 4) t(k)")
def _(spark, sf):
    return E.inverse_folds(T.samples(spark, sf), 4)


@query("split_by_share", "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('1:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT), vec_id) AS r, count(*) OVER () AS n FROM embeddings) SELECT id, CASE WHEN r <= floor(n * 0.3) THEN 4 ELSE 2 END AS status FROM r")
def _(spark, sf):
    return E.by_share(T.samples(spark, sf), 0.3).select("id", "status")


@query("split_by_weight", "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS r, count(*) OVER () AS n FROM embeddings) SELECT id, CASE WHEN r <= floor(n * 0.2) THEN 4 ELSE 2 END AS status FROM r")
def _(spark, sf):
    return E.by_share(T.samples(spark, sf), 0.2, F.col("feat")[0]).select("id", "status")


@query("tiles_split", f"WITH {PX}, h AS (SELECT max(y) + 1 AS h FROM px), t AS (SELECT *, x * 5 // 64 AS tx, y * 3 // h AS ty FROM px, h) SELECT ty * 5 + tx AS tile, x - CAST(ceil(tx * 64 / 5) AS BIGINT) AS x, y - CAST(ceil(ty * h / 3) AS BIGINT) AS y, val FROM t")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", "val")
    return E.split_tiles(px, 64, px.agg(F.max("y")).first()[0] + 1, 5, 3)


@query("tiles_joined", f"WITH {PX} SELECT x, y, val FROM px")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", "val")
    h = px.agg(F.max("y")).first()[0] + 1
    return E.joined_tiles(E.split_tiles(px, 64, h, 5, 3), 64, h, 5, 3)


# --- samples and pixels


@query("labels_on_pixels", f"WITH {PX} SELECT x, y, label + 1 AS val FROM px JOIN embeddings ON vec_id = y")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", F.col("y").alias("id"))
    return E.to_pixels(T.samples(spark, sf), px, "truelabel")


@query("samples_marked", f"WITH {SM}, s AS (SELECT o_custkey % 500 AS id, o_custkey % 3 + 1 AS label, count(*) AS n FROM orders GROUP BY ALL), v AS (SELECT id, arg_max(label, (n, -label)) AS l FROM s GROUP BY id) SELECT sm.id, CAST(coalesce(v.l, 0) AS BIGINT) AS truelabel, CASE WHEN v.l IS NULL THEN 2 ELSE 4 END AS status FROM sm LEFT JOIN v USING (id)")
def _(spark, sf):
    seeds = T.read(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("id"), (F.col("o_custkey") % 3 + 1).alias("label"))
    return E.marked_by_seeds(T.samples(spark, sf), seeds).select("id", F.col("truelabel").cast("long").alias("truelabel"), "status")


@query("edge_samples", f"WITH {PX}, t(dx, dy) AS (VALUES (1, 0), (0, 1)) SELECT p.x, p.y, dx, dy, abs(p.val - q.val) AS d, CASE WHEN p.x // 8 = q.x // 8 THEN 1 ELSE 0 END AS same FROM px p, t JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", F.array("val").alias("feat"), F.floor(F.col("x") / 8).alias("val"))
    return E.edge_samples(px, labels=True).select("x", "y", "dx", "dy", F.col("feat")[0].alias("d"), "same")


@query("joint_masks", f"WITH {PX} SELECT x, y, CASE WHEN val > 0 AND x % 2 = 0 THEN 1 ELSE 0 END AS every, CASE WHEN val > 0 OR x % 2 = 0 THEN 1 ELSE 0 END AS some FROM px")
def _(spark, sf):
    px = _px(spark, sf)
    masks = [px.select("x", "y", (F.col("val") > 0).cast("int").alias("val")), px.select("x", "y", (F.col("x") % 2 == 0).cast("int").alias("val"))]
    every = E.joint_mask(masks).withColumnRenamed("val", "every")
    return every.join(E.joint_mask(masks, every=False).withColumnRenamed("val", "some"), ["x", "y"])


@query("image_graph", f"WITH {PX}, {_taps(CROSS)} SELECT p.y * 64 + p.x AS src, q.y * 64 + q.x AS dst, abs(p.val - q.val) AS w FROM px p CROSS JOIN t JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy WHERE t.i > 0")
def _(spark, sf):
    px = _px(spark, sf).select((F.col("y") * 64 + F.col("x")).alias("p"), F.col("x").cast("long").alias("x"), "y", F.array("val").alias("feat"))
    return E.image_graph(px, CROSS)


@query("band_minmax", f"WITH {RGB} SELECT min(r) AS r0, max(r) AS r1, min(g) AS g0, max(g) AS g1, min(b) AS b0, max(b) AS b1 FROM rgb")
def _(spark, sf):
    return _rgb(spark, sf).agg(*[f(c).alias(f"{c}{k}") for c in "rgb" for k, f in enumerate((F.min, F.max))])


# --- layers on images


@query("image_layer")
def _(spark, sf):
    """One layer learned from a few markers of each image, and what it gives: sums over its channels."""
    from ..operators import image_layers as L
    from ..sources.formats import Architecture, Layer

    lines = _images(spark, sf)
    markers = lines.where("y % 16 = 3").select("image", "y", F.explode(F.array(F.lit(8), F.lit(40))).alias("x")).withColumn("marker", (F.col("x") / 32).cast("long"))
    trained, out = L.train(lines, 1, markers, Architecture(0.01, [Layer(kernels_per_marker=3, channels=6, pool="max_pool")]))
    px = L.to_pixels(out, len(trained[0].bank))
    return px.select("image", "x", "y", r4(F.aggregate("feat", F.lit(0.0), lambda s, v: s + v)).alias("val"))
