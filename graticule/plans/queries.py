"""Every operator as a query on the test tables, with the same result as SQL where SQL can express it.

Floats are rounded to four digits so that both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import graphs, layers, metrics, raster, samples
from ..streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def r4(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4) + F.lit(0.0)


# --- common table expressions of the SQL side

SM = """sm AS (SELECT vec_id AS id, label + 1 AS truelabel, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 4 END AS status, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings)"""
LONG = SM + """, c AS (SELECT id, truelabel, status, unnest(range(0, len(feat))) AS dim, unnest(feat) AS v FROM sm)"""
CENT = LONG + """, ct AS (SELECT truelabel AS c, dim, avg(v) AS m FROM c GROUP BY ALL)"""
PX = """px AS (SELECT 'e' AS image, vec_id AS y, unnest(range(0, len(embedding))) AS x, unnest(list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 1000))) AS val FROM embeddings)"""


# --- distances: every sample against the mean of each class

#: name, column, SQL over f (sample) and g (centre) grouped by sample and class, and the values the features are taken as
_MOM = "(avg(f * f) - avg(f) * avg(f))", "(avg(g * g) - avg(g) * avg(g))", "(avg(f * g) - avg(f) * avg(g))"
_D1 = "sqrt(sum((f - g) * (f - g)))"
DISTANCES: dict[str, tuple[Callable, str, bool]] = {
    "dist1_euclidean": (V.numbered(1), _D1, False),
    "dist2_log_euclidean": (V.numbered(2), f"4095 * ln({_D1} + 1)", False),
    "dist3_power_sum": (V.numbered(3), "sum(abs(f - g))", False),
    "dist4_log_power_sum": (V.numbered(4), "4095 * ln(sum(abs(f - g)) + 1)", False),
    "dist5_saturating": (V.numbered(5), f"1 - exp(-{_D1} / 20)", False),
    "dist6_half_cosine": (V.numbered(6), "0.5 - sum(f * g) / 2", False),
    "dist7_minkowski": (V.numbered(7), "sum(sqrt(abs(f - g)))", False),
    "dist8_correlation": (V.numbered(8), f"1 - abs({_MOM[2]} / sqrt({_MOM[0]} * {_MOM[1]}))", False),
    "dist9_compression": (V.numbered(9), f"{_MOM[0]} + {_MOM[1]} - sqrt(pow({_MOM[0]} + {_MOM[1]}, 2) - 4 * {_MOM[0]} * {_MOM[1]} * (1 - {_MOM[2]} * {_MOM[2]} / ({_MOM[0]} * {_MOM[1]})))", False),
    "dist10_chi_square": (V.numbered(10), "sum((f - g) * (f - g) / (f + g + 1e-7))", True),
    "dist11_hellinger": (V.numbered(11), "0.707106781 * sqrt(sum(pow(sqrt(f) - sqrt(g), 2)))", True),
    "dist12_bhattacharyya": (V.numbered(12), "sum(sqrt(f * g))", True),
    "dist_squared_euclidean": (V.squared_euclidean, "sum((f - g) * (f - g))", False),
    "dist_normalised_euclidean": (lambda a, b: V.euclidean(a, b) / (F.size(a) + 1e-6), f"{_D1} / (count(*) + 1e-6)", False),
    "dist_l1": (V.l1, "sum(abs(f - g))", False),
    "dist_l1_mean": (V.l1_mean, "sum(abs(f - g)) / count(*)", False),
    "dist_l1_normalised": (lambda a, b: V.l1(a, b) / (F.size(a) + 1e-6), "sum(abs(f - g)) / (count(*) + 1e-6)", False),
    "dist_signed_manhattan": (V.signed_manhattan, "sum(g - f)", False),
    "dist_cosine": (V.cosine_distance, "(1 - sum(f * g) / sqrt(sum(f * f) * sum(g * g))) / 2", False),
    "dist_running_differences": (V.running_differences, "sum((f - g) * (n - dim))", False),
    "dist_kullback_leibler": (V.kullback_leibler, "sum(f / sf * ln((f / sf) / (g / sg)))", True),
}


def _distance(fn, positive: bool) -> Query:
    def run(spark, sf):
        sm = T.samples(spark, sf)
        if positive:
            sm = sm.withColumn("feat", F.transform("feat", lambda v: F.abs(v) + 0.001))
        centres = samples.class_centroids(sm)  # as many rows as classes
        return sm.join(F.broadcast(centres)).select("id", "c", r4(fn(F.col("feat"), F.col("centre"))).alias("d"))

    return run


for _name, (_fn, _sql, _positive) in DISTANCES.items():
    _long = LONG.replace("unnest(feat) AS v", "unnest(list_transform(feat, lambda q: abs(q) + 0.001)) AS v") if _positive else LONG
    query(
        _name,
        f"""WITH {_long}, ct AS (SELECT truelabel AS c, dim, avg(v) AS m FROM c GROUP BY ALL),
        p AS (SELECT c.id, ct.c, c.dim, c.v AS f, ct.m AS g, 64 AS n, sum(c.v) OVER w AS sf, sum(ct.m) OVER w AS sg FROM c JOIN ct USING (dim) WINDOW w AS (PARTITION BY c.id, ct.c))
        SELECT id, c, round({_sql}, 4) + 0.0 AS d FROM p GROUP BY id, c""",
    )(_distance(_fn, _positive))


# --- vector norms and feature scaling

ROWWISE: dict[str, tuple[Callable, str]] = {
    "norm_unit": (lambda sm: sm.withColumn("feat", V.unit(F.col("feat"))), "CASE WHEN sqrt(sum(v * v) OVER r) > 0.001 THEN v / sqrt(sum(v * v) OVER r) ELSE v END"),
    "norm_by_maximum": (lambda sm: sm.withColumn("feat", V.by_maximum(F.col("feat"))), "v / max(v) OVER r"),
    "norm_standardised": (lambda sm: sm.withColumn("feat", V.standardised(F.col("feat"))), "(v - avg(v) OVER r) / stddev_pop(v) OVER r"),
    "norm_contrast": (lambda sm: sm.withColumn("feat", V.contrast(F.col("feat"))), "(v - avg(v) OVER r) / sqrt((var_pop(v) OVER r * 64 + 0.1) / 63)"),
    "norm_one": (lambda sm: sm.withColumn("feat", V.norm_one(F.col("feat"))), "v / sum(abs(v)) OVER r"),
    "norm_power": (lambda sm: samples.power_normalised(sm.withColumn("feat", F.transform("feat", F.abs)), 0.5), "sqrt(abs(v))"),
    "scale_z_score": (lambda sm: samples.z_scored(sm), "(v - avg(v) OVER d) / (stddev_pop(v) OVER d + 0.01)"),
    "scale_z_score_training": (lambda sm: samples.z_scored_by_training(sm), "(v - avg(v) FILTER (status = 4) OVER d) / (stddev_pop(v) FILTER (status = 4) OVER d + 0.01)"),
    "scale_centred": (samples.centred, "v - avg(v) OVER d"),
    "scale_min_max": (samples.min_max_scaled, "(v - min(v) OVER d + 1e-5) / (max(v) OVER d - min(v) OVER d + 1e-5)"),
    "scale_band": (samples.band_scaled, "greatest(0, (v - min(CASE WHEN v > 0 THEN v END) OVER d) / (max(v) OVER d - min(CASE WHEN v > 0 THEN v END) OVER d))"),
}


def _rowwise(fn) -> Query:
    return lambda spark, sf: T.components(fn(T.samples(spark, sf))).select("id", F.col("dim").cast("long").alias("dim"), r4("v").alias("v"))


for _name, (_fn, _sql) in ROWWISE.items():
    query(_name, f"WITH {LONG} SELECT id, dim, round({_sql}, 4) + 0.0 AS v FROM c WINDOW r AS (PARTITION BY id), d AS (PARTITION BY dim)")(_rowwise(_fn))


# --- statistics, counts, filters


@query("feature_statistics", f"WITH {LONG} SELECT dim, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) AS stdev_pop, round(stddev_samp(v), 4) AS stdev, round(min(v), 4) + 0.0 AS least, round(max(v), 4) + 0.0 AS largest FROM c GROUP BY dim")
def _(spark, sf):
    got = samples.feature_statistics(T.samples(spark, sf))
    return got.select(F.col("dim").cast("long").alias("dim"), *[r4(c).alias(c) for c in ("mean", "stdev_pop", "stdev", "least", "largest")])


@query("status_counts", f"WITH {SM} SELECT status, count(*) AS n FROM sm GROUP BY status")
def _(spark, sf):
    return T.samples(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("class_counts", f"WITH {SM} SELECT truelabel, count(*) AS n FROM sm WHERE truelabel > 0 GROUP BY truelabel")
def _(spark, sf):
    return samples.class_counts(T.samples(spark, sf))


@query("class_number", f"WITH {SM} SELECT max(truelabel) AS classes FROM sm")
def _(spark, sf):
    return samples.class_number(T.samples(spark, sf))


@query("filter_status", f"WITH {SM} SELECT id, truelabel FROM sm WHERE status & 6 & 2 <> 0")
def _(spark, sf):
    return samples.with_status(T.samples(spark, sf), T.TEST).select("id", "truelabel")


@query("filter_class", f"WITH {SM} SELECT id, status FROM sm WHERE truelabel = 3")
def _(spark, sf):
    return samples.of_class(T.samples(spark, sf), 3).select("id", "status")


@query("remove_class", f"WITH {SM} SELECT id, truelabel FROM sm WHERE truelabel <> 1")
def _(spark, sf):
    return samples.without_class(T.samples(spark, sf), 1).select("id", "truelabel")


@query("object_classes", f"WITH {SM} SELECT id, 2 AS truelabel, 4 AS status FROM sm WHERE truelabel > 1")
def _(spark, sf):
    return samples.object_classes(T.samples(spark, sf)).select("id", "truelabel", "status")


@query("unambiguous_samples", f"WITH {SM} SELECT a.id FROM sm a WHERE NOT EXISTS (SELECT 1 FROM sm b WHERE a.feat = b.feat AND a.truelabel <> b.truelabel)")
def _(spark, sf):
    return samples.unambiguous(T.samples(spark, sf)).select("id")


@query("row_slice", f"WITH {SM} SELECT id FROM sm WHERE id BETWEEN 20 AND 79")
def _(spark, sf):
    return samples.sliced(T.samples(spark, sf), 20, 79).select("id")


@query("status_flags", f"WITH {SM} SELECT id, status | 64 AS status, (status | 64) & ~4 AS cleared FROM sm")
def _(spark, sf):
    s = F.col("status").bitwiseOR(T.SUPERVISED)
    return T.samples(spark, sf).select("id", s.alias("status"), s.bitwiseAND(F.bitwise_not(F.lit(T.TRAIN))).alias("cleared"))


@query("covariance", f"WITH {LONG} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.v, b.v), 4) + 0.0 AS v FROM c a JOIN c b USING (id) GROUP BY 1, 2")
def _(spark, sf):
    m = samples.covariance(T.samples(spark, sf))
    i, j = np.indices(m.shape)
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(i.ravel(), j.ravel(), m.ravel())], "i long, j long, v double").select("i", "j", r4("v").alias("v"))


@query("pca_projection")
def _(spark, sf):
    return samples.pca(T.samples(spark, sf), 8).select("id", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


@query("whitening")
def _(spark, sf):
    return samples.whitened(T.samples(spark, sf)).select("id", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


# --- neighbours, classification, clustering

PAIRS = SM + """, pr AS (SELECT a.id, b.id AS nb, a.truelabel AS tl, b.truelabel AS nl, a.status AS st, b.status AS nst, list_sum(list_transform(list_zip(a.feat, b.feat), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM sm a JOIN sm b ON a.id <> b.id)"""
KNN = PAIRS + """, kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), nb) AS r FROM pr QUALIFY r <= 5)"""
PRED = PAIRS + """, nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), nb) AS r FROM pr WHERE st = 2 AND nst = 4 QUALIFY r <= 5),
  vt AS (SELECT id, tl, nl, count(*) AS n FROM nn GROUP BY ALL),
  pd AS (SELECT id, tl AS truelabel, nl AS label FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, nl) = 1)"""


@query("knn_graph", f"WITH {KNN} SELECT id AS src, nb AS dst, r AS rank, round(sqrt(d2), 4) AS w FROM kn")
def _(spark, sf):
    return samples.knn_graph(T.samples(spark, sf), 5).select("src", "dst", F.col("rank").cast("long").alias("rank"), r4("w").alias("w"))


@query("nearest_neighbour", f"WITH {PAIRS} SELECT id, nb AS neighbour, round(d2, 4) AS d2 FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), nb) = 1")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return samples.nearest(sm, sm, 1).select("id", "neighbour", r4("d2").alias("d2"))


@query("knn_classify", f"WITH {PRED} SELECT id, truelabel, label FROM pd")
def _(spark, sf):
    return samples.knn_classified(T.samples(spark, sf), 5)


def _predicted(spark, sf):
    return samples.knn_classified(T.samples(spark, sf), 5)


@query("confusion_matrix", f"WITH {PRED} SELECT truelabel, label, count(*) AS n FROM pd GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(_predicted(spark, sf))


PER = PRED + """, k AS (SELECT truelabel AS c, count(*) AS size, sum(CASE WHEN truelabel = label THEN 1 ELSE 0 END) AS hit FROM pd GROUP BY 1),
  l AS (SELECT label AS c, count(*) AS claimed FROM pd GROUP BY 1),
  pc AS (SELECT coalesce(k.c, l.c) AS c, coalesce(size, 0) AS size, coalesce(hit, 0) AS hit, coalesce(claimed, 0) AS claimed, (SELECT count(*) FROM pd) AS total FROM k FULL JOIN l ON k.c = l.c),
  rt AS (SELECT *, CASE WHEN size > 0 THEN (size - hit) / size ELSE 0 END AS miss, CASE WHEN total > size THEN (claimed - hit) / (total - size) ELSE 0 END AS alarm FROM pc)"""
METRICS: dict[str, tuple[Callable, str, str]] = {
    "metric_true_positives": (metrics.true_positives, "accuracy", "SELECT sum(hit) / max(total) AS v FROM pc"),
    "metric_f_score": (metrics.f_score, "f_score", "SELECT avg(2 * hit / (size + claimed)) AS v FROM pc"),
    "metric_normalised_accuracy": (metrics.normalised_accuracy, "accuracy", "SELECT avg(CASE WHEN size > 0 THEN hit / size ELSE 0 END) AS v FROM pc"),
    "metric_skewed_true_positives": (metrics.skewed_true_positives, "accuracy", "SELECT sum(hit / size * (1 - size / total)) / sum(1 - size / total) AS v FROM pc WHERE size > 0"),
    "metric_weighted_accuracy": (metrics.weighted_accuracy, "accuracy", "SELECT 1 - greatest(avg(miss), avg(alarm)) AS v FROM rt"),
    "metric_optimum_path_accuracy": (metrics.optimum_path_accuracy, "accuracy", "SELECT 1 - sum(miss + alarm) / (2 * count(*)) AS v FROM rt WHERE size > 0"),
    "metric_kappa": (metrics.kappa, "kappa", "SELECT (sum(hit) / max(total) - sum(size / total * claimed / total)) / (1 - sum(size / total * claimed / total) + 1e-7) AS v FROM pc"),
}


def _metric(fn, column: str) -> Query:
    return lambda spark, sf: fn(_predicted(spark, sf)).select(r4(column).alias(column))


for _name, (_fn, _column, _sql) in METRICS.items():
    query(_name, f"WITH {PER}, m AS ({_sql}) SELECT round(v, 4) + 0.0 AS {_column} FROM m")(_metric(_fn, _column))


@query("metric_binary", """WITH c AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (quality <> 1 AND toxic = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (quality = 1 AND toxic <> 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (quality <> 1 AND toxic <> 1) AS DOUBLE) AS tn FROM labels)
  SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(5 * tp / (5 * tp + 4 * fn + fp), 4) AS f2, round(2 * tp / (2 * tp + fp + fn), 4) AS dice,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 4) AS mcc, round(fp / (fp + tn), 4) AS far, round(fn / (tp + fn), 4) AS frr FROM c""")
def _(spark, sf):
    got = metrics.binary(T.read(spark, sf, "labels"), F.col("quality"), F.col("toxic"))
    return got.select("tp", "fp", "fn", "tn", *[r4(c).alias(c) for c in ("precision", "recall", "f2", "dice", "mcc", "far", "frr")])


@query("metric_entropies", """WITH j AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS s FROM j),
  a AS (SELECT -sum(p * ln(p)) AS ha FROM (SELECT sum(n) / max(s) AS p FROM j, t GROUP BY quality)), b AS (SELECT -sum(p * ln(p)) AS hb FROM (SELECT sum(n) / max(s) AS p FROM j, t GROUP BY toxic)),
  ab AS (SELECT -sum(n / s * ln(n / s)) AS hab FROM j, t) SELECT round(ha, 4) AS ha, round(hb, 4) AS hb, round(hab, 4) AS hab, round((ha + hb) / (2 * hab), 4) AS nmi FROM a, b, ab""")
def _(spark, sf):
    joint = T.read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return metrics.entropies(joint, "quality", "toxic").select(*[r4(c).alias(c) for c in ("ha", "hb", "hab", "nmi")])


OVER = "o AS (SELECT d.source AS region, l.quality AS object, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)"


def _overlap(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", F.col("source").alias("region"))
    return d.join(T.read(spark, sf, "labels"), "doc_id").groupBy("region", F.col("quality").alias("object")).agg(F.count("*").alias("n"))


@query("metric_achievable_accuracy", f"WITH {OVER}, p AS (SELECT region, max(n) AS top, sum(n) AS size FROM o GROUP BY region) SELECT round(sum(top) / sum(size), 4) AS asa FROM p")
def _(spark, sf):
    return metrics.achievable_accuracy(_overlap(spark, sf)).select(r4("asa").alias("asa"))


@query("metric_under_segmentation", f"WITH {OVER}, p AS (SELECT n, sum(n) OVER (PARTITION BY region) AS size FROM o) SELECT round(sum(least(n, size - n)) / sum(n), 4) + 0.0 AS error FROM p")
def _(spark, sf):
    return metrics.under_segmentation(_overlap(spark, sf)).select(r4("error").alias("error"))


DENS = KNN + """, kk AS (SELECT 2 * max(d2) / 9 AS k FROM kn), rw AS (SELECT id, sum(1 - exp(-d2 / k)) AS raw FROM kn, kk GROUP BY id)"""


@query("knn_density", f"WITH {DENS} SELECT id, round(raw, 4) AS raw, round(4094 * (max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()) + 1, 2) AS weight FROM rw")
def _(spark, sf):
    return samples.density(samples.knn_graph(T.samples(spark, sf), 5)).select("id", r4("raw").alias("raw"), F.round("weight", 2).alias("weight"))


@query("normalised_cut", f"WITH {KNN}, a AS (SELECT tl, nl, (SELECT max(sqrt(d2)) FROM kn) - sqrt(d2) AS s FROM kn), g AS (SELECT tl, sum(CASE WHEN tl <> nl THEN s ELSE 0 END) AS b, sum(s) AS t FROM a GROUP BY tl) SELECT round(sum(b / t), 4) AS ncut FROM g WHERE t > 0")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return samples.normalised_cut(samples.knn_graph(sm, 5), sm.select("id", F.col("truelabel").alias("group"))).select(r4("ncut").alias("ncut"))


@query("class_centroids", f"WITH {CENT} SELECT c, dim, round(m, 4) + 0.0 AS m FROM ct")
def _(spark, sf):
    return samples.class_centroids(T.samples(spark, sf)).select("c", F.posexplode("centre").alias("dim", "m")).select("c", F.col("dim").cast("long").alias("dim"), r4("m").alias("m"))


@query("nearest_centroid", f"WITH {CENT}, d AS (SELECT c.id, ct.c AS g, sum((v - m) * (v - m)) AS d FROM c JOIN ct USING (dim) GROUP BY ALL) SELECT id, g AS \"group\", round(d, 4) AS d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, g) = 1")
def _(spark, sf):
    sm = T.samples(spark, sf)
    return samples.nearest_centroid(sm, samples.class_centroids(sm)).select("id", "group", r4("d").alias("d"))


def _step(n: int) -> str:
    """One round of means in SQL: assign to centres k{n}, then move them."""
    return f"""d{n} AS (SELECT c.id, k.c AS g, sum((c.v - k.m) * (c.v - k.m)) AS d FROM c JOIN k{n} k USING (dim) GROUP BY ALL), a{n} AS (SELECT id, g FROM d{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, g) = 1),
    k{n + 1} AS (SELECT g AS c, dim, avg(v) AS m FROM a{n} JOIN c USING (id) GROUP BY ALL)"""


KM = LONG + ", k0 AS (SELECT truelabel AS c, dim, v AS m FROM c WHERE id IN (SELECT min(id) FROM sm GROUP BY truelabel)), " + _step(0) + ", " + _step(1)


def _k_means(spark, sf):
    sm = T.samples(spark, sf)
    first = sm.groupBy("truelabel").agg(F.min_by("feat", "id").alias("centre")).select(F.col("truelabel").alias("c"), "centre")
    return sm, samples.k_means(sm, first, 2)


@query("k_means", f"WITH {KM} SELECT c, dim, round(m, 4) + 0.0 AS m FROM k2")
def _(spark, sf):
    _, centres = _k_means(spark, sf)
    return centres.select("c", F.posexplode("centre").alias("dim", "m")).select("c", F.col("dim").cast("long").alias("dim"), r4("m").alias("m"))


@query("k_means_medoids", f"WITH {KM}, {_step(2)}, e AS (SELECT a2.g, a2.id, sum((c.v - k2.m) * (c.v - k2.m)) AS d FROM a2 JOIN c USING (id) JOIN k2 ON k2.c = a2.g AND k2.dim = c.dim GROUP BY ALL) SELECT g AS c, id FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(d, 9), id) = 1")
def _(spark, sf):
    sm, centres = _k_means(spark, sf)
    return samples.medoids(samples.nearest_centroid(sm, centres), centres)


@query("optimum_path_predict", f"WITH {PAIRS}, q AS (SELECT id, nb, nl, round(greatest((nb % 7) / 10.0, sqrt(d2)), 9) AS cost FROM pr WHERE st = 2 AND nst = 4) SELECT id, nl AS label, round(cost, 4) AS cost FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, nb) = 1")
def _(spark, sf):
    sm = T.samples(spark, sf)
    protos = samples.with_status(sm, T.TRAIN).select("id", "feat", F.col("truelabel").alias("label"), (F.col("id") % 7 / 10).alias("cost"))
    return samples.optimum_path_predicted(samples.with_status(sm, T.TEST), protos).select("id", "label", r4("cost").alias("cost"))


@query("optimum_path_prototypes")
def _(spark, sf):
    return samples.optimum_path_prototypes(T.samples(spark, sf), 5)


# --- samplings

RANK = "rk AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS rn, row_number() OVER (PARTITION BY truelabel ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS rc, count(*) OVER () AS n, count(*) OVER (PARTITION BY truelabel) AS nc FROM sm)"


@query("k_fold", f"WITH {SM}, {RANK} SELECT id, CAST(rn % 5 AS INTEGER) AS fold FROM rk")
def _(spark, sf):
    return samples.k_folds(T.samples(spark, sf), 5).select("id", "fold")


@query("random_split", f"WITH {SM}, {RANK} SELECT id, CASE WHEN rn < floor(n * 0.6) THEN 4 ELSE 2 END AS status FROM rk")
def _(spark, sf):
    return samples.random_split(T.samples(spark, sf), 0.6).select("id", "status")


@query("balanced_split", f"WITH {SM}, {RANK} SELECT id, CASE WHEN rc < 10 THEN 4 ELSE 2 END AS status FROM rk")
def _(spark, sf):
    return samples.balanced_split(T.samples(spark, sf), 10).select("id", "status")


@query("stratified_split", f"""WITH {SM}, {RANK}, b AS (SELECT truelabel, floor(123 * nc / n) AS base FROM rk GROUP BY truelabel, nc, n), q AS (SELECT truelabel, base + CASE WHEN row_number() OVER (ORDER BY truelabel) <= 123 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
  SELECT id, CASE WHEN rc < quota THEN 4 ELSE 2 END AS status FROM rk JOIN q USING (truelabel)""")
def _(spark, sf):
    return samples.stratified_split(T.samples(spark, sf), 123).select("id", "status")


# --- rasters: local operators

BOX = raster.rectangle(3, 3)
CROSS = raster.circle(1)
RING8 = raster.rectangle(3, 3)
DISK = raster.circle(1.5)


def _taps(taps, weights=None) -> str:
    rows = ", ".join(f"({i}, {dx}, {dy}, {float(w)!r})" for i, ((dx, dy), w) in enumerate(zip(taps, weights or [1.0] * len(taps))))
    return f"t(i, dx, dy, w) AS (VALUES {rows})"


def _stencil_sql(taps, expr: str, weights=None, source: str = "px", prefix: str = "") -> str:
    t = _taps(taps, weights)
    return f"WITH {PX}, {prefix}{t} SELECT p.x, p.y, {expr} AS val FROM {source} p CROSS JOIN t JOIN {source} q ON q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY p.x, p.y"


def _lines(fn) -> Query:
    def run(spark, sf):
        got = T.pixels(fn(T.scanlines(spark, sf))).where(F.col("val").isNotNull() & ~F.isnan("val"))
        return got.select(F.col("x").cast("long").alias("x"), "y", r4("val").alias("val"))

    return run


def _over(kind: str, source: str, name: str, taps=BOX) -> str:
    """A common table expression: max or min over taps."""
    rows = ", ".join(f"({dx}, {dy})" for dx, dy in taps)
    return f"{name} AS (SELECT 'e' AS image, p.x, p.y, {kind}(q.val) AS val FROM {source} p CROSS JOIN (VALUES {rows}) u(dx, dy) JOIN {source} q ON q.x = p.x + u.dx AND q.y = p.y + u.dy GROUP BY p.x, p.y), "


_G = raster.gaussian_weights(DISK, 1.0)
_BW = [1 / float(np.hypot(dx, dy)) for dx, dy in BOX[1:]]
_BW = [0.0] + [w / sum(_BW) for w in _BW]
_CENTRE = "(SELECT c.val FROM px c WHERE c.x = p.x AND c.y = p.y)"
_SX = "round(sum(q.val * t.w) FILTER (t.i < 6))"
_SY = "round(sum(q.val * t.w) FILTER (t.i >= 6))"
_BOTH = list(raster.SOBEL_X) + [(y, x) for x, y in raster.SOBEL_X]
_BOTHW = list(raster.SOBEL_X.values()) * 2
LOCAL: dict[str, tuple[Callable, str]] = {
    "raster_dilate": (lambda r: raster.dilate(r, BOX), _stencil_sql(BOX, "max(q.val)")),
    "raster_erode": (lambda r: raster.erode(r, BOX), _stencil_sql(BOX, "min(q.val)")),
    "raster_open": (lambda r: raster.opened(r, BOX), _stencil_sql(BOX, "max(q.val)", source="e1", prefix=_over("min", "px", "e1"))),
    "raster_close": (lambda r: raster.closed(r, BOX), _stencil_sql(BOX, "min(q.val)", source="e1", prefix=_over("max", "px", "e1"))),
    "raster_gradient": (lambda r: raster.morphological_gradient(r, BOX), _stencil_sql(BOX, "max(q.val) - min(q.val)")),
    "raster_mean_filter": (lambda r: raster.mean_filter(r, CROSS), _stencil_sql(CROSS, "round(sum(q.val) / count(*)) + 0.0")),
    "raster_median_filter": (lambda r: raster.median_filter(r, BOX), _stencil_sql(BOX, "list_sort(list(q.val))[1 + count(*) // 2]")),
    "raster_mode_filter": (
        lambda r: raster.mode_filter(r, BOX),
        f"WITH {PX}, {_taps(BOX)}, n AS (SELECT p.x, p.y, q.val, count(*) AS n, min(t.i) AS i FROM px p CROSS JOIN t JOIN px q ON q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY p.x, p.y, q.val) SELECT x, y, val FROM n QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC, i) = 1",
    ),
    "raster_linear_filter": (lambda r: raster.linear_filter(r, BOX, [4, 1, 2, 1, 2, 2, 1, 2, 1]), _stencil_sql(BOX, "round(sum(q.val * t.w)) + 0.0", [4, 1, 2, 1, 2, 2, 1, 2, 1])),
    "raster_gaussian": (lambda r: raster.gaussian_filter(r, 1.5, 1.0), _stencil_sql(DISK, "round(round(sum(q.val * t.w), 9)) + 0.0", _G)),
    "raster_sobel_x": (raster.sobel_x, _stencil_sql(list(raster.SOBEL_X), "round(sum(q.val * t.w)) + 0.0", list(raster.SOBEL_X.values()))),
    "raster_sobel_y": (raster.sobel_y, _stencil_sql([(y, x) for x, y in raster.SOBEL_X], "round(sum(q.val * t.w)) + 0.0", list(raster.SOBEL_X.values()))),
    "raster_sobel_magnitude": (raster.sobel_magnitude, _stencil_sql(_BOTH, f"round(sqrt(pow(coalesce({_SX}, 0), 2) + pow(coalesce({_SY}, 0), 2))) + 0.0", _BOTHW)),
    "raster_basins": (lambda r: raster.basins(r, BOX), _stencil_sql(BOX, "round(round(sum(abs(q.val - p.val) * t.w), 9)) + 0.0", _BW).replace("GROUP BY p.x, p.y", "GROUP BY p.x, p.y, p.val")),
    "raster_lbp": (lambda r: raster.local_binary_pattern(r, RING8), _stencil_sql(RING8, "CAST(sum(CASE WHEN t.i > 0 AND q.val > p.val THEN pow(2, t.i - 1) ELSE 0 END) AS DOUBLE)")),
    "raster_max_pool": (lambda r: raster.max_pool(r, BOX, 2), f"WITH m AS ({_stencil_sql(BOX, 'max(q.val)')}) SELECT x // 2 AS x, y // 2 AS y, val FROM m WHERE x % 2 = 0 AND y % 2 = 0"),
    "raster_min_pool": (lambda r: raster.min_pool(r, BOX, 2), f"WITH m AS ({_stencil_sql(BOX, 'min(q.val)')}) SELECT x // 2 AS x, y // 2 AS y, val FROM m WHERE x % 2 = 0 AND y % 2 = 0"),
    "raster_average_pool": (lambda r: raster.average_pool(r, BOX), _stencil_sql(BOX, "round(sum(q.val) / 9, 4) + 0.0")),
    "raster_power_pool": (lambda r: raster.power_pool(r, BOX, 2.0), _stencil_sql(BOX, "round(sqrt(sum(q.val * q.val)), 4)") + " HAVING count(*) = 9"),
    "raster_atrous_max": (lambda r: raster.dilate(r, raster.rectangle(3, 3, 2)), _stencil_sql(raster.rectangle(3, 3, 2), "max(q.val)")),
    "raster_box_sums": (
        lambda r: raster.box_sums(r, 5, 4),
        f"WITH {PX} SELECT p.x, p.y, CASE WHEN count(*) = 20 THEN sum(q.val) ELSE 0.0 END AS val FROM px p JOIN px q ON q.x BETWEEN p.x - 4 AND p.x AND q.y BETWEEN p.y - 3 AND p.y GROUP BY p.x, p.y",
    ),
}
LOCAL["raster_lbp"] = (LOCAL["raster_lbp"][0], LOCAL["raster_lbp"][1].replace("GROUP BY p.x, p.y", "GROUP BY p.x, p.y, p.val"))

for _name, (_fn, _sql) in LOCAL.items():
    query(_name, _sql)(_lines(_fn))


@query("raster_integral", f"WITH {PX}, r AS (SELECT x, y, sum(val) OVER (PARTITION BY y ORDER BY x) AS s FROM px) SELECT x, y, sum(s) OVER (PARTITION BY x ORDER BY y) AS val FROM r")
def _(spark, sf):
    return raster.integral(T.scanlines(spark, sf)).select(F.col("x").cast("long").alias("x"), "y", "val")


# --- rasters: global operators


def _px(spark, sf):
    return T.pixels(T.scanlines(spark, sf))


ABS = PX + ", v AS (SELECT x, y, CAST(abs(val) AS BIGINT) AS val FROM px)"
HIST = ABS + ", mx AS (SELECT greatest((max(val) + 1) / 64.0, 1.0) AS s FROM v), h AS (SELECT CAST(trunc(val / s) AS INTEGER) AS bin, count(*) AS n FROM v, mx GROUP BY 1)"


def _hist(spark, sf):
    px = _px(spark, sf).select(F.abs("val").alias("val"))
    return raster.histogram(px, "val", 64, float(px.agg(F.max("val")).first()[0] or 0))


@query("raster_histogram", f"WITH {HIST} SELECT bin, n FROM h")
def _(spark, sf):
    return _hist(spark, sf)


@query("raster_cumulative_histogram", f"WITH {HIST} SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS acc, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 4) AS share FROM h")
def _(spark, sf):
    return raster.cumulative(_hist(spark, sf)).withColumn("share", r4("share"))


@query("raster_histogram_summary", f"WITH {HIST}, c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) - n AS b, sum(n) OVER () AS t FROM h) SELECT (SELECT bin FROM h ORDER BY n DESC, bin LIMIT 1) AS mode, round(sum(bin * n) / sum(n), 4) AS mean, max(CASE WHEN b <= t / 2 THEN bin END) AS median FROM c")
def _(spark, sf):
    return raster.histogram_summary(_hist(spark, sf)).withColumn("mean", r4("mean"))


@query("raster_otsu", f"""WITH {HIST}, t AS (SELECT unnest(range(1, (SELECT max(bin) FROM h))) AS T), m AS (SELECT T, CAST(sum(n) FILTER (bin <= T) AS DOUBLE) AS a, CAST(sum(n) FILTER (bin > T) AS DOUBLE) AS b, sum(n * bin) FILTER (bin <= T) AS s1, sum(n * bin) FILTER (bin > T) AS s2, sum(n * bin * bin) FILTER (bin <= T) AS q1, sum(n * bin * bin) FILTER (bin > T) AS q2 FROM t, h GROUP BY T),
  j AS (SELECT T, a * b * pow(s1 / a - s2 / b, 2) / ((a + b) * (q1 - s1 * s1 / a + q2 - s2 * s2 / b)) AS j FROM m) SELECT CAST(T AS INTEGER) AS threshold FROM j ORDER BY round(j, 9) DESC, T LIMIT 1""")
def _(spark, sf):
    return raster.otsu(_hist(spark, sf))


@query("raster_threshold", f"WITH {PX} SELECT x, y, CASE WHEN val BETWEEN 50 AND 150 THEN 1 ELSE 0 END AS val FROM px")
def _(spark, sf):
    return _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", S.threshold(F.col("val"), 50, 150).alias("val"))


@query("raster_linear_stretch", f"WITH {PX} SELECT x, y, CASE WHEN val < -100 THEN 0.0 WHEN val > 200 THEN 255.0 ELSE round(round(255 / 300.0 * (val + 100), 9)) END AS val FROM px")
def _(spark, sf):
    v = F.col("val")
    inside = F.round(F.round(255 / 300.0 * (v + 100), 9))
    return _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", F.when(v < -100, 0.0).when(v > 200, 255.0).otherwise(inside).alias("val"))


@query("raster_blend", f"WITH {PX} SELECT a.x, a.y, round(round(0.25 * a.val + 0.75 * b.val, 6)) + 0.0 AS val FROM px a JOIN px b ON a.x = b.x AND a.y + 1 = b.y")
def _(spark, sf):
    a = T.scanlines(spark, sf)
    b = a.select("image", (F.col("y") - 1).alias("y"), F.col("line").alias("other"))
    line = F.zip_with("line", "other", lambda p, q: F.round(F.round(0.25 * p + 0.75 * q, 6)) + 0.0)
    return T.pixels(a.join(b, ["image", "y"]).withColumn("line", line)).select(F.col("x").cast("long").alias("x"), "y", "val")


@query("raster_algebra", f"WITH {PX} SELECT a.x, a.y, least(a.val, b.val) AS lo, greatest(a.val, b.val) AS hi, CASE WHEN a.val <> b.val THEN 1 ELSE 0 END AS differ, CASE WHEN a.val = b.val THEN a.val ELSE 0.0 END AS both_, a.val + b.val AS plus, abs(a.val - b.val) AS apart FROM px a JOIN px b ON a.x = b.x AND a.y + 1 = b.y")
def _(spark, sf):
    px = _px(spark, sf)
    b = px.select("image", "x", (F.col("y") - 1).alias("y"), F.col("val").alias("o"))
    v, o = F.col("val"), F.col("o")
    return px.join(b, ["image", "x", "y"]).select(F.col("x").cast("long").alias("x"), "y", F.least(v, o).alias("lo"), F.greatest(v, o).alias("hi"), (v != o).cast("int").alias("differ"), F.when(v == o, v).otherwise(0.0).alias("both_"), (v + o).alias("plus"), F.abs(v - o).alias("apart"))


TILE = PX + ", lb AS (SELECT x, y, val, (y // 8) * 8 + x // 8 AS label FROM px)"


def _tiled(spark, sf):
    return _px(spark, sf).withColumn("label", raster.tile_of(F.col("x"), F.col("y"), 8, 8))


@query("region_properties", f"WITH {TILE} SELECT label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(floor(sum(x) / count(*)) AS BIGINT) AS cx, CAST(floor(sum(y) / count(*)) AS BIGINT) AS cy, round(avg(val), 4) + 0.0 AS mean, round(stddev_pop(val), 4) AS stdev, min(val) AS least, max(val) AS largest FROM lb GROUP BY label")
def _(spark, sf):
    got = raster.regions(_tiled(spark, sf).withColumn("x", F.col("x").cast("long")), "label", "val")
    return got.withColumns({"mean": r4("mean"), "stdev": r4("stdev")})


@query("region_adjacency", f"WITH {TILE}, e AS (SELECT a.label AS a, b.label AS b FROM lb a JOIN lb b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM e WHERE a <> b")
def _(spark, sf):
    return raster.adjacency(_tiled(spark, sf))


@query("largest_regions", f"WITH {TILE}, q AS (SELECT label, count(*) FILTER (val > 0) AS area FROM lb GROUP BY label) SELECT label, area FROM q ORDER BY area DESC, label LIMIT 10")
def _(spark, sf):
    got = _tiled(spark, sf).groupBy("label").agg(F.count_if(F.col("val") > 0).alias("area"))
    return got.orderBy(F.desc("area"), "label").limit(10)


@query("regions_above_area", f"WITH {TILE}, q AS (SELECT label, count(*) FILTER (val > 0) AS area FROM lb GROUP BY label) SELECT label, area FROM q WHERE area >= 32")
def _(spark, sf):
    return _tiled(spark, sf).groupBy("label").agg(F.count_if(F.col("val") > 0).alias("area")).where("area >= 32")


@query("bounding_box", f"WITH {PX} SELECT coalesce(min(x), -1) AS x0, coalesce(min(y), -1) AS y0, coalesce(max(x), -1) AS x1, coalesce(max(y), -1) AS y1 FROM px WHERE val > 250")
def _(spark, sf):
    x = F.col("x").cast("long")
    return _px(spark, sf).where("val > 250").agg(*[F.coalesce(f(c), F.lit(-1).cast("long")).alias(n) for n, f, c in (("x0", F.min, x), ("y0", F.min, F.col("y")), ("x1", F.max, x), ("y1", F.max, F.col("y")))])


@query("sliding_tiles", f"WITH {PX}, o AS (SELECT unnest(range(0, 64, 16)) AS x0) SELECT o.x0, (p.y // 16) * 16 AS y0, round(avg(val), 4) + 0.0 AS mean FROM o JOIN px p ON p.x >= o.x0 AND p.x < o.x0 + 32 GROUP BY ALL")
def _(spark, sf):
    spots = F.filter(F.array(F.floor(F.col("x") / 16) * 16, F.floor(F.col("x") / 16) * 16 - 16), lambda s: s >= 0)
    return _px(spark, sf).withColumn("x0", F.explode(spots)).groupBy("x0", (F.floor(F.col("y") / 16) * 16).alias("y0")).agg(r4(F.avg("val")).alias("mean"))


@query("flood_components")
def _(spark, sf):
    lines = T.scanlines(spark, sf).withColumn("line", F.transform("line", lambda v: F.floor(v / 100).cast("double")))
    return raster.flood_components(lines)


# --- graphs

CUST = "ed AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(spark, sf):
    """Customers and the suppliers of their orders as one graph."""
    o, li = T.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), T.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


#: The least label among a node and its neighbours, eight times over; no two nodes of these graphs are farther apart.
_ROUNDS = ", ".join(f"r{k + 1} AS (SELECT r.n, least(min(r.c), min(q.c)) AS c FROM r{k} r JOIN u ON u.s = r.n JOIN r{k} q ON q.n = u.d GROUP BY r.n)" for k in range(8))


@query("connected_components", f"""WITH {CUST}, e AS (SELECT DISTINCT a AS s, b AS d FROM ed), u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), r0 AS (SELECT DISTINCT s AS n, s AS c FROM u), {_ROUNDS}
  SELECT n AS node, c AS component FROM r8""")
def _(spark, sf):
    return graphs.components(_edges(spark, sf))


@query("degrees", f"WITH {CUST}, u AS (SELECT a AS n FROM ed UNION ALL SELECT b FROM ed) SELECT n AS node, count(*) AS degree FROM u GROUP BY n")
def _(spark, sf):
    return graphs.degrees(_edges(spark, sf))


@query("spanning_forest")
def _(spark, sf):
    return graphs.spanning_forest(samples.knn_graph(T.samples(spark, sf), 5).select("src", "dst", "w")).withColumn("w", r4("w"))


@query("seed_votes", "SELECT d.source AS region, CASE WHEN sum(CASE WHEN l.quality = 1 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE 0 END AS vote FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source")
def _(spark, sf):
    rows = T.read(spark, sf, "documents").select("doc_id", "source").join(T.read(spark, sf, "labels"), "doc_id")
    return graphs.seed_votes(rows.select(F.col("source").alias("region"), F.col("quality").alias("label")))


@query("graph_pooling", f"WITH {KNN}, f AS (SELECT id, feat[1] AS v FROM sm), j AS (SELECT kn.id, sum(f.v) AS s, max(f.v) AS m FROM kn JOIN f ON f.id = kn.nb GROUP BY kn.id) SELECT f.id AS node, round((f.v + coalesce(j.s, 0)) / 9, 4) + 0.0 AS avg, round(j.m, 4) + 0.0 AS max FROM f LEFT JOIN j ON j.id = f.id")
def _(spark, sf):
    sm = T.samples(spark, sf)
    near = samples.knn_graph(sm, 5).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    got = graphs.pooled(sm.select(F.col("id").alias("node"), F.col("feat")[0].alias("v")), near, 9)
    return got.select("node", r4("avg").alias("avg"), r4("max").alias("max"))


def _as_graph(spark, sf):
    """Samples of a class as one graph, arcs to the five nearest of the class."""
    sm = T.samples(spark, sf)
    arcs = samples.knn_graph(sm, 5)
    c = sm.select("id", F.col("truelabel").cast("string").alias("graph_id"))
    own = arcs.join(c.select(F.col("id").alias("src"), "graph_id"), "src").join(c.select(F.col("id").alias("dst"), F.col("graph_id").alias("g2")), "dst").where("graph_id = g2").select("graph_id", "src", "dst")
    both = own.unionByName(own.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return sm.select(F.col("truelabel").cast("string").alias("graph_id"), F.col("id").alias("node"), F.lit(1).cast("long").alias("num_pixels"), "feat"), both


@query("graph_ring_neighbours")
def _(spark, sf):
    nodes, edges = _as_graph(spark, sf)
    return graphs.ring_neighbours(nodes, edges, 9)


@query("graph_watershed")
def _(spark, sf):
    nodes, edges = _as_graph(spark, sf)
    seeds = nodes.where("node % 10 = 0").select("graph_id", "node", (F.col("node") % 3).cast("int").alias("label"))
    return graphs.watershed(nodes, edges, seeds).withColumn("cost", r4("cost"))


@query("marker_components")
def _(spark, sf):
    nodes, edges = _as_graph(spark, sf)
    return layers.grouped_markers(edges, nodes.where("node % 4 = 0").select("graph_id", "node"))


# --- feature learning

ONE = (
    LONG
    + """, st AS (SELECT dim, avg(v) AS m, stddev_pop(v) + 0.01 AS s FROM c WHERE status = 4 GROUP BY dim), zl AS (SELECT id, truelabel, dim, (v - m) / s AS v FROM c JOIN st USING (dim)),
  zz AS (SELECT id, truelabel, list(v ORDER BY dim) AS z FROM zl GROUP BY ALL),
  pr AS (SELECT a.id, b.id AS nb, list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM zz a JOIN zz b ON true),
  nn AS (SELECT id, nb FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), nb) <= 9),
  pt AS (SELECT nn.id, zl.dim, avg(zl.v) AS m FROM nn JOIN zl ON zl.id = nn.nb GROUP BY ALL),
  kb AS (SELECT truelabel AS kernel, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM zl WHERE id IN (SELECT min(id) FROM sm GROUP BY truelabel)),
  ac AS (SELECT pt.id, kb.kernel, greatest(sum(pt.m * kb.w), 0) AS a FROM pt JOIN kb USING (dim) GROUP BY ALL),
  po AS (SELECT nn.id, ac.kernel, max(ac.a) AS p FROM nn JOIN ac ON ac.id = nn.nb WHERE nn.id <> nn.nb GROUP BY ALL)"""
)


@query("one_layer", f"WITH {ONE} SELECT sm.truelabel, po.kernel, round(avg(po.p), 4) + 0.0 AS mean_activation FROM po JOIN sm USING (id) GROUP BY ALL")
def _(spark, sf):
    return layers.one_layer(T.samples(spark, sf)).withColumn("mean_activation", r4("mean_activation"))


@query("train_graph_layer")
def _(spark, sf):
    from ..sources.formats import Architecture, Layer

    nodes, edges = _as_graph(spark, sf)
    seeds = nodes.where("node % 6 = 0").select("graph_id", "node")
    arch = Architecture(0.01, [Layer(channels=16, kernels_per_marker=2, pool="max_pool")])
    _, out = layers.train(nodes, edges, seeds, arch)
    return out.select("graph_id", "node", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


@query("superpixel_graph", f"WITH {TILE} SELECT label AS node, count(*) AS num_pixels, round(avg(val), 4) + 0.0 AS feat FROM lb GROUP BY label")
def _(spark, sf):
    px = _tiled(spark, sf).select(F.col("image").alias("image_id"), "x", "y", "label", F.array("val").alias("feat"))
    nodes, _edges = layers.superpixel_graph(px)
    return nodes.select("node", "num_pixels", r4(F.col("feat")[0]).alias("feat"))


@query("decoded_saliency")
def _(spark, sf):
    sm = T.samples(spark, sf)
    px = sm.select(F.lit("e").alias("image_id"), F.col("id").alias("p"), F.transform("feat", lambda v: F.greatest(v, F.lit(0.0))).alias("feat"))
    return layers.decoded(px).withColumn("saliency", r4("saliency"))


# --- colour, strings, numbers, JSON, sets, streams

RGB = "rgb AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(CAST(l_quantity AS BIGINT) * 5 % 256 AS INTEGER) AS b FROM lineitem)"


def _rgb(spark, sf):
    li = T.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), (F.col("l_quantity").cast("long") * 5 % 256).cast("int").alias("b"))


_Y = [f"greatest(0, least(255, CAST(trunc({a!r} * r + {b!r} * g + {c!r} * b + {d}) AS INTEGER)))".replace("+ -", "- ") for a, b, c, d in S.YCBCR]


@query("colour_ycbcr", f"WITH {RGB} SELECT l_orderkey, l_linenumber, {_Y[0]} AS y, {_Y[1]} AS cb, {_Y[2]} AS cr FROM rgb")
def _(spark, sf):
    y, cb, cr = S.ycbcr(*(F.col(c).cast("double") for c in "rgb"))
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


_XYZ = ", ".join(f"({a!r} * r + {b!r} * g + {c!r} * b) / 255 / {w!r} AS {n}" for (a, b, c), w, n in zip(S.XYZ, S.WHITE, ("x", "y", "z")))
_T = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1 / 3.0) ELSE 7.787 * {0} + 16 / 116.0 END"


@query("colour_lab", f"WITH {RGB}, q AS (SELECT l_orderkey, l_linenumber, {_XYZ} FROM rgb) SELECT l_orderkey, l_linenumber, round(CASE WHEN y > 0.008856 THEN 116 * pow(y, 1 / 3.0) - 16 ELSE 903.3 * y END, 3) + 0.0 AS l, round(500 * ({_T.format('x')} - {_T.format('y')}), 3) + 0.0 AS a, round(200 * ({_T.format('y')} - {_T.format('z')}), 3) + 0.0 AS b FROM q")
def _(spark, sf):
    light, a, b = S.lab(*(F.col(c).cast("double") / 255 for c in "rgb"))
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", *[(F.round(v, 3) + 0.0).alias(n) for v, n in ((light, "l"), (a, "a"), (b, "b"))])


@query("colour_luma", f"WITH {RGB} SELECT l_orderkey, l_linenumber, round(0.299 * r + 0.587 * g + 0.114 * b, 3) AS luma FROM rgb")
def _(spark, sf):
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", F.round(S.luma(*(F.col(c).cast("double") for c in "rgb")), 3).alias("luma"))


@query("string_split", "SELECT p_partkey, split_part(p_type, ' ', 1) AS first, split_part(p_type, ' ', -1) AS last, upper(p_name) AS upper_name, replace(p_brand, 'Brand', 'B') AS brand, starts_with(p_type, 'S') AS s_type, length(p_name) AS n FROM part")
def _(spark, sf):
    p = T.read(spark, sf, "part")
    return p.select("p_partkey", S.split_at(F.col("p_type"), " ", 0).alias("first"), S.split_at(F.col("p_type"), " ", -1).alias("last"), F.upper("p_name").alias("upper_name"), F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("brand"), F.col("p_type").startswith("S").alias("s_type"), F.length("p_name").cast("long").alias("n"))


@query("path_functions", r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '(\.[^./]+)$', 1) AS ext, regexp_replace(url, '\.[^./]+$', '') AS stem FROM pages")
def _(spark, sf):
    u = F.col("url")
    return T.read(spark, sf, "pages").select("page_id", S.base_name(u).alias("base"), S.parent(u).alias("parent"), S.extension(u).alias("ext"), S.without_extension(u).alias("stem"))


@query("regex_match", r"SELECT page_id, regexp_matches(url, '^https?://(m|blog)\.') AS hit, regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages")
def _(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", F.col("url").rlike(r"^https?://(m|blog)\.").alias("hit"), F.regexp_replace("url", "[0-9]+", "#").alias("masked"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) AS v, len(json_keys(props)) AS n FROM events")
def _(spark, sf):
    e = T.read(spark, sf, "events")
    key = F.array_min(F.json_object_keys("props"))
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", m[key].alias("v"), F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("numeric_functions", "SELECT o_orderkey, (o_custkey - 700) % 7 + CASE WHEN (o_custkey - 700) % 7 < 0 THEN 7 ELSE 0 END AS m, round(ln(o_totalprice) / ln(2), 4) AS lg, round(1 / (1 + exp(-0.00001 * o_totalprice)), 4) AS sg, round(exp(-pow((o_totalprice / 100000 - 1) / 2, 2) / 2) / (2 * sqrt(2 * pi())), 4) AS pdf FROM orders")
def _(spark, sf):
    p = F.col("o_totalprice")
    return T.read(spark, sf, "orders").select("o_orderkey", S.safe_mod(F.col("o_custkey") - 700, 7).alias("m"), r4(S.logarithm(p, 2)).alias("lg"), r4(S.sigmoid(p, 0.00001)).alias("sg"), r4(S.gauss_pdf(p / 100000, 1.0, 2.0)).alias("pdf"))


@query("prime_numbers", "SELECT p_size, p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 51) t(d) WHERE d < p_size AND p_size % d = 0) AS prime FROM (SELECT DISTINCT p_size FROM part)")
def _(spark, sf):
    return T.read(spark, sf, "part").select("p_size").distinct().select("p_size", S.is_prime(F.col("p_size"), 100).alias("prime"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(T.read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(T.read(spark, sf, "supplier").select("s_nationkey"))


@query("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    used = T.read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("k")).join(used, "k", "left_anti").distinct()


@query("bag_concat", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def _(spark, sf):
    both = T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(T.read(spark, sf, "supplier").select("s_nationkey"))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@query("arg_extremes", "SELECT user_id, arg_min(event_id, (value, event_id)) AS at_least, arg_max(event_id, (value, -event_id)) AS at_most FROM events GROUP BY user_id")
def _(spark, sf):
    e = T.read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("at_least"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("at_most"))


@query("kth_element", "SELECT event_type, value AS third FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) = 3")
def _(spark, sf):
    w = W.partitionBy("event_type").orderBy("value", "event_id")
    return T.read(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r = 3").select("event_type", F.col("value").alias("third"))


@query("running_moments", "SELECT event_id, round(avg(value) OVER w + 1e-9, 4) AS rm, round(avg(value * value) OVER w - pow(avg(value) OVER w, 2) + 1e-6, 2) AS rv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(spark, sf):
    got = running.running_moments(T.read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", F.to_date("ts"))
    return got.select("event_id", r4(F.col("rm") + 1e-9).alias("rm"), F.round(F.col("rv") + 1e-6, 2).alias("rv"))


@query("tumbling_windows", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    e = T.read(spark, sf, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour")
    return e.groupBy(hour, "event_type").agg(F.count("*").alias("n"), r4(F.avg("value") + 1e-9).alias("mean"))


@query("priced_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    price = F.col("l_extendedprice")
    return T.read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r4(F.avg("l_quantity")).alias("avg_qty"), F.count("*").alias("n"))
