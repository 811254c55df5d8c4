"""Filters, predicates, counts, orders and unions as queries, with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import colours as C
from ..operators import samples
from ..operators import selection as Z
from .queries import LONG, PX, RGB, SM, _px, _rgb, query, r4

#: Groups of samples by their first feature.
GR = SM + ", g AS (SELECT *, CAST(floor((feat[1] + 1) * 4) AS BIGINT) + 1 AS grp FROM sm)"


def _grouped(spark, sf) -> DataFrame:
    return T.samples(spark, sf).withColumn("group", (F.floor((F.col("feat")[0] + 1) * 4) + 1).cast("long"))


@query("samples_of_group", f"WITH {GR} SELECT id, grp AS \"group\" FROM g WHERE grp = 4")
def _(spark, sf):
    return Z.of_group(_grouped(spark, sf), 4).select("id", "group")


@query("samples_negative", f"WITH {SM} SELECT id, 2 AS truelabel FROM sm WHERE truelabel <> 3")
def _(spark, sf):
    return Z.negatives(T.samples(spark, sf), 3).select("id", "truelabel")


@query("samples_split_at", f"WITH {SM} SELECT id, CASE WHEN id < 100 THEN 1 ELSE 2 END AS part FROM sm")
def _(spark, sf):
    a, b = Z.split_at(T.samples(spark, sf), 100)
    return a.select("id", F.lit(1).alias("part")).unionByName(b.select("id", F.lit(2).alias("part")))


@query("samples_concatenated", f"WITH {SM} SELECT id, CAST(128 AS INTEGER) AS n, round(feat[1] + feat[64] + feat[64] * 2, 4) + 0.0 AS v FROM sm")
def _(spark, sf):
    sm = T.samples(spark, sf)
    both = Z.concatenated(sm, sm.withColumn("feat", F.transform("feat", lambda v: v * 2)))
    f = F.col("feat")
    return both.select("id", F.size(f).alias("n"), r4(f[0] + f[63] + f[127]).alias("v"))


@query("samples_label_matrix", f"WITH {SM}, k AS (SELECT max(truelabel) AS k FROM sm) SELECT id, truelabel AS c, CAST(k AS INTEGER) AS n FROM sm, k")
def _(spark, sf):
    rows = Z.label_matrix(T.samples(spark, sf), 10)
    return rows.select("id", F.array_position("row", 1.0).cast("int").alias("c"), F.size("row").alias("n"))


@query("samples_cells", f"WITH {LONG} SELECT id, round(sum(v * (dim + 1)), 4) + 0.0 AS v FROM c GROUP BY id")
def _(spark, sf):
    back = Z.from_cells(Z.feature_cells(T.samples(spark, sf)))
    return back.select("id", r4(F.aggregate(F.transform("feat", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v)).alias("v"))


@query("samples_traits", "SELECT true AS supervised, false AS training, false AS testing, true AS centred, false AS normalised")
def _(spark, sf):
    return Z.traits(samples.centred(T.samples(spark, sf)))


@query("samples_equal", "SELECT true AS same, false AS other")
def _(spark, sf):
    sm = T.samples(spark, sf).select("id", "truelabel")
    return Z.equal_tables(sm, sm, ["id", "truelabel"]).withColumnRenamed("equal", "same").join(Z.equal_tables(sm, sm.where("id > 3"), ["id", "truelabel"]).withColumnRenamed("equal", "other"))


@query("group_counts", f"WITH {GR} SELECT grp AS \"group\", count(*) AS n FROM g GROUP BY grp")
def _(spark, sf):
    return Z.group_counts(_grouped(spark, sf))


@query("group_number", f"WITH {GR} SELECT max(grp) AS groups FROM g")
def _(spark, sf):
    return Z.group_number(_grouped(spark, sf))


_TOP = ", t AS (SELECT grp, truelabel, count(*) AS n FROM g GROUP BY ALL)"


@query("group_purity", f"WITH {GR}{_TOP} SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT grp, max(n) AS top, sum(n) AS n FROM t GROUP BY grp)")
def _(spark, sf):
    return Z.purity(_grouped(spark, sf)).select(F.round("purity", 6).alias("purity"))


@query("group_classes", f"WITH {GR}{_TOP} SELECT grp AS \"group\", arg_max(truelabel, (n, -truelabel)) AS truelabel FROM t GROUP BY grp")
def _(spark, sf):
    return Z.group_classes(_grouped(spark, sf))


@query("group_propagated", f"WITH {GR}, t AS (SELECT grp, truelabel, count(*) AS n FROM g WHERE status = 4 GROUP BY ALL), k AS (SELECT grp, arg_max(truelabel, (n, -truelabel)) AS label FROM t GROUP BY grp) SELECT id, label FROM g LEFT JOIN k USING (grp)")
def _(spark, sf):
    return Z.propagated(_grouped(spark, sf)).select("id", "label")


@query("distinct_counts", "SELECT p_size AS value, count(*) AS n FROM part GROUP BY p_size")
def _(spark, sf):
    return Z.distinct_counts(T.read(spark, sf, "part"), "p_size")


@query("distinct_number", "SELECT count(DISTINCT p_size) AS n FROM part")
def _(spark, sf):
    return Z.distinct_counts(T.read(spark, sf, "part"), "p_size").agg(F.count("*").alias("n"))


@query("membership", "SELECT p_partkey, p_size IN (3, 7, 11) AS has FROM part")
def _(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", F.array_contains(F.array(F.lit(3), F.lit(7), F.lit(11)), F.col("p_size")).alias("has"))


# --- pixels

LB = PX + ", lb AS (SELECT x, y, val, (y // 8) * 8 + x // 8 AS label FROM px)"


@query("pixels_inserted", f"WITH {PX} SELECT p.x, p.y, coalesce(q.val, p.val) AS val FROM px p LEFT JOIN px q ON q.x = p.x - 5 AND q.y = p.y - 6 AND q.x < 9 AND q.y < 7")
def _(spark, sf):
    px = _px(spark, sf).select("x", "y", "val")
    return Z.inserted(px, px.where("x < 9 and y < 7"), 5, 6)


@query("pixels_binary", f"WITH {PX} SELECT x, y, CASE WHEN val // 100 <> 0 THEN 1 ELSE 0 END AS one, CASE WHEN val // 100 <> 0 THEN 255 ELSE 0 END AS top FROM (SELECT x, y, CAST(abs(val) AS BIGINT) AS val FROM px)")
def _(spark, sf):
    px = _px(spark, sf).withColumn("val", F.floor(F.abs("val") / 100).cast("int"))
    return Z.binary(px).select("x", "y", F.col("val").alias("one")).join(Z.binary(px, 255).select("x", "y", F.col("val").alias("top")), ["x", "y"])


@query("pixels_of_labels", f"WITH {LB} SELECT x, y, CASE WHEN label IN (3, 9, 27) THEN label ELSE 0 END AS kept, CASE WHEN label IN (3, 9, 27) THEN 0 ELSE label END AS rest FROM lb")
def _(spark, sf):
    px = _px(spark, sf).withColumn("val", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long"))
    kept = Z.only_labels(px, [3, 9, 27]).select("x", "y", F.col("val").alias("kept"))
    return kept.join(Z.only_labels(px, [3, 9, 27], keep=False).select("x", "y", F.col("val").alias("rest")), ["x", "y"])


_VX = LONG + ", vx AS (SELECT dim % 8 AS x, dim // 8 AS y, id AS z, v AS val FROM c)"


def _voxels(spark, sf) -> DataFrame:
    return T.components(T.samples(spark, sf)).select((F.col("dim") % 8).cast("long").alias("x"), F.floor(F.col("dim") / 8).alias("y"), F.col("id").alias("z"), F.col("v").alias("val"))


for _axis, (_u, _v) in {"z": ("x", "y"), "y": ("z", "x"), "x": ("y", "z")}.items():

    def _plane(spark, sf, axis=_axis):
        return Z.plane(_voxels(spark, sf), axis, 3).withColumn("val", r4("val"))

    query(f"plane_{_u}{_v}", f"WITH {_VX} SELECT {_u} AS u, {_v} AS v, round(val, 4) + 0.0 AS val FROM vx WHERE {_axis} = 3")(_plane)


@query("pixels_stacked", f"WITH {PX} SELECT x, y, round(val + 2 * val * 10 + 100 * x / 63.0 + 1000 * y / 63.0, 4) + 0.0 AS v FROM px")
def _(spark, sf):
    px = _px(spark, sf).select("x", "y", "val")
    bands = Z.with_place(Z.stacked([px, px.withColumn("val", F.col("val") * 2)]), 64, 64)
    f = F.col("feat")
    return bands.select("x", "y", r4(f[0] + 10 * f[1] + 100 * f[2] + 1000 * f[3]).alias("v"))


@query("pixels_are_labels", "SELECT true AS labels, false AS \"binary\"")
def _(spark, sf):
    return Z.is_label_image(_px(spark, sf).withColumn("val", (F.col("y") % 4).cast("long")))


@query("pixels_inside", f"WITH {PX} SELECT x, y, x - 2 >= 0 AND x - 2 < 40 AND y - 3 >= 0 AND y - 3 < 30 AS valid FROM px")
def _(spark, sf):
    return _px(spark, sf).select("x", "y", Z.inside(F.col("x") - 2, F.col("y") - 3, 40, 30).alias("valid"))


@query("pixels_mode", f"WITH {PX} SELECT arg_max(val, (n, -val)) AS mode FROM (SELECT val, count(*) AS n FROM px GROUP BY val)")
def _(spark, sf):
    return Z.mode(_px(spark, sf))


@query("pixels_masked_ends", f"WITH {PX} SELECT min(val) FILTER (x % 3 = 0) AS least, max(val) FILTER (x % 3 = 0) AS largest, round(avg(val), 4) + 0.0 AS mean, count(*) AS n, count(*) FILTER (val = 0) AS background FROM px")
def _(spark, sf):
    own = F.when(F.col("x") % 3 == 0, F.col("val"))
    return _px(spark, sf).agg(F.min(own).alias("least"), F.max(own).alias("largest"), r4(F.avg("val")).alias("mean"), F.count("*").alias("n"), F.count(F.when(F.col("val") == 0, 1)).alias("background"))


@query("pixels_exclusive", f"WITH {PX} SELECT p.x, p.y, CASE WHEN (p.val > 0) <> (q.val > 0) THEN 1 ELSE 0 END AS val FROM px p JOIN px q ON q.x = 63 - p.x AND q.y = p.y")
def _(spark, sf):
    px = _px(spark, sf).select("x", "y", (F.col("val") > 0).alias("val"))
    return Z.exclusive(px, px.withColumn("x", 63 - F.col("x")))


@query("centre_voxels", f"WITH {LB} SELECT label, CAST(round(avg(x)) AS INTEGER) AS x, CAST(round(avg(y)) AS INTEGER) AS y FROM lb WHERE val > 0 GROUP BY label")
def _(spark, sf):
    px = _px(spark, sf).where("val > 0").withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long"))
    return Z.weighted_centre(px, "label")


@query("colour_channels", f"WITH {RGB} SELECT l_orderkey, l_linenumber, r AS red, g AS green, b AS blue FROM rgb")
def _(spark, sf):
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue"))


_CH = RGB + ", ch AS (SELECT r // 32 + 8 * (g // 32) + 64 * (b // 32) AS bin, count(*) AS n FROM rgb GROUP BY 1)"


@query("colour_histogram", f"WITH {_CH} SELECT bin, n FROM ch")
def _(spark, sf):
    return Z.colour_histogram(_rgb(spark, sf), 8)


@query("histogram_shares", f"WITH {_CH} SELECT bin, round(n / (SELECT sum(n) FROM ch), 6) AS share FROM ch")
def _(spark, sf):
    return Z.histogram_shares(Z.colour_histogram(_rgb(spark, sf), 8)).withColumn("share", F.round("share", 6))


@query("histograms_added", f"WITH {_CH} SELECT bin, 2 * n AS n FROM ch")
def _(spark, sf):
    h = Z.colour_histogram(_rgb(spark, sf), 8)
    return Z.histograms_added(h, h)


@query("histogram_first_above", f"WITH {_CH} SELECT min(bin) AS bin FROM ch WHERE n > 10")
def _(spark, sf):
    return Z.first_above(Z.colour_histogram(_rgb(spark, sf), 8), 10)


_RG = LB + ", rg AS (SELECT label, count(*) AS n FROM lb WHERE val > 30 GROUP BY label)"


def _sizes(spark, sf) -> DataFrame:
    px = _px(spark, sf).where("val > 30").withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long"))
    return px.groupBy("label").agg(F.count("*").alias("n"))


for _name, _args, _sql in (
    ("regions_smallest", {"k": 5, "smallest": True}, "ORDER BY n, label LIMIT 5"),
    ("regions_one_smallest", {"k": 1, "smallest": True}, "ORDER BY n, label LIMIT 1"),
    ("regions_below", {"most": 22}, "WHERE n <= 22"),
    ("regions_between", {"least": 20, "most": 25}, "WHERE n BETWEEN 20 AND 25"),
):

    def _regions(spark, sf, args=_args):
        return Z.selected_regions(_sizes(spark, sf), **args)

    query(_name, f"WITH {_RG} SELECT label, n FROM rg {_sql}")(_regions)


# --- orders


@query("sorted_values", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders")
def _(spark, sf):
    return Z.ordered(T.read(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"), "o_totalprice", descending=True)


@query("group_ordered_by_weight", f"WITH {GR} SELECT id, grp AS \"group\", row_number() OVER (PARTITION BY grp ORDER BY round(feat[2], 9) DESC, id) AS rank FROM g QUALIFY rank <= 3")
def _(spark, sf):
    got = Z.by_group(_grouped(spark, sf), "group", -F.round(F.col("feat")[1], 9), 3)
    return got.select("id", "group", F.col("rank").cast("long").alias("rank"))


@query("group_ordered_by_root", f"WITH {LONG}, ct AS (SELECT truelabel, dim, avg(v) AS m FROM c GROUP BY ALL), d AS (SELECT c.id, c.truelabel, round(sum((c.v - ct.m) * (c.v - ct.m)), 9) AS d FROM c JOIN ct USING (truelabel, dim) GROUP BY ALL) SELECT truelabel AS \"group\", id, row_number() OVER (PARTITION BY truelabel ORDER BY d, id) AS rank FROM d QUALIFY rank <= 4")
def _(spark, sf):
    sm = T.samples(spark, sf).withColumn("group", F.col("truelabel"))
    return Z.by_root(sm, samples.class_centroids(sm), 4).withColumn("rank", F.col("rank").cast("long"))


@query("samples_drawn", "SELECT vec_id AS id FROM embeddings ORDER BY CAST(('0x' || substr(md5('1:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT), vec_id LIMIT 30")
def _(spark, sf):
    return Z.drawn(T.samples(spark, sf), 30).select("id")


@query("samples_by_tree")
def _(spark, sf):
    from ..operators import graphs

    tree = graphs.spanning_forest(samples.knn_graph(T.samples(spark, sf), 5).select("src", "dst", "w"))
    return Z.by_tree_weight(tree, 20)


# --- file sets

FS = "fs AS (SELECT 'data/' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || '_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.png' AS path, c_nationkey AS label, c_custkey FROM customer)"


def _files(spark, sf) -> DataFrame:
    from ..functions.texts import sample_name

    c = T.read(spark, sf, "customer")
    return c.select(F.concat(F.lit("data/"), sample_name(F.col("c_nationkey"), F.col("c_custkey"), ".png")).alias("path"))


@query("files_named", f"WITH {FS} SELECT path FROM fs WHERE c_custkey IN (5, 17)")
def _(spark, sf):
    names = T.read(spark, sf, "customer").where("c_custkey in (5, 17)").select(F.concat(F.lpad(F.col("c_nationkey").cast("string"), 6, "0"), F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("name"))
    return Z.files_named(_files(spark, sf), names)


@query("files_at", f"WITH {FS} SELECT path FROM fs QUALIFY row_number() OVER (ORDER BY path) - 1 IN (0, 2, 9)")
def _(spark, sf):
    return Z.files_at(_files(spark, sf), [0, 2, 9])


@query("files_of_class", f"WITH {FS} SELECT path FROM fs WHERE label = 3")
def _(spark, sf):
    return Z.files_of_class(_files(spark, sf), 3)


@query("files_per_class", f"WITH {FS} SELECT label, count(*) AS n FROM fs GROUP BY label")
def _(spark, sf):
    return Z.files_per_class(_files(spark, sf))


@query("files_split", f"WITH {FS} SELECT path, CASE WHEN CAST(('0x' || substr(md5('1:' || path), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3 THEN 1 ELSE 2 END AS part FROM fs")
def _(spark, sf):
    return Z.files_split(_files(spark, sf), 0.3)


@query("files_sorted", f"WITH {FS} SELECT path, row_number() OVER (ORDER BY path) AS n FROM fs")
def _(spark, sf):
    from pyspark.sql import Window as W

    return _files(spark, sf).withColumn("n", F.row_number().over(W.orderBy("path")).cast("long"))


# --- unions


@query("samples_merged", f"WITH {SM}, k AS (SELECT max(id) + 1 AS k FROM sm) SELECT id, truelabel FROM sm UNION ALL SELECT id + k, truelabel FROM sm, k WHERE id < 50")
def _(spark, sf):
    sm = T.samples(spark, sf).select("id", "truelabel")
    return Z.merged([sm, sm.where("id < 50")])


@query("samples_merged_drawn", "SELECT 40 AS n")
def _(spark, sf):
    sm = T.samples(spark, sf).select("id", "truelabel")
    return Z.merged_samples([sm, sm], 20).agg(F.count("*").cast("int").alias("n"))


@query("samples_dealt", "SELECT vec_id AS id, CAST(floor(CAST(('0x' || substr(md5('1:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * 4) AS BIGINT) AS part FROM embeddings")
def _(spark, sf):
    return Z.dealt(T.samples(spark, sf), 4).select("id", "part")


@query("moments_without", f"WITH {LONG}, s AS (SELECT id, list(v ORDER BY dim) AS f FROM c GROUP BY id) SELECT id, round(list_avg(f[2:]), 4) + 0.0 AS mean, round(list_var_pop(f[2:]), 4) AS var FROM s")
def _(spark, sf):
    from ..functions import maths as M
    from ..functions import vectors as V

    f = F.col("feat")
    n, m = F.size(f), V.mean(f)
    return T.samples(spark, sf).select("id", r4(Z.mean_without(m, n, f[0])).alias("mean"), r4(Z.variance_without(m, M.variance(f), n, f[0])).alias("var"))


@query("band_quantised", f"WITH {PX} SELECT x, y, (least(7, greatest(0, floor((val + 400) / 100))) + 0.5) * 100 - 400 AS val FROM px")
def _(spark, sf):
    return _px(spark, sf).select("x", "y", C.quantised(F.col("val"), -400.0, 400.0, 8).alias("val"))
