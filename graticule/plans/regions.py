"""Features of regions and edits of region graphs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scalars as S
from ..operators import raster
from ..operators import regions as G
from .pictures import _images
from .queries import PX, RGB, _as_graph, _px, _rgb, _Y, query, r4

RG = RGB + ", rg AS (SELECT l_orderkey % 97 AS label, r, g, b FROM rgb)"


def _pixels(spark, sf) -> DataFrame:
    return _rgb(spark, sf).select((F.col("l_orderkey") % 97).alias("label"), *[F.col(c).cast("double").alias(c) for c in "rgb"])


def _bands() -> list:
    return [F.col(c) for c in "rgb"]


_SKEW = "CASE WHEN var_pop({0}) > 0 THEN sign(avg(pow({0} - m{0}, 3))) * pow(abs(avg(pow({0} - m{0}, 3))), 1 / 3.0) ELSE 0 END"


@query("region_moments", f"WITH {RG}, m AS (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb FROM rg WINDOW w AS (PARTITION BY label)) SELECT label, round(avg(r), 3) AS m0, round(stddev_pop(g), 3) AS s1, round({_SKEW.format('b')}, 3) + 0.0 AS t2, round(count(*) / (SELECT count(*) FROM rg), 6) AS size FROM m GROUP BY label")
def _(spark, sf):
    got = G.moments(_pixels(spark, sf), _bands())
    f = F.col("feat")
    return got.select("label", F.round(f[0], 3).alias("m0"), F.round(f[4], 3).alias("s1"), (F.round(f[8], 3) + 0.0).alias("t2"), F.round("size", 6).alias("size"))


@query("region_colour_means", f"WITH {RG}, y AS (SELECT label, {_Y[0]} AS y, {_Y[1]} AS cb, {_Y[2]} AS cr FROM rg) SELECT label, round(avg(y), 3) AS m0, round(stddev_pop(y), 3) AS s0, round(avg(cr), 3) AS m2, round(stddev_pop(cr), 3) AS s2, round(count(*) / (SELECT count(*) FROM y), 6) AS size FROM y GROUP BY label")
def _(spark, sf):
    got = G.mean_deviation_size(_pixels(spark, sf), S.ycbcr(*_bands()))
    f = F.col("feat")
    return got.select("label", *[F.round(f[k], 3).alias(n) for k, n in ((0, "m0"), (1, "s0"), (4, "m2"), (5, "s2"))], F.round(f[6], 6).alias("size"))


@query("region_lab_means")
def _(spark, sf):
    got = G.moments(_pixels(spark, sf), S.lab(*[c / 255 for c in _bands()]))
    return got.select("label", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"), F.round("size", 6).alias("size"))


@query("region_colour_histograms", f"WITH {RG}, h AS (SELECT label, r // 64 + 4 * (g // 64) + 16 * (b // 64) AS bin, count(*) AS n FROM rg GROUP BY ALL) SELECT label, bin, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM h")
def _(spark, sf):
    return G.histograms(_pixels(spark, sf), _bands(), 4, [0.0] * 3, [256.0] * 3).withColumn("share", F.round("share", 6))


@query("region_lab_histograms")
def _(spark, sf):
    got = G.histograms(_pixels(spark, sf), S.lab_scaled(*[c / 255 for c in _bands()]), 3, [0.0] * 3, [1.0] * 3)
    return got.withColumn("share", F.round("share", 6))


_BI = PX + ", p AS (SELECT x, y, (y // 8) * 8 + x // 8 AS label, CAST(floor(abs(val) / 64) AS BIGINT) AS bin FROM px)"
_ON = " OR ".join(f"coalesce((SELECT q.bin FROM p q WHERE q.x = p.x + {dx} AND q.y = p.y + {dy}), p.bin) <> p.bin" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@query("region_border_interior", f"WITH {_BI}, o AS (SELECT label, bin, ({_ON}) AS b FROM p) SELECT label, bin, count(*) FILTER (b) AS border, count(*) FILTER (NOT b) AS interior FROM o GROUP BY ALL")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("x").cast("long").alias("x"), "y", "val", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("label"))
    return G.border_interior(px, F.floor(F.abs("val") / 64))


@query("oriented_gradients")
def _(spark, sf):
    return G.oriented_gradients(_images(spark, sf)).select("image", "cy", "cx", F.transform("feat", lambda v: F.round(v, 4)).alias("feat"))


@query("brightness", "SELECT CAST(label AS VARCHAR) AS image, CAST(count(*) * 64 AS INTEGER) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    return G.brightness(_images(spark, sf)).select("image", F.size("feat").alias("n"))


@query("graph_without_nodes")
def _(spark, sf):
    nodes, edges = _as_graph(spark, sf)
    _, kept = G.without_node(nodes, edges, nodes.where("node % 7 = 0").select("graph_id", "node"))
    return kept


@query("graph_faults", "SELECT 'none' AS fault WHERE false")
def _(spark, sf):
    """Graphs of nearest neighbours, both ways, have none."""
    return G.faults(*_as_graph(spark, sf)).select("fault")


@query("graph_on_pixels", f"WITH {PX}, l AS (SELECT x, y, val, (y // 8) * 8 + x // 8 AS label FROM px), m AS (SELECT label, avg(val) AS m FROM l GROUP BY label) SELECT x, y, round(m, 4) + 0.0 AS val FROM l JOIN m USING (label)")
def _(spark, sf):
    px = _px(spark, sf).select(F.col("image").alias("graph_id"), F.col("x").cast("long").alias("x"), "y", "val", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("label"))
    nodes = px.groupBy("graph_id", F.col("label").alias("node")).agg(F.array(F.avg("val")).alias("feat"))
    return G.on_pixels(nodes, px).select("x", "y", r4(F.col("feat")[0]).alias("val"))


@query("disjoint_sets", "SELECT n_nationkey AS element, CASE WHEN n_nationkey < 24 THEN n_nationkey % 3 ELSE n_nationkey END AS root FROM nation")
def _(spark, sf):
    n = T.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("element"))
    pairs = n.where("element >= 3 and element < 24").select((F.col("element") - 3).alias("a"), F.col("element").alias("b"))
    return G.disjoint_sets(n, pairs)


@query("text_in_pages", "SELECT url AS path, max(contains(html, '<h1')) AS found FROM pages GROUP BY url")
def _(spark, sf):
    return G.in_files(T.read(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("value")), "<h1")


@query("integral_of_all", f"WITH {PX} SELECT round(sum(val), 2) AS total FROM px")
def _(spark, sf):
    """The last cell of the running sums."""
    got = raster.integral(T.scanlines(spark, sf))
    return got.orderBy(F.desc("y"), F.desc("x")).limit(1).select(F.round("val", 2).alias("total"))
