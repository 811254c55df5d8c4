"""Filters, predicates, counts, histograms, orders and unions of sample tables, pixel tables and file sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import texts as X
from ..functions import vectors as V
from ..tables import TEST, TRAIN, has

# --- samples


def of_group(sm: DataFrame, group: int) -> DataFrame:
    return sm.where(F.col("group") == group)


def negatives(sm: DataFrame, positive: int) -> DataFrame:
    """Samples of other classes than the positive one, all as class 2."""
    return sm.where(F.col("truelabel") != positive).withColumn("truelabel", F.lit(2))


def split_at(sm: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Rows below an id, and the others."""
    return sm.where(F.col("id") < first), sm.where(F.col("id") >= first)


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples of one id with the features of both tables, a's first."""
    other = b.select("id", F.col("feat").alias("_more"))
    return a.join(other, "id").withColumn("feat", F.concat("feat", "_more")).drop("_more")


def label_matrix(sm: DataFrame, classes: int) -> DataFrame:
    """(id, row): 1 at the place of the sample's class, else 0."""
    return sm.select("id", F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda c: (c == F.col("truelabel")).cast("double")).alias("row"))


def feature_cells(sm: DataFrame) -> DataFrame:
    """(i, j, v): the features as cells of a matrix."""
    return sm.select(F.col("id").alias("i"), F.posexplode("feat").alias("j", "v"))


def from_cells(cells: DataFrame) -> DataFrame:
    """(id, feat) of cells (i, j, v) without gaps."""
    own = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("feat"))
    return own.withColumnRenamed("i", "id")


def traits(sm: DataFrame, close: float = 1e-3) -> DataFrame:
    """One row: supervised (classes above 0 on all rows), training, testing (all rows have the status), centred (means near 0), normalised (centred, deviations near 1)."""
    rows = sm.agg(F.min(F.col("truelabel") > 0).alias("supervised"), F.min(has(F.col("status"), TRAIN)).alias("training"), F.min(has(F.col("status"), TEST)).alias("testing"))
    per = feature_cells(sm).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    kinds = per.agg(F.max(F.abs("m")).alias("m"), F.max(F.abs(F.col("s") - 1)).alias("s"))
    return rows.join(kinds).select("supervised", "training", "testing", (F.col("m") < close).alias("centred"), ((F.col("m") < close) & (F.col("s") < close)).alias("normalised"))


def equal_tables(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(equal): whether both hold the same rows, as often."""
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("n")).agg((F.coalesce(F.max(F.abs("n")), F.lit(0)) == 0).alias("equal"))


def group_counts(sm: DataFrame) -> DataFrame:
    return sm.where("group > 0").groupBy("group").agg(F.count("*").alias("n"))


def group_number(sm: DataFrame) -> DataFrame:
    """The largest group: what the samples take as their number of groups."""
    return sm.agg(F.max("group").alias("groups"))


def purity(sm: DataFrame) -> DataFrame:
    """(purity): the share of samples of their group's commonest class."""
    per = sm.groupBy("group", "truelabel").agg(F.count("*").alias("n"))
    return per.groupBy("group").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def group_classes(sm: DataFrame) -> DataFrame:
    """(group, truelabel): the commonest class of each group, the lowest one among equals."""
    per = sm.groupBy("group", "truelabel").agg(F.count("*").alias("n"))
    return per.groupBy("group").agg(F.max_by("truelabel", F.struct(F.col("n"), -F.col("truelabel"))).alias("truelabel"))


def propagated(sm: DataFrame) -> DataFrame:
    """sm with the label of its group's commonest class among training samples."""
    own = group_classes(sm.where(has(F.col("status"), TRAIN))).withColumnRenamed("truelabel", "label")
    return sm.join(own, "group", "left")


def distinct_counts(values: DataFrame, column: str) -> DataFrame:
    """(value, n) of each distinct value."""
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


# --- pixels (x, y, val), also with bands


def inserted(px: DataFrame, part: DataFrame, x: int, y: int) -> DataFrame:
    """px with the values of a part whose corner is put at x, y."""
    moved = part.select((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("val").alias("_new"))
    return px.join(moved, ["x", "y"], "left").withColumn("val", F.coalesce("_new", "val")).drop("_new")


def plane(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    """(u, v, val): the slice of voxels (x, y, z, val) at a place on one axis."""
    u, v = {"z": ("x", "y"), "y": ("z", "x"), "x": ("y", "z")}[axis]
    return voxels.where(F.col(axis) == at).select(F.col(u).alias("u"), F.col(v).alias("v"), "val")


def only_labels(px: DataFrame, labels: list[int], keep: bool = True) -> DataFrame:
    """Other values (or, if not `keep`, these) become 0."""
    own = F.col("val").isin(labels)
    return px.withColumn("val", F.when(own if keep else ~own, F.col("val")).otherwise(0))


def binary(px: DataFrame, top: int = 1) -> DataFrame:
    return px.withColumn("val", F.when(F.col("val") != 0, top).otherwise(0))


def stacked(images: list[DataFrame]) -> DataFrame:
    """Pixels of several grey images as bands (x, y, feat)."""
    return reduce(lambda a, b: a.join(b, ["x", "y"]), [px.select("x", "y", F.array("val").alias(f"_{k}")) for k, px in enumerate(images)]).select("x", "y", F.concat(*[f"_{k}" for k in range(len(images))]).alias("feat"))


def with_place(bands: DataFrame, width: int, height: int) -> DataFrame:
    """Bands with x and y, scaled to 0..1, behind them."""
    return bands.withColumn("feat", F.concat("feat", F.array(F.col("x") / float(max(1, width - 1)), F.col("y") / float(max(1, height - 1)))))


def is_label_image(px: DataFrame) -> DataFrame:
    """(labels, binary): whether the values are 0..k without gaps, and whether at most 0 and another value occur."""
    return px.agg(F.min("val").alias("lo"), F.max("val").alias("hi"), F.countDistinct("val").alias("n"), F.countDistinct(F.when(F.col("val") != 0, F.col("val"))).alias("k")).select(
        ((F.col("lo") == 0) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))).alias("labels"), (F.col("k") <= 1).alias("binary")
    )


def inside(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def mode(px: DataFrame) -> DataFrame:
    """(mode): the commonest value, the lowest among equals."""
    return px.groupBy("val").agg(F.count("*").alias("n")).agg(F.max_by("val", F.struct(F.col("n"), -F.col("val"))).alias("mode"))


def colour_histogram(px: DataFrame, bins: int, top: int = 255) -> DataFrame:
    """(bin, n) of r, g, b: each band in `bins`, numbered r + bins * g + bins^2 * b."""
    size = max((top + 1) / bins, 1)
    r, g, b = (F.floor(F.col(c) / size) for c in "rgb")
    return px.groupBy((r + bins * g + bins * bins * b).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_shares(hist: DataFrame) -> DataFrame:
    total = hist.agg(F.sum("n").alias("_all"))
    return hist.join(F.broadcast(total)).select("bin", (F.col("n") / F.col("_all")).alias("share"))


def histograms_added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bin").agg(F.sum("n").alias("n"))


def first_above(hist: DataFrame, value: float) -> DataFrame:
    """(bin): the first bin that holds more than `value`."""
    return hist.where(F.col("n") > value).agg(F.min("bin").alias("bin"))


def weighted_centre(px: DataFrame, by: str) -> DataFrame:
    """(by, x, y): the voxel next to the mean place of each label."""
    return px.groupBy(by).agg(F.round(F.avg("x")).cast("int").alias("x"), F.round(F.avg("y")).cast("int").alias("y"))


def selected_regions(sizes: DataFrame, k: int | None = None, smallest: bool = False, least: int | None = None, most: int | None = None) -> DataFrame:
    """(label, n): the k largest (or smallest) regions, or those of at least and at most so many pixels; ties by label."""
    if least is not None:
        sizes = sizes.where(F.col("n") >= least)
    if most is not None:
        sizes = sizes.where(F.col("n") <= most)
    return sizes if k is None else sizes.orderBy(F.col("n") if smallest else F.desc("n"), "label").limit(k)


def exclusive(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, val): 1 where two images differ."""
    return a.join(b.select("x", "y", F.col("val").alias("_o")), ["x", "y"]).select("x", "y", (F.col("val") != F.col("_o")).cast("int").alias("val"))


# --- orders


def ordered(values: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """(key, value) in order, ties by key; a range-partitioned sort."""
    c = F.col(column)
    return values.select(F.col(key), c.alias("value")).orderBy(c.desc() if descending else c.asc(), key)


def by_group(rows: DataFrame, by: str, score: Column, n: int) -> DataFrame:
    """The first n rows of each group by a score, then by id, with their rank."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(score, "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def by_root(sm: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """(group, id, rank): the samples nearest to the centre (c, centre) of their group; centres are as many as groups."""
    own = sm.join(F.broadcast(centres), sm["group"] == centres["c"])
    d = F.round(V.squared_euclidean(F.col("feat"), F.col("centre")), 9)
    return by_group(own.select("group", "id", d.alias("d")), "group", F.col("d"), n).select("group", "id", "rank")


def drawn(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows drawn by seed and id."""
    return rows.orderBy(M.uniform(F.col("id"), seed), "id").limit(n)


def by_tree_weight(tree: DataFrame, n: int) -> DataFrame:
    """(id, rank): ends of the heaviest arcs (src, dst, w) of a spanning tree, each once: where classes are likely to meet."""
    ends = tree.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.max("w").alias("w"))
    return ends.orderBy(F.desc("w"), "id").limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("w"), "id"))).select("id", "rank")


# --- file sets (path)


def files_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files whose name without folder and extension is one of (name)."""
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^./]+$", "")
    return files.join(names.select("name").distinct(), base == F.col("name"), "left_semi")


def files_at(files: DataFrame, numbers: list[int]) -> DataFrame:
    """Files by their numbers, from 0, in the order of paths."""
    return files.withColumn("_n", F.row_number().over(W.orderBy("path")) - 1).where(F.col("_n").isin(numbers)).drop("_n")


def files_of_class(files: DataFrame, label: int) -> DataFrame:
    return files.where(X.sample_label(F.col("path")) == label)


def files_per_class(files: DataFrame) -> DataFrame:
    return files.groupBy(X.sample_label(F.col("path")).alias("label")).agg(F.count("*").alias("n"))


def files_split(files: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Files with part 1 or 2, drawn by seed and path."""
    return files.withColumn("part", F.when(M.uniform(F.col("path"), seed) < share, 1).otherwise(2))


# --- unions


def merged(tables: list[DataFrame]) -> DataFrame:
    """All rows, with ids that go on from table to table; tables whose columns differ raise an error."""
    out, first = None, 0
    for t in tables:
        n = t.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        t = t.withColumn("id", F.col("id") + first)
        out, first = t if out is None else out.unionByName(t), first + n
    return out


def merged_samples(tables: list[DataFrame], each: int, seed: int = 1) -> DataFrame:
    """As `merged`, of so many rows of each table, drawn by seed."""
    return merged([drawn(t, each, seed) for t in tables])


def dealt(sm: DataFrame, parts: int, seed: int = 1) -> DataFrame:
    """sm with a part from 0, drawn by seed and id."""
    return sm.withColumn("part", M.integer(F.col("id"), seed, 0, parts - 1))


# --- running mean and variance


def mean_without(mean: Column, n: Column, x: Column) -> Column:
    """The mean after x has gone from n values."""
    return (n * mean - x) / (n - 1)


def variance_without(mean: Column, variance: Column, n: Column, x: Column) -> Column:
    """The population variance after x has gone from n values."""
    left = mean_without(mean, n, x)
    return (n * (variance + mean * mean) - x * x) / (n - 1) - left * left
