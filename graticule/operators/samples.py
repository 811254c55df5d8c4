"""Operators on sample tables (id, feat, truelabel, status): normalisers, statistics, splits, neighbours, clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..tables import TEST, TRAIN, has

#: Rows of a block in block-wise comparisons, and centroids in one broadcast.
BLOCK, CENTROIDS = 2048, 4096


# --- filters and relabelling


def with_status(sm: DataFrame, bits: int) -> DataFrame:
    return sm.where(has(F.col("status"), bits))


def of_class(sm: DataFrame, label: int) -> DataFrame:
    return sm.where(F.col("truelabel") == label)


def without_class(sm: DataFrame, label: int) -> DataFrame:
    return sm.where(F.col("truelabel") != label)


def object_classes(sm: DataFrame) -> DataFrame:
    """Samples of classes above 1, all as class 2 and for training."""
    return sm.where("truelabel > 1").withColumns({"truelabel": F.lit(2), "status": F.lit(TRAIN)})


def unambiguous(sm: DataFrame) -> DataFrame:
    """Samples whose vector no sample of another class shares."""
    mixed = sm.groupBy("feat").agg((F.min("truelabel") != F.max("truelabel")).alias("mixed")).where("not mixed")
    return sm.join(mixed.select("feat"), "feat", "left_semi")


def sliced(sm: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows number begin to end (from 0, both included) by id."""
    return sm.where(F.col("id").between(begin, end))


# --- statistics and normalisers


def feature_statistics(sm: DataFrame) -> DataFrame:
    """(dim, mean, stdev_pop, stdev, least, largest) per feature: partial sums per task, one row per dimension."""
    return sm.select(F.posexplode("feat").alias("dim", "v")).groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev_pop"), F.stddev_samp("v").alias("stdev"), F.min("v").alias("least"), F.max("v").alias("largest"),
        F.min(F.when(F.col("v") > 0, F.col("v"))).alias("least_positive"),
    )


def _as_arrays(stats: DataFrame, *columns: str) -> DataFrame:
    """The statistics as one row of arrays: as wide as the vectors, however many samples."""
    return stats.agg(*[F.transform(F.array_sort(F.collect_list(F.struct("dim", F.col(c).alias("s")))), lambda r: r["s"]).alias(c) for c in columns])


def _each(sm: DataFrame, stats: DataFrame, f, *columns: str) -> DataFrame:
    """feat with f(value, statistics of its dimension) applied; the one row of statistics is broadcast."""
    wide = sm.join(F.broadcast(_as_arrays(stats, *columns)))
    fn = lambda v, k: f(v, *(F.col(c)[k] for c in columns))
    return wide.withColumn("feat", F.transform("feat", fn)).drop(*columns)


def z_scored(sm: DataFrame, stats: DataFrame | None = None, factor: float = 0.01) -> DataFrame:
    """(v - mean) / (population deviation + factor), with the statistics of these or other samples."""
    return _each(sm, feature_statistics(sm) if stats is None else stats, lambda v, m, s: (v - m) / (s + factor), "mean", "stdev_pop")


def z_scored_by_training(sm: DataFrame, factor: float = 0.01) -> DataFrame:
    return z_scored(sm, feature_statistics(with_status(sm, TRAIN)), factor)


def centred(sm: DataFrame) -> DataFrame:
    return _each(sm, feature_statistics(sm), lambda v, m: v - m, "mean")


def min_max_scaled(sm: DataFrame) -> DataFrame:
    """(v - least + 1e-5) / (largest - least + 1e-5)."""
    return _each(sm, feature_statistics(sm), lambda v, a, b: (v - a + 1e-5) / (b - a + 1e-5), "least", "largest")


def band_scaled(sm: DataFrame) -> DataFrame:
    """Per band (v - least positive value) / (largest - least positive value), negatives to 0."""
    return _each(sm, feature_statistics(sm), lambda v, a, b: F.greatest(F.lit(0.0), (v - a) / (b - a)), "least_positive", "largest")


def power_normalised(sm: DataFrame, alpha: float = 0.5) -> DataFrame:
    """v to the power alpha with v's sign; a negative v with a broken power is NaN."""
    return sm.withColumn("feat", F.transform("feat", lambda v: F.pow(v, F.lit(alpha)) * F.signum(v)))


def covariance(sm: DataFrame) -> np.ndarray:
    """The covariance of the features (n - 1), from one sum of outer products per task."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["feat"].to_numpy())
                m = np.concatenate((x.T @ x, x.sum(0)[None], np.full((1, x.shape[1]), len(x))))
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    got = sm.select("feat").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    d = round(np.sqrt(len(got) + 1) - 1)
    m = got.reshape(d + 2, d)
    n, mean = m[-1, 0], m[-2] / m[-1, 0]
    return (m[:d] - n * np.outer(mean, mean)) / (n - 1)


def principal_axes(sm: DataFrame, n: int) -> np.ndarray:
    """The first n principal axes as columns; the component largest in size is positive."""
    w, axes = np.linalg.eigh(covariance(sm))
    axes = axes[:, np.argsort(-w)][:, :n]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def projected(sm: DataFrame, axes: np.ndarray) -> DataFrame:
    """feat times a matrix, in JVM expressions; the matrix is small."""
    columns = [F.array(*map(F.lit, map(float, axes[:, k]))) for k in range(axes.shape[1])]
    return sm.withColumn("feat", F.array(*[V.total2(F.col("feat"), c, lambda a, b: a * b) for c in columns]))


def pca(sm: DataFrame, n: int) -> DataFrame:
    own = centred(sm)
    return projected(own, principal_axes(sm, n))


def whitened(sm: DataFrame, eps: float = 0.1) -> DataFrame:
    """Principal components scaled by 1 / sqrt(variance + eps)."""
    w, axes = np.linalg.eigh(covariance(sm))
    return projected(centred(sm), axes[:, ::-1] / np.sqrt(np.maximum(w[::-1], 0) + eps))


# --- counts


def class_counts(sm: DataFrame) -> DataFrame:
    """(truelabel, n) of classes above 0."""
    return sm.where("truelabel > 0").groupBy("truelabel").agg(F.count("*").alias("n"))


def class_number(sm: DataFrame) -> DataFrame:
    """The largest label: what the samples take as their number of classes."""
    return sm.agg(F.max("truelabel").alias("classes"))


# --- splits


def order_key(column: str = "id") -> Column:
    """A fixed shuffle: the md5 of the id's text."""
    return F.md5(F.col(column).cast("string"))


def _ranked(sm: DataFrame, by: list[str], groups: int = 256) -> DataFrame:
    """Rows numbered from 0 (rn) in shuffled order within `by`, and their number (size), without one task holding a whole class.

    The first two hex digits of the shuffle key cut a class into 256 runs; runs are counted, and ranked each on its own.
    """
    keyed = sm.withColumn("key", order_key()).withColumn("run", F.substring("key", 1, 2))
    counts = keyed.groupBy(*by, "run").agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    counts = counts.withColumn("before", F.sum("n").over(w.orderBy("run")) - F.col("n")).withColumn("size", F.sum("n").over(w)).drop("n")
    ranked = keyed.withColumn("at", F.row_number().over(W.partitionBy(*by, "run").orderBy("key", "id")) - 1)
    return ranked.join(F.broadcast(counts), [*by, "run"]).withColumn("rn", F.col("before") + F.col("at")).drop("key", "run", "before", "at")


def k_folds(sm: DataFrame, k: int) -> DataFrame:
    """(fold): the shuffled row's number modulo k."""
    return _ranked(sm, []).withColumn("fold", (F.col("rn") % k).cast("int")).drop("rn", "size")


def random_split(sm: DataFrame, share: float) -> DataFrame:
    """The first trunc(share * n) rows of the shuffle are for training, the others for testing."""
    r = _ranked(sm, [])
    return r.withColumn("status", F.when(F.col("rn") < F.floor(F.col("size") * share), TRAIN).otherwise(TEST)).drop("rn", "size")


def stratified_split(sm: DataFrame, n_train: int) -> DataFrame:
    """Of each class trunc(n_train * size / n) rows are for training; what is left is dealt out one per class, by class."""
    r = _ranked(sm, ["truelabel"])
    sizes = sm.groupBy("truelabel").agg(F.count("*").alias("c"))
    w = W.partitionBy()
    sizes = sizes.withColumn("base", F.floor(n_train * F.col("c") / F.sum("c").over(w)))
    sizes = sizes.withColumn("rest", n_train - F.sum("base").over(w)).withColumn("rank", F.row_number().over(W.orderBy("truelabel")))
    quota = sizes.select("truelabel", (F.col("base") + (F.col("rank") <= F.col("rest")).cast("long")).alias("quota"))
    got = r.join(F.broadcast(quota), "truelabel")
    return got.withColumn("status", F.when(F.col("rn") < F.col("quota"), TRAIN).otherwise(TEST)).drop("rn", "size", "quota")


def balanced_split(sm: DataFrame, per_class: int) -> DataFrame:
    r = _ranked(sm, ["truelabel"])
    return r.withColumn("status", F.when(F.col("rn") < per_class, TRAIN).otherwise(TEST)).drop("rn", "size")


# --- neighbours


def nearest(queries: DataFrame, base: DataFrame, k: int, itself: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, rank, d2): the k rows of `base` nearest to each query by squared distance, then by id.

    Both sides are cut into blocks; a task compares one block with one, by a matrix product, takes the distances of all that come within
    rounding of the k-th exactly, and keeps the first k of these.  Work is the product of the sides, memory is two blocks.
    """
    nq, nb = queries.count(), base.count()
    bq, bb = max(1, -(-nq // block)), max(1, -(-nb // block))
    left = queries.select("id", "feat", F.lit(True).alias("q"), F.pmod(F.xxhash64("id"), F.lit(bq)).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(bb - 1))))
    right = base.select("id", "feat", F.lit(False).alias("q"), F.pmod(F.xxhash64("id"), F.lit(bb)).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf["q"]], pdf[~pdf["q"]]
        if q.empty or b.empty:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "d2": np.zeros(0)})
        x, y = np.stack(q["feat"].to_numpy()), np.stack(b["feat"].to_numpy())
        qi, bi = q["id"].to_numpy(), b["id"].to_numpy()
        m, out, far = min(len(bi), k), [], 1e-12 * (1 + (x * x).sum(1).max() + (y * y).sum(1).max())
        for at in range(0, len(x), 512):
            part, own = x[at : at + 512], qi[at : at + 512]
            d = (part * part).sum(1)[:, None] - 2 * part @ y.T + (y * y).sum(1)[None]
            if not itself:
                d[own[:, None] == bi[None]] = np.inf
            # distances that differ beyond the ninth digit count as equal
            r, c = np.nonzero((d <= np.partition(d, m - 1, 1)[:, m - 1 : m] + far + 1e-9) & (d < np.inf))
            exact = np.concatenate([((part[i] - y[j]) ** 2).sum(1) for i, j in zip(np.array_split(r, len(r) // 100_000 + 1), np.array_split(c, len(r) // 100_000 + 1))])
            order = np.lexsort((bi[c], np.round(exact, 9), r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k
            out.append(pd.DataFrame({"id": own[r[keep]], "neighbour": bi[c[keep]], "d2": exact[keep]}))
        return pd.concat(out)

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(run, "id long, neighbour long, d2 double")
    # equal distances that differ in their last digits count as equal
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.round("d2", 9), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features as a matrix, and their lengths; zeros and -1 for a vector that is null or holds a null."""
    n = pdf["_n"].to_numpy()
    if (n == n[0]).all() and n[0] > 0:
        return np.stack(pdf["feat"].to_numpy()), n
    x = np.zeros((len(n), max(n.max(), 0)))
    for r in np.nonzero(n > 0)[0]:
        x[r, : n[r]] = pdf["feat"].iloc[r]
    return x, n


def against(left: DataFrame, right: DataFrame, order: list[str], fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """fn(ids, distances, rows) of (id, feat) on the left with (feat, ...) on the right, block by block, the latter sorted and dealt by `order`.

    As in `nearest`, a task holds one block of either side, and a matrix product gives the distances of some samples to all of a block.
    """
    bl, br = (max(1, -(-df.count() // (2 * BLOCK))) for df in (left, right))
    n = F.when(F.col("feat").isNull() | F.exists("feat", F.isnull), -1).otherwise(F.size("feat")).alias("_n")
    one = left.select("id", "feat", n, F.pmod(F.xxhash64("id"), F.lit(bl)).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(br - 1))).alias("_j"))
    two = right.select("*", n, F.pmod(F.xxhash64(*order), F.lit(br)).cast("int").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(bl - 1))).alias("_i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        b = b.sort_values(order, kind="stable").reset_index(drop=True)
        (x, nx), (y, ny) = _features(a), _features(b)
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        ids, out = a["id"].to_numpy(), []
        for at in range(0, len(x), 256):
            own = slice(at, at + 256)
            out.append(fn(ids[own], Distances(x[own], nx[own], y, ny), b))
        return pd.concat(out)

    return one.groupBy("_i", "_j").cogroup(two.groupBy("_i", "_j")).applyInPandas(run, schema)


class Distances:
    """Of some vectors to all of a block: squares by a matrix product, known to within `far`, and exact ones of chosen pairs; infinite where one has none."""

    def __init__(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> None:
        self.x, self.y = x, y
        with np.errstate(all="ignore"):
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            d = xx[:, None] - 2 * x @ y.T + yy[None]
        self.far = 1e-12 * (1 + max(xx[np.isfinite(xx)], default=0.0) + max(yy[np.isfinite(yy)], default=0.0))
        self.none = None if (nx == nx[0]).all() and (ny == nx[0]).all() and nx[0] >= 0 else (nx[:, None] != ny[None]) | (nx < 0)[:, None]
        d[np.isnan(d)] = np.inf
        if self.none is not None:
            d[self.none] = np.inf
        self.d2 = d

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of pairs, rounded to the ninth digit."""
        parts = len(r) // 100_000 + 1
        with np.errstate(all="ignore"):
            d = np.concatenate([((self.x[i] - self.y[j]) ** 2).sum(1) for i, j in zip(np.array_split(r, parts), np.array_split(c, parts))])
        d[np.isnan(d)] = np.inf
        if self.none is not None:
            d[self.none[r, c]] = np.inf
        return np.round(np.sqrt(d), 9)

    def best(self, cost: np.ndarray, on: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(column, value) of each row's least max(cost, distance) among the columns `on`, the first one among equals; the cost alone where there is no distance."""
        cost, d = cost[on], self.d2[:, on]
        square = np.fmax(cost, 0.0) ** 2
        key = np.maximum(d, square)
        if self.none is not None:
            key = np.where(self.none[:, on], square, key)
        least = key.min(1)
        r, c = np.nonzero(key <= (least + 2e-9 * np.sqrt(least) + 2 * self.far + 1e-17)[:, None])
        value = np.round(cost[c], 9)
        # where the distance is surely below the cost, the cost it is
        near = d[r, c] + self.far >= square[c]
        if self.none is not None:
            near &= ~self.none[r, c + (on.start or 0)]
        value[near] = np.fmax(value[near], self.exact(r[near], c[near] + (on.start or 0)))
        first = np.minimum.reduceat(value, np.searchsorted(r, np.arange(len(d))))
        hits = np.nonzero(value == first[r])[0]
        at = hits[np.unique(r[hits], return_index=True)[1]]
        return c[at] + (on.start or 0), value[at]

    def covering(self, radius: np.ndarray) -> np.ndarray:
        """The first column of each row whose radius is not below the distance; -1 where there is none."""
        sure = self.d2 <= np.where(radius > 1e-9, (radius - 1e-9) ** 2, -1.0) - self.far
        r, c = np.nonzero(~sure & (self.d2 <= np.where(radius >= 0, (radius + 1e-9) ** 2, -np.inf) + self.far))
        sure[r, c] = self.exact(r, c) <= radius[c]
        return np.where(sure.any(1), sure.argmax(1), -1)


def knn_classified(sm: DataFrame, k: int) -> DataFrame:
    """(id, truelabel, label) of test samples: the majority of the k nearest training samples, the lowest class among equals."""
    train, test = with_status(sm, TRAIN), with_status(sm, TEST)
    near = nearest(test, train, k).join(train.select(F.col("id").alias("neighbour"), F.col("truelabel").alias("c")), "neighbour")
    votes = near.groupBy("id", "c").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("label"))
    return test.select("id", "truelabel").join(votes, "id")


def knn_graph(sm: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, w): arcs to the k nearest other samples, w their distance."""
    return nearest(sm, sm, k).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "rank", F.sqrt("d2").alias("w"))


def density(graph: DataFrame) -> DataFrame:
    """(id, raw, weight): sum of 1 - exp(-w^2 / K), K = 2 max^2 / 9, turned over and scaled to 1..4095."""
    top = F.broadcast(graph.agg((2 * F.max("w") * F.max("w") / 9).alias("K")))
    raw = graph.join(top).groupBy("src").agg(F.sum(1 - F.exp(-F.col("w") * F.col("w") / F.col("K"))).alias("raw"))
    ends = F.broadcast(raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))
    weight = (V.MAX_WEIGHT - 1) * (F.col("hi") - F.col("raw")) / (F.col("hi") - F.col("lo")) + 1
    return raw.join(ends).select(F.col("src").alias("id"), "raw", weight.alias("weight"))


def normalised_cut(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """(ncut): over groups, arc similarity across the border by all of it, similarity being the largest weight less the arc's."""
    top = F.broadcast(graph.agg(F.max("w").alias("top")))
    g = groups.select("id", "group")
    arcs = graph.join(top).join(g.select(F.col("id").alias("src"), F.col("group").alias("gs")), "src").join(g.select(F.col("id").alias("dst"), F.col("group").alias("gd")), "dst")
    s = F.col("top") - F.col("w")
    per = arcs.groupBy("gs").agg(F.sum(F.when(F.col("gs") != F.col("gd"), s).otherwise(0.0)).alias("b"), F.sum(s).alias("all"))
    return per.where("all > 0").agg(F.sum(F.col("b") / F.col("all")).alias("ncut"))


def nearest_centroid(sm: DataFrame, centroids: DataFrame, distance=V.squared_euclidean) -> DataFrame:
    """sm with (group, d) of its nearest centroid (c, centre); centroids are broadcast, at most CENTROIDS at a time, so that each row holds one block's best."""
    n = centroids.count()
    blocks = max(1, -(-n // CENTROIDS))
    got = sm
    for k in range(blocks):
        own = centroids if blocks == 1 else centroids.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == k)
        table = own.agg(F.collect_list(F.struct("c", "centre")).alias("cs"))
        best = F.array_min(F.transform("cs", lambda s: F.struct(distance(F.col("feat"), s["centre"]).alias("d"), s["c"].alias("c"))))
        got = got.join(F.broadcast(table)).withColumn("_b", F.array_min(F.array_compact(F.array("_b", best))) if k else best).drop("cs")
    return got.withColumns({"group": F.col("_b.c"), "d": F.col("_b.d")}).drop("_b")


def class_centroids(sm: DataFrame, by: str = "truelabel") -> DataFrame:
    """(c, centre): mean vectors, by one partial sum per dimension and class."""
    long = sm.select(F.col(by).alias("c"), F.posexplode("feat").alias("dim", "v")).groupBy("c", "dim").agg(F.avg("v").alias("m"))
    return long.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda r: r["m"]).alias("centre"))


def k_means(sm: DataFrame, init: DataFrame, rounds: int) -> DataFrame:
    """(c, centre) after `rounds` steps from given centroids; a centroid without samples stays."""
    rows = init.select("c", "centre").collect()  # as many rows as centroids
    names, centre = [r[0] for r in rows], np.array([list(r[1]) for r in rows], float)
    if not rows:
        return init
    order = np.argsort(names, kind="stable")
    names, centre = [names[k] for k in order], centre[order]
    k, d = centre.shape

    def sums(at: np.ndarray):
        def run(batches):
            total = np.zeros((k, d + 1))
            for pdf in batches:
                for part in np.array_split(np.arange(len(pdf)), len(pdf) * k // 4_000_000 + 1):
                    x = np.stack(pdf["feat"].to_numpy()[part]) if len(part) else np.zeros((0, d))
                    # equal distances to the ninth digit go to the first centroid
                    own = np.argmin(np.round((x * x).sum(1)[:, None] - 2 * x @ at.T + (at * at).sum(1)[None], 9), 1)
                    for c in np.unique(own):
                        total[c, :d] += x[own == c].sum(0)
                        total[c, d] += (own == c).sum()
            yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

        return run

    for _ in range(rounds):
        got = sm.select("feat").mapInPandas(sums(centre), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
        if not len(got):
            break
        got = got.reshape(k, d + 1)
        centre = np.where(got[:, d:] > 0, got[:, :d] / np.maximum(got[:, d:], 1), centre)
    return sm.sparkSession.createDataFrame([(n, c.tolist()) for n, c in zip(names, centre)], init.select("c", "centre").schema)


def medoids(grouped: DataFrame, centres: DataFrame) -> DataFrame:
    """(c, id): the sample nearest to the centre of its group."""
    own = grouped.join(F.broadcast(centres), grouped["group"] == centres["c"])
    d = V.squared_euclidean(F.col("feat"), F.col("centre"))
    return own.groupBy("c").agg(F.min_by("id", F.struct(F.round(d, 9), "id")).alias("id"))


def optimum_path_predicted(test: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, label, cost): the prototype (id, feat, label, cost) with the least max(cost, distance); ties by id.

    Prototypes are dealt in blocks against blocks of test samples, like neighbours.
    """
    kind = prototypes.schema
    table = prototypes.select(F.col("id").alias("p"), "feat", "label", F.col("cost").cast("double").alias("cost"))

    def run(ids: np.ndarray, to: Distances, ps: pd.DataFrame) -> pd.DataFrame:
        at, cost = to.best(ps["cost"].to_numpy())
        return pd.DataFrame({"id": ids, "cost": cost, "p": ps["p"].to_numpy()[at], "label": ps["label"].to_numpy()[at]})

    names = [test.schema["id"].dataType, kind["id"].dataType, kind["label"].dataType]
    schema = "id {}, cost double, p {}, label {}".format(*(t.simpleString() for t in names))
    found = against(test, table, ["p", "label"], run, schema)
    return found.groupBy("id").agg(F.min(F.struct("cost", "p", "label")).alias("b")).select("id", "b.label", "b.cost")


def optimum_path_prototypes(sm: DataFrame, k: int = 5) -> DataFrame:
    """(id) of training samples at arcs of the minimum spanning forest of the k-nearest graph that join different classes."""
    from .graphs import spanning_forest

    arcs = knn_graph(sm, k).select("src", "dst", "w")
    tree = spanning_forest(arcs)
    c = sm.select("id", "truelabel")
    ends = tree.join(c.select(F.col("id").alias("src"), F.col("truelabel").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("truelabel").alias("cd")), "dst")
    return ends.where("cs <> cd").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
