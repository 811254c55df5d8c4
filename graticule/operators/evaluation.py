"""Projections, clusterings, classifiers, segmentation measures, searches and samplings beside those of `samples`, `learners` and `metrics`.

Sample tables are (id, feat, truelabel, status).  Sums over samples are taken per partition; matrices of the features' size are solved on the
driver; what is driver-sized is said so.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import vectors as V
from ..tables import TEST, TRAIN, has
from . import metrics, samples

# --- projections


def scaled(sm: DataFrame, factor: float) -> DataFrame:
    return sm.withColumn("feat", F.transform("feat", lambda v: v * factor))


def centred_by_training(sm: DataFrame) -> DataFrame:
    """All samples less the means of the training ones."""
    stats = samples.feature_statistics(sm.where(has(F.col("status"), TRAIN)))
    return samples._each(sm, stats, lambda v, m: v - m, "mean")


def training_axes(sm: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and the first n principal axes of the training samples."""
    train = sm.where(has(F.col("status"), TRAIN))
    stats = samples.feature_statistics(train).orderBy("dim").select("mean").collect()
    return np.array([r[0] for r in stats]), samples.principal_axes(train, n)


def _turned(sm: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn of the features of many samples at a time: one matrix product per batch."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(feat=list(fn(np.stack(pdf["feat"].to_numpy()))))

    return sm.mapInPandas(run, sm.schema)


def on_axes(sm: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Samples less the means, turned to the axes."""
    return _turned(sm, lambda x: (x - mean) @ axes)


def from_axes(sm: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Back from the axes: exact where there are as many as features, else the nearest point of their space."""
    return _turned(sm, lambda x: x @ axes.T + mean)


def scatters(sm: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scatter within and between classes, from sums per class: one pass over the samples."""
    rows = samples.class_centroids(sm).collect()  # as many as classes
    counts = {r[0]: r[1] for r in sm.groupBy("truelabel").count().collect()}
    n = sum(counts.values())
    centres = {r["c"]: np.array(r["centre"]) for r in rows}
    mean = sum(counts[c] * m for c, m in centres.items()) / n
    between = sum(counts[c] * np.outer(m - mean, m - mean) for c, m in centres.items())
    return samples.covariance(sm) * (n - 1) - between, between


def discriminants(sm: DataFrame, n: int, ridge: float = 1e-6) -> np.ndarray:
    """The n directions along which classes lie apart most for their own spread, as columns; the component largest in size is positive."""
    within, between = scatters(sm)
    d = len(within)
    low = np.linalg.cholesky(within + ridge * np.trace(within) / d * np.eye(d))
    inner = np.linalg.solve(low, np.linalg.solve(low, between).T)
    w, axes = np.linalg.eigh((inner + inner.T) / 2)
    out = np.linalg.solve(low.T, axes[:, np.argsort(-w)][:, :n])
    out = out / np.linalg.norm(out, axis=0)
    return out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])


def class_axes(sm: DataFrame, n: int) -> np.ndarray:
    """Principal axes of the class means, weighted alike."""
    x = np.array([r["centre"] for r in samples.class_centroids(sm).orderBy("c").collect()])
    w, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-w)][:, :n]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def kernel_bank(patches: DataFrame, n: int) -> np.ndarray:
    """Principal axes of patches (feat) as kernels in columns."""
    return samples.principal_axes(patches, n)


def relevant_kernels(bank: np.ndarray, variances: np.ndarray, share: float) -> np.ndarray:
    """The first kernels that hold a share of the variance."""
    held = np.cumsum(variances) / variances.sum()
    return bank[:, : int(np.searchsorted(held, share - 1e-12)) + 1]


def gram(sm: DataFrame, marks: DataFrame, kind: str = "gauss", width: float = 1.0) -> DataFrame:
    """(id, feat): each sample's kernel values with landmark samples (id, feat), in their order; landmarks are few and broadcast."""
    rows = [(r["id"], list(r["feat"])) for r in marks.orderBy("id").select("id", "feat").collect()]
    out = []
    for _, f in rows:
        m = F.array(*map(F.lit, f))
        d = V.squared_euclidean(F.col("feat"), m)
        out.append({"gauss": F.exp(-d / (2 * width * width)), "linear": V.total2(F.col("feat"), m, lambda a, b: a * b), "cosine": 1 - 2 * V.cosine_distance(F.col("feat"), m)}[kind])
    return sm.withColumn("feat", F.array(*out))


def neighbour_map(sm: DataFrame, perplexity: float = 10.0, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(id, feat): two dimensions in which near samples stay near, by stochastic neighbour embedding.

    Every round compares all samples with all, a few rows at a time: up to `samples.BLOCK` of them in one task, more in one job a round, whose
    tasks get rows dealt out and hold all vectors.  The work is quadratic in the samples, memory is not.
    """
    kind = "id long, feat array<double>"
    own = sm.select("id", "feat")
    if sm.count() <= samples.BLOCK:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            x = np.stack(pdf["feat"].to_numpy())
            y = _embedded(len(x), lambda fn: fn(x, range(0, len(x), ROWS)), perplexity, rounds, seed)
            return pd.DataFrame({"id": pdf["id"].to_numpy(), "feat": y.tolist()})

        return own.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, kind)

    spark = sm.sparkSession
    table = own.toArrow().sort_by("id")
    ids, n = table["id"].to_numpy(), len(table)
    held = spark.sparkContext.broadcast(table["feat"].combine_chunks().flatten().to_numpy().reshape(n, -1))
    del table
    starts = spark.range(0, n, ROWS, min(-(-n // ROWS), 4 * spark.sparkContext.defaultParallelism))

    def everywhere(fn) -> np.ndarray:
        def task(batches):
            for pdf in batches:
                for at in pdf["id"].tolist():
                    got = fn(held.value, [at])
                    yield pd.DataFrame({"at": [at], "m": [got.ravel()]})

        got = starts.mapInPandas(task, "at long, m array<double>").toPandas().sort_values("at")["m"]
        flat = np.concatenate(list(got))
        return flat.reshape(n, -1)

    y = _embedded(n, everywhere, perplexity, rounds, seed)
    held.unpersist()
    return spark.createDataFrame(pd.DataFrame({"id": ids, "feat": y.tolist()}), kind)


#: Rows that are compared with all samples at a time.
ROWS = 64


def _embedded(n: int, over: Callable, perplexity: float, rounds: int, seed: int) -> np.ndarray:
    """over(fn) gives fn(vectors, first rows of blocks) of all blocks, one below the other."""
    widths = over(lambda x, starts: np.concatenate([_widths(x, at, perplexity) for at in starts]))
    y, move = np.random.default_rng(seed).normal(0, 1e-2, (n, 2)), np.zeros((n, 2))
    kept = {} if n <= samples.BLOCK else None  # of few samples all pairs' nearness stays from round to round
    for t in range(rounds):
        sums = over(lambda x, starts, y=y, k=4 if t < 50 else 1: np.concatenate([_pulls(x, at, widths, y, k, kept) for at in starts]))
        move = (0.5 if t < 50 else 0.8) * move - 40 * (sums[:, 1:3] - sums[:, 3:5] / sums[:, 0].sum())
        y = y + move
    return y


def _squares(x: np.ndarray, at: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Squared distances of a block's rows to all, and the places of each row itself."""
    own = x[at : at + ROWS]
    r = np.arange(len(own))
    return ((own * own).sum(1)[:, None] - 2 * own @ x.T + (x * x).sum(1)[None]).clip(0), (r, at + r)


def _widths(x: np.ndarray, at: int, perplexity: float) -> np.ndarray:
    """The width of each neighbourhood, by halving, and the sum of its weights."""
    d, itself = _squares(x, at)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(50):
        used, p = beta, np.exp(-d * beta[:, None])
        p[itself] = 0
        total = np.maximum(p.sum(1), 1e-300)
        p /= total[:, None]
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = h > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return np.stack([used, total], 1)


def _nearness(x: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """Of a block's rows the share of each pair in the nearness of all."""
    d, itself = _squares(x, at)
    beta, total = widths.T
    own = slice(at, at + len(d))
    p = np.exp(-d * beta[own, None]) / total[own, None] + np.exp(-d * beta) / total
    p[itself] = 0
    return np.maximum(p / (2 * len(x)), 1e-12)


def _pulls(x: np.ndarray, at: int, widths: np.ndarray, y: np.ndarray, k: float, kept: dict | None = None) -> np.ndarray:
    """Of a block's rows the sum of the map's weights, and the two parts of the gradient: towards neighbours, away from all."""
    p = kept.get(at) if kept is not None else None
    if p is None:
        p = _nearness(x, at, widths)
        if kept is not None:
            kept[at] = p
    own, r = slice(at, at + len(p)), np.arange(len(p))
    itself = r, at + r
    q = 1 / (1 + ((y[own] * y[own]).sum(1)[:, None] - 2 * y[own] @ y.T + (y * y).sum(1)[None]))
    q[itself] = 0
    near, far = k * p * q, q * q
    return np.column_stack([q.sum(1), near.sum(1)[:, None] * y[own] - near @ y, far.sum(1)[:, None] * y[own] - far @ y])


# --- bags of words


def soft_words(sm: DataFrame, book: DataFrame, by: str, width: float) -> DataFrame:
    """(by, word, weight): sums over a group's samples of their shares in the words (c, centre) of a book, falling with squared distance."""
    rows = book.orderBy("c").collect()
    shares = F.array(*[F.exp(-V.squared_euclidean(F.col("feat"), F.array(*map(F.lit, r["centre"]))) / (2 * width * width)) for r in rows])
    own = sm.select(by, shares.alias("s")).withColumn("all", V.total(F.col("s")))
    words = F.array(*[F.lit(r["c"]) for r in rows])
    cells = own.select(by, "all", F.explode(F.arrays_zip(words.alias("word"), F.col("s").alias("s"))).alias("w"))
    return cells.groupBy(by, F.col("w.word").alias("word")).agg(F.sum(F.col("w.s") / F.col("all")).alias("weight"))


def second_order(sm: DataFrame, book: DataFrame, by: str) -> DataFrame:
    """(by, word, dim, first, second): of each group the mean of its samples less the nearest word, by dimension, and of the squares, over the number of its samples."""
    own = samples.nearest_centroid(sm, book).join(F.broadcast(book.select(F.col("c").alias("group"), "centre")), "group")
    n = sm.groupBy(by).agg(F.count("*").alias("_n"))
    cells = own.select(by, F.col("group").alias("word"), F.posexplode(F.zip_with("feat", "centre", lambda a, b: a - b)).alias("dim", "v"))
    got = cells.groupBy(by, "word", "dim").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return got.join(n, by).select(by, "word", "dim", (F.col("s") / F.col("_n")).alias("first"), (F.col("q") / F.col("_n")).alias("second"))


# --- clustering


def drawn_centres(sm: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(c, centre): k samples drawn by seed and id, numbered from 1."""
    rows = sm.orderBy(M.uniform(F.col("id"), seed), "id").limit(k)
    return rows.withColumn("c", F.row_number().over(W.orderBy(M.uniform(F.col("id"), seed), "id"))).select("c", F.col("feat").alias("centre"))


def spherical_means(sm: DataFrame, init: DataFrame, rounds: int) -> DataFrame:
    """(c, centre): k-means of unit vectors whose centres are scaled to length one after each round."""
    unit = sm.withColumn("feat", V.unit(F.col("feat")))
    centres = init.withColumn("centre", V.unit(F.col("centre")))
    for _ in range(rounds):
        centres = samples.k_means(unit, centres, 1).withColumn("centre", V.unit(F.col("centre")))
    return centres


def best_k(sm: DataFrame, least: int, most: int) -> DataFrame:
    """(k, ncut): normalised cuts of the optimum-path clusters for each number of neighbours, the best first."""
    from .learners import optimum_path_clusters

    out = None
    for k in range(least, most + 1):
        groups = optimum_path_clusters(sm, k).withColumnRenamed("root", "group")
        own = samples.normalised_cut(samples.knn_graph(sm, k), groups).select(F.lit(k).alias("k"), "ncut")
        out = own if out is None else out.unionByName(own)
    return out.orderBy(F.round("ncut", 9), "k")


def exactly(sm: DataFrame, c: int, k: int) -> DataFrame:
    """(id, root): optimum-path clusters, of which the c largest stay and the others' samples go to the nearest of their roots."""
    from .learners import optimum_path_clusters

    own = optimum_path_clusters(sm, k)
    top = own.groupBy("root").count().orderBy(F.desc("count"), "root").limit(c).select("root")
    roots = sm.join(top.withColumnRenamed("root", "id"), "id").select(F.col("id").alias("c"), F.col("feat").alias("centre"))
    lost = sm.join(own.join(top, "root", "left_anti").select("id"), "id")
    return own.join(top, "root", "left_semi").select("id", "root").unionByName(samples.nearest_centroid(lost, roots).select("id", F.col("group").alias("root")))


def hierarchy(sm: DataFrame, k: int, levels: int) -> DataFrame:
    """(level, id, root): clusters of samples, then of their roots, and so on."""
    from .graphs import cut_lineage
    from .learners import optimum_path_clusters

    out, now = None, sm
    for level in range(1, levels + 1):
        own = cut_lineage(optimum_path_clusters(now, k))
        out = own.withColumn("level", F.lit(level)) if out is None else out.unionByName(own.withColumn("level", F.lit(level)))
        roots = now.join(own.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
        if roots.count() in (1, now.count()):
            break
        now = roots
    return out.select("level", "id", "root")


def density_of(graph: DataFrame, least: float, most: float) -> DataFrame:
    """(id, density): as `samples.density` raw values, scaled to a range."""
    raw = samples.density(graph).select("id", "raw")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.join(F.broadcast(ends)).select("id", (least + (most - least) * (F.col("hi") - F.col("raw")) / (F.col("hi") - F.col("lo"))).alias("density"))


# --- classification


def certainty(test: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, label, cost, weight): the best prototype's label, and the best cost of another label over the sum of both; 0.5 where both are about 0."""
    table = prototypes.select("id", "feat", "label", F.col("cost").cast("double").alias("cost"))

    def run(ids: np.ndarray, to: samples.Distances, ps: pd.DataFrame) -> pd.DataFrame:
        labels, cost = ps["label"].to_numpy(), ps["cost"].to_numpy()
        ends = [0, *(np.nonzero(labels[1:] != labels[:-1])[0] + 1), len(labels)]
        return pd.concat([pd.DataFrame({"id": ids, "label": labels[lo], "cost": to.best(cost, slice(lo, hi))[1]}) for lo, hi in itertools.pairwise(ends)])

    schema = "id {}, label {}, cost double".format(*(df.schema[c].dataType.simpleString() for df, c in ((test, "id"), (prototypes, "label"))))
    per = samples.against(test, table, ["label", "id"], run, schema).groupBy("id", "label").agg(F.min("cost").alias("cost"))
    best = per.select("id", F.struct("cost", "label").alias("b"))
    two = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("b")), 1, 2).alias("b"))
    c1, c2 = F.col("b")[0]["cost"], F.try_element_at("b", F.lit(2))["cost"]
    weight = F.when(c2.isNull(), 1.0).when(c1 + c2 < 1e-7, 0.5).otherwise(c2 / (c1 + c2))
    return two.select("id", F.col("b")[0]["label"].alias("label"), c1.alias("cost"), weight.alias("weight"))


def covered(test: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group): the group of the first node (id, feat, group, rank, radius), by rank, whose radius covers the sample; of the nearest node where none does."""
    table = nodes.select("feat", "rank", "group", F.col("radius").cast("double").alias("radius"))

    def run(ids: np.ndarray, to: samples.Distances, ns: pd.DataFrame) -> pd.DataFrame:
        first, (near, d) = to.covering(ns["radius"].to_numpy()), to.best(np.zeros(len(ns)))
        on = first >= 0
        at = np.where(on, first, near)
        return pd.DataFrame({"id": ids, "far": ~on, "d": np.where(on, 0.0, d), "rank": ns["rank"].to_numpy()[at], "group": ns["group"].to_numpy()[at]})

    kinds = [test.schema["id"].dataType, nodes.schema["rank"].dataType, nodes.schema["group"].dataType]
    schema = "id {}, far boolean, d double, rank {}, group {}".format(*(t.simpleString() for t in kinds))
    found = samples.against(test, table, ["rank", "group"], run, schema)
    return found.groupBy("id").agg(F.min(F.struct("far", "d", "rank", "group")).alias("b")).select("id", "b.group")


def one_class(test: DataFrame, train: DataFrame, reach: float) -> DataFrame:
    """(id, label): 1 where the nearest training sample of the class is within `reach`, else 0."""
    near = samples.nearest(test, train, 1).select("id", "d2")
    return near.select("id", (F.col("d2") <= reach * reach).cast("int").alias("label"))


def one_against_one(train: DataFrame, test: DataFrame, fit: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int = 5000) -> DataFrame:
    """(id, label): votes of linear classifiers of each two classes; fit(features with a 1, signs) gives weights, on at most `rows` samples of a class drawn by id."""
    w = W.partitionBy("truelabel").orderBy(M.uniform(F.col("id"), 1), "id")
    got = train.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).select("truelabel", "feat").orderBy("truelabel", "_r").collect()
    x, y = np.array([list(r["feat"]) + [1.0] for r in got]), np.array([r["truelabel"] for r in got])
    votes = []
    for a, b in itertools.combinations(sorted(set(y.tolist())), 2):
        on = (y == a) | (y == b)
        weights = F.array(*map(F.lit, map(float, fit(x[on], np.where(y[on] == a, 1.0, -1.0)))))
        score = V.total2(F.concat("feat", F.array(F.lit(1.0))), weights, lambda p, q: p * q)
        votes.append(F.when(score >= 0, a).otherwise(b))
    ballots = test.select("id", F.explode(F.array(*votes)).alias("label")).groupBy("id", "label").agg(F.count("*").alias("n"))
    return ballots.groupBy("id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))


def fitted_plane(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a least-squares plane between two signs."""
    return np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ sign)


def spread_labels(sm: DataFrame, rounds: int, k: int = 5) -> DataFrame:
    """(id, label): labels of training samples spread along arcs to the k nearest, the label of the nearest labelled one in each round; null where none comes."""
    from .graphs import cut_lineage

    arcs = samples.knn_graph(sm, k).select(F.col("src").alias("id"), F.col("dst").alias("n"), "w")
    own = cut_lineage(sm.select("id", F.when(has(F.col("status"), TRAIN), F.col("truelabel")).alias("label")))
    arcs = cut_lineage(arcs.unionByName(arcs.select(F.col("n").alias("id"), F.col("id").alias("n"), "w")))
    for _ in range(rounds):
        known = own.where("label is not null").select(F.col("id").alias("n"), F.col("label").alias("l"))
        best = arcs.join(known, "n").groupBy("id").agg(F.min(F.struct(F.round("w", 9).alias("w"), "n", "l")).alias("b")).select("id", F.col("b.l").alias("new"))
        own = cut_lineage(own.join(best, "id", "left").select("id", F.coalesce("label", "new").alias("label")))
    return own


# --- measures


def by_name(predicted: DataFrame, name: str) -> DataFrame:
    """(value) of the measure of a name."""
    known = {
        "true_positives": (metrics.true_positives, "accuracy"), "f_score": (metrics.f_score, "f_score"), "kappa": (metrics.kappa, "kappa"), "normalised_accuracy": (metrics.normalised_accuracy, "accuracy"),
        "optimum_path_accuracy": (metrics.optimum_path_accuracy, "accuracy"), "weighted_accuracy": (metrics.weighted_accuracy, "accuracy"), "skewed_true_positives": (metrics.skewed_true_positives, "accuracy"),
    }
    fn, column = known[name]
    return fn(predicted).select(F.col(column).alias("value"))


def error_rate(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("truelabel") != F.col("label")).cast("double")).alias("error"))


def matthews(predicted: DataFrame) -> DataFrame:
    """(mcc) over any number of classes."""
    p = metrics._per_class(predicted).agg(F.sum("hit").alias("c"), F.max("all").alias("s"), F.sum(F.col("size") * F.col("claimed")).alias("pt"), F.sum(F.col("claimed") * F.col("claimed")).alias("pp"), F.sum(F.col("size") * F.col("size")).alias("tt"))
    s = F.col("s").cast("double")
    return p.select(F.try_divide(F.col("c") * s - F.col("pt"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))).alias("mcc"))


def accepts_and_rejects(predicted: DataFrame) -> DataFrame:
    """(c, far, frr): each class's share of others' samples that get it, and of its own that do not."""
    size, hit, claimed, total = (F.col(x) for x in ("size", "hit", "claimed", "all"))
    return metrics._per_class(predicted).select("c", F.try_divide(claimed - hit, total - size).alias("far"), F.try_divide(size - hit, size).alias("frr"))


def f_beta(counts: DataFrame, beta: float) -> DataFrame:
    """counts (tp, fp, fn) with f."""
    b = beta * beta
    return counts.withColumn("f", F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, dice): of two label images (x, y, val) twice the common pixels over all pixels of each label."""
    both = a.select("x", "y", F.col("val").alias("p")).join(b.select("x", "y", F.col("val").alias("q")), ["x", "y"])
    ends = both.select(F.explode(F.array(F.struct(F.col("p").alias("l"), (F.col("p") == F.col("q")).cast("int").alias("hit")), F.struct(F.col("q").alias("l"), F.lit(0).alias("hit")))).alias("e"))
    return ends.where("e.l <> 0").groupBy(F.col("e.l").alias("label")).agg((2 * F.sum("e.hit") / F.count("*")).alias("dice"))


def segment_errors(a: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn) of two masks (x, y, val)."""
    both = a.select("x", "y", (F.col("val") != 0).alias("p")).join(truth.select("x", "y", (F.col("val") != 0).alias("t")), ["x", "y"])
    return both.agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", F.col("p") & F.col("t")), ("fp", F.col("p") & ~F.col("t")), ("fn", ~F.col("p") & F.col("t")), ("tn", ~F.col("p") & ~F.col("t")))])


def surface_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(there, back, both): the mean distance of a's border pixels (x, y) to b's nearest one, the other way round, and over both."""
    from .graphs import cut_lineage

    one, two = (cut_lineage(df.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n"))) for df in (a, b))
    ways = [_nearest_pixels(p, q).agg(F.sum(F.sqrt("d2") * F.col("n")).alias("s"), F.sum("n").alias("n")) for p, q in ((one, two), (two, one))]
    x, y = (w.toDF(*[f"{c}{k}" for c in ("s", "n")]) for k, w in enumerate(ways))
    return x.join(y).select((F.col("s0") / F.col("n0")).alias("there"), (F.col("s1") / F.col("n1")).alias("back"), ((F.col("s0") + F.col("s1")) / (F.col("n0") + F.col("n1"))).alias("both"))


def _nearest_pixels(pixels: DataFrame, others: DataFrame, size: float = 64.0) -> DataFrame:
    """(n, d2): of pixels (x, y, n) the squared distance to the nearest of the others.

    A square tile of pixels is compared with the others in it and round it, which settles what has one within the tile's size; what has
    none goes on with tiles twice as large.
    """
    from .graphs import cut_lineage

    ends = pixels.select("x", "y").unionByName(others.select("x", "y")).agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    reach = 0.0 if ends[0] is None else max(ends[1] - ends[0], ends[3] - ends[2])
    out, left = None, pixels
    while True:
        got = cut_lineage(_in_tiles(left, others, size))
        done = got if size >= reach else got.where(F.col("d2") <= size * size)
        out, left = done if out is None else out.unionByName(done), got.where(F.col("d2") > size * size).drop("d2")
        if size >= reach or left.isEmpty():
            return out.where(F.col("d2") < float("inf")).select("n", "d2")
        size *= 2


def _in_tiles(pixels: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """(x, y, n, d2) by the others in a pixel's tile and the eight round it; infinity where these are empty."""
    cells = [F.floor(F.col(c) / size) for c in "xy"]
    own = pixels.withColumns({"tx": cells[0], "ty": cells[1]})
    round_it = [F.struct((F.col("tx") + dx).alias("sx"), (F.col("ty") + dy).alias("sy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    wanted = own.select("tx", "ty").distinct().select(F.col("tx").alias("hx"), F.col("ty").alias("hy"), F.inline(F.array(*round_it)))
    near = others.select("x", "y", cells[0].alias("sx"), cells[1].alias("sy")).join(wanted, ["sx", "sy"]).select("hx", "hy", "x", "y")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        px, py, qx, qy = (df[c].to_numpy() for df in (p, q) for c in "xy")
        d2 = np.full(len(p), np.inf)
        rows = max(1, 2_000_000 // max(1, len(q)))
        for at in range(0, len(p) if len(q) else 0, rows):
            part = slice(at, at + rows)
            d2[part] = ((px[part, None] - qx) ** 2 + (py[part, None] - qy) ** 2).min(1)
        return p[["x", "y", "n"]].assign(d2=d2)

    return own.groupBy("tx", "ty").cogroup(near.groupBy("hx", "hy")).applyInPandas(run, "x double, y double, n long, d2 double")


def border_recall(found: DataFrame, truth: DataFrame, reach: int) -> DataFrame:
    """(recall): the share of true border pixels (x, y) with a found one within `reach` columns and rows."""
    spots = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]
    wide = found.select(F.explode(F.array(*spots)).alias("s")).select("s.x", "s.y").distinct().withColumn("_on", F.lit(1))
    return truth.select("x", "y").join(wide, ["x", "y"], "left").agg(F.avg(F.coalesce("_on", F.lit(0))).alias("recall"))


def leak(overlap: DataFrame, share: float = 0.05) -> DataFrame:
    """(error) of (region, object, n): the sizes of regions that hold more than a share of themselves of an object, less the objects' pixels, over these."""
    size = F.sum("n").over(W.partitionBy("region"))
    own = overlap.withColumn("size", size).where(F.col("n") > share * F.col("size"))
    total = overlap.agg(F.sum("n").alias("all"))
    return own.agg(F.sum("size").alias("s")).join(total).select(((F.col("s") - F.col("all")) / F.col("all")).alias("error"))


def compactness(px: DataFrame) -> DataFrame:
    """(compactness): the mean over pixels of 4 pi area / perimeter^2 of their regions (x, y, val); a side counts if its other pixel has another label, or none."""
    sides = px.select("x", "y", "val", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s"))
    other = px.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("val").alias("o"))
    seen = sides.select("val", F.col("s.x").alias("ox"), F.col("s.y").alias("oy")).join(other, ["ox", "oy"], "left")
    per = seen.groupBy("val").agg(F.count_if(F.col("o").isNull() | (F.col("o") != F.col("val"))).alias("p"), (F.count("*") / 4).alias("a"))
    return per.agg((F.sum(4 * np.pi * F.col("a") * F.col("a") / (F.col("p") * F.col("p"))) / F.sum("a")).alias("compactness"))


def topology(px: DataFrame) -> DataFrame:
    """(regions, neighbours): how many regions (x, y, val) there are, and how many others each touches on the mean."""
    n = px.select("val").distinct().agg(F.count("*").alias("regions"))
    return n.join(region_arcs(px).agg(F.count("*").alias("k"))).select("regions", (2 * F.col("k") / F.col("regions")).alias("neighbours"))


# --- searches


def grid(values: dict[str, Iterable]) -> list[dict]:
    """Every combination of parameter values."""
    return [dict(zip(values, combo)) for combo in itertools.product(*values.values())]


def searched(spark, settings: list[dict], score: Callable[..., float]) -> DataFrame:
    """(setting, score) of each setting, the best first; score runs a distributed evaluation and gives one number."""
    rows = [(str(sorted(s.items())), float(score(**s))) for s in settings]
    return spark.createDataFrame(rows, "setting string, score double").orderBy(F.desc("score"), "setting")


def drawn_settings(values: dict[str, tuple[float, float]], n: int, seed: int = 1) -> list[dict]:
    """n settings drawn from ranges."""
    rng = np.random.default_rng(seed)
    return [{k: float(rng.uniform(*v)) for k, v in values.items()} for _ in range(n)]


def mean_fold_accuracy(sm: DataFrame, folds: int, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(accuracy): the mean over folds of the share of right labels (id, truelabel, label), each fold tested by the others."""
    parts = samples.k_folds(sm, folds)
    out = None
    for f in range(folds):
        own = parts.withColumn("status", F.when(F.col("fold") == f, TEST).otherwise(TRAIN)).drop("fold")
        got = metrics.true_positives(classify(own))
        out = got if out is None else out.unionByName(got)
    return out.agg(F.avg("accuracy").alias("accuracy"))


def scale_search(score: Callable[[np.ndarray], float], start: np.ndarray, scales: list[float], rounds: int = 20, least: bool = True) -> tuple[np.ndarray, float]:
    """A point that no step of any scale along an axis betters, from `start`; score may run distributed evaluations."""
    sign = 1 if least else -1
    x, best = np.array(start, float), sign * score(np.array(start, float))
    for _ in range(rounds):
        tries = [x + s * d * e for s in scales for e in np.eye(len(x)) for d in (1, -1)]
        values = [sign * score(t) for t in tries]
        k = int(np.argmin(values))
        if values[k] >= best:
            break
        x, best = tries[k], values[k]
    return x, sign * best


# --- samplings


def inverse_folds(sm: DataFrame, k: int) -> DataFrame:
    """(fold, id, status): for each fold its own rows are for training, all others for testing."""
    own = samples.k_folds(sm, k).select("id", "fold")
    every = own.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.select(F.col("f").alias("fold"), "id", F.when(F.col("fold") == F.col("f"), TRAIN).otherwise(TEST).alias("status"))


def leave_one_out(sm: DataFrame, k: int = 1) -> DataFrame:
    """(id, truelabel, label): each sample by the k nearest among all others."""
    near = samples.nearest(sm, sm, k).join(sm.select(F.col("id").alias("neighbour"), F.col("truelabel").alias("c")), "neighbour")
    votes = near.groupBy("id", "c").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("c", F.struct(F.col("n"), -F.col("c"))).alias("label"))
    return sm.select("id", "truelabel").join(votes, "id")


def by_share(sm: DataFrame, share: float, weight: Column | None = None, seed: int = 1) -> DataFrame:
    """sm with the first share of rows, drawn by seed or taken by weight, for training, the others for testing."""
    n = int(sm.count() * share)
    order = [M.uniform(F.col("id"), seed)] if weight is None else [weight.desc()]
    first = sm.orderBy(*order, "id").limit(n).select("id", F.lit(TRAIN).alias("_s"))
    return sm.drop("status").join(first, "id", "left").withColumn("status", F.coalesce("_s", F.lit(TEST))).drop("_s")


def split_tiles(px: DataFrame, width: int, height: int, nx: int, ny: int) -> DataFrame:
    """Pixels with their tile (from 0, row by row) and place inside it, of nx by ny nearly equal tiles."""
    tx = F.floor(F.col("x") * nx / width)
    ty = F.floor(F.col("y") * ny / height)
    x0, y0 = F.ceil(tx * width / nx), F.ceil(ty * height / ny)
    return px.select((ty * nx + tx).alias("tile"), (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "val")


def joined_tiles(tiles: DataFrame, width: int, height: int, nx: int, ny: int) -> DataFrame:
    """Pixels at their places in the whole image again."""
    tx, ty = F.col("tile") % nx, F.floor(F.col("tile") / nx)
    return tiles.select((F.col("x") + F.ceil(tx * width / nx)).alias("x"), (F.col("y") + F.ceil(ty * height / ny)).alias("y"), "val")


# --- samples and pixels


def to_pixels(labels: DataFrame, px: DataFrame, column: str) -> DataFrame:
    """(x, y, val): each pixel (x, y, id) with a column of its sample."""
    return px.join(labels.select("id", F.col(column).alias("val")), "id").select("x", "y", "val")


def marked_by_seeds(sm: DataFrame, seeds: DataFrame) -> DataFrame:
    """sm with the labels of seeds (id, label): these samples are for training, of several labels the commonest, the lowest among equals."""
    votes = seeds.groupBy("id", "label").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("_l"))
    got = sm.join(votes, "id", "left")
    return got.withColumns({"truelabel": F.coalesce("_l", F.lit(0)), "status": F.when(F.col("_l").isNotNull(), TRAIN).otherwise(TEST)}).drop("_l")


def edge_samples(px: DataFrame, labels: bool = False) -> DataFrame:
    """(x, y, dx, dy, feat): each two pixels (x, y, feat) side by side, with the difference of their features; `labels` compares a column val too."""
    more = ["val"] if labels else []
    arcs = px.withColumn("a", F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))))
    arcs = arcs.select("x", "y", F.col("a.dx").alias("dx"), F.col("a.dy").alias("dy"), "feat", *more).withColumns({"_x": F.col("x") + F.col("dx"), "_y": F.col("y") + F.col("dy")})
    other = px.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("feat").alias("_f"), *[F.col(c).alias("_v") for c in more])
    got = arcs.join(other, ["_x", "_y"])
    same = [(F.col("val") == F.col("_v")).cast("int").alias("same")] if labels else []
    return got.select("x", "y", "dx", "dy", F.zip_with("feat", "_f", lambda a, b: F.abs(a - b)).alias("feat"), *same)


def joint_mask(masks: list[DataFrame], every: bool = True) -> DataFrame:
    """(x, y, val): 1 where every mask (or any of them) is not 0."""
    rows = None
    for m in masks:
        own = m.select("x", "y", (F.col("val") != 0).cast("int").alias("val"))
        rows = own if rows is None else rows.unionByName(own)
    hits = F.sum("val")
    return rows.groupBy("x", "y").agg((hits == len(masks) if every else hits > 0).cast("int").alias("val"))


def image_graph(px: DataFrame, taps: list[tuple[int, int]]) -> DataFrame:
    """(src, dst, w): arcs between pixels (p, x, y, feat) of a frame, weighted by the distance of their features."""
    other = px.select(F.col("p").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("feat").alias("_f"))
    spots = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in taps if (dx, dy) != (0, 0)])
    both = px.withColumn("_s", F.explode(spots)).withColumns({"_x": F.col("_s.x"), "_y": F.col("_s.y")}).join(other, ["_x", "_y"])
    return both.select(F.col("p").alias("src"), "dst", V.euclidean(F.col("feat"), F.col("_f")).alias("w"))


def region_arcs(px: DataFrame) -> DataFrame:
    """(a, b, sides): labels of regions (x, y, val) that touch, the lower one first, and how many sides they share."""
    spots = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (0, 1))])
    there = px.select("val", F.explode(spots).alias("s")).select("val", F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    both = there.join(px.select("x", "y", F.col("val").alias("o")), ["x", "y"]).where("val <> o")
    return both.groupBy(F.least("val", "o").alias("a"), F.greatest("val", "o").alias("b")).agg(F.count("*").alias("sides"))
