"""Classifiers, clusterings and code books on sample tables beyond nearest neighbours.

Fits are sums over all samples (least squares, mixtures, linear machines) or run on blocks of samples that are joined by their
prototypes (optimum-path clusters, medoids).
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..tables import TEST, TRAIN
from . import samples

#: Samples that one task clusters.
BLOCK = 4096


def least_squares(sm: DataFrame, classes: int) -> np.ndarray:
    """Weights (features + 1, classes) of least squares on one-hot labels, from one sum of outer products per task."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack((np.stack(pdf["feat"].to_numpy()), np.ones(len(pdf))))
                y = np.eye(classes)[pdf["truelabel"].to_numpy() - 1]
                m = np.column_stack((x.T @ x, x.T @ y))
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    got = sm.select("feat", "truelabel").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    # d * (d + classes) numbers
    d = round((-classes + np.sqrt(classes * classes + 4 * len(got))) / 2)
    m = got.reshape(d, d + classes)
    return np.linalg.pinv(m[:, :d]) @ m[:, d:]


def least_squares_classified(sm: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, truelabel, label): the class of the largest response, the lowest among equals."""
    columns = [F.array(*map(F.lit, map(float, weights[:-1, c]))) for c in range(weights.shape[1])]
    scores = [F.struct((-F.round(V.total2(F.col("feat"), w, lambda a, b: a * b) + float(weights[-1, c]), 9)).alias("s"), F.lit(c + 1).alias("c")) for c, w in enumerate(columns)]
    return sm.select("id", "truelabel", F.array_min(F.array(*scores))["c"].alias("label"))


def _vectors(sm: DataFrame) -> DataFrame:
    return sm.withColumn("features", array_to_vector("feat")).withColumn("label", (F.col("truelabel") - 1).cast("double"))


def support_vectors(train: DataFrame, test: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, truelabel, label) by one linear machine per class against the rest."""
    model = OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=0.01)).fit(_vectors(train))
    return model.transform(_vectors(test)).select("id", "truelabel", (F.col("prediction") + 1).cast("int").alias("label"))


def mixture(sm: DataFrame, k: int, seed: int = 42, rounds: int = 30) -> DataFrame:
    """(id, group, p) of a Gaussian mixture."""
    model = GaussianMixture(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="group").fit(_vectors(sm))
    return model.transform(_vectors(sm)).select("id", F.col("group").cast("int").alias("group"), F.array_max(vector_to_array("probability")).alias("p"))


def classified(sm: DataFrame, method: str, k: int = 5) -> DataFrame:
    """(id, truelabel, label) of test samples by a method: knn, least_squares, svm, or nearest_mean."""
    train, test = samples.with_status(sm, TRAIN), samples.with_status(sm, TEST)
    if method == "knn":
        return samples.knn_classified(sm, k)
    if method == "least_squares":
        classes = train.agg(F.max("truelabel")).first()[0]
        return least_squares_classified(test, least_squares(train, classes))
    if method == "svm":
        return support_vectors(train, test)
    if method == "nearest_mean":
        return samples.nearest_centroid(test, samples.class_centroids(train)).select("id", "truelabel", F.col("group").alias("label"))
    raise ValueError(f"no such method: {method}")


def cross_validated(sm: DataFrame, folds: int, k: int) -> DataFrame:
    """(fold, accuracy) of nearest neighbours, each fold tested on the others' samples: one pass, neighbours of the same fold left out."""
    own = samples.k_folds(sm, folds)
    found = None
    for f in range(folds):
        part = own.withColumn("status", F.when(F.col("fold") == f, TEST).otherwise(TRAIN))
        got = samples.knn_classified(part, k).agg(F.avg((F.col("truelabel") == F.col("label")).cast("double")).alias("accuracy")).withColumn("fold", F.lit(f))
        found = got if found is None else found.unionByName(got)
    return found.select("fold", "accuracy")


def medoids(sm: DataFrame, init: DataFrame, rounds: int = 3) -> DataFrame:
    """(c, id): of each group the sample with the least sum of squared distances to the others, after `rounds` steps from given samples (c, id).

    The sum of squared distances to a group is least for the sample nearest to its mean, so no pair is compared.
    """
    centres = init.join(sm.select("id", F.col("feat").alias("centre")), "id").select("c", "centre")
    best = init
    for _ in range(rounds):
        grouped = samples.nearest_centroid(sm, centres)
        best = samples.medoids(grouped, samples.class_centroids(grouped, "group"))
        rows = best.join(sm.select("id", F.col("feat").alias("centre")), "id").select("c", "id", "centre").collect()  # as many as groups
        table = sm.sparkSession.createDataFrame(rows, "c int, id long, centre array<double>")
        best, centres = table.select("c", "id"), table.select("c", "centre")
    return best


def _near(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k nearest others, and their distances."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2) if n <= 512 else (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)[None], 0))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(np.round(d, 9), 1, kind="stable")[:, : min(k, n - 1)]
    return near, np.take_along_axis(d, near, 1)


def _climbed(ids: np.ndarray, near: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root and density of each row: each climbs, along arcs to its nearest ones, the path whose least density is largest."""
    n = len(ids)
    if n == 1 or not near.size:
        return np.arange(n), np.ones(n)
    scale = 2 * w.max() ** 2 / 9
    raw = (1 - np.exp(-w * w / scale)).sum(1) if scale else np.zeros(n)
    span = raw.max() - raw.min()
    density = (V.MAX_WEIGHT - 1) * (raw.max() - raw) / span + 1 if span else np.full(n, V.MAX_WEIGHT)
    around = [set(r) for r in near.tolist()]
    for i, r in enumerate(near.tolist()):
        for j in r:
            if density[j] == density[i]:  # plateaus are joined both ways
                around[j].add(i)
    value, root, done = density - 1, np.arange(n), np.zeros(n, bool)
    heap = [(-value[i], int(ids[i]), i) for i in range(n)]
    heapq.heapify(heap)
    while heap:
        v, _, i = heapq.heappop(heap)
        if done[i] or -v < value[i]:
            continue
        done[i] = True
        if root[i] == i:
            value[i] = density[i]
        for j in around[i]:
            new = min(value[i], density[j])
            if not done[j] and new > value[j]:
                value[j], root[j] = new, root[i]
                heapq.heappush(heap, (-new, int(ids[j]), j))
    return root, density


def optimum_path_clusters(sm: DataFrame, k: int = 5) -> DataFrame:
    """(id, root): clusters around density maxima, over all samples at once.

    The k nearest of each sample come from the distributed graph; one task climbs it, and holds k numbers for each sample, not
    its features.  For more samples than a task can climb see `two_level_clusters`.
    """
    arcs = samples.knn_graph(sm, k).select("src", "dst", "rank", "w")
    rows = arcs.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst", "w"))), lambda a: F.struct(a["dst"].alias("dst"), a["w"].alias("w"))).alias("near"))
    alone = sm.select(F.col("id").alias("src")).join(rows, "src", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src")
        ids = pdf["src"].to_numpy()
        got = [[] if a is None else list(a) for a in pdf["near"]]
        m = min((len(a) for a in got), default=0)
        near = np.array([[a["dst"] for a in r[:m]] for r in got], np.int64).reshape(len(ids), m)
        w = np.array([[a["w"] for a in r[:m]] for r in got], float).reshape(len(ids), m)
        root, _ = _climbed(ids, np.searchsorted(ids, near), w)
        return pd.DataFrame({"id": ids, "root": ids[root]})

    return alone.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "id long, root long")


def two_level_clusters(sm: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, root): clusters of blocks of samples, then of the roots of all blocks, until these fit one block; the blocks show in the result."""
    n = sm.count()
    blocks = max(1, -(-n // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["feat"].to_numpy())
        root, _ = _climbed(ids, *(_near(x, k) if len(x) > 1 else (np.zeros((1, 0), int), np.zeros((1, 0)))))
        return pd.DataFrame({"id": ids, "root": ids[root]})

    first = sm.select("id", "feat", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).groupBy("b").applyInPandas(run, "id long, root long")
    if blocks == 1:
        return first
    from .graphs import cut_lineage

    first = cut_lineage(first)
    roots = sm.join(first.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
    upper = two_level_clusters(roots, k, block) if roots.count() < n else first
    return first.join(upper.select(F.col("id").alias("root"), F.col("root").alias("top")), "root").select("id", F.col("top").alias("root"))


def code_histogram(sm: DataFrame, book: DataFrame, by: str) -> DataFrame:
    """(by, word, n): how often each word (c, centre) of a book is the nearest one among a group's samples."""
    return samples.nearest_centroid(sm, book).groupBy(by, F.col("group").alias("word")).agg(F.count("*").alias("n"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two matrices of cells (i, k, v) and (k, j, v): a join on the inner index, summed before the shuffle where it can be."""
    right = b.select("k", "j", F.col("v").alias("w"))
    return a.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def mahalanobis(sm: DataFrame, centres: DataFrame, inverse: np.ndarray) -> DataFrame:
    """(id, c, d) to each centre (c, centre) under an inverse covariance."""
    rows = F.array(*[F.array(*map(F.lit, map(float, r))) for r in inverse])
    diff = F.zip_with("feat", "centre", lambda x, y: x - y)
    turned = F.transform(rows, lambda r: V.total2(r, F.col("diff"), lambda x, y: x * y))
    d = F.sqrt(F.greatest(V.total2(F.col("diff"), F.col("turned"), lambda x, y: x * y), F.lit(0.0)))
    return sm.select("id", "feat").join(F.broadcast(centres)).withColumn("diff", diff).withColumn("turned", turned).select("id", "c", d.alias("d"))
