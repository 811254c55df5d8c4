"""Whole-image operators and learners against plain restatements."""

import numpy as np
import pytest

from graticule.operators import learners, pictures, samples

RNG = np.random.default_rng(7)
IMAGES = {"a": RNG.integers(0, 6, (9, 8)).astype(float), "b": RNG.integers(0, 3, (5, 11)).astype(float), "c": np.ones((3, 3)), "d": RNG.integers(0, 50, (7, 7)).astype(float)}


def table(spark):
    return spark.createDataFrame([(n, y, row.tolist()) for n, a in IMAGES.items() for y, row in enumerate(a)], "image string, y long, line array<double>")


def got(df):
    out = {}
    for r in df.orderBy("image", "y").collect():
        out.setdefault(r["image"], []).append(r["line"])
    return {n: np.array(v, float) for n, v in out.items()}


def same(df, fn):
    found = got(df)
    assert found.keys() == IMAGES.keys()
    for n, a in IMAGES.items():
        assert np.array_equal(found[n], np.array(fn(a), float), equal_nan=True), n


def around(a, y, x, ring):
    return [(y + dy, x + dx) for dx, dy in ring if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]


def part(a, start, ok, ring):
    seen, stack = {start}, [start]
    while stack:
        for q in around(a, *stack.pop(), ring):
            if q not in seen and ok(q):
                seen.add(q)
                stack.append(q)
    return seen


def test_distances(spark):
    def want(a):
        zero = np.argwhere(a == 0)
        return [[min(((zero - (y, x)) ** 2).sum(1)) if len(zero) else np.inf for x in range(a.shape[1])] for y in range(a.shape[0])]

    same(pictures.distance_transform(table(spark)), want)


@pytest.mark.parametrize("area", [2, 4, 9])
def test_area_opening(spark, area):
    """The highest level at which the part of a pixel is large enough, or the lowest there is."""

    def want(a):
        out = np.full(a.shape, a.min())
        for y, x in np.ndindex(*a.shape):
            for t in np.unique(a[a <= a[y, x]]):
                if len(part(a, (y, x), lambda q: a[q] >= t, pictures.RING4)) >= area:
                    out[y, x] = max(out[y, x], t)
        return out

    same(pictures.area_opening(table(spark), area), want)


def test_regional_maxima(spark):
    def want(a):
        out = np.zeros(a.shape)
        for y, x in np.ndindex(*a.shape):
            flat = part(a, (y, x), lambda q: a[q] == a[y, x], pictures.RING8)
            out[y, x] = all(a[q] <= a[p] for p in flat for q in around(a, *p, pictures.RING8))
        return out

    same(pictures.regional_maxima(table(spark)), want)


def test_reconstruction(spark):
    """Along paths the level that can be kept: the best least value, from any pixel's lowered level."""

    def want(a):
        out = a - 2
        for _ in range(a.size):
            for y, x in np.ndindex(*a.shape):
                out[y, x] = min(a[y, x], max([out[y, x], *(out[q] for q in around(a, y, x, pictures.RING4))]))
        return out

    same(pictures.reconstruct_by_dilation(table(spark), 2.0), want)
    up = got(pictures.reconstruct_by_erosion(table(spark), 2.0))
    assert all((up[n] >= a).all() and (up[n] <= a + 2).all() for n, a in IMAGES.items())
    filled = got(pictures.closed_holes(table(spark)))
    assert all((filled[n] >= a).all() for n, a in IMAGES.items())


def test_superpixels(spark):
    a = np.zeros((8, 8))
    a[:, 4:] = 100
    df = spark.createDataFrame([("i", y, row.tolist()) for y, row in enumerate(a)], "image string, y long, line array<double>")
    label = got(pictures.superpixels(df, 16, 2))["i"]
    assert len(np.unique(label)) == 2 and len(np.unique(label[:, :4])) == 1 and len(np.unique(label[:, 4:])) == 1


def test_spectrum_and_geometry(spark):
    energy = got(pictures.spectrum(table(spark)))
    assert all(np.isclose((energy[n] ** 2).sum(), a.size * (a**2).sum()) for n, a in IMAGES.items())
    same(pictures.flipped_x(table(spark)), lambda a: a[:, ::-1])
    same(pictures.flipped_y(table(spark)), lambda a: a[::-1])
    same(pictures.transposed(table(spark)), lambda a: a.T)
    twice = got(pictures.rescaled(table(spark), 15, 17))
    assert np.allclose(twice["a"][::2, ::2], IMAGES["a"]) and all(v.shape == (17, 15) for v in twice.values())


def clouds(spark, n=60):
    x = np.concatenate([RNG.normal(c, 0.5, (n // 3, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    rows = [(k, v.tolist(), k // (n // 3) + 1, 2 if k % 4 == 0 else 4) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, feat array<double>, truelabel int, status int")


@pytest.mark.parametrize("method", ["knn", "least_squares", "svm", "nearest_mean"])
def test_classifiers(spark, method):
    rows = learners.classified(clouds(spark), method).collect()
    assert len(rows) == 15 and all(r["label"] == r["truelabel"] for r in rows)


def test_least_squares_weights(spark):
    sm = clouds(spark)
    rows = sm.orderBy("id").collect()
    x = np.column_stack((np.array([r["feat"] for r in rows]), np.ones(len(rows))))
    y = np.eye(3)[[r["truelabel"] - 1 for r in rows]]
    assert np.allclose(learners.least_squares(sm, 3), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_optimum_path_clusters(spark):
    """Clusters never mix clouds; joined from several blocks, every sample has a root that is its own."""
    sm = clouds(spark)
    truth = {r["id"]: r["truelabel"] for r in sm.collect()}
    found = learners.optimum_path_clusters(sm, 6).collect()
    assert len(found) == 60 and all(truth[r["id"]] == truth[r["root"]] for r in found)
    assert len({r["root"] for r in found}) < 30
    assert sorted(found) == sorted(learners.two_level_clusters(sm, 6, 1000).collect())  # one block is all of them
    joined = {r["id"]: r["root"] for r in learners.two_level_clusters(sm, 6, 25).collect()}
    assert joined.keys() == truth.keys() and all(joined[r] == r for r in set(joined.values()))


def test_medoids_are_means_nearest(spark):
    sm = clouds(spark)
    init = spark.createDataFrame([(1, 0), (2, 20), (3, 40)], "c int, id long")
    truth = {r["id"]: (r["truelabel"], np.array(r["feat"])) for r in sm.collect()}
    for r in learners.medoids(sm, init).collect():
        own = {k: v for k, (c, v) in truth.items() if c == r["c"]}
        assert r["id"] == min(own, key=lambda k: sum(((own[k] - v) ** 2).sum() for v in own.values()))


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        learners.classified(clouds(spark), "other")
    assert samples.class_number(clouds(spark)).first()[0] == 3
