"""Hand-made cases: what the rules say on inputs small enough to work out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.functions import scalars as S
from graticule.functions import texts
from graticule.functions import vectors as V
from graticule.operators import evaluation, graphs, layers, metrics, raster, samples


def lines(spark, a):
    return spark.createDataFrame([("i", y, [float(v) for v in row]) for y, row in enumerate(a)], "image string, y long, line array<double>")


def picture(df):
    return [r["line"] for r in df.orderBy("y").collect()]


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def vec(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_votes(spark):
    seeds = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, 0)], "region int, label int")
    assert {r[0]: r[1] for r in graphs.seed_votes(seeds).collect()} == {1: 1, 2: 0, 3: 0}


def test_frames():
    assert len(raster.rectangle(3, 3)) == 9 and raster.rectangle(3, 3)[:3] == [(0, 0), (-1, -1), (0, -1)]
    assert len(raster.rectangle(2, 2)) == 9
    assert [len(raster.circle(r)) for r in (1, 1.5, 2)] == [5, 9, 13]


def test_deviation_with_factor(spark):
    sm = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id long, feat array<double>")
    assert sorted(r["feat"][0] for r in samples.z_scored(sm).collect()) == pytest.approx([-1 / 1.01, 1 / 1.01])


def test_pools_at_a_corner(spark):
    ones = lines(spark, np.ones((4, 4)))
    box = raster.rectangle(3, 3)
    assert picture(raster.average_pool(ones, box))[0][0] == pytest.approx(4 / 9)
    assert picture(raster.mean_filter(ones, box))[0][0] == 1
    assert len(picture(raster.max_pool(ones, box, 2))) == 2


def test_graph_pools(spark):
    act = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], "node long, v double")
    near = spark.createDataFrame([(1, 2), (1, 3)], "node long, neighbour long")
    got = {r["node"]: (r["avg"], r["max"]) for r in graphs.pooled(act, near, 9).collect()}
    assert got[1] == (pytest.approx(3 / 9), 1.0) and got[4] == (pytest.approx(1 / 9), -math.inf)


def test_norms_and_distances(spark):
    assert value(spark, V.unit(vec(0.0005, 0))) == [0.0005, 0]
    assert value(spark, V.half_cosine(vec(1, 0), vec(1, 0))) == 0 and value(spark, V.half_cosine(vec(1, 0), vec(-1, 0))) == 1
    assert value(spark, V.l1_mean(vec(0, 0), vec(1, 3))) == 2
    assert value(spark, V.numbered(99)(vec(0, 0), vec(3, 4))) == 5


@pytest.mark.parametrize("values,want", [([0, 0, 0, 10, 10, 10], 1), ([0, 1, 2, 20, 21, 22], 2), ([5, 5, 6, 9], 6)])
def test_otsu(spark, values, want):
    px = spark.createDataFrame([(v,) for v in values], "val int")
    assert raster.otsu(raster.histogram(px, "val", max(values) + 1, max(values))).first()[0] == want


def test_ring_neighbours(spark):
    nodes = spark.createDataFrame([("g", k, [float(k)]) for k in range(4)], "graph_id string, node long, feat array<double>")
    edges = spark.createDataFrame([("g", a, b) for k in range(3) for a, b in ((k, k + 1), (k + 1, k))], "graph_id string, src long, dst long")
    got = graphs.ring_neighbours(nodes, edges, 3).where("node = 0").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [0, 1, 2]
    far = graphs.ring_neighbours(nodes, edges, 2, dilation=2).where("node = 0").orderBy("rank").collect()
    assert [r["neighbour"] for r in far] == [0, 2]


def test_markers_on_a_path(spark):
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 3)], "graph_id string, src long, dst long")
    seeds = spark.createDataFrame([("g", 0, 1), ("g", 1, 0), ("g", 3, 1)], "graph_id string, node long, label int")
    assert {r["node"]: r["marker"] for r in layers.grouped_markers(edges, seeds).collect()} == {0: 0, 1: 0, 3: 3}


def test_kernel_selection():
    bank = np.eye(3)
    assert layers.selected(bank, "2,-3").tolist() == [[0, 1, 0], [0, 0, -1]]
    assert len(layers.selected(bank, "1-3,-1")) == 4
    with pytest.raises(ValueError):
        layers.selected(bank, "0")


def test_bias_folding():
    rng = np.random.default_rng(0)
    bank, mean, stdev, x = rng.normal(size=(4, 6)), rng.normal(size=2), rng.random(2) + 0.1, rng.normal(size=(5, 6))
    w, b = layers.folded(bank, mean, stdev)
    z = (x - np.tile(mean, 3)) / np.tile(stdev, 3)
    assert np.allclose(x @ w.T + b, z @ bank.T)


def test_number_of_classes_is_the_largest(spark):
    assert samples.class_number(spark.createDataFrame([(1,), (5,)], "truelabel int")).first()[0] == 5


@pytest.mark.parametrize("band", [2, 3, 256])
def test_bands_do_not_show(spark, band, monkeypatch):
    """Local operators give the same whatever the height of a band."""
    monkeypatch.setattr(raster, "BAND", band)
    a = np.random.default_rng(1).integers(0, 9, (11, 7)).astype(float)
    df = lines(spark, a)
    got = picture(raster.banded(df, lambda x: np.nanmax(raster.stacked(x, raster.rectangle(3, 3)), 0), 1, band))
    want = np.nanmax(raster.stacked(a, raster.rectangle(3, 3)), 0)
    assert got == want.tolist()


def test_opening_and_closing_order(spark):
    a = np.random.default_rng(2).integers(0, 9, (9, 9)).astype(float)
    df, box = lines(spark, a), raster.rectangle(3, 3)
    low, high = np.array(picture(raster.opened(df, box))), np.array(picture(raster.closed(df, box)))
    assert (low <= a).all() and (a <= high).all()
    assert picture(raster.opened(lines(spark, low), box)) == low.tolist()


def test_flood_components(spark, monkeypatch):
    monkeypatch.setattr(raster, "BAND", 2)
    a = np.array([[1, 1, 0, 2], [0, 1, 0, 2], [0, 0, 1, 2], [3, 3, 0, 1], [3, 0, 0, 1]])
    got = {(r["y"], r["x"]): r["component"] for r in raster.flood_components(lines(spark, a)).collect()}
    want = {}
    for y in range(5):
        for x in range(4):
            if (y, x) in want:
                continue
            stack = [(y, x)]
            want[y, x] = y * 4 + x
            while stack:
                p, q = stack.pop()
                for r in range(max(0, p - 1), min(5, p + 2)):
                    for s in range(max(0, q - 1), min(4, q + 2)):
                        if (r, s) not in want and a[r, s] == a[y, x]:
                            want[r, s] = y * 4 + x
                            stack.append((r, s))
    assert got == want


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 15, 60), rng.integers(0, 15, 60), rng.integers(1, 30, 60)) if a < b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double")
    up = list(range(15))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    total = n = 0
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total, n = total + w, n + 1
    got = graphs.spanning_forest(df).collect()
    assert (len(got), sum(r["w"] for r in got)) == (n, total)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 50) if k % 10 != 9] + [(100, 100), (None, 3)], "src long, dst long")
    got = {r[0]: r[1] for r in graphs.components(edges).collect()}
    assert got == {k: k // 10 * 10 for k in range(51) if k != 50} | {100: 100}
    assert graphs.components(edges.limit(0)).count() == 0


def test_watershed(spark):
    nodes = spark.createDataFrame([("g", k, [float(v)]) for k, v in enumerate([0, 1, 5, 6])], "graph_id string, node long, feat array<double>")
    edges = spark.createDataFrame([("g", a, b) for k in range(3) for a, b in ((k, k + 1), (k + 1, k))], "graph_id string, src long, dst long")
    seeds = spark.createDataFrame([("g", 0, 7), ("g", 3, 8)], "graph_id string, node long, label int")
    got = {r["node"]: (r["label"], r["cost"]) for r in graphs.watershed(nodes, edges, seeds).collect()}
    assert got == {0: (7, 0.0), 1: (7, 1.0), 2: (8, 1.0), 3: (8, 0.0)}


def test_neighbours_across_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    sm = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, feat array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in samples.nearest(sm, sm, 4, block=16).collect()}
    for k in range(60):
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        assert [got[k, r] for r in range(1, 5)] == np.argsort(d)[:4].tolist()


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1), (None, 1)], "t int, g int")
    r = metrics.binary(df, F.col("t"), F.col("g")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1)
    assert r["dice"] == pytest.approx(4 / 6) and r["mcc"] == pytest.approx((2 - 1) / math.sqrt(3 * 3 * 2 * 2))


def test_scalars(spark):
    assert value(spark, S.split_at(F.lit("a_b_c"), "_", -1)) == "c" and value(spark, S.split_at(F.lit("a_b"), "_", 5)) is None
    assert value(spark, S.half_away(F.lit(-2.5))) == -3
    assert value(spark, S.json_path(F.lit('{"a": {"b": 7}}'), "a:b")) == "7"
    assert value(spark, texts.right_trim(F.lit("a//"), "/")) == "a"
    assert [r[0] for r in spark.range(20).where(S.is_prime(F.col("id"), 30)).collect()] == [2, 3, 5, 7, 11, 13, 17, 19]


def test_means_by_cosine():
    x = np.array([[1, 0.01], [1, 0.02], [0.01, 1], [0.02, 1], [0.0, 1]])
    got, sizes = layers.spherical_means(x, 2)
    assert sorted(sizes.tolist()) == [2, 3] and len(got) == 2
    assert layers.consensus(np.eye(4), 8).shape == (4, 4) and layers.consensus(np.random.default_rng(0).normal(size=(9, 4)), 3).shape == (3, 4)


def test_training_two_layers(spark):
    from graticule.sources.formats import Architecture, Layer

    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(g, k, rng.random(3).tolist()) for g in ("a", "b") for k in range(12)], "graph_id string, node long, feat array<double>")
    edges = spark.createDataFrame([(g, a, b) for g in ("a", "b") for k in range(11) for a, b in ((k, k + 1), (k + 1, k))], "graph_id string, src long, dst long")
    seeds = spark.createDataFrame([(g, k) for g in ("a", "b") for k in (0, 1, 5, 6, 7)], "graph_id string, node long")
    arch = Architecture(0.01, [Layer(channels=5, kernels_per_marker=2, pool="avg_pool"), Layer(channels=3, kernels_per_marker=1, pool="max_pool")])
    trained, out = layers.train(nodes, edges, seeds, arch)
    rows = out.collect()
    assert len(trained) == 2 and len(rows) == 24
    assert {len(r["feat"]) for r in rows} == {len(trained[1].bank)} and len(trained[0].bank) <= 5


def test_neighbours_at_equal_distance_go_by_id(spark):
    """Two hundred copies of a vector: the lowest ids, whatever the blocks."""
    base = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(200)], "id long, feat array<double>")
    q = spark.createDataFrame([(1000, [1.0, 2.5])], "id long, feat array<double>")
    for block in (16, 64, 1000):
        got = samples.nearest(q, base, 3, block=block).orderBy("rank").collect()
        assert [r["neighbour"] for r in got] == [0, 1, 2]
    got = samples.nearest(base, base, 2, block=32).where("id = 7").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [0, 1]


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + k, 501 + k) for k in range(80)] + [(900, 900)]
    want = {}
    for a, b in pairs:
        for n in (a, b):
            want.setdefault(n, n)
    for _ in range(len(want)):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    for parts in (1, 7):
        df = spark.createDataFrame(pairs, "src long, dst long").repartition(parts)
        assert {r["node"]: r["component"] for r in graphs.components(df).collect()} == want
    text = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {r["node"]: r["component"] for r in graphs.components(text).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_running_moments_by_block(spark):
    from pyspark.sql import functions as F

    from graticule.streaming import running

    rows = [(k, k % 2, k // 7, float(k * k % 11) if k % 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, user long, day long, value double")
    plain = {r["id"]: (r["rm"], r["rv"]) for r in running.running_moments(df, "user", ["id"], "value").collect()}
    for r in running.running_moments(df, "user", ["id"], "value", F.col("day")).collect():
        a, b = plain[r["id"]]
        assert (a is None and r["rm"] is None) or (abs(a - r["rm"]) < 1e-9 and abs(b - r["rv"]) < 1e-9)


def test_nearest_centroids_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(40, 3)), rng.normal(size=(23, 3))
    sm = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, feat array<double>")
    centres = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "c int, centre array<double>")
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for size in (5, 4096):
        monkeypatch.setattr(samples, "CENTROIDS", size)
        got = {r["id"]: r["group"] for r in samples.nearest_centroid(sm, centres).collect()}
        assert [got[k] for k in range(40)] == want.tolist()


def _points(spark, seed: int, n: int, start: int = 0):
    """n samples on a coarse grid, so that distances tie, two of them without a vector."""
    x = np.random.default_rng(seed).integers(0, 4, (n, 3)) / 4
    feats = [None if k == 3 else [None, 1.0, 0.0] if k == 5 else v.tolist() for k, v in enumerate(x)]
    rows = [(start + k, f, k % 3 + 1, [0.0, 0.3, 0.55][k % 5 % 3]) for k, f in enumerate(feats)]
    return rows, spark.createDataFrame(rows, "id long, feat array<double>, label int, cost double")


def _away(a, b) -> float | None:
    return None if a is None or b is None or None in a or None in b else math.dist(a, b)


def test_optimum_paths_in_blocks(spark, monkeypatch):
    """Against all pairs; no row holds a block of prototypes."""
    monkeypatch.setattr(samples, "BLOCK", 8)
    (ts, test), (ps, protos) = _points(spark, 1, 40), _points(spark, 2, 70, start=100)
    got = samples.optimum_path_predicted(test, protos)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {t[0]: min((round(max(p[3], _away(t[1], p[1]) or 0.0), 9), p[0], p[2]) for p in ps) for t in ts}
    assert {r["id"]: (r["cost"], r["label"]) for r in got.collect()} == {k: (c, label) for k, (c, _, label) in want.items()}


def test_covering_nodes_in_blocks(spark, monkeypatch):
    """Against all pairs, with distances equal to the radius; no row holds a block of nodes."""
    monkeypatch.setattr(samples, "BLOCK", 8)
    (ts, test), (ps, nodes) = _points(spark, 1, 40), _points(spark, 2, 70, start=100)
    got = evaluation.covered(test, nodes.select("id", "feat", F.col("label").alias("group"), (-F.col("id")).alias("rank"), (F.col("cost") - 0.05).alias("radius")))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for t in ts:
        seen = [(math.inf if (d := _away(t[1], p[1])) is None else round(d, 9), -p[0], p[2], p[3] - 0.05) for p in ps]
        within = [(rank, group) for d, rank, group, radius in seen if d <= radius]
        want[t[0]] = min(within)[1] if within else min(seen)[2]
    assert {r["id"]: r["group"] for r in got.collect()} == want


def test_certainty_in_one_pass(spark, monkeypatch):
    """Against all pairs; test samples are read once, however many labels there are."""
    monkeypatch.setattr(samples, "BLOCK", 8)
    (ts, test), (ps, protos) = _points(spark, 1, 40), _points(spark, 2, 70, start=100)
    got = evaluation.certainty(test, protos)
    assert "Union" not in got._jdf.queryExecution().toString()
    want = {}
    for t in ts:
        least = sorted((min(round(max(p[3], _away(t[1], p[1]) or 0.0), 9) for p in ps if p[2] == label), label) for label in (1, 2, 3))[:2]
        (a, label), (b, _) = least
        want[t[0]] = (label, a, pytest.approx(0.5 if a + b < 1e-7 else b / (a + b)))
    assert {r["id"]: (r["label"], r["cost"], r["weight"]) for r in got.collect()} == want


def test_nearest_pixels_in_tiles(spark):
    """Against all pairs: near, far beyond the first tiles, repeated; and in tiles, so that pairs do not grow with the square of the border."""
    rng = np.random.default_rng(3)
    a = [(int(x), int(y)) for x, y in rng.integers(-90, 90, (60, 2))] + [(3000, 1)] * 2
    b = [(int(x), int(y)) for x, y in rng.integers(20, 400, (40, 2))]
    got = evaluation.surface_distance(*(spark.createDataFrame(p, "x int, y long") for p in (a, b))).first()
    there, back = ([min(math.dist(p, q) for q in two) for p in one] for one, two in ((a, b), (b, a)))
    assert tuple(got) == pytest.approx((np.mean(there), np.mean(back), np.mean(there + back)))
    one, two = (spark.range(3000).select((F.col("id") % 3 * 1000).cast("double").alias("x"), (F.col("id") * 7 + k).cast("double").alias("y"), F.lit(1).alias("n")) for k in (0, 5))
    seen = evaluation._in_tiles(one, two, 64.0)
    assert seen.where("d2 <= 4096").count() == 3000 and "CoGroup" in seen._jdf.queryExecution().toString()
    assert tuple(evaluation.surface_distance(one, two.limit(0)).first()) == (None, None, None)


def test_neighbour_map_in_blocks(spark, monkeypatch):
    """One task and a job a round give the same map, and no comparison holds all pairs."""
    x = np.random.default_rng(5).normal(0, 1, (150, 4))
    sm = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, feat array<double>")
    one = {r["id"]: r["feat"] for r in evaluation.neighbour_map(sm, rounds=3).collect()}
    monkeypatch.setattr(samples, "BLOCK", 100)
    many = {r["id"]: r["feat"] for r in evaluation.neighbour_map(sm, rounds=3).collect()}
    assert one.keys() == many.keys() and all(v == pytest.approx(many[k], abs=1e-9) for k, v in one.items())
    assert evaluation._squares(x, 64)[0].shape == (64, 150)
