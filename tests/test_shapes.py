"""Shapes, frames, colours and matrices on small fixtures, against plain computations."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.functions import colours as C
from graticule.functions import maths as M
from graticule.functions import scalars as S
from graticule.functions import texts as X
from graticule.operators import frames as R
from graticule.operators import image_layers as IL
from graticule.operators import shapes as Z


def lines(spark, a, image="i"):
    return spark.createDataFrame([(image, y, [float(v) for v in row]) for y, row in enumerate(np.asarray(a))], "image string, y long, line array<double>")


def back(df):
    return np.array([[np.nan if v is None else v for v in r["line"]] for r in df.orderBy("y").collect()])


def cut_weight(a, side, sharp):
    top = a.max() - a.min() or 1.0
    total = 0.0
    for y, x in itertools.product(range(a.shape[0]), range(a.shape[1])):
        for dx, dy in ((1, 0), (0, 1)):
            if y + dy < a.shape[0] and x + dx < a.shape[1] and side[y, x] != side[y + dy, x + dx]:
                total += (1 - abs(a[y, x] - a[y + dy, x + dx]) / top) ** sharp
    return total


@pytest.mark.parametrize("seed", range(3))
def test_least_cut_against_all_cuts(spark, seed):
    a = np.random.default_rng(seed).integers(0, 9, (3, 4)).astype(float)
    inside, outside = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
    inside[0, 0], outside[2, 3] = True, True
    free = [p for p in itertools.product(range(3), range(4)) if p not in ((0, 0), (2, 3))]
    best = np.inf
    for choice in itertools.product((False, True), repeat=len(free)):
        side = inside.copy()
        for p, c in zip(free, choice):
            side[p] = c
        best = min(best, cut_weight(a, side, 2.0))
    got = back(Z.cut(lines(spark, a), lambda m: inside, lambda m: outside, 2.0)) == 1
    assert got[0, 0] and not got[2, 3] and abs(cut_weight(a, got, 2.0) - best) < 1e-9


def test_geodesic_distances_go_round_walls(spark):
    a = np.ones((5, 5))
    a[1:, 2] = 0
    seeds = np.zeros((5, 5), bool)
    seeds[4, 0] = True
    got = back(Z.geodesic_distance(lines(spark, a), lambda m: seeds))
    assert abs(got[4, 4] - (2 * (2 + 2 * 2**0.5) + 0)) < 1e-9 and np.isnan(got[3, 2]) and got[4, 0] == 0
    centre = back(Z.geodesic_centre(lines(spark, np.ones((3, 5)))))
    assert centre[1, 2] == 1 and centre.sum() == 1


def test_medial_axis_gives_the_shape_back(spark):
    a = np.zeros((9, 12))
    a[1:8, 2:11] = 1
    a[4, 5] = 0
    axis = Z.medial_axis(lines(spark, a))
    assert (back(Z.shape_of_axis(axis)) == a).all()
    assert (back(axis) > 0).sum() < a.sum()


def test_shape_of_axis_of_a_tall_image(monkeypatch):
    """Against every disk in small images; a tall one of many disks takes no pass over the image for each."""
    monkeypatch.setattr(Z, "per_image", lambda a, fn: fn(a))
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 9), (12, 5), (9, 14)) * 5:
        a = rng.choice([0, 0, 0, 0, 1, 2, 5, 13, 40, -3, np.nan, np.inf], shape, p=[0.2] * 4 + [0.03] * 4 + [0.02, 0.02, 0.03, 0.01])
        yy, xx = np.mgrid[: shape[0], : shape[1]]
        disks = [(yy - y) ** 2 + (xx - x) ** 2 < a[y, x] for y, x in np.ndindex(shape)]
        assert (Z.shape_of_axis(a) == np.any(disks, axis=0)).all()
    tall = np.zeros((40_000, 64))
    tall[::2, ::2] = 2
    began = time.process_time()
    assert Z.shape_of_axis(tall)[:-1, :-1].mean() > 0.75
    assert time.process_time() - began < 20


def test_trees_and_attributes(spark):
    a = np.array([[0, 5, 5, 0, 9], [0, 0, 0, 0, 0], [3, 3, 0, 0, 7]], float)
    assert back(Z.volume_opening(lines(spark, a), 8.0)).tolist() == [[0, 5, 5, 0, 9], [0] * 5, [0, 0, 0, 0, 0]]
    assert back(Z.volume_closing(lines(spark, -a), 8.0)).tolist() == [[0, -5, -5, 0, -9], [0] * 5, [0, 0, 0, 0, 0]]
    assert back(Z.area_closing(lines(spark, -a), 2)).tolist() == [[0, -5, -5, 0, 0], [0] * 5, [-3, -3, 0, 0, 0]]
    parent = back(Z.max_tree(lines(spark, a))).ravel().astype(int)
    flat = a.ravel()
    assert all(flat[p] <= flat[k] for k, p in enumerate(parent)) and (parent == np.arange(15)).sum() == 1


def test_reconstruction_keeps_what_an_erosion_leaves(spark):
    a = np.zeros((7, 9))
    a[1:6, 1:6], a[3, 7] = 4, 8
    taps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    got = back(Z.open_by_reconstruction(lines(spark, a), taps))
    assert (got[:, :7] == a[:, :7]).all() and got[3, 7] == 0
    assert back(Z.open_domes(lines(spark, a), taps))[3, 7] == 8
    assert (back(Z.close_by_reconstruction(lines(spark, -a), taps)) == -got).all()


def test_watersheds(spark):
    a = np.array([[0, 1, 9, 1, 0]] * 3, float)
    seeds = np.zeros((3, 5), int)
    seeds[1, 0], seeds[1, 4] = 1, 2
    for arcs in ("difference", "height", "rise"):
        got = back(Z.flooded(lines(spark, a), lambda m: seeds, arcs))
        assert (got[:, :2] == 1).all() and (got[:, 3:] == 2).all()
    for by in (True, False):
        got = back(Z.dynamic_trees(lines(spark, a), lambda m: seeds, by))
        assert (got[:, :2] == 1).all() and (got[:, 3:] == 2).all()
    assert sorted(set(back(Z.water_gray(lines(spark, a), 2.0)).ravel())) == [1, 2]
    assert set(back(Z.water_gray(lines(spark, a), 20.0)).ravel()) == {1}


def test_nearest_and_signed_distances(spark):
    a = np.zeros((6, 7))
    a[2:4, 1:5] = 1
    d = back(Z.signed_distance(lines(spark, a)))
    assert d[2, 2] == 1 and d[0, 2] == -2 and abs(d[0, 6] + 8**0.5) < 1e-9
    root = back(Z.nearest_in_set(lines(spark, a), lambda m: m == 1))
    assert root[0, 0] == 2 * 7 + 1 and root[5, 6] == 3 * 7 + 4
    assert back(Z.border_distance(lines(spark, np.ones((5, 5)))))[2, 2] == 4


def test_superpixels_by_means(spark):
    a = np.zeros((16, 16))
    a[:, 8:] = 100
    got = back(Z.slic(lines(spark, a), 16, 1.0))
    assert not set(got[:, :8].ravel()) & set(got[:, 8:].ravel())


def test_frames():
    assert R.cuboid(3, 3, 1) == [(0, 0, 0)] + [(dx, dy, 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
    assert R.ball(1.0, 2) == [(0, 0), (0, -1), (-1, 0), (1, 0), (0, 1)] and len(R.ball(1.0)) == 7
    assert R.box((3, 1, 1, 3))[0] == (0, 0, 0, 0) and len(R.box((3, 1, 1, 3))) == 9
    assert R.cross(3, 5) == [(0, 0), (-1, 0), (1, 0), (0, -2), (0, -1), (0, 1), (0, 2)]
    assert [o for o in R.clockwise(1.0)] == [(0, 0), (-1, 0), (0, -1), (1, 0), (0, 1)]
    assert R.shell(R.cuboid(3, 3, 1), 1.2, 2, centre=True)[0] == (0, 0, 0) and len(R.shell(R.cuboid(3, 3, 1), 1.2, 2)) == 4
    assert R.half_ball(1.0, 0, -1) and all(o[0] <= 0 for o in R.half_ball(2.0, 0, -1))
    edges = R.one_way(R.ball(1.5, 2), 1.5)
    assert all((o == (0, 0)) or (tuple(-v for v in o) not in edges) for o in edges) and len(edges) == 5


def test_low_pass_keeps_the_mean():
    a = np.random.default_rng(0).normal(size=(8, 10))
    got = R.low_passed(a, 2, 0.2)
    assert abs(got.mean() - a.mean()) < 1e-9 and got.std() < a.std()
    volume = np.random.default_rng(1).normal(size=(4, 4, 4))
    assert np.allclose(R.low_passed(volume, 1, 1e9), volume, atol=1e-6)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_greys_have_no_chroma(spark):
    v = F.col("id").cast("double")
    got = spark.range(256).select(*[c.alias(n) for c, n in zip(S.ycbcr(v, v, v), ("y", "cb", "cr"))])
    assert got.where("cb <> 128 or cr <> 128").count() == 0


def test_colours_go_back_and_forth(spark):
    lit = [F.lit(v) for v in (200.0, 40.0, 90.0)]
    for to, close in (("ycbcr", 3), ("lab", 3), ("lab_scaled", 3)):
        got = one(spark, *C.converted(C.converted(lit, "rgb", to), to, "rgb"))
        assert max(abs(a - b) for a, b in zip(got, (200, 40, 90))) <= close
    assert one(spark, *C.rgb_of_wide_ycbcr(*C.wide_ycbcr(*lit, 8, 16), 16, 8)) == pytest.approx((200, 40, 90), abs=1)
    assert one(spark, *C.rgb_of_hsv(F.lit(0.0), F.lit(0.0), F.lit(77.0))) == (77, 77, 77)
    assert one(spark, *C.converted(lit, "rgb", "rgb")) == (200.0, 40.0, 90.0)
    rows = {r["n"]: (r["r"], r["g"], r["b"]) for r in C.gradient(spark, C.VIRIDIS, 64).collect()}
    assert len(rows) == 64 and rows[0] == (0x48, 0, 0x54) and rows[63] == (0xF3, 0xE9, 0x1C)
    rows = [tuple(r)[1:] for r in C.blue_to_red(spark, 10).orderBy("n").collect()]
    assert len(rows) == 10 and rows[0] == C.BLUE_TO_RED[0] and rows[3] == C.BLUE_TO_RED[1] and rows[6] == C.BLUE_TO_RED[2] and rows[9] == C.BLUE_TO_RED[3]
    assert one(spark, S.luma(*lit))[0] == pytest.approx(0.299 * 200 + 0.587 * 40 + 0.114 * 90)


def test_special_functions(spark):
    import math

    for x in (-7.0, -2.5, -0.1, 0.0, 0.4, 1.9, 5.5):
        assert one(spark, M.erf(F.lit(x)))[0] == pytest.approx(math.erf(x), abs=1e-12)
    for x in (0.2, 0.5, 1.0, 3.3, 10.0):
        assert one(spark, M.gamma(F.lit(x)))[0] == pytest.approx(math.gamma(x), rel=1e-9)
    # |gamma(1 + iy)|^2 = pi y / sinh(pi y)
    for y in (0.3, 1.5, 4.0):
        assert one(spark, M.gamma_ratio(F.lit(1.0), F.lit(y)))[0] == pytest.approx(math.pi * y / math.sinh(math.pi * y), rel=1e-9)
    assert one(spark, M.factorial(F.lit(0)), M.factorial(F.lit(20))) == (1.0, float(math.factorial(20)))
    assert one(spark, M.geometric(1.0, 8.0, 2.0)) == ([1.0, 2.0, 4.0, 8.0],)


def test_string_number_wraps_round(spark):
    def plain(text):
        h, m = 0, (1 << 64) - 1
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for c in text.encode():
            h = (h + c) & m
            h = (h + (h << 10)) & m
            h ^= (signed(h) >> 6) & m
        h = (h + (h << 3)) & m
        h ^= (signed(h) >> 11) & m
        return signed((h + (h << 15)) & m)

    for t in ("", "a", "Brand#45", "a much longer text, so that it overflows"):
        assert one(spark, X.string_number(F.lit(t)))[0] == plain(t)


def test_paths_and_durations(spark):
    assert one(spark, X.joined_path(F.lit("/a/"), F.lit("/b"), F.lit("c")), X.absolute(F.lit("../x/./y"), "/u/v"), X.absolute(F.lit("/a//b/"), "/u")) == ("/a/b/c", "/u/x/y", "/a/b")
    assert one(spark, X.duration(F.lit(90_061_001.0)), X.duration(F.lit(0.25)), X.duration(F.lit(3_600_000.0))) == ("1 day(s) 1 hour(s) 1 min(s) 1 sec(s) 1 ms", "0.250000 ms", "1 hour(s) ")
    assert one(spark, *X.colour_of_hex(F.lit("#0aFF10"))) == (10, 255, 16) and one(spark, X.colour_of_hex(F.lit("0aFF10"))[0]) == (None,)


# --- layers on images


def plain_layer(x, mean, stdev, taps, bank):
    z = (x - mean) / stdev
    h, w, b = x.shape
    out = np.zeros((h, w, len(bank)))
    for y, xx in itertools.product(range(h), range(w)):
        patch = [z[y + dy, xx + dx] if 0 <= y + dy < h and 0 <= xx + dx < w else np.zeros(b) for dx, dy in taps]
        out[y, xx] = np.maximum(bank @ np.concatenate(patch), 0)
    return out


def test_image_layer_against_plain_computation(spark):
    rng = np.random.default_rng(7)
    x, taps = rng.normal(size=(11, 6, 2)), [(0, 0), (1, 0), (-2, 1), (0, -2)]
    mean, stdev, bank = rng.normal(size=2), np.array([0.5, 2.0]), rng.normal(size=(3, 8))
    df = lines(spark, x.reshape(11, -1))
    want = plain_layer(x, mean, stdev, taps, bank)
    ring = [(0, 0), (1, 0), (0, 1), (-1, -1)]
    for band in (4, 256):
        got = IL.convolved(df, mean, stdev, taps, bank, band=band)
        assert np.allclose(back(got), want.reshape(11, -1))
        top = back(IL.pooled(got, 3, "max_pool", ring, 2, band)).reshape(6, 3, 3)
        mean_ = back(IL.pooled(got, 3, "avg_pool", ring, 1, band)).reshape(11, 6, 3)
        for y, xx in itertools.product(range(11), range(6)):
            near = [want[y + dy, xx + dx] for dx, dy in ring if 0 <= y + dy < 11 and 0 <= xx + dx < 6]
            assert np.allclose(mean_[y, xx], np.sum(near, 0) / 4)
            if y % 2 == 0 and xx % 2 == 0:
                assert np.allclose(top[y // 2, xx // 2], np.max(near, 0))
    px = IL.to_pixels(df, 2)
    assert px.count() == 66 and np.allclose(back(IL.from_pixels(px)), x.reshape(11, -1))


def test_image_layers_learn_from_markers(spark):
    from graticule.sources.formats import Architecture, Layer

    rng = np.random.default_rng(8)
    a = rng.normal(0, 0.1, (24, 20))
    a[:, 10:] += 3
    df = lines(spark, a, "p").unionByName(lines(spark, a[::-1], "q"))
    seeds = [(i, x, y, m) for i in "pq" for m, xs in ((1, (2, 3, 4)), (2, (14, 15, 16))) for x in xs for y in (5, 6, 7)]
    markers = spark.createDataFrame(seeds, "image string, x int, y int, marker long")
    arch = Architecture(0.01, [Layer(kernels_per_marker=2, channels=6, pool="max_pool", stride=2), Layer(kernels_per_marker=2, channels=4)])
    for by_axes in (False, True):
        trained, out = IL.train(df, 1, markers, arch, by_axes)
        got = IL.to_pixels(out, len(trained[-1].bank)).where("image = 'p'").collect()
        assert len(trained) == 2 and len(got) == 12 * 10 and len(trained[0].bank) <= 6
        if not by_axes:  # the two halves differ in what they activate
            halves = [np.mean([r["feat"] for r in got if (r["x"] < 4) == left], 0) for left in (True, False)]
            assert np.abs(halves[0] - halves[1]).max() > 0.1
        again = IL.extract(df, trained)
        assert np.allclose(back(again.where("image = 'p'")), back(out.where("image = 'p'")))
    wide, out = IL.train(df, 1, markers, Architecture(0.01, arch.layers, atrous=True))
    assert back(out.where("image = 'q'")).shape == (24, 20 * len(wide[-1].bank)) and wide[1].taps[1][0] in (-2, 2)
    grey = IL.activations(out, len(wide[-1].bank), 0).agg(F.min("val"), F.max("val")).first()
    assert tuple(grey) == (0, 255) and IL.batch_size(1000.0, 20, 24, wide) > 1
