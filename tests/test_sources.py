"""Round trips of every file format."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.sources import formats as fm
from graticule.sources import images, models
from graticule.streaming import running


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def test_multiband_image(spark, tmp_path):
    data = np.arange(24, dtype=np.float32).reshape(1, 3, 4, 2)
    path = put(tmp_path, "img.mimg", fm.write_mimg(data))
    rows = fm.scan(spark, path, fm.parse_mimg, fm.MIMG).orderBy("p").collect()
    assert [tuple(r)[:5] for r in rows[:5]] == [("img", k, k % 4, k // 4, 0) for k in range(5)]
    assert [r["feat"] for r in rows] == data.reshape(-1, 2).tolist()
    with pytest.raises(ValueError):
        list(fm.parse_mimg("x", b"other"))


@pytest.mark.parametrize("shape,top", [((3, 4), 200), ((2, 2, 3), 255), ((3, 3), 4000)])
def test_grey_and_colour_images(shape, top):
    data = np.random.default_rng(0).integers(0, top, shape)
    got = [r[4] for r in fm.parse_pnm("x", fm.write_pnm(data))]
    assert got == data.reshape(shape[0] * shape[1], -1).tolist()


def test_plain_image():
    rows = list(fm.parse_pnm("x", b"P2 # grey\n2 1\n# size\n9\n3 7\n"))
    assert rows == [("x", 0, 0, 0, [3]), ("x", 1, 1, 0, [7])]


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "u8", "f4", "f8"])
def test_arrays(kind):
    a = np.arange(6).astype(kind).reshape(2, 3)
    assert [(i, j, v) for _, i, j, v in fm.parse_npy("x", fm.write_npy(a))] == [(i, j, float(a[i, j])) for i in range(2) for j in range(3)]


def test_lists():
    assert [v for *_, v in fm.parse_list("conv1-mean", fm.write_list([1.5, -2]).encode())] == [1.5, -2]
    assert [v for *_, v in fm.parse_list("conv1-bias", fm.write_list([1.5, -2], count=True).encode())] == [1.5, -2]


def test_markers_as_sets(spark):
    a = [(100 + k, 135, 3, 0) for k in range(4)]
    b = [(283 + k, 215, 2, 1) for k in range(4)]
    read = lambda rows: spark.createDataFrame(list(fm.parse_pixel_seeds("m", fm.write_pixel_seeds(rows, 481, 321).encode())), fm.PIXEL_SEEDS)
    first, second, both = read(a), read(b), read(a + b)
    assert sorted(first.union(second).collect()) == sorted(both.collect())
    assert sorted(both.exceptAll(second).collect()) == sorted(first.collect())
    assert list(fm.parse_pixel_seeds("m", b"2 10 10\n3 4 1 0\n30 4 1 0\n")) == [("m", 3, 4, 0, 1, 0, 0)]
    assert list(fm.parse_pixel_seeds("m", b"1 10 10 5\n3 4 2 7 1 9\n")) == [("m", 3, 4, 2, 7, 1, 9)]
    assert list(fm.parse_graph_seeds("g", fm.write_graph_seeds([(5, 1, 0)]).encode())) == [("g", 5, 1, 0)]


def test_graphs():
    nodes = [(0, 4, [0.25, 1.0]), (1, 2, [0.5, 2.0]), (2, 1, [1 / 3, 0.0])]
    text = fm.write_graph(nodes, [(0, 1), (2, 1)]).encode()
    assert [(n, p, f) for _, n, p, f in fm.parse_graph_nodes("g", text)] == [(0, 4, [0.25, 1.0]), (1, 2, [0.5, 2.0]), (2, 1, [0.333333, 0.0])]
    assert [(a, b) for _, a, b in fm.parse_graph_edges("g", text)] == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_architectures():
    arch = fm.Architecture(0.05, [fm.Layer((3, 3, 0), (1, 1, 0), 100, 5, 64, True, "max_pool", (3, 3, 0), 2), fm.Layer(relu=False)])
    assert fm.read_architecture(fm.write_architecture(arch)) == arch
    bare = {"nlayers": 1, "layer1": {"conv": {"kernel_size": [3, 3, 0], "dilation_rate": [1, 1, 0], "nkernels_per_image": 9, "nkernels_per_marker": 2, "noutput_channels": 4}}}
    assert fm.read_architecture(json.dumps(bare)).layers[0].pool == "no_pool"


def test_tables_of_text(spark, tmp_path):
    with_head = fm.read_csv(spark, put(tmp_path, "a.csv", "f0,f1,label,id\n1.5,2,3,10\n2.5,3,1,11\n"))
    assert with_head.columns == ["f0", "f1", "label", "id"]
    assert fm.read_csv(spark, put(tmp_path, "b.csv", "1;2\n3;4\n"), ";").count() == 2
    sm = fm.samples_from_csv(with_head, 2)
    assert sorted((r["id"], r["feat"], r["truelabel"]) for r in sm.collect()) == [(10, [1.5, 2.0], 3), (11, [2.5, 3.0], 1)]
    fm.write_csv(fm.samples_to_csv(sm, 2), str(tmp_path / "out"), ";")
    assert fm.samples_from_csv(fm.read_csv(spark, str(tmp_path / "out"), ";"), 2).count() == 2
    with pytest.raises(ValueError):
        fm.write_csv(sm, str(tmp_path / "x"), "|")


def test_file_sets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("000002_00000007_x.pgm", "000001_00000003.pgm", "notes.txt"):
        put(tmp_path, name, b"1")
    put(tmp_path / "sub", "000005_1.pgm", b"1")
    got = fm.file_set(spark, str(tmp_path), ".pgm").collect()
    assert [(r["name"], r["label"], r["sample"], r["suffix"]) for r in got] == [("000001_00000003.pgm", 1, "00000003", None), ("000002_00000007_x.pgm", 2, "00000007", "x")]
    assert fm.file_set(spark, str(tmp_path), ".pgm", depth=-1).count() == 3
    assert fm.file_set(spark, str(tmp_path), regex="^notes").count() == 1
    assert fm.manifest(spark, put(tmp_path, "list.csv", "a.pgm\n\nb.pgm\n")).count() == 2


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1, 2, 0), ("g1", 3, 2, 1), ("g2", 5, 1, 1)], fm.GRAPH_SEEDS)
    fm.sink(df, "graph_id", lambda p: fm.write_graph_seeds(list(p[["node", "marker", "label"]].itertuples(index=False, name=None))), str(tmp_path / "s"))
    back = fm.scan(spark, str(tmp_path / "s/name=g1"), fm.parse_graph_seeds, fm.GRAPH_SEEDS)
    assert sorted((r["node"], r["label"]) for r in back.collect()) == [(1, 0), (3, 1)]


def test_stream_of_moments(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "value")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = running.stream_moments(stream).writeStream.outputMode("update").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    got = {r[0]: (r[1], r[2], r[3]) for r in spark.sql("SELECT user_id, max_by(n, n), max_by(mean, n), max_by(var, n) FROM moments GROUP BY user_id").collect()}
    for r in events.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect():
        assert got[r["user_id"]] == (r["n"], pytest.approx(r["m"]), pytest.approx(r["v"], abs=1e-6))


def test_means_one_more_and_one_less(spark):
    r = spark.range(1).select(running.added(F.lit(2.0), F.lit(3), F.lit(6.0)).alias("a"), running.removed(F.lit(3.0), F.lit(4), F.lit(6.0)).alias("b")).first()
    assert tuple(r) == (3.0, 2.0)


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:00:50", 3.0), ("a", "2024-01-01 00:05:00", 5.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    src = str(tmp_path / "in")
    rows.write.parquet(src)
    q = running.windowed(spark.readStream.schema(rows.schema).parquet(src), "t", "1 minute", "10 seconds", "k", "v").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["mean"]) for r in spark.sql("SELECT * FROM windows").collect()] == [(2, 2.0)]
    assert running.between(rows, "t", "2024-01-01 00:00:50", "2024-01-01 00:05:00").count() == 1


# --- PNG, volumes, containers


@pytest.mark.parametrize("shape,top", [((5, 7), 255), ((4, 6, 3), 255), ((3, 3), 60000), ((2, 5, 4), 255), ((3, 2, 2), 255)])
def test_png(shape, top):
    data = np.random.default_rng(1).integers(0, top + 1, shape)
    raw = images.write_png(data)
    assert (images.decode_png(raw) == data.reshape(*shape[:2], -1)).all()
    with pytest.raises(ValueError):
        images.decode_png(raw[:40] + b"\0" + raw[41:])


def test_png_filters_and_palette():
    """Each scanline with another filter, and two-bit numbers of a palette."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    flat, lines, up = data.reshape(5, -1).astype(int), [], np.zeros(12, int)
    for y, row in enumerate(flat):
        left, corner = np.concatenate(([0, 0, 0], row[:-3])), np.concatenate(([0, 0, 0], up[:-3]))
        near = [min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2] for a, b, c in zip(left.tolist(), up.tolist(), corner.tolist())]
        guess = [0 * row, left, up, (left + up) // 2, np.array(near)][y]
        lines.append(bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        up = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (images.decode_png(raw) == data).all()
    raw = images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 1, 2, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"IDAT", zlib.compress(bytes([0, 0b00011011, 0b01000000]))) + chunk(b"IEND", b"")
    assert images.decode_png(raw)[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [3, 4, 5]]


def test_images_by_extension(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 200, (4, 5))
    put(tmp_path, "a.png", images.write_png(data))
    put(tmp_path, "b.pgm.gz", images.zipped(fm.write_pnm(data)))
    for name in ("a.png", "b.pgm.gz"):
        rows = images.read_images(spark, str(tmp_path / name)).orderBy("p").collect()
        assert [r["feat"][0] for r in rows] == data.ravel().tolist() and rows[6]["x"] == 1 and rows[6]["y"] == 1
    with pytest.raises(ValueError):
        images.read_images(spark, "x.tiff")


@pytest.mark.parametrize("kind", ["nii", "nii.gz", "vtk"])
def test_volumes(spark, tmp_path, kind):
    data = np.random.default_rng(4).integers(-50, 900, (2, 3, 4))
    raw = images.write_vtk(data) if kind == "vtk" else images.write_nifti(data, (0.5, 1.0, 2.0))
    path = put(tmp_path, f"v.{kind}", images.zipped(raw) if kind.endswith("gz") else raw)
    rows = images.read_images(spark, path).orderBy("p").collect()
    assert [r["val"] for r in rows] == data.ravel().tolist()
    assert (rows[17]["x"], rows[17]["y"], rows[17]["z"]) == (1, 1, 1)
    if kind == "nii":
        got, voxel = images.decode_nifti(images.write_nifti(data / 4.0))
        assert np.allclose(got, data / 4.0) and voxel == (1.0, 1.0, 1.0)


def test_frames_and_sequences(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"f{k}.png", images.write_png(np.full((2, 2), 10 * k)))
    volume = images.frames_as_volume(images.read_images(spark, str(tmp_path / "*.png")))
    assert {(r["z"], r["val"]) for r in volume.collect()} == {(0, 0), (1, 10), (2, 20)}
    times = volume.withColumn("t", F.lit(0)).select("t", "x", "y", "z", "val")
    longer = images.sequence(times, 1, volume.withColumn("val", F.col("val") + 1))
    assert {r["val"] for r in images.moment_slice(longer, 1, 2).collect()} == {21} and longer.count() == 24
    assert images.sequence(longer, 1, volume).where("val = 21").count() == 0


def test_animation():
    frames = np.random.default_rng(5).integers(0, 128, (3, 11, 17))
    assert images.gif_frames(images.write_gif(frames)) == frames.reshape(3, -1).tolist()


def test_containers(spark, tmp_path):
    sm = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [4.0, 5.0], 1)], "id long, feat array<double>, truelabel int")
    models.save_samples(str(tmp_path / "s"), sm, classes=3)
    assert sorted(models.load_samples(spark, str(tmp_path / "s")).collect()) == sorted(sm.collect())
    arcs = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")
    models.save_graph(str(tmp_path / "g"), sm, arcs, k=5, best=2)
    nodes, got, params = models.load_graph(spark, str(tmp_path / "g"))
    assert params == {"k": 5, "best": 2} and got.collect() == arcs.collect() and nodes.count() == 2
    models.save_model(spark, str(tmp_path / "m"), mean=np.array([1.5, 2.0]), axes=np.eye(2), kind="pca", n=np.int64(4))
    m = models.load_model(spark, str(tmp_path / "m"))
    assert m["kind"] == "pca" and m["n"] == 4 and (m["axes"] == np.eye(2)).all() and m["mean"].tolist() == [1.5, 2.0]
    d = {(r["i"], r["j"]): r["d"] for r in models.distances(sm).collect()}
    assert d[1, 1] == 0 and abs(d[1, 2] - 18**0.5) < 1e-12 and len(d) == 4


def test_files_of_numbers(spark, tmp_path):
    a = np.array([[1.5, -2.0, 3.25], [0.0, 4.0, 5.5]])
    cells = [("m", i, j, a[i, j]) for i in range(2) for j in range(3)]
    assert list(models.parse_matrix_csv("m", models.write_matrix_csv(a).encode())) == cells
    path = put(tmp_path, "m.raw", models.write_raw_matrix(a))
    assert sorted(tuple(r) for r in fm.scan(spark, path, models.parse_raw_matrix, models.CELLS).collect()) == cells
    axes = list(models.parse_axes("p", models.write_axes(a[0], a.T)))
    assert axes[:3] == [("p", -1, j, a[0, j]) for j in range(3)] and [x[3] for x in axes[3:]] == a.T.ravel().tolist()
    taps = [(0, 0), (1, -1), (2, 3)]
    assert [x[2:] for x in models.parse_stencil("k", models.write_stencil(taps, [1.0, 0.5, 2.0]).encode())] == [(0, 0, 0, 1.0), (1, -1, 0, 0.5), (2, 3, 0, 2.0)]
    assert [x[2:] for x in models.parse_stencil("k", models.write_stencil(taps).encode())][1] == (1, -1, 0, 1.0)
    values, shape = models.write_tensor(np.arange(6).reshape(1, 2, 3))
    assert shape == "1,2,3" and [x[2] for x in models.parse_array("t", values.encode())] == [0, 1, 2, 3, 4, 5]
    put(tmp_path, "t.txt", values)
    t = models.tensor_of(fm.scan(spark, str(tmp_path / "t.txt"), models.parse_array, models.ARRAY), (1, 2, 3))
    assert {tuple(r["index"]): r["v"] for r in t.collect()}[(0, 1, 2)] == 5
    pts = spark.createDataFrame([("1 2 3",), (" 4.5  6 1 ",), ("",)], "value string")
    assert sorted((r["feat"], r["truelabel"]) for r in models.points(pts).collect()) == [([1.0, 2.0], 3), ([4.5, 6.0], 1)]
    assert json.loads(models.write_pretty({"a": [1, {"b": 2}]})) == {"a": [1, {"b": 2}]}
