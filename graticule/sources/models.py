"""Samples, graphs, fitted models, stencils and arrays on disk.

What is as large as the data is Parquet in a folder, what is small is JSON beside it or a file of numbers; both are written and read by
Spark, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- containers: tables by name, and parameters


def save(path: str, tables: dict[str, DataFrame], params: dict | None = None) -> None:
    """Each table as Parquet below `path`, and the parameters as one line of JSON."""
    path = path.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    doc = json.dumps({"tables": sorted(tables), "params": params or {}}, sort_keys=True)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    path = path.rstrip("/")
    doc = json.loads(spark.read.text(f"{path}/info").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in doc["tables"]}, doc["params"]


def save_samples(path: str, sm: DataFrame, **params) -> None:
    save(path, {"samples": sm}, params)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path)[0]["samples"]


def save_graph(path: str, nodes: DataFrame, arcs: DataFrame, **params) -> None:
    """A neighbour graph, or the prototypes and arcs of a trained classifier."""
    save(path, {"nodes": nodes, "arcs": arcs}, params)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    tables, params = load(spark, path)
    return tables["nodes"], tables["arcs"], params


# --- small models as one line of JSON


def _plain(v):
    return v.tolist() if isinstance(v, np.ndarray) else [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v.item() if isinstance(v, np.generic) else v


def save_model(spark: SparkSession, path: str, **parts) -> None:
    """Arrays and numbers of a fitted model: normalisers, axes, weights, support vectors, kernels, stencils."""
    spark.createDataFrame([(json.dumps({k: _plain(v) for k, v in parts.items()}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """The parts, lists of numbers as arrays."""
    doc = json.loads(spark.read.text(path).first()[0])
    return {k: np.array(v) if isinstance(v, list) else v for k, v in doc.items()}


# --- files of numbers: parsers for `formats.scan`, and writers

CELLS = "name string, i int, j int, v double"


def parse_matrix_csv(name: str, raw: bytes) -> Iterator[tuple]:
    """A matrix of comma-separated rows, as cells."""
    for i, line in enumerate(raw.decode().split()):
        for j, v in enumerate(line.split(",")):
            yield name, i, j, float(v)


def write_matrix_csv(a: np.ndarray) -> str:
    return "".join(",".join(f"{v:f}" for v in row) + "\n" for row in a)


def parse_raw_matrix(name: str, raw: bytes) -> Iterator[tuple]:
    """Columns and rows as 32-bit integers, then 32-bit floats row by row."""
    columns, rows = struct.unpack("<ii", raw[:8])
    for k, v in enumerate(np.frombuffer(raw, "<f4", columns * rows, 8).tolist()):
        yield name, k // columns, k % columns, v


def write_raw_matrix(a: np.ndarray) -> bytes:
    return struct.pack("<ii", a.shape[1], a.shape[0]) + a.astype("<f4").tobytes()


def parse_axes(name: str, raw: bytes) -> Iterator[tuple]:
    """Principal axes: features, components, means, then the matrix; cells, the means as row -1."""
    feats, _ = struct.unpack("<ii", raw[:8])
    for j, v in enumerate(np.frombuffer(raw, "<f4", feats, 8).tolist()):
        yield name, -1, j, v
    at = 8 + 4 * feats
    columns, rows = struct.unpack("<ii", raw[at : at + 8])
    for k, v in enumerate(np.frombuffer(raw, "<f8", columns * rows, at + 8).tolist()):
        yield name, k // columns, k % columns, v


def write_axes(mean: np.ndarray, axes: np.ndarray) -> bytes:
    return struct.pack("<ii", len(mean), axes.shape[1]) + mean.astype("<f4").tobytes() + struct.pack("<ii", axes.shape[1], axes.shape[0]) + axes.astype("<f8").tobytes()


STENCIL = "name string, k int, dx int, dy int, dz int, w double"


def parse_stencil(name: str, raw: bytes) -> Iterator[tuple]:
    """How many offsets, then dx, dy, dz of each, and a weight where there is a fourth number."""
    lines = raw.decode().split("\n")
    for k, line in enumerate(x.split() for x in lines[1 : 1 + int(lines[0])]):
        yield name, k, int(line[0]), int(line[1]), int(line[2]), float(line[3]) if len(line) > 3 else 1.0


def write_stencil(taps: list[tuple[int, ...]], weights: list[float] | None = None) -> str:
    rows = [" ".join(map(str, (*t, *([0] * (3 - len(t)))))) + (f" {weights[k]:f}" if weights else "") for k, t in enumerate(taps)]
    return "\n".join([str(len(taps)), *rows]) + "\n"


def parse_array(name: str, raw: bytes) -> Iterator[tuple]:
    """Numbers separated by white space, commas or semicolons, one row each; `formats` schema of lists."""
    for k, v in enumerate(raw.replace(b",", b" ").replace(b";", b" ").split()):
        yield name, k, float(v)


ARRAY = "name string, i int, v double"


def write_array(values, sep: str = ",") -> str:
    return sep.join(f"{v:g}" if isinstance(v, float) else str(v) for v in values)


def write_tensor(a: np.ndarray, sep: str = ",") -> tuple[str, str]:
    """A tensor's values in one line, and its shape in another."""
    return write_array(a.ravel().tolist(), sep), write_array(list(a.shape), sep)


def tensor_of(values: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(t, index, v) of rows (name, i, v) of a tensor's values."""
    from ..operators.matrices import tensor

    return tensor(values.select(F.col("name").alias("t"), F.col("i").alias("k"), "v"), shape)


def distances(sm: DataFrame) -> DataFrame:
    """(i, j, d): a distance table of samples that fit one array of vectors; meant for prototypes and centres."""
    from ..functions import vectors as V

    rows = sm.agg(F.collect_list(F.struct("id", "feat")).alias("all"))
    pairs = sm.select(F.col("id").alias("i"), "feat").join(F.broadcast(rows)).select("i", "feat", F.explode("all").alias("o"))
    return pairs.select("i", F.col("o.id").alias("j"), V.euclidean(F.col("feat"), F.col("o.feat")).alias("d"))


def write_pretty(doc: dict) -> str:
    """A document as JSON over several lines."""
    return json.dumps(doc, indent=4)


def points(table: DataFrame) -> DataFrame:
    """(id, feat, truelabel) of lines `x y label` (value)."""
    cells = F.split(F.trim("value"), r"\s+")
    ok = table.where(F.size(cells) >= 3)
    return ok.select(F.monotonically_increasing_id().alias("id"), F.array(cells[0].cast("double"), cells[1].cast("double")).alias("feat"), cells[2].cast("int").alias("truelabel"))
