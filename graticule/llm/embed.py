"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned to their principal axes, largest variance
first.  Tiles of vectors are compared on the leading axes; the product of what is left is at most the
product of the suffix norms, and pairs that cannot reach the threshold any more are dropped.  Those that
stay are decided on the original double-precision components.

Equal vectors are one class with a weight, so copies are never paired with each other.  Vectors
that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths link with nothing of another length.  An empty table gives an empty
result; other columns are ignored; repeated ids count as separate vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors of one tile: with their partners they must fit a task.
TILE = 8192
#: Rows of a tile that are multiplied at a time.
STEP = 1024


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _axes(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the unit vectors, largest variance first, from distributed second moments."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                x = x / np.sqrt((x * x).sum(1))[:, None]
                m = np.concatenate((x.T @ x, x.sum(0)[None], np.full((1, x.shape[1]), len(x))))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "x": total.ravel()})

    got = reps.select("vec").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    d = round((np.sqrt(4 + 4 * len(got)) - 2) / 2)
    m = got["x"].to_numpy().reshape(d + 2, d)
    n, mean = m[-1, 0], m[-2] / m[-1, 0]
    _, axes = np.linalg.eigh(m[:d] / n - np.outer(mean, mean))
    return axes[:, ::-1], mean


def _compare(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, lead: int, same: bool):
    """Index pairs whose cosine reaches the threshold; px, py are x, y on the principal axes."""
    sx, sy = np.sqrt(np.maximum((px[:, lead:] ** 2).sum(1), 0)), np.sqrt(np.maximum((py[:, lead:] ** 2).sum(1), 0))
    for at in range(0, len(x), STEP):
        first = at if same else 0
        most = px[at : at + STEP, :lead] @ py[first:, :lead].T
        most += sx[at : at + STEP, None] * sy[None, first:]
        i, j = np.nonzero(most >= threshold - 1e-9)
        i, j = i + at, j + first
        if same:
            i, j = i[j > i], j[j > i]
        k = lead
        while len(i) and k < px.shape[1]:  # carry on in steps of axes, with a bound after each
            k = min(px.shape[1], 2 * k)
            rest = np.sqrt((px[:, k:] ** 2).sum(1)), np.sqrt((py[:, k:] ** 2).sum(1))
            keep = np.concatenate([
                np.einsum("ab,ab->a", px[a, :k], py[b, :k]) + rest[0][a] * rest[1][b] >= threshold - 1e-9
                for a, b in zip(np.array_split(i, len(i) // 200_000 + 1), np.array_split(j, len(i) // 200_000 + 1))
            ])
            i, j = i[keep], j[keep]
        if len(i):
            exact = np.concatenate([
                (lambda u, v: (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)))(x[a], y[b]) >= threshold
                for a, b in zip(np.array_split(i, len(i) // 200_000 + 1), np.array_split(j, len(i) // 200_000 + 1))
            ])
            yield i[exact], j[exact]


def near_vectors(table: DataFrame, threshold: float = 0.95, lead: int = 16) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of `table` (vec_id, embedding)."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    # -0.0 and 0.0 are one class
    rows = table.select("vec_id", F.when(sound, F.transform(vec, lambda v: v + F.lit(0.0))).alias("vec"))
    reps = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    reps = common.stored(reps, "vectors")
    dims = [r[0] for r in reps.select(F.size("vec").alias("d")).distinct().collect()]
    parts = [_links(reps.where(F.size("vec") == d), threshold, lead) for d in sorted(dims)]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = common.checkpointed(found)
    comps = common.connected_components(found.where("other is not null"), "rep", "other")
    linked = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(linked, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("vec", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = rows.where("vec is not null").join(named, "vec").select("vec_id", "n_links", "component_id")
    return got.unionByName(rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def _links(reps: DataFrame, threshold: float, lead: int) -> DataFrame:
    """(rep, other, links): counts of linked vectors where other is null, else edges that connect."""
    n = reps.count()
    axes, mean = _axes(reps)
    lead = min(lead, axes.shape[0])
    first = axes[:, 0].tolist()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    along = F.aggregate(F.zip_with("vec", F.array(*map(F.lit, first)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) / norm
    reps = reps.withColumn("at", along)
    tiles = max(1, -(-n // TILE))
    cuts = reps.stat.approxQuantile("at", [k / tiles for k in range(1, tiles)], 0.1 / tiles) if tiles > 1 else []
    bounds = [-1.0 - 1e-9, *cuts, 1.0 + 1e-9]
    reach = np.sqrt(2 - 2 * threshold) + 1e-6 if threshold < 1 else 1e-6
    # Tiles are slices along the first axis; those farther apart than two linked vectors can be never meet, and a vector goes to
    # those slices only that it can reach.  Slices that a tile meets stand side by side, so their first and last say which.
    edges = np.array(bounds)
    low = np.searchsorted(edges[1:], edges[:-1] - reach)
    high = np.searchsorted(edges[:-1], edges[1:] + reach, side="right") - 1
    table = reps.sparkSession.createDataFrame([(k, int(low[k]), int(high[k])) for k in range(tiles)], "tile int, low int, high int")
    sides = reps.sparkSession.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(tiles)], "other int, begin double, end double")
    between = np.array(cuts)

    @F.pandas_udf("int")
    def tile_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(between, at.to_numpy()).astype(np.int32))

    dealt = reps.withColumn("tile", tile_of("at")).join(F.broadcast(table), "tile").withColumn("other", F.explode(F.sequence("low", "high")))
    dealt = dealt.join(F.broadcast(sides), "other").where((F.col("tile") == F.col("other")) | ((F.col("at") >= F.col("begin") - reach) & (F.col("at") <= F.col("end") + reach)))
    dealt = dealt.withColumn("pair", F.least("tile", "other").cast("long") * tiles + F.greatest("tile", "other"))

    def compare(t: pa.Table) -> pa.Table:
        pair = t.column("pair")[0].as_py()
        a, b = divmod(pair, tiles)
        own = t.column("tile").to_numpy()
        ids, w, v = t.column("rep").to_numpy(), t.column("weight").to_numpy(), _matrix(t.column("vec"))
        unit = v / np.sqrt((v * v).sum(1))[:, None]
        p = unit @ axes
        i, j = np.flatnonzero(own == a), np.flatnonzero(own == b)
        count, forest, edges = np.zeros(len(ids), np.int64), common.Forest(len(ids)), []
        if len(i) and len(j):
            for r, c in _compare(v[i], v[j], p[i], p[j], threshold, lead, a == b):
                r, c = i[r], j[c]
                np.add.at(count, r, w[c])
                np.add.at(count, c, w[r])
                edges += [(x, y) for x, y in zip(r.tolist(), c.tolist()) if forest.join(x, y)]
        hit = np.flatnonzero(count)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "rep": np.concatenate((ids[hit], ids[e[:, 0]])),
            "other": pa.array(np.concatenate((ids[hit], ids[e[:, 1]])), mask=np.arange(len(hit) + len(e)) < len(hit)),
            "links": np.concatenate((count[hit], np.zeros(len(e), np.int64))),
        })

    return dealt.select("pair", "tile", "rep", "weight", "vec").groupBy("pair").applyInArrow(compare, "rep long, other long, links long")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(v, v) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) >= 0.95 * a.n * b.n
), r(n, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
k AS (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY n), l AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(l.n_links, 0) AS n_links, k.component_id, k.component_id = e.vec_id AS kept FROM e JOIN k USING (vec_id) LEFT JOIN l USING (vec_id)
"""
