import numpy as np

from graticule.llm import embed


def brute(rows, threshold=0.95):
    """n_links and component of each row."""
    n = len(rows)
    vec = []
    for _, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        vec.append(np.array(v, float) if ok else None)
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            if vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b]):
                c = vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b]))
                link[a][b] = link[b][a] = bool(c >= threshold)
    out = []
    for a in range(n):
        seen, stack = {a}, [a]
        while stack:
            x = stack.pop()
            for y in range(n):
                if link[x][y] and y not in seen:
                    seen.add(y)
                    stack.append(y)
        out.append((rows[a][0], sum(link[a]), min(rows[y][0] for y in seen)))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in embed.near_vectors(df, **kw).select("vec_id", "n_links", "component_id").collect())


def planted(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=d)
        if k % 3 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=d) * 0.09
        rows.append((k, [float(np.float32(x)) for x in v]))
    return rows


def test_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed.op9_embeddings(spark, sf).collect())
    assert got == brute(rows)


def test_planted_neighbours(spark):
    rows = planted(240)
    assert run(spark, rows, lead=4) == brute(rows)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed, "TILE", 30)
    rows = planted(200, seed=5)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]), (7, [1.0, 2.0]), (8, [-1.0, -2.0, -3.0]), (9, [float("inf"), 0.0, 0.0]), (10, [])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(3, None)]) == [(3, 0, 3)]
