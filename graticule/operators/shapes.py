"""Shapes in label images and masks: borders, distances, optimum paths, cuts, skeletons, attribute filters, region clean-up, priors.

What looks at neighbours alone runs on bands with a halo; counts and selections are aggregations; searches along paths take an image
to a task, as in `pictures`.  Missing pixels are NaN and stay so.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pictures import RING4, RING8, _reconstruct, _squared_distances, area_opening, per_image
from .raster import Taps, dilate, erode, stacked, stencil

# --- borders: bands


def object_borders(lines: DataFrame, ring: Taps = tuple(RING4)) -> DataFrame:
    """The label of pixels of objects that have a neighbour with another label, or none; else 0."""

    def fn(s: np.ndarray) -> np.ndarray:
        other = np.isnan(s[1:]) | (s[1:] != s[0])
        return np.where((s[0] != 0) & other.any(0), s[0], 0.0)

    return stencil(lines, [(0, 0), *ring], fn)


def on_rim(px: DataFrame) -> DataFrame:
    """Pixels (image, x, y, ...) in the first or last row or column of their image."""
    ends = px.groupBy("image").agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))])
    own = px.join(ends, "image")
    return own.where((F.col("x") == F.col("_ax")) | (F.col("y") == F.col("_ay")) | (F.col("x") == F.col("_bx")) | (F.col("y") == F.col("_by"))).select(px.columns)


def border_set(lines: DataFrame) -> DataFrame:
    """(image, x, y, val) of the pixels on an image's rim."""
    return on_rim(lines.select("image", "y", F.posexplode("line").alias("x", "val"))).select("image", "x", "y", "val")


def object_border_set(lines: DataFrame) -> DataFrame:
    """(image, x, y, val) of the pixels on objects' borders."""
    return object_borders(lines).select("image", "y", F.posexplode("line").alias("x", "val")).where((F.col("val") != 0) & ~F.isnan("val")).select("image", "x", "y", "val")


def inside_set(px: DataFrame, borders: DataFrame) -> DataFrame:
    """Pixels of objects (image, x, y, val) that are on no border."""
    return px.where("val <> 0").join(borders.select("image", "x", "y"), ["image", "x", "y"], "left_anti")


# --- region clean-up: aggregations over pixels (image, x, y, val)


def relabelled(px: DataFrame) -> DataFrame:
    """Labels from 1 without gaps, in their order; 0 stays."""
    from pyspark.sql import Window as W

    names = px.where("val <> 0").select("image", "val").distinct().withColumn("_n", F.row_number().over(W.partitionBy("image").orderBy("val")))
    got = px.join(names, ["image", "val"], "left")
    return got.select("image", "x", "y", F.coalesce("_n", F.lit(0)).alias("val"))


def without_small(px: DataFrame, area: int) -> DataFrame:
    """Labels of fewer than `area` pixels become 0."""
    large = px.where("val <> 0").groupBy("image", "val").agg(F.count("*").alias("_n")).where(F.col("_n") >= area).select("image", "val", F.lit(1).alias("_on"))
    got = px.join(large, ["image", "val"], "left")
    return got.select("image", "x", "y", F.when(F.col("_on") == 1, F.col("val")).otherwise(0).alias("val"))


def without_border_regions(px: DataFrame) -> DataFrame:
    """Labels that touch the image's rim become 0."""
    rim = on_rim(px).where("val <> 0").select("image", "val").distinct()
    got = px.join(rim.withColumn("_on", F.lit(1)), ["image", "val"], "left")
    return got.select("image", "x", "y", F.when(F.col("_on").isNull(), F.col("val")).otherwise(0).alias("val"))


def absorbed(px: DataFrame, area: int) -> DataFrame:
    """Regions of fewer than `area` pixels take the label of the large region with which they share most sides, the lowest one among equals."""
    sizes = px.groupBy("image", "val").agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") < area).select("image", "val")
    other = px.join(small, ["image", "val"], "left_anti")
    sides = px.join(small, ["image", "val"], "left_semi").withColumn("_s", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in RING4])))
    beside = sides.select("image", "val", F.col("_s.x").alias("x"), F.col("_s.y").alias("y")).join(other.select("image", "x", "y", F.col("val").alias("_o")), ["image", "x", "y"])
    best = beside.groupBy("image", "val", "_o").agg(F.count("*").alias("_k")).groupBy("image", "val").agg(F.max_by("_o", F.struct(F.col("_k"), -F.col("_o"))).alias("_to"))
    return px.join(best, ["image", "val"], "left").select("image", "x", "y", F.coalesce("_to", "val").alias("val"))


def spaced_seeds(px: DataFrame, spacing: int, mixed: bool = False) -> DataFrame:
    """Pixels of a mask on a grid; with `mixed` every second row is shifted by half a step."""
    half = spacing // 2
    shift = F.when(F.floor(F.col("y") / spacing) % 2 == 1, half).otherwise(0) if mixed else F.lit(0)
    return px.where((F.col("val") != 0) & (F.col("y") % spacing == half) & ((F.col("x") + shift) % spacing == half))


def drawn_from_mask(px: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n pixels of a mask, drawn by seed and place."""
    from ..functions.maths import uniform

    key = F.concat_ws(",", "image", F.col("x").cast("string"), F.col("y").cast("string"))
    return px.where("val <> 0").withColumn("_u", uniform(key, seed)).orderBy("_u", "image", "x", "y").limit(n).drop("_u")


# --- filters by reconstruction and by attributes


def open_by_reconstruction(lines: DataFrame, taps: Taps) -> DataFrame:
    """The erosion rebuilt under the image."""
    return _rebuilt(erode(lines, taps), lines, lambda marker, mask: _reconstruct(marker, mask))


def close_by_reconstruction(lines: DataFrame, taps: Taps) -> DataFrame:
    """The dilation rebuilt above the image."""
    return _rebuilt(dilate(lines, taps), lines, lambda marker, mask: -_reconstruct(-marker, -mask))


def _rebuilt(marker: DataFrame, mask: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    both = marker.select("image", "y", F.col("line").alias("_m")).join(mask.select("image", "y", "line"), ["image", "y"])
    joined = both.select("image", "y", F.concat("_m", "line").alias("line"))

    def run(a: np.ndarray) -> np.ndarray:
        w = a.shape[1] // 2
        return fn(a[:, :w], a[:, w:])

    return per_image(joined, run)


def open_domes(lines: DataFrame, taps: Taps) -> DataFrame:
    """What the opening by reconstruction takes away."""
    return lines.select("image", "y", F.col("line").alias("_own")).join(open_by_reconstruction(lines, taps), ["image", "y"]).select("image", "y", F.zip_with("_own", "line", lambda a, b: a - b).alias("line"))


def area_closing(lines: DataFrame, area: int) -> DataFrame:
    """Dark parts of fewer than `area` pixels rise to the level at which they have as many."""
    turned = lines.withColumn("line", F.transform("line", lambda v: -v))
    return area_opening(turned, area).withColumn("line", F.transform("line", lambda v: -v))


def _tree(a: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(pixels from the brightest down, parent of each, flat values): parents are the last pixel of a part at its next lower level."""
    h, w = a.shape
    flat = a.ravel()
    order = [int(k) for k in np.argsort(-flat, kind="stable") if flat[k] == flat[k]]
    up, parent, seen = list(range(h * w)), list(range(h * w)), [False] * (h * w)

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k in order:
        seen[k] = True
        for dx, dy in RING4:
            y, x = k // w + dy, k % w + dx
            if 0 <= y < h and 0 <= x < w and seen[y * w + x]:
                r = find(y * w + x)
                if r != k:
                    up[r] = parent[r] = k
    return order, parent, flat


def max_tree(lines: DataFrame, darkest: bool = False) -> DataFrame:
    """(image, y, line): for each pixel the number of the pixel above it in the tree of bright (or dark) parts; the root is its own."""

    def run(a: np.ndarray) -> np.ndarray:
        _, parent, _ = _tree(-a if darkest else a)
        return np.array(parent, float).reshape(a.shape)

    return per_image(lines, run)


def volume_opening(lines: DataFrame, volume: float) -> DataFrame:
    """Bright parts whose sum of heights above their level's base is below `volume` sink to the next level at which it is not."""

    def run(a: np.ndarray) -> np.ndarray:
        order, parent, flat = _tree(a)
        n, total, level = np.zeros(a.size), np.zeros(a.size), flat.copy()
        for k in order:  # children before parents
            n[k] += 1
            total[k] += flat[k]
            if parent[k] != k:
                n[parent[k]] += n[k]
                total[parent[k]] += total[k]
        for k in reversed(order):
            p = parent[k]
            base = flat[p] if p != k else flat[k]
            sinks = p != k and total[k] - n[k] * base < volume
            level[k] = level[p] if p != k and (flat[p] == flat[k] or sinks) else flat[k]
        return level.reshape(a.shape)

    return per_image(lines, run)


def volume_closing(lines: DataFrame, volume: float) -> DataFrame:
    turned = lines.withColumn("line", F.transform("line", lambda v: -v))
    return volume_opening(turned, volume).withColumn("line", F.transform("line", lambda v: -v))


# --- distances


def signed_distance(lines: DataFrame) -> DataFrame:
    """The distance to the nearest pixel of the other kind: positive inside the object, negative outside."""

    def run(a: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(a), np.nan, np.sqrt(_squared_distances(a)) - np.sqrt(_squared_distances((a == 0).astype(float))))

    return per_image(lines, run)


def border_distance(lines: DataFrame) -> DataFrame:
    """The squared distance of object pixels to the nearest border pixel of their own label; 0 outside."""
    return per_image(lines, lambda a: np.where(a != 0, _by_label(a, lambda m: _squared_distances((~_rim(m)).astype(float))), 0.0))


def _rim(m: np.ndarray) -> np.ndarray:
    s = stacked(m.astype(float), RING4)
    return m & (np.isnan(s) | (s == 0)).any(0)


def _by_label(a: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.zeros_like(a)
    for v in np.unique(a[~np.isnan(a) & (a != 0)]):
        m = a == v
        out[m] = fn(m)[m]
    return out


def set_distance(lines: DataFrame, to: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The squared distance of each pixel to the nearest one of a set, given as a mask of the image."""
    return per_image(lines, lambda a: _squared_distances((~to(a)).astype(float)))


def nearest_in_set(lines: DataFrame, to: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The number (y * width + x) of the nearest pixel of a set, the lowest one among equals."""

    def run(a: np.ndarray) -> np.ndarray:
        ys, xs = np.nonzero(to(a))
        if not len(ys):
            return np.full(a.shape, np.nan)
        out = np.zeros(a.shape)
        for y in range(a.shape[0]):
            d = (np.arange(a.shape[1])[:, None] - xs[None]) ** 2 + (y - ys[None]) ** 2
            k = d.argmin(1)
            out[y] = ys[k] * a.shape[1] + xs[k]
        return out

    return per_image(lines, run)


def _paths(a: np.ndarray, seeds, cost, ring=RING8) -> tuple[np.ndarray, np.ndarray]:
    """(cost, root) of the cheapest path from seeds (y, x, start); cost(old, here, there, step) of a step may be infinite."""
    h, w = a.shape
    best, root, heap = np.full((h, w), np.inf), np.full((h, w), -1), []
    for y, x, c in seeds:
        if c < best[y, x]:
            best[y, x], root[y, x] = c, y * w + x
            heapq.heappush(heap, (c, y * w + x, y, x))
    while heap:
        c, _, y, x = heapq.heappop(heap)
        if c > best[y, x]:
            continue
        for dx, dy in ring:
            p, q = y + dy, x + dx
            if 0 <= p < h and 0 <= q < w and a[p, q] == a[p, q]:
                new = cost(c, a[y, x], a[p, q], float(np.hypot(dx, dy)))
                if new < best[p, q]:
                    best[p, q], root[p, q] = new, root[y, x]
                    heapq.heappush(heap, (new, int(root[y, x]), p, q))
    return best, root


def geodesic_distance(lines: DataFrame, seeds: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The length of the shortest path of eight neighbours inside the object from its seeds; infinity where none leads, NaN outside."""

    def run(a: np.ndarray) -> np.ndarray:
        inside = np.where(a != 0, 1.0, np.nan)
        s = [(int(y), int(x), 0.0) for y, x in zip(*np.nonzero(seeds(a) & (a != 0)))]
        return np.where(a != 0, _paths(inside, s, lambda c, _, __, step: c + step)[0], np.nan)

    return per_image(lines, run)


def geodesic_centre(lines: DataFrame) -> DataFrame:
    """1 at the object pixel from which the farthest one along paths is nearest, first in raster order; else 0."""

    def run(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for v in np.unique(a[~np.isnan(a) & (a != 0)]):
            inside, best = np.where(a == v, 1.0, np.nan), (np.inf, 0, 0)
            for y, x in zip(*np.nonzero(a == v)):
                far = _paths(inside, [(int(y), int(x), 0.0)], lambda c, _, __, step: c + step)[0][a == v].max()
                best = min(best, (float(far), int(y), int(x)))
            out[best[1], best[2]] = v
        return out

    return per_image(lines, run)


def medial_axis(lines: DataFrame) -> DataFrame:
    """Of object pixels the squared distance to the background where no neighbour's disk covers theirs, else 0."""

    def run(a: np.ndarray) -> np.ndarray:
        square = _squared_distances(a)
        d = np.sqrt(square)
        s = stacked(d, RING8)
        far = np.array([np.hypot(*t) for t in RING8])[:, None, None]
        covered = (np.nan_to_num(s, nan=-1.0) >= d + far - 1e-9).any(0)
        return np.where((a != 0) & ~covered, square, 0.0)

    return per_image(lines, run)


def shape_of_axis(lines: DataFrame) -> DataFrame:
    """1 on all pixels nearer to a pixel of a medial axis (squared distances) than that says, else 0."""
    return per_image(lines, lambda a: (_reached(_reached(np.where(a > 0, -a, np.inf)).T).T < 0).astype(float))


def _reached(left: np.ndarray) -> np.ndarray:
    """Of each pixel the least squared distance to one of its column, plus what `left` has there, as far as that is below 0."""
    out, (y, x) = left.copy(), np.nonzero(left < 0)
    for d in range(1, len(left)):
        on = left[y, x] < -d * d  # these alone reach so far
        y, x = y[on], x[on]
        if not len(y):
            break
        for p in (y + d, y - d):
            on = (p >= 0) & (p < len(left))
            out[p[on], x[on]] = np.minimum(out[p[on], x[on]], left[y[on], x[on]] + d * d)
    return out


# --- optimum paths and cuts


def flooded(lines: DataFrame, seeds: Callable[[np.ndarray], np.ndarray], arcs: str = "difference") -> DataFrame:
    """Labels of a seeded watershed over four neighbours: seeds(image) gives labels from 1, 0 elsewhere.

    A path costs its largest arc: the difference of two pixels, the value that it climbs to (`height`), or what it climbs by (`rise`).
    """
    costs = {"difference": lambda c, u, v, _: max(c, abs(u - v)), "height": lambda c, u, v, _: max(c, v), "rise": lambda c, u, v, _: max(c, v - u)}

    def run(a: np.ndarray) -> np.ndarray:
        label = seeds(a)
        s = [(int(y), int(x), float(a[y, x]) if arcs == "height" else 0.0) for y, x in zip(*np.nonzero(label))]
        _, root = _paths(a, s, costs[arcs], RING4)
        return np.where(root >= 0, label.ravel()[np.maximum(root, 0)], np.nan)

    return per_image(lines, run)


def water_gray(lines: DataFrame, rise: float) -> DataFrame:
    """The watershed from all basins deeper than `rise`: labels from 1 in the order of their lowest pixels."""

    def run(a: np.ndarray) -> np.ndarray:
        from .pictures import _plateaus

        filled = -_reconstruct(-a - rise, -a)
        flat = _plateaus(filled, RING4)
        low = (stacked(filled, RING4) < filled).any(0)
        basins = [v for v in np.unique(flat[~low & (flat >= 0)]) if not low[flat == v].any()]
        label = np.zeros(a.shape, int)
        for n, v in enumerate(basins, 1):
            label[flat == v] = n
        s = [(int(y), int(x), float(filled[y, x])) for y, x in zip(*np.nonzero(label))]
        _, root = _paths(filled, s, lambda c, u, v, _: max(c, v), RING4)
        return np.where(root >= 0, label.ravel()[np.maximum(root, 0)], np.nan)

    return per_image(lines, run)


def dynamic_trees(lines: DataFrame, seeds: Callable[[np.ndarray], np.ndarray], by_object: bool = True) -> DataFrame:
    """Labels from 1 of seeds whose trees compete with the mean of what an object (or a root's tree) has taken so far."""

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        label = seeds(a).astype(int)
        best, name, heap, total, count = np.full((h, w), np.inf), np.zeros((h, w), int), [], {}, {}
        for y, x in zip(*np.nonzero(label)):
            best[y, x], name[y, x] = 0.0, label[y, x] if by_object else y * w + x + 1
            heapq.heappush(heap, (0.0, len(heap), int(y), int(x)))
        turn, done = len(heap), np.zeros((h, w), bool)
        while heap:
            c, _, y, x = heapq.heappop(heap)
            if done[y, x] or c > best[y, x]:
                continue
            done[y, x] = True
            k = name[y, x]
            total[k], count[k] = total.get(k, 0.0) + a[y, x], count.get(k, 0) + 1
            for dx, dy in RING4:
                p, q = y + dy, x + dx
                if 0 <= p < h and 0 <= q < w and not done[p, q] and a[p, q] == a[p, q]:
                    new = max(c, abs(a[p, q] - total[k] / count[k]))
                    if new < best[p, q]:
                        best[p, q], name[p, q], label[p, q], turn = new, k, label[y, x], turn + 1
                        heapq.heappush(heap, (new, turn, p, q))
        return np.where(label > 0, label, np.nan)

    return per_image(lines, run)


def cut(lines: DataFrame, inside: Callable[[np.ndarray], np.ndarray], outside: Callable[[np.ndarray], np.ndarray], sharp: float = 1.0) -> DataFrame:
    """1 on the source's side of the least cut between two sets of pixels, else 0; an arc is the weaker the more two pixels differ."""

    def run(a: np.ndarray) -> np.ndarray:
        return _least_cut(a, inside(a), outside(a), sharp).astype(float)

    return per_image(lines, run)


def _least_cut(a: np.ndarray, inside: np.ndarray, outside: np.ndarray, sharp: float) -> np.ndarray:
    """Maximum flow by shortest augmenting levels over four neighbours."""
    h, w = a.shape
    n, top = h * w, float(np.nanmax(a) - np.nanmin(a)) or 1.0
    flow_to: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for y in range(h):
        for x in range(w):
            for dx, dy in ((1, 0), (0, 1)):
                if y + dy < h and x + dx < w:
                    c = float((1 - abs(a[y, x] - a[y + dy, x + dx]) / top) ** sharp)
                    u, v = y * w + x, (y + dy) * w + x + dx
                    flow_to[u][v] = flow_to[v][u] = c
            k = y * w + x
            if inside[y, x]:
                flow_to[n][k] = 1e9
                flow_to[k][n] = 0.0
            if outside[y, x]:
                flow_to[k][n + 1] = 1e9
                flow_to[n + 1][k] = 0.0
    while True:
        level, queue = {n: 0}, deque([n])
        while queue:
            u = queue.popleft()
            for v, c in flow_to[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if n + 1 not in level:
            out = np.zeros(n, bool)
            out[[k for k in level if k < n]] = True
            return out.reshape(h, w)
        arcs = {u: iter(list(flow_to[u])) for u in level}
        path = [n]
        while path:
            u = path[-1]
            if u == n + 1:
                least = min(flow_to[p][q] for p, q in zip(path, path[1:]))
                for p, q in zip(path, path[1:]):
                    flow_to[p][q] -= least
                    flow_to[q][p] = flow_to[q].get(p, 0.0) + least
                path = [n]
                arcs = {k: iter(list(flow_to[k])) for k in level}
                continue
            for v in arcs[u]:
                if flow_to[u][v] > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def slic(lines: DataFrame, n: int, compactness: float = 10.0, rounds: int = 5) -> DataFrame:
    """Superpixels from 1 by means in place and value, each looked for within twice the spacing of its centre."""

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        step = max(1, int(np.sqrt(h * w / max(1, n))))
        centres = [(float(y), float(x), float(a[y, x])) for y in range(step // 2, h, step) for x in range(step // 2, w, step)]
        yy, xx = np.mgrid[:h, :w]
        for _ in range(rounds):
            best, label = np.full((h, w), np.inf), np.zeros((h, w), int)
            for k, (cy, cx, cv) in enumerate(centres, 1):
                ys, xs = slice(max(0, int(cy) - 2 * step), int(cy) + 2 * step + 1), slice(max(0, int(cx) - 2 * step), int(cx) + 2 * step + 1)
                d = (a[ys, xs] - cv) ** 2 + (compactness / step) ** 2 * ((yy[ys, xs] - cy) ** 2 + (xx[ys, xs] - cx) ** 2)
                near = d < best[ys, xs]
                best[ys, xs][near], label[ys, xs][near] = d[near], k
            for k in range(1, len(centres) + 1):
                m = label == k
                if m.any():
                    centres[k - 1] = (float(yy[m].mean()), float(xx[m].mean()), float(a[m].mean()))
        return label.astype(float)

    return per_image(lines, run)


# --- priors of saliency, as column expressions


def centre_prior(x: Column, y: Column, width: int, height: int, spread: float) -> Column:
    """exp of minus the squared distance to the image's centre over a spread, both by its size."""
    dx, dy = (x - (width - 1) / 2) / width, (y - (height - 1) / 2) / height
    return F.exp(-(dx * dx + dy * dy) / (spread * spread))


def focus_prior(px: DataFrame, label: str, value: str) -> DataFrame:
    """(label, focus): how much a region's pixels vary, over the largest such among all regions."""
    own = px.groupBy(label).agg(F.stddev_pop(value).alias("s"))
    return own.join(F.broadcast(own.agg(F.max("s").alias("top")))).select(label, F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(0.0).alias("focus"))


def ellipse_prior(px: DataFrame, label: str) -> DataFrame:
    """(label, fit): the share of a region's pixels inside the ellipse of its own second moments, that of twice their roots."""
    m = px.groupBy(label).agg(*[F.avg(c).alias(f"m{c}") for c in "xy"], *[F.var_pop(c).alias(f"v{c}") for c in "xy"], F.covar_pop("x", "y").alias("c"))
    own = px.join(m, label)
    dx, dy, det = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("vx") * F.col("vy") - F.col("c") * F.col("c")
    d = (F.col("vy") * dx * dx - 2 * F.col("c") * dx * dy + F.col("vx") * dy * dy) / det
    return own.groupBy(label).agg(F.avg(F.when((det > 0) & (F.round(d, 9) <= 4), 1.0).otherwise(0.0)).alias("fit"))
