"""String, value, maths, colour and radiometric functions as queries, with the same result as SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import colours as C
from ..functions import maths as M
from ..functions import scalars as S
from ..functions import texts as X
from ..functions import vectors as V
from ..operators import raster
from .queries import _T, _XYZ, LONG, PX, RGB, SM, _px, _rgb, query, r4


def columns(name: str, table: str, keys: tuple[str, ...], parts: dict[str, tuple[Callable[[], Column], str | None]]) -> None:
    """A query of column expressions over one table: name -> (column, the same in SQL)."""
    sql = None
    if all(text for _, text in parts.values()):
        sql = f"SELECT {', '.join(keys)}, {', '.join(f'{text} AS {n}' for n, (_, text) in parts.items())} FROM {table}"

    @query(name, sql)
    def _(spark, sf):
        return T.read(spark, sf, table).select(*keys, *[c().alias(n) for n, (c, _) in parts.items()])


# --- strings

columns("string_trims", "part", ("p_partkey",), {
    "l": (lambda: X.left_trim(F.col("p_type"), "S"), "ltrim(p_type, 'S')"), "r": (lambda: X.right_trim(F.col("p_type"), "L"), "rtrim(p_type, 'L')"), "both": (lambda: X.trim(F.concat(F.lit("--"), F.col("p_name"), F.lit("-")), "-"), "trim('--' || p_name || '-', '-')"),
})

columns("string_affixes", "part", ("p_partkey",), {
    "starts": (lambda: F.col("p_brand").startswith("Brand#1"), "starts_with(p_brand, 'Brand#1')"), "ends": (lambda: F.col("p_type").endswith("STEEL"), "ends_with(p_type, 'STEEL')"), "same": (lambda: F.col("p_brand") == "Brand#11", "p_brand = 'Brand#11'"),
    "no_prefix": (lambda: X.without_prefix(F.col("p_brand"), "Brand#"), "CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END"),
    "no_suffix": (lambda: X.without_suffix(F.col("p_type"), "STEEL"), "CASE WHEN ends_with(p_type, 'STEEL') THEN left(p_type, length(p_type) - 5) ELSE p_type END"),
})

columns("string_changes", "part", ("p_partkey",), {
    "joined": (lambda: F.concat(F.col("p_brand"), F.lit(":"), F.col("p_type")), "p_brand || ':' || p_type"), "upper": (lambda: F.upper(F.col("p_name")), "upper(p_name)"), "lower": (lambda: F.lower(F.col("p_type")), "lower(p_type)"),
    "replaced": (lambda: X.replaced(F.col("p_name"), "e", "EE"), "replace(p_name, 'e', 'EE')"), "found": (lambda: F.col("p_name").contains("re"), "contains(p_name, 're')"),
})

columns("path_joins", "pages", ("page_id",), {
    "joined": (lambda: X.joined_path(F.lit("/data/"), F.col("url"), F.lit("/x")), "'/data/' || regexp_replace(url, '^/', '') || CASE WHEN ends_with(url, '/') THEN 'x' ELSE '/x' END"),
    "place": (lambda: X.absolute(F.lit("a/./b/../c.txt"), "/base"), "'/base/a/c.txt'"),
})



def _file() -> Column:
    return X.sample_name(F.col("c_nationkey"), F.col("c_custkey"), "_x.png")


columns("sample_names", "customer", ("c_custkey",), {
    "file": (lambda: _file(), "lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || '_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_x.png'"),
    "label": (lambda: X.sample_label(_file()), "c_nationkey"), "sample": (lambda: X.sample_number(_file()), "CAST(c_custkey AS INTEGER)"),
})

columns("string_numbers", "part", ("p_partkey",), {"number": (lambda: X.string_number(F.col("p_brand")), None)})


@query("hex_colours", f"WITH {RGB} SELECT l_orderkey, l_linenumber, printf('%02X%02X%02X', r, g, b) AS code, r AS r2, g AS g2, b AS b2 FROM rgb")
def _(spark, sf):
    code = X.hex_of_colour(*(F.col(c) for c in "rgb"))
    back = X.colour_of_hex(F.concat(F.lit("#"), F.col("code")))
    return _rgb(spark, sf).withColumn("code", code).select("l_orderkey", "l_linenumber", "code", *[c.alias(f"{n}2") for n, c in zip("rgb", back)])


# --- values

@query("value_tables", """WITH e AS (SELECT event_id, list_sort(json_keys(props)) AS ks, props AS js FROM events)
  SELECT event_id, ks[1] AS first_key, json_extract_string(js, '$.' || ks[1]) AS first_value, ks[2] AS next_key, len(ks) + 1 AS n_more, len(ks) - 1 AS n_less, CAST(event_type AS VARCHAR) AS added
  FROM e JOIN events USING (event_id)""")  # fmt: skip
def _(spark, sf):
    e = T.read(spark, sf, "events").withColumn("m", X.json_map(F.col("props")))
    first = X.first_entry(F.col("m"))
    more = X.inserted(F.col("m"), F.lit("~type"), F.col("event_type"))
    return e.withColumn("f", first).withColumn("more", more).select(
        "event_id", F.col("f.key").alias("first_key"), F.col("f.value").alias("first_value"), X.next_entry(F.col("m"), F.col("f.key"))["key"].alias("next_key"),
        F.size("more").cast("long").alias("n_more"), F.size(X.removed(F.col("m"), F.col("f.key"))).cast("long").alias("n_less"), F.col("more")["~type"].alias("added"),
    )


@query("value_updates", "SELECT event_id, 'changed' AS v, event_type AS second, '{\"0\":\"' || event_type || '\",\"1\":\"x\"}' AS text FROM events")
def _(spark, sf):
    e = T.read(spark, sf, "events").withColumn("m", X.numbered_values(F.array(F.lit("old"), F.col("event_type"))))
    changed = X.inserted(F.col("m"), F.lit(0), F.lit("changed"))
    text = F.create_map(F.lit("1"), F.lit("x"), F.lit("0"), F.col("event_type"))
    return e.select("event_id", changed[0].alias("v"), changed[1].alias("second"), X.minified(text).alias("text"))


@query("json_arrays", "SELECT event_id, event_id AS n0, 2 AS n_size, CAST(event_id AS DOUBLE) AS m11, event_type AS s1, 3 AS keys, true AS has_k FROM events")
def _(spark, sf):
    doc = F.concat(F.lit('{"a":{"n":['), F.col("event_id").cast("string"), F.lit(',2],"m":[[1,2],[3,'), F.col("event_id").cast("string"), F.lit(']],"s":["x","'), F.col("event_type"), F.lit('"]},"k":1}'))
    d = F.col("doc")
    numbers = X.json_array(d, "a:n", "long")
    return T.read(spark, sf, "events").withColumn("doc", doc).select(
        "event_id", numbers[0].alias("n0"), F.size(numbers).alias("n_size"), X.json_array(d, "a:m", "array<double>")[1][1].alias("m11"), X.json_array(d, "a:s", "string")[1].alias("s1"),
        F.size(X.json_map(d, "a")).alias("keys"), X.json_map(d)["k"].isNotNull().alias("has_k"),
    )


@query("json_changes", "SELECT event_id, '{\"a\":\"1\",\"n\":\"' || event_id || '\"}' AS more, '{\"b\":\"' || event_type || '\"}' AS less FROM events")
def _(spark, sf):
    two = F.to_json(F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("1")))
    return T.read(spark, sf, "events").select("event_id", X.json_with(F.lit('{"a":"1"}'), "n", F.col("event_id")).alias("more"), X.json_without(two, "a").alias("less"))


@query("typed_values", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS text, o_custkey = o_custkey AS same, o_custkey = 1 AS one FROM orders")
def _(spark, sf):
    """Values of any type as variants: copied, compared, written."""
    v = F.parse_json(F.col("o_custkey").cast("string"))
    o = T.read(spark, sf, "orders").withColumn("v", v)
    return o.select("o_orderkey", F.variant_get("v", "$", "string").alias("text"), (F.to_json("v") == F.to_json(v)).alias("same"), (F.to_json("v") == F.to_json(F.parse_json(F.lit("1")))).alias("one"))


# --- maths



def _price() -> Column:
    return F.col("o_totalprice") / 100000


_s = "(o_totalprice / 100000)"
columns("special_functions", "orders", ("o_orderkey",), {
    "gamma": (lambda: r4(M.gamma(_price() + 0.5)), f"round(gamma({_s} + 0.5), 4) + 0.0"), "beta": (lambda: r4(M.beta(_price() + 0.5, F.lit(2.5))), f"round(gamma({_s} + 0.5) * gamma(2.5) / gamma({_s} + 3.0), 4) + 0.0"),
    "f": (lambda: r4(M.f_density(_price(), 5.0, 8.0)), f"round(sqrt(pow(5 * {_s}, 5) * pow(8, 8) / pow(5 * {_s} + 8, 13)) / ({_s} * gamma(2.5) * gamma(4) / gamma(6.5)), 4) + 0.0"),
    "pearson": (lambda: r4(M.pearson4_density(_price(), 2.0, 0.5, 1.5, 1.0, 0.7)), f"round(0.7 * pow(1 + pow(({_s} - 1) / 1.5, 2), -2.0) * exp(-0.5 * atan(({_s} - 1) / 1.5)), 4) + 0.0"),
    "fifth": (lambda: F.round(M.power(_price(), 5), 3), f"round(pow({_s}, 5), 3)"), "factorial": (lambda: M.factorial(F.col("o_custkey") % 15), "CAST(factorial(CAST(o_custkey % 15 AS INTEGER)) AS DOUBLE)"),
})

columns("gauss_cdf", "orders", ("o_orderkey",), {"cdf": (lambda: M.gauss_cdf(_price(), 1.5, 0.8), None), "ratio": (lambda: M.gamma_ratio(_price() + 0.5, F.lit(1.5)), None)})

_TESTS = {
    "sphere": (M.sphere, "sum(v * v)"),
    "rosenbrock": (M.rosenbrock, "sum(CASE WHEN nxt IS NOT NULL THEN 100 * pow(nxt - v * v, 2) + pow(v - 1, 2) ELSE 0 END)"),
    "ackley": (M.ackley, "-20 * exp(-0.2 * sqrt(sum(v * v) / count(*))) - exp(sum(cos(2 * pi() * v)) / count(*)) + 20 + exp(1)"),
    "griewank": (M.griewank, "sum(v * v) / 4000 - product(cos(v / sqrt(dim + 1))) + 1"),
    "rastrigin": (M.rastrigin, "10 * count(*) + sum(v * v - 10 * cos(2 * pi() * v))"),
}


@query("optimiser_functions", f"WITH {LONG}, nx AS (SELECT *, lead(v) OVER (PARTITION BY id ORDER BY dim) AS nxt FROM c) SELECT id, {', '.join(f'round({q}, 4) + 0.0 AS {n}' for n, (_, q) in _TESTS.items())} FROM nx GROUP BY id")
def _(spark, sf):
    return T.samples(spark, sf).select("id", *[r4(f(F.col("feat"))).alias(n) for n, (f, _) in _TESTS.items()])


def _u(seed: int, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


columns("random_numbers", "orders", ("o_orderkey",), {
    "u": (lambda: F.round(M.uniform(F.col("o_orderkey"), 7, -1.0, 3.0), 6), f"round(-1 + 4 * {_u(7, 'o_orderkey')}, 6)"), "k": (lambda: M.integer(F.col("o_orderkey"), 8, 3, 9), f"CAST(3 + floor({_u(8, 'o_orderkey')} * 7) AS BIGINT)"),
    "g": (lambda: r4(M.normal(F.col("o_orderkey"), 9, 2.0, 4.0)), f"round(2 + 2 * sqrt(-2 * ln(1 - {_u(9, 'o_orderkey')})) * cos(2 * pi() * {_u(10, 'o_orderkey')}), 4) + 0.0"),
})


@query("random_distinct", f"SELECT p_partkey FROM part ORDER BY {_u(11, 'p_partkey')}, p_partkey LIMIT 25")
def _(spark, sf):
    """Some different integers of a range, drawn by seed."""
    return T.read(spark, sf, "part").select("p_partkey").orderBy(M.uniform(F.col("p_partkey"), 11), "p_partkey").limit(25)


columns("sequences", "region", ("r_regionkey",), {
    "geometric": (lambda: F.array_join(F.transform(M.geometric(1.0, 100.0, 3.0), lambda v: v.cast("int").cast("string")), ","), "'1,3,9,27,81'"), "steps": (lambda: F.size(M.stepped(0.0, 1.0, 0.25)), "5"),
    "again": (lambda: F.array_join(M.repeated(F.col("r_regionkey").cast("string"), 3), ","), "CAST(r_regionkey AS VARCHAR) || ',' || CAST(r_regionkey AS VARCHAR) || ',' || CAST(r_regionkey AS VARCHAR)"),
})

_ms = "(o_totalprice * 1000)"
_DURATION = f"CASE WHEN {_ms} < 1 THEN printf('%f ms', {_ms}) ELSE " + " || ".join(
    f"CASE WHEN {q} > 0 THEN {q} || ' {u}' ELSE '' END"
    for q, u in (
        (f"CAST({_ms} AS BIGINT) // 86400000", "day(s) "), (f"CAST({_ms} AS BIGINT) // 3600000 % 24", "hour(s) "), (f"CAST({_ms} AS BIGINT) // 60000 % 60", "min(s) "),
        (f"CAST({_ms} AS BIGINT) // 1000 % 60", "sec(s) "), (f"CAST({_ms} AS BIGINT) % 1000", "ms"),
    )
).replace(f"CAST({_ms} AS BIGINT)", f"CAST(trunc({_ms}) AS BIGINT)") + " END"
columns("durations", "orders", ("o_orderkey",), {"text": (lambda: X.duration(F.round(F.col("o_totalprice") * 1000, 3)), _DURATION.replace(_ms, "round(o_totalprice * 1000, 3)"))})


@query("elapsed_times", "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000, 3) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    before = F.lag(stamp).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return T.read(spark, sf, "events").withColumn("before", before).select("event_id", F.round(X.elapsed_ms(F.col("before"), stamp), 3).alias("ms"))


# --- arrays

@query("array_sums", f"WITH {LONG} SELECT id, round(sum(v + v * 2), 4) + 0.0 AS added, round(sum(v - v * 3), 4) + 0.0 AS less, round(var_pop(v), 4) AS var, round(list_sort(list(v))[33], 4) + 0.0 AS med, round(sum(v * (dim + 1)) / sum(dim + 1), 4) + 0.0 AS wmean FROM c GROUP BY id")
def _(spark, sf):
    f = F.col("feat")
    w = F.transform(f, lambda _, k: (k + 1).cast("double"))
    return T.samples(spark, sf).select(
        "id", r4(V.total(M.added(f, M.scaled(f, 2.0)))).alias("added"), r4(V.total(M.subtracted(f, M.scaled(f, 3.0)))).alias("less"), r4(M.variance(f)).alias("var"), r4(M.median(f)).alias("med"), r4(M.weighted_mean(f, w)).alias("wmean"),
    )


@query("array_orders", "SELECT 1 AS one, '2,3,5' AS merged, '5,2,3,2' AS joined, 2.5 AS others, 3.0 AS wmedian, '1.0,2.0' AS as_double")
def _(spark, sf):
    a, b = F.array(F.lit(5), F.lit(2)), F.array(F.lit(3), F.lit(2))
    d = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return spark.range(1).select(
        F.lit(1).alias("one"), text(F.array_sort(F.array_union(a, b))).alias("merged"), text(F.concat(a, b)).alias("joined"), M.mean_of_others(d(0, 2, 3, 0)).alias("others"),
        M.weighted_median(d(1, 3, 9), d(1, 3, 2)).alias("wmedian"), text(F.array(F.lit(1), F.lit(2)).cast("array<float>").cast("array<double>")).alias("as_double"),
    )


@query("array_shuffle")
def _(spark, sf):
    return T.samples(spark, sf).select("id", M.shuffled(F.col("feat"), 3).alias("feat"))


# --- colours


def _colour_query(name: str, make, sql: dict[str, str] | None, columns_: str = "rgb", cte: str = RGB) -> None:
    text = f"WITH {cte} SELECT l_orderkey, l_linenumber, {', '.join(f'{q} AS {n}' for n, q in sql.items())} FROM rgb" if sql else None

    @query(name, text)
    def _(spark, sf):
        found = make(*(F.col(c).cast("double") for c in columns_))
        return _rgb(spark, sf).select("l_orderkey", "l_linenumber", *[(c if "round" not in q or q.startswith("CAST") else F.round(c, 3) + 0.0).alias(n) for c, (n, q) in zip(found, (sql or dict.fromkeys(("x", "y", "z"), "round")).items())])


def _clamped(q: str) -> str:
    return f"greatest(0, least(255, CAST(trunc({q}) AS INTEGER)))"


_back = [f"{a!r} * (r - 16.0) + {b!r} * (g - 128.0) + {c!r} * (b - 128.0)" for a, b, c in C.BACK]
_colour_query("colour_of_ycbcr", C.rgb_of_ycbcr, {n: _clamped(q) for n, q in zip("xyz", _back)})

_yw = "(0.2627 * (r / 255.0) + 0.6780 * (g / 255.0) + 0.0593 * (b / 255.0))"
_colour_query("colour_wide", C.wide_ycbcr, {
    "x": f"CAST(trunc(least(1.0, greatest(0.0, {_yw})) * 876) AS INTEGER) + 64",
    "y": f"CAST(trunc(least(0.5, greatest(-0.5, (b / 255.0 - {_yw}) / 1.8814)) * 896) AS INTEGER) + 512", "z": f"CAST(trunc(least(0.5, greatest(-0.5, (r / 255.0 - {_yw}) / 1.4746)) * 896) AS INTEGER) + 512",
})
_wy, _wb, _wr = "((r * 3 - 64) / 876.0)", "((g * 4 - 512) / 896.0)", "((b * 4 - 512) / 896.0)"
_wR, _wB = f"({_wr} * 1.4746 + {_wy})", f"({_wb} * 1.8814 + {_wy})"
_colour_query("colour_of_wide", lambda r, g, b: C.rgb_of_wide_ycbcr(r * 3, g * 4, b * 4), {
    n: f"CAST(trunc(least(1.0, greatest(0.0, {q})) * 255.0) AS INTEGER)" for n, q in (("x", _wR), ("y", f"(({_wy} - 0.2627 * {_wR} - 0.0593 * {_wB}) / 0.6780)"), ("z", _wB))
})
_colour_query("colour_quantised_lab", lambda r, g, b: C.quantised_lab(r / 3, g / 3 - 50, b / 3 - 50), {
    "x": "CAST(trunc((r / 3.0 + 0.0) / 99.998337 * 255) AS INTEGER)", "y": "CAST(trunc((g / 3.0 - 50 + 86.182236) / 184.44085 * 255) AS INTEGER)", "z": "CAST(trunc((b / 3.0 - 50 + 107.867744) / 202.349426 * 255) AS INTEGER)",
})
_colour_query("colour_of_quantised_lab", C.lab_of_quantised, {
    "x": "round(r / 255.0 * 99.998337, 3)", "y": "round(g / 255.0 * 184.44085 - 86.182236, 3) + 0.0", "z": "round(b / 255.0 * 202.349426 - 107.867744, 3) + 0.0",
})
_li = "((r / 3.0 + 16) / 116)"
_inv = "(CASE WHEN {0} >= 6.0 / 29 THEN {0} * {0} * {0} ELSE 108.0 / 841 * ({0} - 4.0 / 29) END)"
_xyz = [f"({w!r} * {_inv.format(t)})" for w, t in zip(S.WHITE, (f"({_li} + (g / 3.0 - 50) / 500)", _li, f"({_li} - (b / 3.0 - 50) / 200)"))]
_colour_query("colour_of_lab", lambda r, g, b: C.rgb_of_lab(r / 3, g / 3 - 50, b / 3 - 50), {n: f"CAST(trunc(({p!r} * {_xyz[0]} + {q!r} * {_xyz[1]} + {s!r} * {_xyz[2]}) * 255) AS INTEGER)" for n, (p, q, s) in zip("xyz", C.RGB_OF_XYZ)})
_LAB = ["CASE WHEN y > 0.008856 THEN 116 * pow(y, 1 / 3.0) - 16 ELSE 903.3 * y END", f"500 * ({_T.format('x')} - {_T.format('y')})", f"200 * ({_T.format('y')} - {_T.format('z')})"]
_CONVERTED = RGB.replace("rgb AS", "raw AS") + f", own AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{_clamped(q)} AS {n}' for n, q in zip('rgb', _back))} FROM raw), rgb AS (SELECT l_orderkey, l_linenumber, {_XYZ} FROM own)"
_colour_query("colour_ycbcr_lab", C.ycbcr_to_lab, {n: f"round({q}, 3) + 0.0" for n, q in zip("xyz", _LAB)}, cte=_CONVERTED)
_colour_query("colour_ycbcr_lab_scaled", C.ycbcr_to_lab_scaled, {n: f"round(({q} + {low!r}) / {span!r}, 3) + 0.0" for n, q, (low, span) in zip("xyz", _LAB, S.LAB_RANGE)}, cte=_CONVERTED)
_colour_query("colour_converted", lambda r, g, b: C.converted([r, g, b], "hsv", "lab_scaled"), None)
_colour_query("colour_as_gray", lambda r, g, b: C.converted([r, g, b], "rgb", "gray") * 1, {"x": "round(0.299 * r + 0.587 * g + 0.114 * b, 3)"})

_h = "(r / 60.0)"
_f = f"(CASE WHEN floor({_h}) % 2 = 0 THEN 1 - ({_h} - floor({_h})) ELSE {_h} - floor({_h}) END)"
_v, _m, _nn = "(b / 255.0)", "(b / 255.0 * (1 - g / 255.0))", f"(b / 255.0 * (1 - g / 255.0 * {_f}))"
_SECT = ((_v, _nn, _m), (_nn, _v, _m), (_m, _v, _nn), (_m, _nn, _v), (_nn, _m, _v), (_v, _m, _nn))
_colour_query("colour_of_hsv", C.rgb_of_hsv, {n: "CAST(trunc(round(255 * CASE WHEN g = 0 THEN " + _v + "".join(f" WHEN floor({_h}) % 6 = {k} THEN {s[i]}" for k, s in enumerate(_SECT)) + " END, 9)) AS INTEGER)" for i, n in enumerate("xyz")})

columns("normalisation_value", "orders", ("o_orderkey",), {
    "top": (lambda: C.largest_of(F.floor(F.col("o_totalprice")) % 70000), "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 70000 <= 1 THEN 1 WHEN CAST(floor(o_totalprice) AS BIGINT) % 70000 <= 255 THEN 255 WHEN CAST(floor(o_totalprice) AS BIGINT) % 70000 <= 4095 THEN 4095 WHEN CAST(floor(o_totalprice) AS BIGINT) % 70000 <= 65535 THEN 65535 ELSE 4294967295 END"),
    "middle": (lambda: C.quantised(F.col("o_totalprice"), 0.0, 500000.0, 16), "(least(15, greatest(0, floor(o_totalprice / 31250))) + 0.5) * 31250.0"),
})


@query("colour_tables")
def _(spark, sf):
    parts = [(C.blue_to_red(spark, 24), "blue_to_red"), (C.gradient(spark, C.VIRIDIS, 64), "viridis"), (C.gradient(spark, C.GRAY, 16), "gray"), (C.drawn(spark, 32), "drawn")]
    out = None
    for table, name in parts:
        table = table.withColumn("name", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


@query("gray_as_colour", f"WITH {PX} SELECT x, y, CAST(abs(val) AS BIGINT) % 16 * 17 AS r FROM px")
def _(spark, sf):
    px = _px(spark, sf).withColumn("val", F.abs("val").cast("long") % 16)
    return C.coloured(px, C.gradient(spark, C.GRAY, 16)).select("x", "y", F.col("r").cast("long").alias("r"))


# --- pixel arithmetic and radiometry


def _pixels(name: str, parts: dict[str, tuple[Callable[[], Column], str]]) -> None:
    @query(name, f"WITH {PX} SELECT x, y, {', '.join(f'{q} AS {n}' for n, (_, q) in parts.items())} FROM px")
    def _(spark, sf):
        return _px(spark, sf).select("x", "y", *[c().alias(n) for n, (c, _) in parts.items()])




def _val() -> Column:
    return F.col("val")


_pixels("pixel_arithmetic", {
    "square": (lambda: (_val() - 3) * (_val() - 3), "(val - 3) * (val - 3)"), "relu": (lambda: F.greatest(_val(), F.lit(0.0)), "greatest(val, 0.0)"), "root": (lambda: r4(F.sqrt(F.abs(_val()))), "round(sqrt(abs(val)), 4) + 0.0"),
    "more": (lambda: _val() + 5, "val + 5"), "times": (lambda: r4(_val() * 1.5), "round(val * 1.5, 4) + 0.0"), "times_int": (lambda: _val() * 3, "val * 3"),
})
_pixels("radiometric_stretches", {
    "gauss": (lambda: F.floor(255 * F.exp(-(_val() - 10) * (_val() - 10) / (2 * 60.0 * 60.0))), "CAST(floor(255 * exp(-(val - 10) * (val - 10) / 7200)) AS BIGINT)"),
    "expo": (lambda: S.exponential_stretch(_val(), -100.0, 150.0, 0.0, 255.0), f"CASE WHEN val < -100 THEN 0 WHEN val > 150 THEN 255 ELSE CAST(trunc(255 * (exp((val - 150) / 250.0) - {math.exp(-1)!r}) + {math.exp(-1)!r}) AS INTEGER) END"),
})


@query("radiometric_normal", f"WITH {PX}, m AS (SELECT min(val) FILTER (y % 2 = 0) AS lo, max(val) FILTER (y % 2 = 0) AS hi, avg(val) AS mean, stddev_pop(val) AS sd FROM px) SELECT x, y, CAST(trunc(round(255 * (val - lo) / (hi - lo), 9)) AS BIGINT) AS region, CAST(trunc(round(CASE WHEN val > mean THEN least(255.0, 100 + abs(val - mean) * sqrt(20 / sd)) ELSE greatest(0.0, 100 - abs(val - mean) * sqrt(20 / sd)) END, 6)) AS BIGINT) AS standard FROM px, m")
def _(spark, sf):
    px = _px(spark, sf)
    own = raster.region_normalised(px, F.col("y") % 2 == 0, 0.0, 255.0, "region")
    return raster.standardised(own, 100.0, 20.0, 255, "standard").select("x", "y", F.col("region").cast("long").alias("region"), F.col("standard").cast("long").alias("standard"))


_H = PX + ", h AS (SELECT CAST(abs(val) AS BIGINT) AS v, count(*) AS n FROM px GROUP BY 1), a AS (SELECT v, sum(n) OVER (ORDER BY v) / (SELECT sum(n) FROM h) AS acc FROM h)"


@query("radiometric_no_outliers", f"WITH {_H}, t AS (SELECT min(v) AS top FROM a WHERE acc > 0.95), l AS (SELECT min(v) AS low FROM h) SELECT x, y, CASE WHEN abs(val) <= top THEN CAST(trunc(round(255.0 * (abs(val) - low) / (top - low), 9)) AS BIGINT) ELSE 255 END AS val FROM px, t, l")
def _(spark, sf):
    px = _px(spark, sf).withColumn("val", F.abs("val").cast("long"))
    return raster.without_outliers(px, 0, 255, 0.95).select("x", "y", "val")


@query("radiometric_matched", f"WITH {_H}, g AS (SELECT CAST(abs(val) AS BIGINT) // 2 AS v, count(*) AS n FROM px GROUP BY 1), b AS (SELECT v, sum(n) OVER (ORDER BY v) / (SELECT sum(n) FROM g) AS acc FROM g), m AS (SELECT a.v, arg_min(b.v, (round(abs(a.acc - b.acc), 12), b.v)) AS t FROM a, b GROUP BY a.v) SELECT x, y, m.t AS val FROM px JOIN m ON m.v = CAST(abs(val) AS BIGINT)")
def _(spark, sf):
    px = _px(spark, sf).withColumn("val", F.abs("val").cast("long"))
    return raster.histogram_matched(px, px.withColumn("val", F.floor(F.col("val") / 2))).select("x", "y", "val")


@query("radiometric_equalised", f"WITH {PX} SELECT x, y, (row_number() OVER (ORDER BY val, y, x) - 1) // greatest(1, (SELECT count(*) FROM px) // 64) AS val FROM px")
def _(spark, sf):
    return raster.equalised(_px(spark, sf), 64).select("x", "y", "val")


