"""URL filters with redirect equivalence; native DataFrame operations only.

Rules of a host and a path prefix judge each url; the longest fitting rule wins.  Urls that redirect to one another, or name
one another as canonical, are aliases: connected components over these edges.  A block by a rule reaches
every alias that no rule allows explicitly; everything else is allowed.

A page's edges are its canonical links and its refresh targets, absolute or relative to its url; more edges (src, dst) can be
given.  A url stands for itself without its fragment, with its scheme and host lower-cased, an empty path as "/", and "&amp;"
as "&".

Edge cases: null urls and urls without "://" have an empty host and path, fit no rule and have no aliases; null
html has no edges; repeated urls are one node; rules of equal length that fit are ordered block before allow, then by text; no pages
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = r"(?s)^.*?://(.*)$"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without its fragment, scheme and host lower-cased; null where there is no host."""
    url = F.replace(url, F.lit("&amp;"), F.lit("&"))
    whole = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", 2)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(F.translate(whole, UPPER, LOWER), rest))


def resolved(url: Column, target: Column) -> Column:
    """A target as seen from the page at `url`; null where it names no page."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    root, scheme = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    page = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    whole = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, target))
    )
    # "." and ".." in the path
    path = F.regexp_replace(path_of(whole), r"/\.{1,2}$", "$0/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    short = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*([?#].*)?$", 1)
    return F.when(path_of(whole).contains("/."), F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), short, rest)).otherwise(whole)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: A tag's attribute, quoted either way.
LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and refresh targets."""
    found = []
    for sign, pattern in (("canonical", LINK), ("http-equiv", REFRESH)):
        # the plain search spares almost all pages the pattern
        page = F.when(F.col("html").rlike(f"(?i){sign}"), F.col("html"))
        found.append(F.coalesce(F.regexp_extract_all(page, F.lit(pattern), 1), F.array().cast("array<string>")))
    rows = pages.select("url", F.explode(F.array_distinct(F.concat(*found))).alias("target"))
    return rows.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("url"), F.col("target"))).alias("dst"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) for every row; component is the smallest alias, null without a host."""
    url = F.col("url")
    own = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "node", "r.rule", F.col("r.verdict").alias("said"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    comps = common.connected_components(edges, "src", "dst")
    # every node of a component is judged, also those that are no page
    nodes = comps.select("node", "component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("v"))
    blocked = nodes.groupBy("component").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked"))
    blocked = nodes.join(blocked, "component").select("node", "component", "blocked")
    # urls without a host have no aliases, and would all meet in one task
    alone = own.where("node is null").withColumns({"component": F.lit(None).cast("string"), "blocked": F.lit(None).cast("boolean")})
    got = own.where("node is not null").join(blocked, "node", "left").unionByName(alone)
    verdict = F.coalesce("said", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return got.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict")


#: No page of the tables has a canonical link or a refresh; SQL for the rules, and for allowing what no rule names.
SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
