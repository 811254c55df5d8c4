from pyspark.sql import functions as F

from graticule.llm import urls

PAGES = [
    (0, "https://example.com/en/a", None),
    (1, "https://www.example.com/en/a", ""),
    (2, "http://alias.org/x#frag", '<link rel="canonical" href="https://example.com/en/a">'),
    (3, "http://alias.org/y", "<html><meta http-equiv='refresh' content='0; url=/x'></html>"),
    (4, "http://other.org/z", '<LINK href=//alias.org/y REL=canonical>'),
    (5, "http://www.example.com/en/k", '<link href="http://alias.org/x" rel="canonical">'),
    (6, "http://free.org/", "<link rel='canonical' href='http://free.org/home'>"),
    (7, None, None),
    (8, "no scheme", "<link rel=canonical href=https://example.com/en/a>"),
    (9, "ftp://SUB.Example.COM?q=/en/", None),
    (10, "x://a.net/es/1?u=://b", None),
    (11, "http://net/fr/", None),
    (12, "http://notnet/fr/", None),
    (13, "http://example.com/EN/a", None),
    (14, "HTTP://ALIAS.ORG/x", "canonical"),
    (15, "http://example.com/en/a", None),
]


def test_rules_and_components(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    want = {
        0: ("example.com", "/en/a", "example.com/en/", "block"), 1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("alias.org", "/x", None, "block"), 3: ("alias.org", "/y", None, "block"), 4: ("other.org", "/z", None, "block"),
        5: ("www.example.com", "/en/k", "www.example.com/en/", "allow"), 6: ("free.org", "/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("sub.example.com", "", None, "allow"), 10: ("a.net", "/es/1", "net/es/", "block"), 11: ("net", "/fr/", "net/fr/", "block"), 12: ("notnet", "/fr/", None, "allow"),
        13: ("example.com", "/EN/a", "com/", "allow"), 14: ("alias.org", "/x", None, "block"), 15: ("example.com", "/en/a", "example.com/en/", "block"),
    }
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want
    assert len({got[k]["component"] for k in (0, 2, 3, 4, 5, 14)}) == 1 and got[7]["component"] is None


def test_given_redirects(spark):
    df = spark.createDataFrame(PAGES[:1] + PAGES[6:7], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://free.org/home", "http://mid.org/"), ("https://EXAMPLE.com/en/a#x", "http://mid.org/"), (None, "http://mid.org/")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, redirects=edges).collect()} == {0: "block", 6: "block"}


def test_long_chains_and_hubs(spark):
    n = 60
    rows = [(k, f"http://c.org/{k}", f'<link rel="canonical" href="http://c.org/{k + 1}">') for k in range(n)]
    rows += [(100 + k, f"http://h{k}.org/", '<link rel="canonical" href="http://c.org/0">') for k in range(40)]
    rows += [(200, f"http://c.org/{n}", '<link rel="canonical" href="http://a.net/es/">')]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["verdict"] for r in got} == {"block"} and len({r["component"] for r in got}) == 1


def test_no_pages_and_native_plan(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(df).count() == 0
    plan = urls.judge(spark.createDataFrame(PAGES, df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark, sf):
    from oracle import connect, difference

    assert difference(connect(sf), urls.op6_urls(spark, sf), urls.SQL) == ""
