from lattice.llm import urls as U
from lattice.llm.queries import URL_RULES


def rules(spark):
    return spark.createDataFrame(URL_RULES, "action string, host string, path string")


def test_rules_hosts_and_aliases(spark):
    canon = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head></html>'
    rows = [
        (1, "https://A.Example.NET/x?y#z", None, "a.example.net", "/x", "net/", "block"),
        (2, "http://example.net/en/1", None, "example.net", "/en/1", "example.net/en/", "allow"),
        (3, "http://example.com/de/1", None, "example.com", "/de/1", "example.com/de/", "block"),
        (4, "http://notexample.com/de/1", None, "notexample.com", "/de/1", None, "allow"),
        (5, None, None, "", "", None, "allow"),
        (6, "no scheme", None, "", "", None, "allow"),
        (7, "http://other.com/1", canon("http://bad.net/q"), "other.com", "/1", None, "block"),
        (8, "https://third.com/1#f", canon("http://other.com/1"), "third.com", "/1", None, "block"),
        (9, "http://x.org/fr/1", canon("http://third.com/1"), "x.org", "/fr/1", "org/fr/", "allow"),
        (10, "http://lone.com?q", '<meta http-equiv="refresh" content="0; url=/b?c=1&amp;d">', "lone.com", "", None, "allow"),
        (11, "http://lone.com/b?c=1&d", "", "lone.com", "/b", None, "allow"),
        (12, "http://net/", None, "net", "/", "net/", "block"),
        (13, "http://net", None, "net", "", None, "allow"),
        (13, "http://net", None, "net", "", None, "allow"),
    ]
    df = spark.createDataFrame([(*r[:3], "extra", "extra") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = sorted(tuple(r) for r in U.judge(df, rules(spark)).collect())
    assert got == sorted((r[0], *r[3:]) for r in rows)
    assert U.judge(df.limit(0), rules(spark)).count() == 0


def test_redirect_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/1", None)], "page_id long, url string, html string")
    red = spark.createDataFrame([("http://a.com/1", "http://b.com/"), ("http://b.com", "https://c.net/z")], "from_url string, to_url string")
    assert [r.verdict for r in U.judge(df, rules(spark), red).collect()] == ["block"]


def test_relative_targets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://h.com/a/b", f'<link rel=canonical href={t}>') for t in ("c", "/c", "//o.com/c", "http://p.com/")], "url string, html string")
    got = [r[0] for r in df.select(U.targets(F.col("url"), F.col("html"))).collect()]
    assert got == [["http://h.com/a/c"], ["http://h.com/c"], ["http://o.com/c"], ["http://p.com/"]]


def test_allow_wins_a_tie(spark):
    both = spark.createDataFrame([("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "a.com", "/")], "action string, host string, path string")
    df = spark.createDataFrame([(1, "http://a.com/x1", None), (2, "http://a.com/y", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge(df, both).collect()} == {1: ("a.com/x", "allow"), 2: ("a.com/", "block")}


def test_links_in_comments_and_scripts_do_not_count(spark):
    from pyspark.sql import functions as F

    link = '<link rel="canonical" href="http://no.net/">'
    pages = [f"<!-- {link} --><link rel=canonical href=http://yes.com/>", f"<script>var x = '{link}'</script>", f"<textarea>{link}</textarea>", f"<!-- {link}"]
    df = spark.createDataFrame([("http://h.com/", p) for p in pages], "url string, html string")
    assert [r[0] for r in df.select(U.targets(F.col("url"), F.col("html"))).collect()] == [["http://yes.com/"], [], [], []]
