"""Queries that take whole tables, not a part of them."""

import pytest

from pagequern.operators import crawl
from pagequern.plans import catalog


@pytest.mark.parametrize("name", ["frontier_admit", "best_first"])
def test_all_deliveries_are_read(spark, base, name):
    """The SQL of each is compared in test_oracles."""
    assert name in catalog.ORACLES
    assert {r[0] for r in catalog.QUERIES[name](spark, base).select("delivery").distinct().collect()} == {1, 2, 3, 4, 5}


def test_levels_of_a_small_graph(spark):
    edges = "a>b,a>c,b>d,c>d,d>e,e>a,b>c,f>g".split(",")
    small = spark.createDataFrame([(x[0], i, x[2]) for i, x in enumerate(edges)], "src string, pos int, dst string")
    got = {(r["url"], r["depth"], r["parent"]) for r in crawl.crawl_levels(small, spark.createDataFrame([("a",)], "url string"), 3).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")}


def test_redirects_of_snapshots(spark, tmp_path):
    rows = [(1, "https://a.example/1", "https://a.example/2", 1), (2, "https://a.example/2", "https://a.example/3", 1), (3, "https://a.example/4/", "https://a.example/4", 1), (4, "https://a.example/5", None, 1), (5, "https://a.example/1", "https://a.example/9", 0)]
    df = spark.createDataFrame(rows, "snapshot_id bigint, url string, final_url string, t int").selectExpr("*", "timestamp_seconds(t) AS taken_at")
    df.write.parquet(f"{tmp_path}/snapshots.parquet")
    got = {tuple(r) for r in catalog.QUERIES["redirects_snapshots"](spark, str(tmp_path)).collect()}
    assert got == {("https://a.example/1", "https://a.example/3", 2, "ok"), ("https://a.example/2", "https://a.example/3", 1, "ok")}


def test_titles_of_all_characters(spark, tmp_path):
    spark.createDataFrame([(1, "Größe"), (2, "Größe"), (3, "abc"), (4, None)], "snapshot_id bigint, title string").write.parquet(f"{tmp_path}/snapshots.parquet")
    got = {r["snapshot_id"]: r["similarity"] for r in catalog.QUERIES["line_similarity_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_pages_heads_and_deep_headings(spark, tmp_path):
    deep = "<div>" * 12 + "<h1 class='t'>A title</h1>" + "</div>" * 12
    rows = [(1, "https://a.example/d/p", '<html><head><link rel="alternate" type="text/markdown" href="/a.md"><meta http-equiv="refresh" content="0; URL=/next"></head><body>' + deep + "</body></html>"), (2, "https://a.example/q", f"<html><body>{deep}</body></html>"), (3, "https://a.example/r", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["kind"], r["target"]) for r in catalog.QUERIES["head_links_pages"](spark, str(tmp_path)).collect()}
    assert got == {(1, "refresh", "https://a.example/next"), (1, "alternate", "https://a.example/a.md")}
    found = {(r["page_id"], r["tag"]) for r in catalog.QUERIES["heal_selector"](spark, str(tmp_path)).collect()}
    assert found == {(1, "h1"), (2, "h1")}


def test_robots_groups_wildcards_and_delays(spark):
    body = "Disallow: /early\n# note\nUser-agent: One\nUser-agent: *\nDisallow: /a*b$\nDisallow: /c.d # why\nAllow: /c.d/e\nCrawl-delay: 2.5\nSitemap: https://h/s.xml\n\nUser-agent: Two\nDisallow:\nCrawl-delay: x\n"
    bodies = spark.createDataFrame([("h", body), ("i", None)], "host string, body string")
    assert {(r["agent"], r["allow"], r["path"]) for r in crawl.robots_rules(bodies).collect()} == {(a, *r) for a in ("one", "*") for r in ((False, "/a*b$"), (False, "/c.d"), (True, "/c.d/e"))}
    paths = ["/axxb", "/axxbc", "/c.d/x", "/cxd", "/c.d/e", "/early", "/"]
    urls = spark.createDataFrame([(f"u{p}", "h", p) for p in paths] + [("v", "j", "/")], "url string, host string, path string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(urls, crawl.robots_rules(bodies)).collect()}
    assert {k for k, v in got.items() if not v} == {"u/axxb", "u/c.d/x"} and len(got) == 8
    assert [tuple(r) for r in crawl.crawl_delays(bodies).orderBy("agent").collect()] == [("h", "*", 2.5), ("h", "one", 2.5)]
    assert [tuple(r) for r in crawl.robots_sitemaps(bodies).collect()] == [("h", "https://h/s.xml")]


def test_discovered_urls(spark):
    one = lambda *locs, tag="url": "<x>" + "".join(f"<{tag}><loc>{x}</loc><lastmod>{m}</lastmod></{tag}>" for x, m in locs) + "</x>"
    files = [
        ("https://a", "https://a/robots.txt", "robots", "Sitemap: https://a/one.xml\nUser-agent: *\nSitemap: https://a/one.xml"),
        ("https://a", "https://a/one.xml", "sitemap", one(("https://a/p", "1"), ("https://a/q", "1")) + one(("https://a/deep.xml", ""), ("https://a/one.xml", ""), tag="sitemap")),
        ("https://a", "https://a/sitemap.xml", "sitemap", one(("https://a/p", "2"))),
        ("https://a", "https://a/deep.xml", "sitemap", one(("https://a/r", "3"), ("https://a/q", "4"))),
        ("https://a", "https://a/other.xml", "sitemap", one(("https://a/never", "1"))),
        ("https://a", "https://a/llms.txt", "llms", "[The p](https://a/p)\n[New](https://a/s)"),
        ("https://b", "https://b/robots.txt", "robots", None),
    ]
    df = spark.createDataFrame(files, "site string, url string, kind string, body string")
    got = {(r["url"], r["source"], r["source_url"], r["lastmod"], r["title"]) for r in crawl.discover_urls(df).collect()}
    assert got == {("https://a/p", "llms", "https://a/llms.txt", None, "The p"), ("https://a/s", "llms", "https://a/llms.txt", None, "New"), ("https://a/q", "sitemap", "https://a/deep.xml", "4", None), ("https://a/r", "sitemap", "https://a/deep.xml", "3", None)}
    assert {r["url"] for r in crawl.discover_urls(df, 1).collect()} == {"https://a/p", "https://a/q", "https://a/s"}
    assert crawl.discover_urls(df.limit(0)).count() == 0
