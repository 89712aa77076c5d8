import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequern.functions import page as P
from pagequern.functions import text as T
from pagequern.functions import url as U
from pagequern.functions.volatile import bare_link, mask_lines
from pagequern.operators import crawl, dom, line_diff, manifest, ranking, state
from pagequern.streaming import streams


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_url", "wanted"),
    [
        ("HTTPS://Docs.A.Example:443/x/?b=2&a=1&utm_source=q#top", "https://docs.a.example/x?a=1&b=2"),
        ("http://a.example", "http://a.example/"),
        ("http://a.example:80/", "http://a.example/"),
        ("http://a.example:8080/x//", "http://a.example:8080/x"),
        ("https://a.example/?UTM_Campaign=1&FBCLID=2", "https://a.example/"),
        ("https://a.example/p?q=b&q=a", "https://a.example/p?q=a&q=b"),
        ("https://a.example/p?q=a%20b+c", "https://a.example/p?q=a+b+c"),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, given_url, wanted):
    assert one(spark, U.normalize_url(F.col("u")), u=("string", given_url)) == wanted


@pytest.mark.parametrize(("href", "wanted"), [("/x", "https://a.example/x"), ("y", "https://a.example/d/y"), ("../z", "https://a.example/z"), ("//b.example/q", "https://b.example/q"), ("mailto:a@b", None), ("", None), ("#f", "https://a.example/d/p?k=1#f"), ("?z=1", "https://a.example/d/p?z=1")])
def test_absolute_url(spark, href, wanted):
    assert one(spark, U.absolute_url(F.col("h"), F.lit("https://a.example/d/p?k=1")), h=("string", href)) == wanted


def test_masks(spark):
    lines = ["Last updated about 3 days ago.", " at 2025-01-02T03:04:05.678Z. ", "session=abcdefghijklmn is", "ad-slot:abcdef12 x", "see https://a.example/p?id=1&utm_source=x&utm_medium=y now", None, "  "]
    got = one(spark, mask_lines(F.col("a")), a=("array<string>", lines))
    assert got == ["Last updated <relative-time>.", "at <timestamp>.", "token=<volatile-token> is", "ad-slot=<volatile-ad-slot> x", "see https://a.example/p?id=1 now"]
    assert one(spark, bare_link(F.col("u")), u=("string", "https://a.example/p?session=1&k=2&utm_source=3")) == "https://a.example/p?k=2"
    assert one(spark, bare_link(F.col("u")), u=("string", "https://a.example/p?session=1#f")) == "https://a.example/p#f"


def test_text(spark):
    assert one(spark, T.normalize_whitespace(F.col("t")), t=("string", " a\t b \r\n\r\n\r\n\r\nc ")) == "a b\n\nc"
    assert one(spark, T.token_estimate(F.col("t")), t=("string", "abcde")) == 2
    s = one(spark, T.section_between(F.col("t"), "<<", ">>"), t=("string", "a<<b>>c"))
    assert (s["start_index"], s["end_index"], s["text"], s["truncated"]) == (1, 4, "<<b", False)
    e = one(spark, T.excerpts(F.col("t"), "aa", 1, 1), t=("string", "xaaaay"))
    assert [(x["index"], x["text"]) for x in e] == [(1, "xaaa"), (3, "aaay")]
    assert one(spark, T.line_similarity(F.col("a"), F.col("b")), a=("string", "one two"), b=("string", "two one")) == 1.0


def test_decisions(spark):
    assert one(spark, P.content_route(F.col("c"), F.col("u")), c=("string", "TEXT/HTML; charset=x"), u=("string", None)) == "html"
    assert one(spark, P.content_route(F.col("c"), F.col("u")), c=("string", None), u=("string", "https://a/b.tsx?q")) == "source"
    assert one(spark, P.decode_body(F.col("b"), F.lit("windows-1252")), b=("binary", b"\x93x\x94")) == "“x”"


def test_dom_tolerates(spark):
    html = '<ul><li>a<li><b>c</b></ul><p>x<p class="k m">y <a href="/z">z</a><table><tr><td>1<td>2</table><script>"</p>"</script>'
    nodes = dom.node_table(spark.createDataFrame([(1, html), (2, None), (3, "")], "page bigint, html string"))
    pick = lambda s: [r["text"] for r in dom.select(nodes, s).orderBy("pre").collect()]
    assert pick("ul > li") == ["a", "c"]
    assert pick("p") == ["x", "y z"]
    assert pick("p.m a[href]") == ["z"]
    assert pick("td:first-child, b") == ["c", "1"]
    assert pick("p + p") == ["y z"]
    with pytest.raises(ValueError):
        dom.select(nodes, "p::before")
    assert dom.xpath_to_css('//div[@id="a"]/p[contains(@class,"k")]') == 'div[id="a"] > p[class*="k"]'


def test_markdown_and_islands():
    root = dom.parse('<h1>T</h1><p>a <b>b</b> <a href="/x">l</a></p><ol><li>1<li>2</ol><pre><code>x &lt; y</code></pre><script type="application/ld+json">{"name":"N","articleBody":"A text that is long enough to be kept as useful."}</script><script type="application/json">{</script>')
    assert dom.to_markdown(root) == "# T\n\na **b** [l](/x)\n\n1. 1\n2. 2\n\n```\nx < y\n```"
    assert dom.data_islands(root) == [("json_ld", "N", "N\nA text that is long enough to be kept as useful.")]


def test_diff_lines():
    got = line_diff.diff_lines(["same", "old line one", "gone entirely"], ["old line two", "same", "new"])
    assert [(g[0], g[1], g[2]) for g in got] == [("changed", "old line one", "old line two"), ("removed", "gone entirely", None), ("added", None, "new")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab ", max_size=4), max_size=8), st.lists(st.text("ab ", max_size=4), max_size=8))
def test_diff_is_symmetric(a, b):
    count = lambda rows, kind: sum(r[0] == kind for r in rows)
    one_way, back = line_diff.diff_lines(a, b), line_diff.diff_lines(b, a)
    assert count(one_way, "added") + count(one_way, "changed") == count(back, "removed") + count(back, "changed")


def test_blocks():
    text = "x" * 500 + ". " + "y" * 600
    blocks = ranking.split_blocks(text, 490)
    assert blocks[0][1] == 501 and "".join(text[a:b] for a, b, _ in blocks) == text
    assert ranking.split_blocks("") == []


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1)], "src string, dst string, pos int")
    got = {r["url"]: (r["depth"], r["parent"]) for r in crawl.crawl_levels(edges, spark.createDataFrame([("a",)], "url string"), 5).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}


def test_cookies(spark):
    headers = spark.createDataFrame([("a.example", 1, "k=1; Path=/x"), ("a.example", 2, "k=2; Path=/x"), ("a.example", 3, "s=3; Domain=.example; Secure"), ("a.example", 4, "bad")], "host string, seq int, set_cookie string")
    urls = spark.createDataFrame([("u1", "a.example", "/x/y", True), ("u2", "b.example", "/", False)], "url string, host string, path string, https boolean")
    got = {(r["url"], r["name"], r["value"]) for r in state.cookies_for(state.cookie_jar(headers), urls).collect()}
    assert got == {("u1", "k", "2"), ("u1", "s", "3")}


def test_manifest(spark):
    m = {"name": "pkg", "urlPatterns": ["https://p.example/package/:name+/v/:version", "https://p.example/package/:name+"], "request": {"urlTemplate": "https://r.example/{{name|encodePathSegments}}/{{version|default:latest}}"}, "extract": {"n": "$.name", "first": "$.items[0].t|clean", "all": "$.items|pluck:t", "v": "{{version}}|emptyToUndefined", "x": "$.none||$.name"}, "throwIf": [{"path": "$.error", "message": "failed"}]}
    df = spark.createDataFrame([("https://p.example/package/@a/b/v/1.2", '{"name":"b","items":[{"t":" x &amp; y "},{"t":"z"}]}'), ("https://p.example/package/q", '{"error":"e"}'), ("https://o.example/", "{}")], "u string, j string").select("u", F.try_parse_json("j").alias("v"))
    c = manifest.compile_manifest(m, F.col("u"), F.col("v"))
    rows = df.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert rows[0]["request_url"] == "https://r.example/%40a/b/1.2" and rows[0]["first"] == "x & y" and rows[0]["v"] == "1.2" and rows[0]["x"] == "b" and rows[0]["all"] == [" x &amp; y ", "z"]
    assert rows[1]["error"] == "failed" and rows[1]["n"] is None and rows[1]["request_url"].endswith("/q/latest")
    assert rows[2]["matched"] is False
    assert manifest.validate({"name": "X"}) == ["name", "urlPatterns", "extract"]
    with pytest.raises(manifest.ManifestError):
        manifest.json_value(F.col("v"), "$..a")


def test_politeness(spark):
    log = spark.createDataFrame([("h", i, s) for i, s in enumerate([200, 429, 429, 200, 500])] + [("g", 0, 429)], "host string, seq bigint, status int")
    assert {r["host"]: r["limit"] for r in streams.politeness(log, 4).collect()} == {"h": 2, "g": 2}


def test_blocks_reach_for_gaps_and_stops():
    word = "w" * 9 + " "
    near = word * 52 + "end.\n\nNext" + word * 60
    (_, first, _), *_ = ranking.split_blocks(near)
    assert near[:first].endswith("end.\n\n")
    stop = word * 53 + "x. " + word * 80
    assert stop[: ranking.split_blocks(stop)[0][1]].endswith("x.")
    far = word * 70 + "x. " + word * 80
    assert ranking.split_blocks(far)[0][1] == 512
    # a gap wider than what is seen ahead doesn't count
    assert ranking.split_blocks("a" * 520 + "\n" + " " * 300 + "\n" + "b" * 900)[0][1] == 512
    assert ranking.split_blocks(" " * 2000) == [] and ranking.split_blocks("  a ") == [(0, 4, "  a ")]


def test_ranking_without_shuffle(spark):
    rows = [(1, ["alpha beta", "beta gamma", None, ""]), (2, None), (3, []), (1, ["alpha"])]
    df = spark.createDataFrame(rows, "doc bigint, blocks array<string>")
    top = ranking.cosine_top(df, "alpha", top=2)
    assert [(r["doc"], r["block"], r["rank"]) for r in top.collect()] == [(1, 0, 1), (1, 1, 2), (1, 0, 1)]
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    assert ranking.cosine_top(df, " ").count() == 0


def test_edit_distance_is_the_tables():
    import random

    from pagequern.operators.line_diff import edit_distance

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert edit_distance(a, b) == row[-1]
