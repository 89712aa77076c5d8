"""Queries of page heads, other markups, extraction actions, context packages and API symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions import markup as M
from pagequern.functions import text as T
from pagequern.operators import extract as E
from pagequern.session import table

HEAD = '<meta http-equiv="refresh" content="5"><meta http-equiv="Refresh" content="0; URL=/next"><link rel="alternate" type="text/markdown" href="/a.md"><link rel="stylesheet" href="/s.css"><a rel="alternate" href="b.html">b</a>'
RST = "Title\n=====\n\ntext\n\nPart one\n--------\nno\n--\n"
MDX = 'import X from "x"\n\n<Card title="a">\n\n# Head\n<Tabs.Item/>\n'


def head_links(spark: SparkSession, base: str) -> DataFrame:
    """Refresh and alternates of a small head; agent addresses of it."""
    d = spark.createDataFrame([(HEAD, "https://s.example/d/p.html")], "html string, url string")
    r = M.meta_refresh(F.col("html"), F.col("url"))
    a = M.alternates(F.col("html"), F.col("url"))
    rows = d.select(F.lit("refresh").alias("kind"), r["url"].alias("target"), (r["delay"] == 0).alias("flag"))
    alt = d.select(F.explode(a).alias("a")).select(F.lit("alternate").alias("kind"), F.col("a.url").alias("target"), F.col("a.agent").alias("flag"))
    agents = d.select(F.lit("agent").alias("kind"), F.explode(M.agent_urls(F.col("url"))).alias("target"), F.lit(True).alias("flag"))
    best = d.select(F.lit("picked").alias("kind"), M.pick_alternate(a, ["text/html", "text/"]).alias("target"), F.lit(True).alias("flag"))
    return rows.unionByName(alt).unionByName(agents).unionByName(best)


def head_links_pages(spark: SparkSession, base: str) -> DataFrame:
    """Refresh and alternates of every page."""
    d = table(spark, base, "pages").where("html IS NOT NULL")
    r = M.meta_refresh(F.col("html"), F.col("url"))
    rows = d.select("page_id", F.lit("refresh").alias("kind"), r["url"].alias("target"), (r["delay"] == 0).alias("flag")).where("target IS NOT NULL")
    alt = d.select("page_id", F.explode(M.alternates(F.col("html"), F.col("url"))).alias("a"))
    return rows.unionByName(alt.select("page_id", F.lit("alternate").alias("kind"), F.col("a.url").alias("target"), F.col("a.agent").alias("flag")))


def other_markups(spark: SparkSession, base: str) -> DataFrame:
    d = spark.createDataFrame([(RST, MDX)], "rst string, mdx string")
    heads = d.select(F.explode(M.rst_headings(F.col("rst"))).alias("h")).select(F.lit("rst").alias("kind"), F.col("h.text").alias("name"), F.col("h.line").alias("line"))
    parts = d.select(F.posexplode(M.mdx_components(F.col("mdx"))).alias("line", "name")).select(F.lit("mdx").alias("kind"), "name", "line")
    plain = d.select(F.lit("stripped").alias("kind"), T.clean_text(T.strip_mdx(F.col("mdx"))).alias("name"), F.lit(0).alias("line"))
    return heads.unionByName(parts).unionByName(plain)


def llm_render(spark: SparkSession, base: str) -> DataFrame:
    """Each scrape as text for a model, with its site and charset as metadata; hashed."""
    s = table(spark, base, "scrapes")
    meta = F.map_filter(F.create_map(F.lit("site"), F.col("site"), F.lit("charset"), F.col("charset")), lambda k, v: v.isNotNull())
    out = M.llm_text(F.col("title"), F.lit(None).cast("string"), F.col("text"), meta)
    return s.select("scrape_id", F.sha2(M.rendered("llm", F.col("text"), F.col("text"), F.col("raw_text"), out), 256).alias("hash"))


def pattern_matches(spark: SparkSession, base: str) -> DataFrame:
    """Addresses in the documents, each once, in order, with their number."""
    d = table(spark, base, "documents").where("text IS NOT NULL")
    m = M.regex_matches(F.col("text"), r"https?://[a-z]+\.example/[a-z0-9/-]+", ["-"], sort=True, limit=5)
    return d.select("doc_id", F.array_join(m, " ").alias("links")).where("links <> ''")


def extract_selector(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "pages").select(F.col("page_id").alias("page"), "url", "html", F.col("readable_text").alias("text"))
    return E.extract(p, selector="h2", limit=3)


def extract_cosine(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "pages").where("readable_text IS NOT NULL").select(F.col("page_id").alias("page"), "url", "html", F.col("readable_text").alias("text"))
    return E.extract(p, query="compressed queue", top=2, least=0.01).select("page", "block", "rank")


def context_packages(spark: SparkSession, base: str) -> DataFrame:
    """Excerpts of each source's documents within 50 KiB a source."""
    d = table(spark, base, "documents").where("text IS NOT NULL AND url IS NOT NULL").groupBy(F.col("source").alias("package"), "url").agg(F.min_by("text", "doc_id").alias("text"))
    return E.context_package(d).groupBy("package").agg(F.count("*").alias("entries"), F.sum(F.octet_length("excerpt") + F.octet_length("url") + F.octet_length("label")).alias("bytes"))


def api_symbols(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").where("kind = 'api' AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    return E.api_symbols(d).select(F.col("doc").alias("doc_id"), "symbol", "kind", "line")


def operation_search(spark: SparkSession, base: str) -> DataFrame:
    from pagequern.plans import catalog

    rows = [(k, (f.__doc__ or "").strip()) for k, f in sorted(catalog.QUERIES.items())]
    return E.search_operations(spark.createDataFrame(rows, "name string, description string"), "links page").select("name", "score")


def source_resolution(spark: SparkSession, base: str) -> DataFrame:
    d = spark.createDataFrame([(1, "a", None, None), (2, None, None, None), (3, "a", "u", None), (4, None, None, "r")], "id int, content string, url string, response string")
    return E.resolve_source(d).select("id", "error")


QUERIES = {f.__name__: f for f in (head_links, head_links_pages, other_markups, llm_render, pattern_matches, extract_selector, extract_cosine, context_packages, api_symbols, operation_search, source_resolution)}
ORACLES = {
    "head_links": "SELECT * FROM (VALUES ('refresh', 'https://s.example/next', true), ('alternate', 'https://s.example/a.md', true), ('alternate', 'https://s.example/d/b.html', false), ('agent', 'https://s.example/d/p.html.md', true), ('agent', 'https://s.example/llms.txt', true), ('picked', 'https://s.example/a.md', true)) t(kind, target, flag)",
    "other_markups": "SELECT * FROM (VALUES ('rst', 'Title', 1), ('rst', 'Part one', 6), ('mdx', 'Card', 0), ('mdx', 'Tabs.Item', 1), ('stripped', '# Head', 0)) t(kind, name, line)",
    "llm_render": "SELECT scrape_id, sha256(concat_ws(chr(10) || chr(10), '# ' || nullif(title, ''), nullif(text, ''), CASE WHEN site IS NOT NULL OR charset IS NOT NULL THEN 'Metadata:' || chr(10) || concat_ws(chr(10), 'charset: ' || charset, 'site: ' || site) END)) AS hash FROM scrapes",
    "pattern_matches": r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, 'https?://[a-z]+\.example/[a-z0-9/-]+'), lambda x: contains(x, '-'))))[1:5], ' ') AS links FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_extract_all(text, 'https?://[a-z]+\.example/[a-z0-9/-]+'), lambda x: contains(x, '-'))) > 0",
    "api_symbols": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE kind = 'api' AND text IS NOT NULL)), h AS (SELECT doc_id, no, trim(regexp_replace(line, '^#+\s+|\s*#*$', '', 'g')) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S'))
SELECT doc_id, regexp_extract(title, '`?(?:class\s+|function\s+)?([A-Za-z_$][\w.$]*)\s*(\(|`)', 1) AS symbol, CASE WHEN regexp_matches(title, '`?class\s') THEN 'class' WHEN contains(title, '(') THEN 'function' ELSE 'value' END AS kind, no AS line FROM h WHERE regexp_extract(title, '`?(?:class\s+|function\s+)?([A-Za-z_$][\w.$]*)\s*(\(|`)', 1) <> ''""",
    "source_resolution": "SELECT * FROM (VALUES (1, NULL), (2, 'EXTRACT_INPUT_MISSING'), (3, 'EXTRACT_SOURCE_AMBIGUOUS'), (4, NULL)) t(id, error)",
}
