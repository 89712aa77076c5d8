"""Queries over pages: profile, links, headings, metadata, routes, signals, URL trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions import page as P
from pagequern.functions import text as T
from pagequern.functions import url as U
from pagequern.session import table

_A = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
_H = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"


def _inner(html):
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def page_profile(spark: SparkSession, base: str) -> DataFrame:
    """Normal URL, title, counts of links and headings, visible characters and their token estimate."""
    pages = table(spark, base, "pages")
    seen = P.visible_text(F.col("html"))
    return pages.select(
        "page_id",
        U.normalize_url(F.col("url")).alias("normal_url"),
        P.title_of(F.col("html")).alias("title"),
        F.regexp_count("html", F.lit(_A)).alias("links"),
        F.regexp_count("html", F.lit(_H)).alias("headings"),
        F.length(seen).alias("visible_chars"),
        T.token_estimate(seen).alias("tokens"),
    )


def url_normalize(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "snapshots").select("snapshot_id", U.normalize_url(F.col("url")).alias("normal_url"))


def page_links(spark: SparkSession, base: str) -> DataFrame:
    """Every link of a page in order, resolved against the page's URL."""
    found = table(spark, base, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_A.replace("(.*?)</a>", ".*?</a>").replace('([^"]*)', '[^"]*')), F.lit(0))).alias("pos", "tag"))
    href = F.regexp_extract("tag", 'href="([^"]*)"', 1)
    return found.select("page_id", "pos", href.alias("href"), U.absolute_url(href, F.col("url")).alias("target"), _inner(F.regexp_replace("tag", "^<a[^>]*>|</a>$", "")).alias("label"))


def page_headings(spark: SparkSession, base: str) -> DataFrame:
    found = table(spark, base, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_H.replace("([1-6])", "[1-6]").replace("(.*?)", ".*?")), F.lit(0))).alias("pos", "tag"))
    return found.select("page_id", "pos", F.substring("tag", 3, 1).cast("int").alias("level"), _inner(F.col("tag")).alias("heading"))


def page_title_meta(spark: SparkSession, base: str) -> DataFrame:
    html = F.col("html")
    return table(spark, base, "pages").select("page_id", P.title_of(html).alias("title"), F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("lang"), P.meta_content(html, "description").alias("description"))


def content_route(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "scrapes").select("scrape_id", P.content_route(F.col("content_type"), F.col("url")).alias("route"), P.charset_of(F.col("content_type")).alias("declared"))


def page_signals(spark: SparkSession, base: str) -> DataFrame:
    """Signals of the scrapes' texts, with the stored HTML length."""
    s = table(spark, base, "scrapes").where("text IS NOT NULL AND signals IS NOT NULL")
    full = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))
    signals = P.page_signals(F.col("text"), F.col("signals.html_length"), F.col("status_code"), full, F.col("text"), F.col("signals.data_island_text_length"))
    return s.select("scrape_id", signals.alias("x")).select("scrape_id", F.round("x.density", 6).alias("density"), "x.sparse", "x.spa", "x.blocked", "x.try_readable", "x.try_browser", F.array_join("x.reasons", ",").alias("reasons"))


def url_tree(spark: SparkSession, base: str) -> DataFrame:
    """URLs of each host grouped by their first path segment; the longest lists stay distributed as counts,
    with the first and last URL in order."""
    u = table(spark, base, "snapshots").select(U.url_key(F.col("url")).alias("u")).distinct()
    section = F.coalesce(F.try_element_at(U.path_segments(F.col("u")), F.lit(1)), F.lit("/"))
    return u.groupBy(U.host(F.col("u")).alias("host"), section.alias("section")).agg(F.count("*").alias("urls"), F.min("u").alias("first_url"), F.max("u").alias("last_url"))


def url_safety(spark: SparkSession, base: str) -> DataFrame:
    """Addresses of a list of literals and of all scrapes that may be fetched or not, with the reason."""
    literals = ["http://localhost/a", "http://10.1.2.3/", "http://172.20.0.1/x", "http://192.168.1.1", "http://169.254.169.254/latest", "ftp://a.example/x", "http://8.8.8.8/", "http://printer.local/", "not a url", "http://100.64.0.1/", "http://[::1]/", "http://203.0.113.9/"]
    lit = spark.createDataFrame([(x,) for x in literals], "url string")
    urls = table(spark, base, "scrapes").select("url").distinct().unionByName(lit)
    return urls.select("url", U.url_safety(F.col("url")).alias("verdict"))


def landmark_counts(spark: SparkSession, base: str) -> DataFrame:
    tags = ["main", "nav", "header", "footer", "aside", "article", "section", "form"]
    return table(spark, base, "pages").select("page_id", *[F.regexp_count("html", F.lit(rf"(?i)<{t}[\s>]")).alias(t) for t in tags])


def path_labels(spark: SparkSession, base: str) -> DataFrame:
    """Label and breadcrumb depth of each document's URL."""
    u = F.col("url")
    return table(spark, base, "documents").where("url IS NOT NULL").select("doc_id", U.url_label(u).alias("label"), F.size(U.path_segments(u)).alias("depth"), P.safe_name(U.url_label(u)).alias("safe_label"))


QUERIES = {f.__name__: f for f in (page_profile, url_normalize, page_links, page_headings, page_title_meta, content_route, page_signals, url_tree, url_safety, landmark_counts, path_labels)}

from pagequern.plans.snapshot_queries import KEYED  # noqa: E402

_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<template\b[^>]*>.*?</template>|<!--.*?-->', ' ', 'g'), '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_AS = _A.replace("'", "''")
_META = "nullif(trim(regexp_extract(html, '(?is)<meta[^>]*(?:name|property)=[\"'']?{}[\"'']?[^>]*content=\"([^\"]*)\"', 1)), '')"
_PATH = r"regexp_extract({}, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]*)([^?#]*)', 3)"
_SEG = "list_filter(string_split(" + _PATH + ", '/'), lambda x: x <> '')"
_PATHKIND = "regexp_replace(lower(coalesce(url, '')), '[?#].*$', '')"
ORACLES = {
    "page_profile": f"WITH {KEYED.replace('FROM snapshots', 'FROM pages')} SELECT page_id, url_key AS normal_url, coalesce({_TITLE}, {_META.format('title')}, {_META.format('og:title')}) AS title, len(regexp_extract_all(html, '{_AS}')) AS links, len(regexp_extract_all(html, '{_H}')) AS headings, length({_VISIBLE}) AS visible_chars, CAST(ceil(length({_VISIBLE}) / 4.0) AS INTEGER) AS tokens FROM keyed",
    "url_normalize": f"WITH {KEYED} SELECT snapshot_id, url_key AS normal_url FROM keyed",
    "page_headings": f"""SELECT page_id, pos - 1 AS pos, CAST(substr(tag, 3, 1) AS INTEGER) AS level, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS heading
FROM (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS t FROM pages WHERE html IS NOT NULL))""",
    "page_links": f"""SELECT page_id, pos - 1 AS pos, href, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[^:]+://[^/?#]*') || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href ELSE NULL END AS target,
trim(regexp_replace(regexp_replace(regexp_replace(tag, '^<a[^>]*>|</a>$', '', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS label
FROM (SELECT page_id, url, tag, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, url, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?href="[^"]*"[^>]*>.*?</a>') AS t FROM pages WHERE html IS NOT NULL)))""",
    "page_title_meta": f"SELECT page_id, coalesce({_TITLE}, {_META.format('title')}, {_META.format('og:title')}) AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang=[\"'']?([A-Za-z-]+)', 1), '') AS lang, {_META.format('description')} AS description FROM pages",
    "content_route": f"""SELECT scrape_id, CASE WHEN k = 'application/pdf' OR p LIKE '%.pdf' THEN 'pdf' WHEN k IN ('text/html', 'application/xhtml+xml') OR p LIKE '%.html' THEN 'html' WHEN p LIKE '%.mdx' THEN 'mdx' WHEN k LIKE '%markdown%' OR regexp_matches(p, '\\.(md|markdown)$') THEN 'markdown' WHEN p LIKE '%.rst' THEN 'rst'
WHEN regexp_matches(p, '\\.([cm]?[jt]sx?|py|rs)$') THEN 'source' WHEN k LIKE '%json%' OR p LIKE '%.json' THEN 'json' WHEN k LIKE '%svg%' OR p LIKE '%.svg' THEN 'svg' WHEN k LIKE '%xml%' OR p LIKE '%.xml' THEN 'xml' WHEN k LIKE 'text/%' OR p LIKE '%.txt' THEN 'text' ELSE 'binary' END AS route,
nullif(replace(lower(regexp_extract(content_type, '(?i)charset=["'']?([^;"''\\s]+)', 1)), '_', '-'), '') AS declared FROM (SELECT scrape_id, content_type, lower(trim(string_split(coalesce(content_type, ''), ';')[1])) AS k, {_PATHKIND} AS p FROM scrapes)""",
    "page_signals": """WITH b AS (SELECT scrape_id, length(text) AS n, signals.html_length AS h, signals.data_island_text_length AS d, coalesce(status_code IN (401,403,407,409,418,429,503), false) OR regexp_matches(coalesce(title, '') || chr(10) || text, '(?i)captcha|cloudflare|access denied|temporarily blocked|unusual traffic|verify you are human') AS blocked,
regexp_matches(text, '(?i)id=["''](?:root|app|__next)["'']|data-reactroot|enable javascript|javascript is required') OR regexp_matches(text, '__NEXT_DATA__|window\\.__INITIAL_STATE__') AS spa FROM scrapes WHERE text IS NOT NULL AND signals IS NOT NULL),
c AS (SELECT *, CASE WHEN h > 0 THEN n / h ELSE 0.0 END AS density FROM b), e AS (SELECT *, n < 200 OR density < 0.03 AS sparse FROM c)
SELECT scrape_id, round(density, 6) AS density, sparse, spa, blocked, NOT blocked AND (sparse OR n < 800) AND h > 0 AS try_readable, (spa AND sparse AND d < 200) OR (blocked AND sparse) AS try_browser,
array_to_string(list_filter([CASE WHEN blocked THEN 'blocked_signal' END, CASE WHEN spa THEN 'spa_marker' END, CASE WHEN sparse THEN 'sparse_dom' END, CASE WHEN d > n THEN 'rich_data_islands' END], lambda x: x IS NOT NULL), ',') AS reasons FROM e""",
    "url_tree": f"WITH {KEYED}, u AS (SELECT DISTINCT url_key AS u, site_host FROM keyed) SELECT site_host AS host, coalesce(({_SEG.format('u')})[1], '/') AS section, count(*) AS urls, min(u) AS first_url, max(u) AS last_url FROM u GROUP BY ALL",
    "landmark_counts": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[\\s>]')) AS {t}" for t in ["main", "nav", "header", "footer", "aside", "article", "section", "form"]) + " FROM pages",
    "path_labels": f"SELECT doc_id, coalesce(({_SEG.format('url')})[-1], regexp_extract(url, '://([^/:?#]*)', 1)) AS label, len({_SEG.format('url')}) AS depth, regexp_replace(coalesce(({_SEG.format('url')})[-1], regexp_extract(url, '://([^/:?#]*)', 1)), '[^A-Za-z0-9._-]', '_', 'g') AS safe_label FROM documents WHERE url IS NOT NULL",
    "url_safety": "WITH l AS (SELECT unnest(['http://localhost/a','http://10.1.2.3/','http://172.20.0.1/x','http://192.168.1.1','http://169.254.169.254/latest','ftp://a.example/x','http://8.8.8.8/','http://printer.local/','not a url','http://100.64.0.1/','http://[::1]/','http://203.0.113.9/']) AS url, unnest(['local_host','private_address','private_address','private_address','private_address','scheme','ok','local_host','invalid_url','private_address','private_address','private_address']) AS verdict) SELECT DISTINCT url, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'invalid_url' ELSE 'ok' END AS verdict FROM scrapes UNION ALL SELECT url, verdict FROM l",
}
