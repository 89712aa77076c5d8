"""Queries of change summaries, merges and decisions about pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions import decide as D
from pagequern.functions import markup as M
from pagequern.functions import page as P
from pagequern.functions import url as U
from pagequern.operators import changes
from pagequern.plans.snapshot_queries import KEYED
from pagequern.session import table

NO_PROXY = "docs.brelvane.example, .example.org, console.example:443"


def snapshot_summary(spark: SparkSession, base: str) -> DataFrame:
    """What changed in each snapshot against the one of the same URL and name in the delivery before."""
    kept = F.struct("title", "content_hash", "normalized_hash", "paragraphs", F.col("links.url").alias("links"))
    s = table(spark, base, "snapshots").groupBy("url", F.coalesce("snapshot_name", F.lit("")).alias("name"), "delivery").agg(F.max_by(kept, F.struct("taken_at", "snapshot_id")).alias("x"), F.max(F.struct("taken_at", "snapshot_id"))["snapshot_id"].alias("id"))
    before = s.select("url", "name", (F.col("delivery") + 1).alias("delivery"), F.col("x").alias("previous"))
    return changes.change_summary(s.join(before, ["url", "name", "delivery"]).select("id", "previous", F.col("x").alias("current"))).withColumnRenamed("id", "snapshot_id")


def page_parts(spark: SparkSession, base: str) -> DataFrame:
    """Headings and paragraphs that a snapshot of each page would hold."""
    h, p = D.headings_of(F.col("markdown")), D.paragraphs_of(F.col("markdown"))
    return table(spark, base, "pages").where("markdown IS NOT NULL").select("page_id", F.array_join(h, "|").alias("headings"), F.size(p).alias("paragraphs"), F.sha2(F.array_join(p, "\n"), 256).alias("hash"))


def readable_better(spark: SparkSession, base: str) -> DataFrame:
    """Pages whose stored readable text should replace one of half their markdown's length."""
    p = table(spark, base, "pages").where("html IS NOT NULL")
    return p.select("page_id", D.readable_is_better(F.col("readable_ok"), F.col("readable_text"), F.length("markdown") / 2).alias("better"))


def proxy_bypass(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "scrapes").where("url IS NOT NULL")
    return s.groupBy(U.host(F.col("url")).alias("host")).agg(F.count_if(D.bypasses_proxy(F.col("url"), NO_PROXY)).alias("direct"), F.count("*").alias("requests"))


def finished_results(spark: SparkSession, base: str) -> DataFrame:
    """Documents as results of at most 50,000 characters."""
    r = D.finish_result(F.col("text"))
    return table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", F.length(r["text"]).alias("chars"), r["truncated"].alias("truncated"))


def result_sources(spark: SparkSession, base: str) -> DataFrame:
    """What each snapshot's result is looked up by: its response, or else its URL."""
    by = D.result_source(F.lit(None).cast("string"), F.col("response_id"), F.col("url"))
    return table(spark, base, "snapshots").groupBy(by.alias("source")).agg(F.count("*").alias("results"))


def alternate_decisions(spark: SparkSession, base: str) -> DataFrame:
    """Whether each page's markdown sibling should be fetched in its place."""
    p = table(spark, base, "pages").where("url IS NOT NULL")
    chars = F.coalesce(F.length("readable_text"), F.lit(0))
    sibling = M.agent_urls(F.col("url"))[0]
    return p.select("page_id", D.follow_alternate(sibling, F.col("url"), F.lit("html"), chars).alias("follow"), D.follow_alternate(sibling, F.col("url"), F.lit("html"), chars, prefer=True).alias("prefer"), P.should_follow_refresh(F.lit(3), F.lit(0), sibling, F.col("url"), chars).alias("refresh"))


def agent_addresses(spark: SparkSession, base: str) -> DataFrame:
    """Where each page's text for agents may lie."""
    a = M.agent_urls(F.col("url"))
    return table(spark, base, "pages").where("url IS NOT NULL").select("page_id", a[0].alias("sibling"), a[1].alias("llms"))


def merged_states(spark: SparkSession, base: str) -> DataFrame:
    """All deliveries merged by URL key, a later one overwriting."""
    s = table(spark, base, "snapshots")
    return changes.last_wins(s, U.url_key(F.col("url")), ["delivery", "taken_at", "snapshot_id"], ["snapshot_id", "delivery"]).withColumnRenamed("key", "url_key")


def response_lists(spark: SparkSession, base: str) -> DataFrame:
    """Each URL's response ids, each once, in the order in which they came."""
    s = table(spark, base, "snapshots")
    found = changes.unique_append(s, F.col("url"), "response_id", "snapshot_id")
    return found.select(F.col("key").alias("url"), F.array_join("values", " ").alias("responses"))


def matched_fields(spark: SparkSession, base: str) -> DataFrame:
    """In how many scrapes title, text, raw text and URL hold a word."""
    return changes.field_matches(table(spark, base, "scrapes"), ["title", "text", "raw_text", "url"], "Record")


QUERIES = {f.__name__: f for f in (snapshot_summary, page_parts, readable_better, proxy_bypass, finished_results, result_sources, alternate_decisions, agent_addresses, merged_states, response_lists, matched_fields)}

_L = "list_filter(coalesce({0}, []), lambda x: x IS NOT NULL)"
_LESS = "least(25, len(list_filter(list_distinct({0}), lambda x: NOT list_contains({1}, x))))"
_PAGES = KEYED.replace("FROM snapshots", "FROM pages WHERE url IS NOT NULL")
_SIB = "regexp_extract(url_key, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN regexp_extract(url_key, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/index' ELSE regexp_replace(regexp_extract(url_key, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') END || '.md'"
ORACLES = {
    "snapshot_summary": f"""WITH l AS (SELECT url, coalesce(snapshot_name, '') AS name, delivery, snapshot_id, title, content_hash AS ch, normalized_hash AS nh, {_L.format('paragraphs')} AS p, {_L.format('list_transform(links, lambda y: y.url)')} AS k FROM snapshots
QUALIFY row_number() OVER (PARTITION BY url, coalesce(snapshot_name, ''), delivery ORDER BY taken_at DESC, snapshot_id DESC) = 1)
SELECT c.snapshot_id, {_LESS.format('c.k', 'b.k')} AS links_added, {_LESS.format('b.k', 'c.k')} AS links_removed,
CASE WHEN b.title IS NULL AND c.title IS NOT NULL THEN 'title:added' WHEN b.title IS NOT NULL AND c.title IS NULL THEN 'title:removed' WHEN b.title <> c.title THEN 'title:changed' ELSE '' END AS metadata,
b.ch IS DISTINCT FROM c.ch AND b.nh IS NOT DISTINCT FROM c.nh AS unchanged_after_normalization,
b.ch IS DISTINCT FROM c.ch AND list_sort(list_filter(b.p, lambda x: x <> '')) = list_sort(list_filter(c.p, lambda x: x <> '')) AS hash_only_change
FROM l c JOIN l b ON b.url = c.url AND b.name = c.name AND b.delivery + 1 = c.delivery""",
    "page_parts": r"""WITH l AS (SELECT page_id, string_split(markdown, chr(10)) AS x FROM pages WHERE markdown IS NOT NULL),
q AS (SELECT page_id, list_transform(list_filter(x, lambda y: regexp_matches(y, '^#{1,6}\s+\S')), lambda y: trim(regexp_replace(y, '^#{1,6}\s+', '')))[1:100] AS h, list_filter(x, lambda y: NOT regexp_matches(y, '^#{1,6}\s+') AND length(y) >= 24)[1:100] AS p FROM l)
SELECT page_id, coalesce(array_to_string(h, '|'), '') AS headings, len(p) AS paragraphs, sha256(coalesce(array_to_string(p, chr(10)), '')) AS hash FROM q""",
    "readable_better": "SELECT page_id, coalesce(readable_ok AND readable_text <> '' AND length(readable_text) >= greatest(250, length(markdown) / 2.0 * 1.15), false) AS better FROM pages WHERE html IS NOT NULL",
    "proxy_bypass": r"WITH h AS (SELECT lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)', 1)) AS host, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch, regexp_extract(url, '://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS port FROM scrapes WHERE url IS NOT NULL) SELECT host, count(*) FILTER (host = 'docs.brelvane.example' OR host LIKE '%.docs.brelvane.example' OR host = 'example.org' OR host LIKE '%.example.org' OR ((host = 'console.example' OR host LIKE '%.console.example') AND (port = '443' OR (port = '' AND sch = 'https')))) AS direct, count(*) AS requests FROM h GROUP BY host",
    "finished_results": "SELECT doc_id, least(length(text), 50000) AS chars, length(text) > 50000 AS truncated FROM documents WHERE text IS NOT NULL",
    "result_sources": "SELECT CASE WHEN response_id <> '' THEN 'response' WHEN url <> '' THEN 'snapshot' END AS source, count(*) AS results FROM snapshots GROUP BY 1",
    "alternate_decisions": "SELECT page_id, coalesce(length(readable_text), 0) < 100 AS follow, true AS prefer, coalesce(length(readable_text), 0) < 100 AS refresh FROM pages WHERE url IS NOT NULL",
    "agent_addresses": f"WITH {_PAGES} SELECT page_id, {_SIB} AS sibling, regexp_extract(url_key, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || '/llms.txt' AS llms FROM keyed",
    "merged_states": f"WITH {KEYED} SELECT coalesce(url_key, '') AS url_key, snapshot_id, delivery FROM keyed QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY delivery DESC, taken_at DESC NULLS LAST, snapshot_id DESC) = 1",
    "response_lists": "SELECT url, array_to_string(list(v ORDER BY o), ' ') AS responses FROM (SELECT url, response_id AS v, min(snapshot_id) AS o FROM snapshots WHERE response_id IS NOT NULL GROUP BY ALL) GROUP BY url",
    "matched_fields": "SELECT unnest(['title', 'text', 'raw_text', 'url']) AS field, unnest([count(*) FILTER (contains(lower(title), 'record')), count(*) FILTER (contains(lower(text), 'record')), count(*) FILTER (contains(lower(raw_text), 'record')), count(*) FILTER (contains(lower(url), 'record'))]) AS matches FROM scrapes",
}
