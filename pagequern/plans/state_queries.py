"""Queries over state tables, graphs and site files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions import page as P
from pagequern.functions import url as U
from pagequern.operators import crawl, state
from pagequern.session import table



def _now():
    """A fixed time, so that results don't change from run to run."""
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


_NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def cache_asof(spark: SparkSession, base: str) -> DataFrame:
    """The newest scrape of each URL up to mid-2025, if it is at most 30 days old by then."""
    s = table(spark, base, "scrapes").select("url", "scrape_id", "fetched_at").withColumn("at", F.struct("fetched_at", "scrape_id"))
    then = F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")
    last = s.where(F.col("fetched_at") <= then).groupBy("url").agg(F.max("at").alias("m"))
    age = F.floor((F.unix_micros(then.cast("timestamp")) - F.unix_micros(F.col("m.fetched_at").cast("timestamp"))) / 1_000_000)
    return last.select("url", F.col("m.scrape_id").alias("scrape_id"), age.alias("age_seconds")).where("age_seconds <= 2592000")


def staleness_bucket(spark: SparkSession, base: str) -> DataFrame:
    age = P.age_seconds(F.col("fetched_at"), _now())
    d = table(spark, base, "documents").where("fetched_at IS NOT NULL")
    return d.groupBy(P.staleness(age, F.lit(86_400 * 90)).alias("bucket"), P.crawl_staleness(age).alias("crawl_bucket")).agg(F.count("*").alias("documents"), F.min(age).alias("youngest"))


def fresh_aggregate(spark: SparkSession, base: str) -> DataFrame:
    """Of each source the age of its oldest document, and whether any is past 180 days."""
    age = P.age_seconds(F.col("fetched_at"), _now())
    return table(spark, base, "documents").where("fetched_at IS NOT NULL").groupBy("source").agg(F.max(age).alias("oldest_seconds"), F.bool_or(age > 86_400 * 180).alias("any_stale"))


def recommended_action(spark: SparkSession, base: str) -> DataFrame:
    """A crawl per user of the events: its last event decides its status, its age what to do."""
    last = table(spark, base, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    kind = F.col("m.event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "done").when(kind == "signup", "paused").otherwise("running")
    age = P.age_seconds(F.col("m.ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return last.select("user_id", status.alias("status"), P.crawl_staleness(age).alias("staleness"), P.recommended_action(status, P.crawl_staleness(age)).alias("action"))


def crawl_list(spark: SparkSession, base: str) -> DataFrame:
    """The 20 newest scrapes of one site with an error status."""
    s = table(spark, base, "scrapes").where("url LIKE 'https://docs.brelvane.example/%' AND status_code >= 400")
    return s.orderBy(F.desc("stored_at"), "scrape_id").limit(20).select("scrape_id", "status_code", "url")


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The last snapshot of each URL and name, over all deliveries."""
    s = table(spark, base, "snapshots").select("url", F.coalesce("snapshot_name", F.lit("")).alias("name"), "snapshot_id", "taken_at", "delivery")
    return state.latest(s, ["url", "name"], ["taken_at", "snapshot_id"]).select("url", "name", "snapshot_id", "delivery")


def store_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Responses of the first half of 2025 with those of the second put over them, by URL."""
    s = table(spark, base, "scrapes").where("fetched_at IS NOT NULL").select("url", "scrape_id", "fetched_at", "sha256")
    first = state.latest(s.where("fetched_at < '2025-07-01'"), ["url"], ["fetched_at", "scrape_id"])
    second = state.latest(s.where("fetched_at >= '2025-07-01'"), ["url"], ["fetched_at", "scrape_id"])
    return state.upsert(first, second, ["url"], "fetched_at").select("url", "scrape_id", "sha256")


def state_delta(spark: SparkSession, base: str) -> DataFrame:
    """URLs to insert into and delete from the crawl state of delivery 1 to reach that of delivery 2."""
    s = table(spark, base, "snapshots")
    one, two = (s.where(F.col("delivery") == d).select("url").distinct() for d in (1, 2))
    return state.delta(one, two, ["url"])


def storage_stats(spark: SparkSession, base: str) -> DataFrame:
    """Stored texts by extension and first hex digit of their hash."""
    s = table(spark, base, "scrapes").where("text IS NOT NULL")
    return s.groupBy(P.extension_for(F.col("content_type")).alias("extension"), F.substring(F.sha2("text", 256), 1, 1).alias("shard")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


def batch_summary(spark: SparkSession, base: str) -> DataFrame:
    """Of each site: pages, failures, retryable ones and cache hits, with requests deduplicated by URL key."""
    s = table(spark, base, "scrapes").select("site", "status_code", U.url_key(F.col("url")).alias("k"))
    keyed = s.groupBy("site", "k").agg(F.count("*").alias("asked"), F.max("status_code").alias("status"))
    failed = F.coalesce(F.col("status") >= 400, F.lit(False))
    return keyed.groupBy("site").agg(F.sum("asked").alias("requests"), F.count("*").alias("fetched"), F.sum(F.col("asked") - 1).alias("cache_hits"), F.count_if(failed).alias("failed"), F.count_if(F.coalesce(P.retryable(F.col("status")), F.lit(False))).alias("retryable"))


def _links(snapshots: DataFrame) -> DataFrame:
    links = snapshots.select("delivery", U.url_key(F.col("url")).alias("src"), F.posexplode("links.url").alias("pos", "dst"))
    return links.where("dst IS NOT NULL").select("delivery", "src", "pos", U.url_key(F.col("dst")).alias("dst"))


def _edges(spark: SparkSession, base: str) -> DataFrame:
    return _links(table(spark, base, "snapshots"))


def _may_enter() -> Column:
    return crawl.admitted(F.col("dst"), F.col("src"), F.lit(1), exclude=["*-adapter-*"])


def frontier_admit(spark: SparkSession, base: str) -> DataFrame:
    """Links that may enter the frontier of their page's site, by delivery and page."""
    return _edges(spark, base).where(_may_enter()).groupBy("delivery", "src").agg(F.count_distinct("dst").alias("admitted"))


def best_first(spark: SparkSession, base: str) -> DataFrame:
    """The turn of every link of a page under best-first order, by delivery."""
    e = _edges(spark, base).select(F.struct("delivery", "src").alias("seed"), F.col("dst").alias("url"), F.lit(1).alias("depth"), F.col("pos").alias("seq"))
    return crawl.frontier_order(e, "best-first").select("seed.delivery", F.col("seed.src").alias("seed"), "url", "seq", "turn")


def crawl_bfs(spark: SparkSession, base: str) -> DataFrame:
    """Breadth-first levels over the links of all deliveries, counted by depth."""
    e = _edges(spark, base)
    over = crawl.crawl_levels(e.select("src", "dst", "pos"), e.select(F.col("src").alias("url")).distinct(), 1)
    return over.groupBy("depth").agg(F.count("*").alias("pages"))


def redirects(spark: SparkSession, base: str) -> DataFrame:
    """Chains of a small table: resolved, looping and too long ones."""
    hops = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]]
    return crawl.redirect_targets(spark.createDataFrame(hops, "url string, target string"))


def redirects_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Chains of the snapshots' redirects by URL key: of each URL its last one, over all deliveries."""
    s = table(spark, base, "snapshots").where("final_url IS NOT NULL").select(U.url_key(F.col("url")).alias("url"), U.url_key(F.col("final_url")).alias("target"), "taken_at", "snapshot_id")
    last = state.latest(s.where("url IS NOT NULL AND target IS NOT NULL"), ["url"], ["taken_at", "snapshot_id"])
    return crawl.redirect_targets(last.where("url <> target").select("url", "target"))


def context_parents(spark: SparkSession, base: str) -> DataFrame:
    """The nearest ancestor of each document URL among all document URLs and their site roots."""
    d = table(spark, base, "documents").where("url IS NOT NULL").select("url").distinct()
    roots = d.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("url")).distinct()
    return crawl.nearest_parent(d.unionByName(roots).distinct())


ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /tmp # old\nSitemap: https://a.example/s.xml\n\nUser-agent: other\nDisallow: /"
SITEMAP = "<urlset><url><loc>https://a.example/1</loc><lastmod>2025-01-01</lastmod></url><url><loc><![CDATA[https://a.example/2]]></loc></url></urlset><sitemapindex><sitemap><loc>https://a.example/more.xml</loc></sitemap></sitemapindex>"
LLMS = "# Site\n- [One](https://a.example/1): first\n- [Two](https://a.example/2)\nSee https://a.example/1 and https://a.example/3"


def site_files(spark: SparkSession, base: str) -> DataFrame:
    """Entries of a robots.txt, a sitemap and an llms.txt, and what the robots rules allow."""
    rules = crawl.robots_rules(spark.createDataFrame([("a.example", ROBOTS)], "host string, body string"))
    paths = spark.createDataFrame([(p, "a.example", p) for p in ("/", "/private/x", "/private/open/y", "/tmp/z")], "url string, host string, path string")
    allowed = crawl.robots_allowed(paths, rules).select(F.lit("robots").alias("source"), F.col("url").alias("entry"), F.col("allowed").cast("string").alias("detail"))
    maps = crawl.sitemap_entries(spark.createDataFrame([("s", SITEMAP)], "source string, body string")).select(F.col("kind").alias("source"), F.col("loc").alias("entry"), F.col("lastmod").alias("detail"))
    llms = crawl.llms_links(spark.createDataFrame([("l", LLMS)], "source string, body string")).select(F.lit("llms").alias("source"), F.col("url").alias("entry"), F.col("title").alias("detail"))
    return allowed.unionByName(maps).unionByName(llms)


def politeness_slots(spark: SparkSession, base: str) -> DataFrame:
    """When each scrape of a site would start with a second between requests."""
    s = table(spark, base, "scrapes").select("site", "scrape_id")
    return state.turn_windows(s, "site", "scrape_id", 1000)


def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Events by type and hour, with mean value (an extension: tumbling windows)."""
    e = table(spark, base, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "mean")


def event_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of each user with a gap of six hours (an extension: session windows)."""
    e = table(spark, base, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


QUERIES = {f.__name__: f for f in (cache_asof, staleness_bucket, fresh_aggregate, recommended_action, crawl_list, latest_snapshot, store_upsert, state_delta, storage_stats, batch_summary, frontier_admit, best_first, crawl_bfs, redirects, redirects_snapshots, context_parents, site_files, politeness_slots, event_windows, event_sessions)}

from pagequern.plans.snapshot_queries import KEYED  # noqa: E402


def _age(col: str, now: str = _NOW) -> str:
    return f"greatest(0, CAST(floor((epoch_us({now}) - epoch_us({col})) / 1000000.0) AS BIGINT))"


_CB = "CASE WHEN {0} < 86400 THEN 'fresh' WHEN {0} < 604800 THEN 'aging' WHEN {0} < 2592000 THEN 'stale' ELSE 'expired' END"
_EDGE = f"""WITH {KEYED}, raw AS (SELECT delivery, url_key AS src, unnest(list_transform(links, lambda x: x.url)) AS url, generate_subscripts(links, 1) - 1 AS pos FROM keyed),
{KEYED.replace('keyed AS', 'keyed2 AS').replace('FROM snapshots', 'FROM raw WHERE url IS NOT NULL')}, e AS (SELECT delivery, src, pos, url_key AS dst, site_host AS dhost, regexp_extract(src, '://([^/:?#]*)', 1) AS shost FROM keyed2)"""
_BF = """40 + CASE WHEN p IN ('', '/') OR regexp_matches(p, '^/index\\.\\w+$') THEN 5 WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) <= 1 THEN 3 ELSE 0 END + CASE WHEN contains(dst, '#') THEN 1 ELSE 0 END"""
ORACLES = {
    "cache_asof": "SELECT url, scrape_id, CAST(floor((epoch_us(TIMESTAMP '2025-07-01') - epoch_us(fetched_at)) / 1000000.0) AS BIGINT) AS age_seconds FROM (SELECT * FROM scrapes WHERE fetched_at <= TIMESTAMP '2025-07-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, scrape_id DESC) = 1) WHERE floor((epoch_us(TIMESTAMP '2025-07-01') - epoch_us(fetched_at)) / 1000000.0) <= 2592000",
    "staleness_bucket": f"SELECT CASE WHEN a < 7776000 * 0.5 THEN 'fresh' WHEN a < 7776000 THEN 'aging' WHEN a < 15552000 THEN 'stale' ELSE 'expired' END AS bucket, {_CB.format('a')} AS crawl_bucket, count(*) AS documents, min(a) AS youngest FROM (SELECT {_age('fetched_at')} AS a FROM documents WHERE fetched_at IS NOT NULL) GROUP BY ALL",
    "fresh_aggregate": f"SELECT source, max({_age('fetched_at')}) AS oldest_seconds, bool_or({_age('fetched_at')} > 15552000) AS any_stale FROM documents WHERE fetched_at IS NOT NULL GROUP BY source",
    "recommended_action": f"""WITH l AS (SELECT user_id, event_type AS k, {_age('ts', "TIMESTAMP '2024-02-01'")} AS a FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT user_id, CASE k WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'paused' ELSE 'running' END AS status, {_CB.format('a')} AS staleness FROM l)
SELECT *, CASE WHEN status IN ('running', 'paused') AND staleness NOT IN ('stale', 'expired') THEN 'resume' WHEN status = 'done' AND staleness IN ('fresh', 'aging') THEN 'reuse_results' WHEN status = 'done' THEN 'recrawl' WHEN status = 'error' AND staleness IN ('stale', 'expired') THEN 'discard' ELSE 'inspect' END AS action FROM m""",
    "crawl_list": "SELECT scrape_id, status_code, url FROM scrapes WHERE url LIKE 'https://docs.brelvane.example/%' AND status_code >= 400 ORDER BY stored_at DESC, scrape_id LIMIT 20",
    "latest_snapshot": "SELECT url, coalesce(snapshot_name, '') AS name, snapshot_id, delivery FROM snapshots QUALIFY row_number() OVER (PARTITION BY url, coalesce(snapshot_name, '') ORDER BY taken_at DESC, snapshot_id DESC) = 1",
    "store_upsert": "SELECT url, scrape_id, sha256 FROM scrapes WHERE fetched_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, scrape_id DESC) = 1",
    "state_delta": "WITH a AS (SELECT DISTINCT url FROM snapshots WHERE delivery = 1), b AS (SELECT DISTINCT url FROM snapshots WHERE delivery = 2) SELECT url, 'insert' AS op FROM b ANTI JOIN a USING (url) UNION ALL SELECT url, 'delete' AS op FROM a ANTI JOIN b USING (url)",
    "storage_stats": "SELECT CASE WHEN k LIKE '%html%' THEN '.html' WHEN k LIKE '%json%' THEN '.json' WHEN k LIKE '%markdown%' THEN '.md' WHEN k LIKE '%pdf%' THEN '.pdf' WHEN k LIKE 'text/%' THEN '.txt' ELSE '.bin' END AS extension, substr(sha256(text), 1, 1) AS shard, count(*) AS files, sum(strlen(text)) AS bytes FROM (SELECT text, lower(trim(string_split(content_type, ';')[1])) AS k FROM scrapes WHERE text IS NOT NULL) GROUP BY ALL",
    "batch_summary": f"WITH {KEYED.replace('FROM snapshots', 'FROM scrapes')}, k AS (SELECT site, coalesce(url_key, '') AS k, count(*) AS asked, max(status_code) AS status FROM keyed GROUP BY ALL) SELECT site, sum(asked) AS requests, count(*) AS fetched, sum(asked - 1) AS cache_hits, count(*) FILTER (status >= 400) AS failed, count(*) FILTER (status IN (408, 429, 500, 502, 503, 504)) AS retryable FROM k GROUP BY site",
    "frontier_admit": f"{_EDGE} SELECT delivery, src, count(DISTINCT dst) AS admitted FROM e WHERE dhost = shost AND NOT contains(dst, '-adapter-') GROUP BY ALL",
    "best_first": f"{_EDGE}, s AS (SELECT *, regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM e) SELECT delivery, src AS seed, dst AS url, pos AS seq, row_number() OVER (PARTITION BY delivery, src ORDER BY {_BF} DESC, pos, dst) AS turn FROM s",
    "crawl_bfs": f"{_EDGE}, seeds AS (SELECT DISTINCT src AS url FROM e) SELECT 0 AS depth, count(*) AS pages FROM seeds UNION ALL SELECT 1, n FROM (SELECT count(DISTINCT dst) AS n FROM e WHERE dst NOT IN (SELECT url FROM seeds)) WHERE n > 0",
    "redirects": """WITH RECURSIVE h(url, target) AS (VALUES ('a','b'),('b','c'),('x','y'),('y','x'),('s','s'),('n0','n1'),('n1','n2'),('n2','n3'),('n3','n4'),('n4','n5'),('n5','n6'),('n6','n7'),('n7','n8'),('n8','n9')),
r AS (SELECT url, target AS final, [url, target] AS path, 1 AS k FROM h UNION ALL SELECT r.url, h.target, list_append(r.path, h.target), k + 1 FROM r JOIN h ON h.url = r.final WHERE k < 6 AND r.url <> r.final AND NOT list_contains(r.path, h.target)),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY k DESC) = 1)
SELECT l.url, l.final, l.k AS hops, CASE WHEN l.url = l.final OR (n.target IS NOT NULL AND list_contains(l.path, n.target)) THEN 'loop' WHEN n.target IS NULL AND l.k < 6 THEN 'ok' ELSE 'limit' END AS status FROM l LEFT JOIN h n ON n.url = l.final""",
    "site_files": "SELECT * FROM (VALUES ('robots', '/', 'true'), ('robots', '/private/x', 'false'), ('robots', '/private/open/y', 'true'), ('robots', '/tmp/z', 'false'), ('url', 'https://a.example/1', '2025-01-01'), ('url', 'https://a.example/2', NULL), ('sitemap', 'https://a.example/more.xml', NULL), ('llms', 'https://a.example/1', 'One'), ('llms', 'https://a.example/2', 'Two'), ('llms', 'https://a.example/3', NULL)) t(source, entry, detail)",
    "context_parents": """WITH d AS (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL), u AS (SELECT url FROM d UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) FROM d), k AS (SELECT url, regexp_replace(url, '/+$', '') AS p FROM u)
SELECT a.url, arg_max(b.url, length(b.p)) FILTER (b.url IS NOT NULL) AS parent FROM k a LEFT JOIN k b ON starts_with(a.p, b.p || '/') GROUP BY a.url""",
    "politeness_slots": "SELECT site, scrape_id, (row_number() OVER (PARTITION BY site ORDER BY scrape_id) - 1) * 1000 AS slot_ms FROM scrapes",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}
