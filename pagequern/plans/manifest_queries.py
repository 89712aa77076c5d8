"""Queries of manifests, JSON walks, grounding, docstrings and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.operators import dom, manifest
from pagequern.session import table
from pagequern.streaming import streams

EVENT = {"name": "event-props", "urlPatterns": ["https://api.example/users/:user/:kind"], "request": {"urlTemplate": "https://api.example/v1/{{user|encodeURIComponent}}?t={{kind|default:view}}"}, "extract": {"k": "$.k|number", "user": "{{user}}", "kind": "{{kind}}|truncate:4", "label": "$.missing||$.k||none"}}


def manifest_project(spark: SparkSession, base: str) -> DataFrame:
    """A manifest run over the events' JSON, with made-up addresses."""
    e = table(spark, base, "events").select("event_id", F.concat(F.lit("https://api.example/users/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("url"), F.try_parse_json("props").alias("v"))
    c = manifest.compile_manifest(EVENT, F.col("url"), F.col("v"))
    return e.select("event_id", *[c[k].alias(k) for k in ("matched", "request_url", "k", "user", "kind", "label")])


def url_captures(spark: SparkSession, base: str) -> DataFrame:
    """Section and slug of the documents' addresses by a URL pattern."""
    matched, got = manifest.captures(F.col("url"), ["https://:source.example/:section/:slug"])
    return table(spark, base, "documents").where("url IS NOT NULL").select("doc_id", matched.alias("matched"), *[v.alias(k) for k, v in got.items()])


def _walked(snapshots: DataFrame) -> DataFrame:
    s = snapshots.select(F.col("snapshot_id").alias("id"), F.to_json(F.struct("links")).alias("json"))
    found = manifest.json_walk(s, ["text"], {"href": "url", "label": "text"}, dedupe_by="href")
    return found.select(F.col("id").alias("snapshot_id"), "pos", F.col("emitted")["href"].alias("href"))


def json_walk(spark: SparkSession, base: str) -> DataFrame:
    """Objects of the snapshots' links, as JSON, that have a text."""
    return _walked(table(spark, base, "snapshots"))


def grounding(spark: SparkSession, base: str) -> DataFrame:
    """Titles of scrapes looked for in their own texts."""
    s = table(spark, base, "scrapes").where("title IS NOT NULL").select(F.col("scrape_id").alias("id"), F.to_json(F.struct("title")).alias("json"), F.col("text").alias("source"))
    return manifest.grounded_fields(s).select(F.col("id").alias("scrape_id"), "field", F.col("start").isNotNull().alias("grounded"))


_SOURCE = '/**\n * Adds.\n * @param {number} a first\n * @param b second\n */\nexport function add(a, b) {\n}\n\n/** A box. */\nclass Box {\n}\n'


def docstring_exports(spark: SparkSession, base: str) -> DataFrame:
    rows = [(d["name"], d["kind"], d["description"], ",".join(d["params"]), d["line"]) for d in dom.docstrings(_SOURCE)]
    return spark.createDataFrame(rows, "name string, kind string, description string, params string, line int")


def stream_windows(spark: SparkSession, base: str) -> DataFrame:
    """Hourly counts of the events as a stream; windows still open at the end don't come out."""
    out = streams.drain(streams.windowed_counts(streams.read_stream(spark, base, "events")))
    return out.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("events").alias("events"))


def stream_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Snapshots as a stream against the last of their URL and name."""
    return streams.drain(streams.snapshot_stream(streams.read_stream(spark, base, "snapshots"))).groupBy("change").agg(F.count("*").alias("snapshots"))


def politeness_fold(spark: SparkSession, base: str) -> DataFrame:
    """The concurrency of each site after the statuses of its scrapes."""
    log = table(spark, base, "scrapes").select(F.col("site").alias("host"), F.col("scrape_id").alias("seq"), F.col("status_code").alias("status"))
    return streams.politeness(log)


QUERIES = {f.__name__: f for f in (manifest_project, url_captures, json_walk, grounding, docstring_exports, stream_windows, stream_snapshots, politeness_fold)}
ORACLES = {
    "manifest_project": "SELECT event_id, true AS matched, 'https://api.example/v1/' || user_id || '?t=' || event_type AS request_url, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(user_id AS VARCHAR) AS user, substr(event_type, 1, 4) AS kind, coalesce(json_extract_string(props, '$.k'), 'none') AS label FROM events",
    "url_captures": r"SELECT doc_id, regexp_matches(url, '^https?://[^/.?#]+\.example/[^/?#]+/[^/?#]+/?([?#].*)?$') AS matched, regexp_extract(url, '^https?://([^/.?#]+)\.example/([^/?#]+)/([^/?#]+)/?(?:[?#].*)?$', 1) AS source, regexp_extract(url, '^https?://([^/.?#]+)\.example/([^/?#]+)/([^/?#]+)/?(?:[?#].*)?$', 2) AS section, regexp_extract(url, '^https?://([^/.?#]+)\.example/([^/?#]+)/([^/?#]+)/?(?:[?#].*)?$', 3) AS slug FROM documents WHERE url IS NOT NULL",
    "json_walk": "WITH l AS (SELECT snapshot_id, unnest(links) AS l, generate_subscripts(links, 1) AS p FROM snapshots), f AS (SELECT snapshot_id, l.url AS href, p FROM l WHERE l.text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id, l.url ORDER BY p) = 1) SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY p) - 1 AS pos, href FROM f",
    "docstring_exports": "SELECT * FROM (VALUES ('add', 'function', 'Adds.', 'a,b', 1), ('Box', 'class', 'A box.', '', 9)) t(name, kind, description, params, line)",
    "stream_snapshots": "WITH s AS (SELECT hash(paragraphs) AS h, lag(hash(paragraphs)) OVER w AS b, row_number() OVER w AS k FROM snapshots WINDOW w AS (PARTITION BY url, coalesce(snapshot_name, '') ORDER BY delivery, taken_at, snapshot_id)) SELECT CASE WHEN k = 1 THEN 'first' WHEN h = b THEN 'same' ELSE 'changed' END AS change, count(*) AS snapshots FROM s GROUP BY 1",
    "stream_windows": "WITH w AS (SELECT event_type, date_trunc('hour', ts) + INTERVAL 1 HOUR AS closes, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, count(*) AS windows, sum(n) AS events FROM w WHERE closes <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY event_type",
}
