"""Queries over snapshots: what changed between full deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.operators.snapshot_diff import page_snapshot_changes
from pagequern.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return page_snapshot_changes(table(spark, base, "snapshots")).drop("snapshot_id")


def p2_change_counts(spark: SparkSession, base: str) -> DataFrame:
    return p2_found(spark, base).groupBy("delivery", "change").agg(F.count("*").alias("records"))


QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts}

_KEY = r"""
  lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 1)) AS sch,
  lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)) AS hst,
  regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS pth,
  regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4) AS qry"""

_TRACKING = "('fbclid','gclid','igshid','mc_cid','mc_eid','msclkid','utm_campaign','utm_content','utm_medium','utm_source','utm_term')"

#: url_key in SQL, as far as the tables' URLs go (no percent-coded parameters).
KEYED = rf"""
keyed AS (
  SELECT *, sch || '://' || regexp_replace(hst, CASE WHEN sch = 'https' THEN ':443$' ELSE ':80$' END, '')
    || CASE WHEN pth = '' THEN '/' WHEN length(pth) > 1 THEN coalesce(nullif(regexp_replace(pth, '/+$', ''), ''), '/') ELSE pth END
    || CASE WHEN len(prm) > 0 THEN '?' || array_to_string(prm, '&') ELSE '' END AS url_key,
    regexp_replace(hst, ':[0-9]*$', '') AS site_host
  FROM (SELECT *, list_sort(list_filter(string_split(substr(qry, 2), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN {_TRACKING})) AS prm
        FROM (SELECT *, {_KEY} FROM snapshots)))"""

_P = "utm_[^=&#]*|fbclid|gclid|msclkid|yclid|mc_cid|mc_eid"
_S = "session|sid|csrf|xsrf|nonce|token"
_MASK = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\b(last updated|updated|posted)\s+(?:about\s+)?\d+\s+(?:seconds?|minutes?|hours?|days?)\s+ago\b', '\1 <relative-time>', 'gi'),"
    r" '\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\b', '<timestamp>', 'g'),"
    r" '\b(?:csrf|xsrf|session|sid|nonce|token)=[''\x22]?[A-Za-z0-9._:-]{12,}[''\x22]?', 'token=<volatile-token>', 'gi'),"
    r" '\b(?:ad-slot|ad_unit|google_ads_iframe)[:=_-][A-Za-z0-9._-]{6,}\b', 'ad-slot=<volatile-ad-slot>', 'gi')"
)
# a URL's parameters vanish one after another; the tables' paragraphs hold at most two that track
_CUT = rf"regexp_replace(regexp_replace({{0}}, '(https?://[^\s)?]*\?(?:[^\s)#&]*&)*?)(?:{_P})=[^&#\s)]*&?', '\1', 'gi'), '(https?://[^\s)]*)[?&](\s|\)|$)', '\1\2', 'g')"

_P2 = rf"""
WITH {KEYED},
rows_ AS (
  SELECT delivery, url_key, coalesce(snapshot_name, '') AS snapshot_name, taken_at, snapshot_id,
    CASE WHEN paragraphs IS NULL THEN NULL ELSE list_transform(list_filter(list_transform(paragraphs, lambda x: trim(x, ' ' || chr(160) || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), lambda x: {_CUT.format(_CUT.format(_MASK))}) END AS p,
    CASE WHEN regexp_full_match(lower(replace(normalized_hash, 'sha256:', '')), '[0-9a-f]{{64}}') THEN lower(replace(normalized_hash, 'sha256:', '')) END AS n,
    list_sort(list_distinct(list_transform(coalesce(links, []), lambda x: regexp_replace(regexp_replace(regexp_replace(x.url, '([?&])(?:{_P}|{_S})=[^&#]*&?', '\1', 'gi'), '([?&])(?:{_P}|{_S})=[^&#]*&?', '\1', 'gi'), '[?&]+(#|$)', '\1')))) AS l
  FROM keyed),
last_ AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY url_key, snapshot_name, delivery ORDER BY taken_at DESC, snapshot_id DESC) = 1),
changes AS (
  SELECT coalesce(b.url_key, a.url_key) AS url_key, coalesce(b.snapshot_name, a.snapshot_name) AS snapshot_name, coalesce(b.delivery, a.delivery + 1) AS delivery,
    CASE WHEN a.url_key IS NULL THEN 'added' WHEN b.url_key IS NULL THEN 'removed'
         WHEN a.l <> b.l OR CASE WHEN a.p IS NULL OR b.p IS NULL THEN coalesce(a.n <> b.n, false) ELSE a.p <> b.p END THEN 'changed' END AS change
  FROM last_ a FULL OUTER JOIN last_ b ON a.url_key = b.url_key AND a.snapshot_name = b.snapshot_name AND a.delivery + 1 = b.delivery)
"""
_BOUNDS = "change IS NOT NULL AND delivery BETWEEN 2 AND 5"
ORACLES = {
    "p2_found": f"{_P2} SELECT url_key, snapshot_name, delivery, change FROM changes WHERE {_BOUNDS}",
    "p2_change_counts": f"{_P2} SELECT delivery, change, count(*) AS records FROM changes WHERE {_BOUNDS} GROUP BY ALL",
}
