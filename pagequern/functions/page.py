"""Facts of a page as column expressions: content route, signals, metadata, freshness, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.functions.url import normalize_url

# What tells a blocked page and one that needs scripts, and the status codes of refusal.
BLOCK_PATTERN = "(?i)captcha|cloudflare|access denied|temporarily blocked|unusual traffic|verify you are human"
SPA_PATTERN = r"(?i)id=[\"'](?:root|app|__next)[\"']|data-reactroot|enable javascript|javascript is required"
BLOCKED_STATUS = [401, 403, 407, 409, 418, 429, 503]
SPARSE_CHARS, SPARSE_DENSITY, READABLE_CHARS = 200, 0.03, 800


def content_route(content_type: Column, url: Column) -> Column:
    """One of eleven kinds, by MIME type, then by the path's extension."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    path = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[?#].*$", "")
    return (
        F.when((kind == "application/pdf") | path.endswith(".pdf"), "pdf")
        .when(kind.isin("text/html", "application/xhtml+xml") | path.endswith(".html"), "html")
        .when(path.endswith(".mdx"), "mdx")
        .when(kind.contains("markdown") | path.rlike(r"\.(md|markdown)$"), "markdown")
        .when(path.endswith(".rst"), "rst")
        .when(path.rlike(r"\.([cm]?[jt]sx?|py|rs)$"), "source")
        .when(kind.contains("json") | path.endswith(".json"), "json")
        .when(kind.contains("svg") | path.endswith(".svg"), "svg")
        .when(kind.contains("xml") | path.endswith(".xml"), "xml")
        .when(kind.startswith("text/") | path.endswith(".txt"), "text")
        .otherwise("binary")
    )


def charset_of(content_type: Column) -> Column:
    return F.nullif(F.replace(F.lower(F.regexp_extract(content_type, "(?i)charset=[\"']?([^;\"'\\s]+)", 1)), F.lit("_"), F.lit("-")), F.lit(""))


def decode_body(body: Column, charset: Column) -> Column:
    """Bytes as text by charset: ASCII, Latin-1, windows-1252, else UTF-8."""
    latin = F.decode(body, "ISO-8859-1")
    special = bytes(range(0x80, 0xA0)).decode("latin-1")
    known = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    name = F.lower(F.coalesce(charset, F.lit("utf-8")))
    return (
        F.when(name.isin("iso-8859-1", "latin1", "latin-1", "ascii", "us-ascii"), latin)
        .when(name.isin("windows-1252", "cp1252"), F.translate(latin, special, known))
        .otherwise(F.decode(body, "UTF-8"))
    )


def title_of(html: Column) -> Column:
    """<title>, else meta title, else og:title; NULL if none."""
    plain = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(F.nullif(plain, F.lit("")), meta_content(html, "title"), meta_content(html, "og:title"))


def meta_content(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']?{name}[\"']?[^>]*content=\"([^\"]*)\"", 1)
    return F.nullif(F.trim(found), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text of the HTML without scripts, styles and tags, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<title[^>]*>.*?</title>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def page_signals(visible: Column, html_length: Column, status: Column, full: Column, html: Column, island_chars: Column) -> Column:
    """struct of density, sparse, spa, blocked, what to try next, and reasons."""
    length = F.length(visible)
    density = F.when(html_length > 0, length / html_length).otherwise(0.0)
    blocked = F.coalesce(status.isin(BLOCKED_STATUS), F.lit(False)) | full.rlike(BLOCK_PATTERN)
    spa = html.rlike(SPA_PATTERN) | html.rlike(r"__NEXT_DATA__|window\.__INITIAL_STATE__")
    sparse = (length < SPARSE_CHARS) | (density < SPARSE_DENSITY)
    reasons = F.array_compact(F.array(F.when(blocked, "blocked_signal"), F.when(spa, "spa_marker"), F.when(sparse, "sparse_dom"), F.when(island_chars > length, "rich_data_islands")))
    return F.struct(
        density.alias("density"),
        sparse.alias("sparse"),
        spa.alias("spa"),
        blocked.alias("blocked"),
        (~blocked & (sparse | (length < READABLE_CHARS)) & (html_length > 0)).alias("try_readable"),
        ((spa & sparse & (island_chars < 200)) | (blocked & sparse)).alias("try_browser"),
        reasons.alias("reasons"),
    )


def age_seconds(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000)).cast("bigint")


def staleness(age: Column, ttl: Column) -> Column:
    return F.when(age < ttl * 0.5, "fresh").when(age < ttl, "aging").when(age < ttl * 2, "stale").otherwise("expired")


def crawl_staleness(age: Column) -> Column:
    return F.when(age < 86_400, "fresh").when(age < 604_800, "aging").when(age < 2_592_000, "stale").otherwise("expired")


def recommended_action(status: Column, stale: Column) -> Column:
    return (
        F.when(status.isin("running", "paused") & ~stale.isin("stale", "expired"), "resume")
        .when((status == "done") & stale.isin("fresh", "aging"), "reuse_results")
        .when(status == "done", "recrawl")
        .when((status == "error") & stale.isin("stale", "expired"), "discard")
        .otherwise("inspect")
    )


# Status codes after which a request may be sent again.
RETRYABLE_STATUS = [408, 429, 500, 502, 503, 504]


def retryable(status: Column) -> Column:
    return status.isin(RETRYABLE_STATUS)


def retry_delay_ms(attempt: Column, base: int = 250, most: int = 5_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))


def should_follow_refresh(delay: Column, hops: Column, target: Column, own: Column, visible_chars: Column, route: Column | None = None, prefer: bool = False) -> Column:
    """Within three hops and five seconds, to another page, from HTML with less than 100 visible characters;
    prefer follows whatever the page shows."""
    near = (hops < 3) & (delay <= 5) & own.isNotNull() & (normalize_url(target) != normalize_url(own))
    if prefer:
        return near
    html = F.lit(True) if route is None else route == "html"
    return near & html & (visible_chars < 100)


def best_first_score(url: Column, depth: Column) -> Column:
    """(5 - depth) x 10, 5 more for a root or index page, 3 for short paths, 1 for a fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return (5 - depth) * 10 + F.when((path == "") | (path == "/") | path.rlike(r"^/index\.\w+$"), 5).when(segments <= 1, 3).otherwise(0) + F.when(url.contains("#"), 1).otherwise(0)


def safe_name(text: Column) -> Column:
    """Every character that isn't safe in a file's name becomes one underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def extension_for(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(kind.contains("html"), ".html").when(kind.contains("json"), ".json").when(kind.contains("markdown"), ".md").when(kind.contains("pdf"), ".pdf").when(kind.startswith("text/"), ".txt").otherwise(".bin")
