"""What a page's head and other markups say: refreshes, alternates, MDX and reStructuredText, renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.functions.url import absolute_url, normalize_url, part

# Types of alternates that are made for agents, and the rendering order of formats.
AGENT_TYPES = ["text/markdown", "text/plain", "text/x-markdown", "application/markdown"]
EXCERPT_LADDER = [800, 400, 120, 0]


def meta_refresh(html: Column, base: Column) -> Column:
    """struct(delay, url) of the first refresh that names a target; NULL if none does."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>"), F.lit(0))
    contents = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)content=(?:\"([^\"]*)\"|'([^']*)')", 0))
    inner = F.transform(contents, lambda c: F.regexp_replace(c, r"(?is)^content=[\"']|[\"']$", ""))
    good = F.get(F.filter(inner, lambda c: c.rlike(r"(?is)^\s*[0-9]*\.?[0-9]+\s*(?:;|\s)\s*url\s*=\s*\S")), F.lit(0))
    delay = F.regexp_extract(good, r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    target = F.trim(F.regexp_extract(good, r"(?is)url\s*=\s*(.+)$", 1))
    return F.when(good.isNotNull(), F.struct(delay.alias("delay"), absolute_url(target, base).alias("url")))


def is_agent_readable(url: Column, kind: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(F.lower(kind).isin(AGENT_TYPES), F.lit(False)) | low.rlike(r"\.(md|markdown|txt)$") | low.contains("llms.txt")


def alternates(html: Column, base: Column) -> Column:
    """Array of struct(url, rel, kind, agent) of <link rel=alternate> and such anchors."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|a)\b[^>]*rel=[\"'][^\"']*alternate[^\"']*[\"'][^>]*>"), F.lit(0))

    def attr(tag: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}=[\"']([^\"']*)[\"']", 1), F.lit(""))

    made = F.transform(tags, lambda t: F.struct(absolute_url(attr(t, "href"), base).alias("url"), attr(t, "rel").alias("rel"), attr(t, "type").alias("kind")))
    found = F.filter(made, lambda a: a["url"].isNotNull())
    return F.transform(found, lambda a: F.struct(a["url"].alias("url"), a["rel"].alias("rel"), a["kind"].alias("kind"), is_agent_readable(a["url"], a["kind"]).alias("agent")))


def agent_urls(url: Column) -> Column:
    """Where a page's text for agents may lie: its path with .md (of the root: /index.md), and the site's
    llms.txt; both of the URL's normal form, without a query."""
    normal = normalize_url(url)
    origin = F.concat(part(normal, 1), F.lit("://"), part(normal, 2))
    path = F.regexp_replace(part(normal, 3), "/$", "")
    return F.array(F.concat(origin, F.when(path == "", "/index").otherwise(path), F.lit(".md")), F.concat(origin, F.lit("/llms.txt")))


def pick_alternate(found: Column, kinds: list[str]) -> Column:
    """The URL of the best alternate: exact types by priority, then types that begin so."""

    def first(test) -> Column:
        return F.get(F.filter(found, test), F.lit(0))["url"]

    # a second parameter of a filter's function would be the index, so each test is a closure
    exact = [first((lambda kind: lambda a: F.lower(a["kind"]) == kind)(k)) for k in kinds]
    begins = [first((lambda kind: lambda a: F.lower(a["kind"]).startswith(kind))(k)) for k in kinds]
    return F.coalesce(*exact, *begins)


def mdx_components(text: Column) -> Column:
    """Names of components that stand alone on a line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*<[A-Z][A-Za-z0-9.]*\b[^>]*/?>\s*$"))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"<([A-Z][A-Za-z0-9.]*)", 1))


def rst_headings(text: Column) -> Column:
    """Array of struct(line, text, mark): lines underlined by at least as many marks of one kind."""
    lines = F.split(text, "\r?\n", -1)
    pairs = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("under")))
    found = F.filter(pairs, lambda p: (p["text"] != "") & p["under"].rlike(r"^([=\-~^\"'#*+.:_])\1{2,}\s*$") & (F.length(F.rtrim(p["under"])) >= F.length(p["text"])))
    return F.transform(found, lambda p: F.struct(p["line"].alias("line"), p["text"].alias("text"), F.substring(p["under"], 1, 1).alias("mark")))


def llm_text(title: Column, description: Column, body: Column, metadata: Column) -> Column:
    """# title, description, body and sorted metadata, with empty lines between; NULL parts left out."""
    entries = F.array_sort(F.map_entries(metadata))
    listed = F.when(F.size(entries) > 0, F.concat(F.lit("Metadata:\n"), F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.nullif(title, F.lit(""))), F.nullif(description, F.lit("")), F.nullif(body, F.lit("")), listed)


def rendered(kind: str, markdown: Column, text: Column, html: Column, llm: Column) -> Column:
    """A page in one of the output formats; what is missing falls back to the text."""
    if kind not in ("markdown", "text", "llm", "html", "raw", "json"):
        raise ValueError(f"unknown format: {kind}")
    return F.coalesce({"markdown": markdown, "text": text, "llm": llm, "html": html, "raw": html, "json": F.to_json(F.struct(text.alias("text"), markdown.alias("markdown")))}[kind], text)


def regex_matches(text: Column, pattern: str, contains: list[str] | None = None, dedupe: bool = True, sort: bool = False, limit: int = 50) -> Column:
    """Matches of a pattern that hold all of contains, each once, sorted if asked, at most limit."""
    out = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    for c in contains or []:
        out = F.filter(out, (lambda part: lambda m: m.contains(part))(c))
    out = F.array_distinct(out) if dedupe else out
    return F.slice(F.array_sort(out) if sort else out, 1, limit)


def error_record(code: Column, message: Column, url: Column) -> Column:
    """A structured error, NULL where code is: failures stay rows."""
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.substring(message, 1, 500).alias("message"), url.alias("url"), code.isin("TIMEOUT", "RATE_LIMITED", "SERVER_ERROR").alias("retryable")))


def aria_roles(outline: Column) -> Column:
    """Roles of the lines of an accessibility outline ("- role "name""), in order."""
    lines = F.filter(F.split(outline, "\n"), lambda x: x.rlike(r"^\s*-\s+[a-z]+"))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*-\s+([a-z]+)", 1))


def quality(ok: Column, total: Column, stale: Column) -> Column:
    """struct(confidence, coverage) of a batch or crawl."""
    share = F.when(total > 0, ok / total).otherwise(0.0)
    return F.struct(F.when(share >= 0.9, "high").when(share >= 0.5, "medium").otherwise("low").alias("confidence"), F.round(share, 3).alias("coverage"), F.when(stale, "stale").otherwise("fresh").alias("freshness"))
