"""Decisions about one page or request as column expressions: which text, which address, which way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.functions.url import authority, host, normalize_url, part

# A readable text is better from this length on and if it's so much longer; the shown characters of
# a result; the characters below which a page is thin.
READABLE_LEAST, READABLE_GAIN, RESULT_CHARS, THIN_CHARS = 250, 1.15, 50_000, 100


def readable_is_better(ok: Column, readable: Column, chars: Column) -> Column:
    """Whether an extracted readable text should replace one of so many characters."""
    long_ = F.length(readable) >= F.greatest(F.lit(float(READABLE_LEAST)), chars * READABLE_GAIN)
    return F.coalesce(ok & (readable != "") & long_, F.lit(False))


def finish_result(text: Column, most: int = RESULT_CHARS) -> Column:
    """struct(text, truncated): at most so many characters, and whether there were more."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def result_source(job: Column, response: Column, snapshot: Column) -> Column:
    """What a stored result is looked up by: a job before a response before a snapshot; NULL if nothing is given."""
    return F.when(F.length(job) > 0, "job").when(F.length(response) > 0, "response").when(F.length(snapshot) > 0, "snapshot")


def follow_alternate(candidate: Column, own: Column, route: Column, chars: Column, prefer: bool = False) -> Column:
    """Another address of the same origin stands in for a thin HTML page, or for any page with prefer."""
    origin = lambda u: F.concat_ws("://", F.lower(part(u, 1)), authority(u))
    near = (origin(candidate) == origin(own)) & (normalize_url(candidate) != normalize_url(own))
    return F.coalesce(near if prefer else near & (route == "html") & (chars < THIN_CHARS), F.lit(False))


def bypasses_proxy(url: Column, rules: str) -> Column:
    """Whether a URL goes past the proxy by a comma list of hosts: '*' is any; a host stands for its subdomains
    too, with or without a leading dot; host:port only for that port, the scheme's own included."""
    name = host(url)
    given = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    scheme = F.lower(part(url, 1))
    port = F.when(given != "", given).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    out = F.lit(False)
    for rule in (r.strip().lower() for r in rules.split(",")):
        if rule == "*":
            return F.lit(True)
        if not rule:
            continue
        bare, _, number = rule.partition(":")
        scoped = number.isdigit() and ":" not in number
        bare = (bare if scoped else rule.strip("[]")).lstrip(".")
        hit = (name == bare) | name.endswith(f".{bare}")
        out = out | (hit & (port == number) if scoped else hit)
    return out


def headings_of(text: Column, most: int = 100) -> Column:
    """The titles of a text's markdown headings, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s+", ""))), 1, most)


def paragraphs_of(text: Column, least: int = 24, most: int = 100) -> Column:
    """The lines that are no headings and have enough characters, in order."""
    return F.slice(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^#{1,6}\s+") & (F.length(x) >= least)), 1, most)
