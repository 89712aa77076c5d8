"""URLs as column expressions: normal form, host, tracking parameters, pattern and safety predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, compared in lower case.
TRACKING = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\\s]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_QUOTED = r"[%+ ]|[^\x00-\x7F]"


def part(url: Column, index: int) -> Column:
    """Scheme 1, authority 2, path 3, ?query 4, #fragment 5; '' where there is none."""
    return F.regexp_extract(url, _PARTS, index)


def authority(url: Column) -> Column:
    """Host in lower case with its port, unless that is the scheme's own."""
    host = F.lower(part(url, 2))
    scheme = F.lower(part(url, 1))
    return (
        F.when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", ""))
        .when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", ""))
        .otherwise(host)
    )


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^[^@]*@", ""), ":[0-9]*$", "")


def _coded(text: Column) -> Column:
    return F.when(text.rlike(_QUOTED), F.url_encode(F.coalesce(F.try_url_decode(text), text))).otherwise(text)


def sorted_query(query: Column) -> Column:
    """A query string without tracking parameters, in order of name, then value; '' if none is left."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: x != "")
    named = F.transform(
        pairs,
        lambda x: F.named_struct(
            F.lit("k"),
            _coded(F.substring_index(x, "=", 1)),
            F.lit("v"),
            F.when(F.instr(x, "=") > 0, _coded(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise(""),
        ),
    )
    kept = F.array_sort(F.filter(named, lambda x: ~F.lower(x["k"]).isin(TRACKING)))
    return F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")


def normal_path(path: Column) -> Column:
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, " ", "%20"))
    return F.when((F.length(path) > 1) & path.endswith("/"), F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case; default port, fragment, tracking parameters and a path's trailing
    slash dropped; parameters sorted. NULL for NULL and for what isn't an absolute URL."""
    query = part(url, 4)
    tail = F.when(F.length(query) > 1, sorted_query(query)).otherwise("")
    made = F.concat(F.lower(part(url, 1)), F.lit("://"), authority(url), normal_path(part(url, 3)), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(part(url, 2) != "", made)


def url_key(url: Column) -> Column:
    """normalize_url, with other texts trimmed and kept, and '' for NULL: every row has a key."""
    return F.coalesce(normalize_url(url), F.trim(url), F.lit(""))


def without_params(url: Column, pattern: str) -> Column:
    """url without the query parameters whose name matches pattern (any case), all else as it is."""
    name = rf"(?i)(?:{pattern})(?:=[^&#]*)?(?=[&#]|$)"
    cut = F.regexp_replace(url, rf"(?<=[?&]){name}&?", "")
    return F.when(url.rlike(rf"(?i)[?&](?:{pattern})(?:[=&#]|$)"), F.regexp_replace(cut, r"[?&]+(?=#|$)", "")).otherwise(url)


def blob_to_raw(url: Column) -> Column:
    """A code host's page of a file becomes the address of the file itself."""
    return F.regexp_replace(url, r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/blob/([^?#]+).*$", "https://raw.githubusercontent.com/$1/$2/$3")


def absolute_url(href: Column, base: Column) -> Column:
    """A link resolved against the page's URL; NULL for empty links and other schemes' pseudo links."""
    href = F.trim(href)
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    joined = F.concat(folder, href)
    # two passes take out "x/../" for paths of up to two such steps in a row, the rest at the root
    for _ in range(3):
        joined = F.regexp_replace(joined, r"/(?!\.\./)[^/]+/\.\./", "/")
    joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"^(/\.\.)+/", "/")
    joined = F.regexp_replace(joined, r"/\./", "/")
    joined = F.regexp_replace(joined, r"^/?\./", "/")
    return (
        F.when(href.isNull() | (href == ""), None)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, part(base, 3), href))
        .otherwise(F.concat(root, joined))
    )


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda x: x != "")


def url_label(url: Column) -> Column:
    """The last path segment, or else the host."""
    segments = path_segments(url)
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), host(url))


def glob_regex(pattern: str) -> str:
    """'*' stands for any run of characters; '/re/' is a regular expression. Both match whole URLs."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return f"^(?:{pattern[1:-1]})$"
    return "^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$"


def matches_any(url: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(glob_regex(p))
    return out


def _octets(name: Column) -> list[Column]:
    return [F.regexp_extract(name, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]


def url_safety(url: Column) -> Column:
    """'ok', or why an address must not be fetched: scheme, host, local name, private or reserved address."""
    name = host(url)
    a, b, c, _ = _octets(name)
    reserved = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    inner6 = F.regexp_extract(F.lower(part(url, 2)), r"^\[([0-9a-f:.]+)\]", 1)
    return (
        F.when(url.isNull() | (part(url, 2) == ""), "invalid_url")
        .when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        .when((name == "localhost") | name.rlike(r"\.(localhost|local|internal|lan|home|intranet)$"), "local_host")
        .when(F.coalesce(reserved, F.lit(False)), "private_address")
        .when(inner6.rlike("^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)$"), "private_address")
        .otherwise("ok")
    )
