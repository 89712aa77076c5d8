"""Declarative extraction manifests compiled to column expressions: nothing is interpreted at run time.

A manifest is a dict: urlPatterns, optional request.urlTemplate, extract (field: expression), limits and
throwIf. URL patterns become regular expressions, expressions become columns over a VARIANT response.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequern.functions.text import clean_text, decode_xml

_PATH = re.compile(r"^\$?(?:\.?[A-Za-z_][\w-]*|\[\d+\]|\[\"[^\"]+\"\])*$")


class ManifestError(ValueError):
    """A manifest, expression or path that isn't supported."""


def url_pattern(pattern: str) -> tuple[str, list[str]]:
    """(regular expression, names of captures) of a URL pattern: :name one segment, :name+ the rest, :name*x a
    segment that ends in x, *. and :sub. in the host, ?key=:name in the query."""
    m = re.fullmatch(r"(https?)://([^/?]+)(/[^?]*)?(\?.*)?", pattern)
    if not m:
        raise ManifestError(f"unsupported URL pattern: {pattern}")
    names: list[str] = []

    def capture(name: str, body: str) -> str:
        names.append(name)
        return f"({body})"

    host = r"\.".join(r"[^/.?#]+" if x == "*" else capture(x[1:], r"[^/.?#]+") if x.startswith(":") else re.escape(x) for x in m.group(2).split("."))
    path = ""
    for part in (m.group(3) or "/").strip("/").split("/"):
        if not part:
            continue
        named = re.fullmatch(r":(\w+)(\+|\*(.*))?", part)
        if not named:
            path += "/" + (r"[^/?#]+" if part == "*" else re.escape(part))
        elif named.group(2) == "+":
            path += "/" + capture(named.group(1), r"[^?#]+?")
        elif named.group(2):
            path += "/" + capture(named.group(1), r"[^/?#]+?") + re.escape(named.group(3))
        else:
            path += "/" + capture(named.group(1), r"[^/?#]+")
    query = ""
    for pair in (m.group(4) or "").lstrip("?").split("&"):
        if "=:" in pair:
            key, name = pair.split("=:", 1)
            query += rf"(?=[^#]*[?&]{re.escape(key)}={capture(name, '[^&#]+')})"
    return f"^https?://{host}{query}{path}/?(?:[?#].*)?$", names


def captures(url: Column, patterns: list[str]) -> tuple[Column, dict[str, Column]]:
    """(whether any pattern matches, captured values of the first that does)."""
    compiled = [url_pattern(p) for p in patterns]
    matched = F.lit(False)
    for regex, _ in compiled:
        matched = matched | url.rlike(regex)
    out: dict[str, Column] = {}
    for name in dict.fromkeys(n for _, names in compiled for n in names):
        value = None
        for regex, names in compiled:
            got = F.regexp_extract(url, regex, names.index(name) + 1) if name in names else F.lit("")
            value = F.when(url.rlike(regex), got) if value is None else value.when(url.rlike(regex), got)
        out[name] = value.otherwise("")
    return matched, out


def _variant_path(path: str) -> str:
    if not _PATH.match(path):
        raise ManifestError(f"JSON_PATH_UNSUPPORTED: {path}")
    path = path if path.startswith("$") else f"$.{path}"
    return path


def json_value(response: Column, path: str, kind: str = "string") -> Column:
    """A path ($.a.b[0], or a.b[0]) of a VARIANT, as a string; one [*] gives the array of its values."""
    if "[*]" in path:
        head, _, tail = path.partition("[*]")
        items = F.try_variant_get(response, _variant_path(head), "array<variant>")
        return F.transform(items, lambda x: F.try_variant_get(x, "$" + (tail if tail.startswith((".", "[")) or not tail else f".{tail}"), kind))
    return F.try_variant_get(response, _variant_path(path), kind)


def transform_value(value: Column, name: str, known: dict[str, Column]) -> Column:
    """One step of a |transform pipeline."""
    head, _, arg = name.partition(":")
    steps = {
        "clean": lambda: F.nullif(clean_text(decode_xml(value)), F.lit("")),
        "number": lambda: value.try_cast("double"),
        "boolean": lambda: F.coalesce(~value.cast("string").isin("", "false", "0"), F.lit(False)),
        "trueOnly": lambda: F.when(value.cast("string") == "true", F.lit(True)),
        "length": lambda: F.length(value),
        "firstLine": lambda: F.get(F.filter(F.transform(F.split(value, "\n"), F.trim), lambda x: x != ""), F.lit(0)),
        "compact": lambda: F.array_compact(value),
        "emptyToUndefined": lambda: F.nullif(value, F.lit("")),
        "truncate": lambda: F.substring(value, 1, int(arg)),
        "isLongerThan": lambda: F.length(value) > int(arg),
        "unlessCapture": lambda: F.when(F.coalesce(known.get(arg, F.lit("")), F.lit("")) == "", value),
        "after": lambda: F.substring_index(value, arg, -1),
        "pluck": lambda: F.transform(value, lambda x: json_value(x, arg)),
        "base64": lambda: F.decode(F.unbase64(value), "UTF-8"),
        "trim": lambda: F.trim(value),
        "string": lambda: value.cast("string"),
        "absoluteUrl": lambda: F.when(value.rlike("^https?:"), value).otherwise(F.concat(F.lit(arg.rstrip("/") + "/"), F.regexp_replace(value, "^/+", ""))),
        "encodeURIComponent": lambda: F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")),
        "encodePathSegments": lambda: F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")),
        "default": lambda: F.coalesce(F.nullif(value, F.lit("")), F.lit(arg)),
        "switch": lambda: _switch(value, arg),
    }
    if head not in steps:
        raise ManifestError(f"unknown transform: {name}")
    return steps[head]()


def _switch(value: Column, spec: str) -> Column:
    out = None
    for option in spec.split(","):
        key, _, result = option.partition("=")
        made = F.replace(F.lit(result), F.lit("{value}"), value)
        test = F.lit(True) if key == "*" else value == key
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(value)


def template(text: str, known: dict[str, Column]) -> Column:
    """{{name|filter}} places of a text filled from captures."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([^}]+?)\s*\}\}", text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        name, *filters = [x.strip() for x in m.group(1).split("|")]
        value = known.get(name, F.lit(""))
        for f in filters:
            value = transform_value(value, f, known)
        parts.append(value)
        at = m.end()
    if at < len(text) or not parts:
        parts.append(F.lit(text[at:]))
    return F.concat(*parts)


def expression(text: str, response: Column, known: dict[str, Column]) -> Column:
    """$.path|transform, {{capture}}|transform or a literal; alternatives by || take the first non-empty."""
    alternatives = [x.strip() for x in text.split("||")]
    if len(alternatives) > 1:
        return F.coalesce(*[F.nullif(expression(x, response, known).cast("string"), F.lit("")) for x in alternatives])
    selector, *steps = re.split(r"\|(?![^{]*\}\})", text)
    plucks = any(s.startswith("pluck:") for s in steps)
    if selector.startswith("{{"):
        value = template(selector, known)
    elif selector.startswith("$"):
        value = json_value(response, selector, "array<variant>" if plucks else "string")
    else:
        value = F.lit(selector)
    for s in steps:
        value = transform_value(value, s.strip(), known)
    return value


def compile_manifest(manifest: dict, url: Column, response: Column) -> dict[str, Column]:
    """Columns of a manifest: matched, request_url, error and one per field, NULL where not matched."""
    problems = validate(manifest)
    if problems:
        raise ManifestError("; ".join(problems))
    matched, known = captures(url, manifest["urlPatterns"])
    limits = {x["field"]: x["maxChars"] for x in manifest.get("limits", [])}
    out = {"matched": matched}
    if "request" in manifest:
        out["request_url"] = F.when(matched, template(manifest["request"]["urlTemplate"], known))
    fail = F.lit(None).cast("string")
    for rule in manifest.get("throwIf", []):
        fail = F.coalesce(fail, F.when(F.coalesce(json_value(response, rule["path"]), F.lit("")) != "", F.lit(rule["message"])))
    out["error"] = F.when(matched, fail)
    for field, text in manifest["extract"].items():
        value = expression(text, response, known)
        if field in limits:
            value = F.substring(value, 1, limits[field])
        out[field] = F.when(matched & fail.isNull(), value)
    return out


def validate(manifest: dict) -> list[str]:
    """What is wrong with a manifest; nothing if it can be compiled."""
    out = []
    if not re.fullmatch(r"[a-z][a-z0-9_-]{1,60}", str(manifest.get("name", ""))):
        out.append("name")
    if not manifest.get("urlPatterns"):
        out.append("urlPatterns")
    if not isinstance(manifest.get("extract"), dict) or not manifest.get("extract"):
        out.append("extract")
    target = manifest.get("request", {}).get("urlTemplate", "https://ok.example/")
    if not target.startswith(("https://", "http://")) or re.match(r"https?://(localhost|127\.|10\.|192\.168\.|169\.254\.)", target):
        out.append("request.urlTemplate")
    for k in manifest.get("request", {}).get("headers", {}):
        if re.search(r"authorization|cookie|token|secret|api[-_]?key", k, re.I):
            out.append(f"request.headers.{k}")
    return out


def overlay(layers: list[list[dict]]) -> list[dict]:
    """Manifests of later layers replace those of the same name; in order, then by name."""
    by_name: dict[str, dict] = {}
    for layer in layers:
        for m in layer:
            by_name[m["name"]] = m
    return sorted(by_name.values(), key=lambda m: (m.get("order") is None, m.get("order") or 0, m["name"]))


_WALK = "id bigint, pos int, emitted map<string,string>"


def json_walk(rows: DataFrame, when: list[str], emit: dict[str, str], dedupe_by: str | None = None, max_items: int | None = None) -> DataFrame:
    """rows (id, json) -> (id, pos, emitted): objects in pre-order that have all keys of when, with the fields
    of emit; the first of each dedupe_by value."""

    def get(obj: object, path: str) -> object:
        for key in path.split("."):
            obj = obj.get(key) if isinstance(obj, dict) else None
        return obj

    def walk(data: object) -> list[dict[str, str]]:
        out, seen, stack = [], set(), [data]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if all(get(x, p) is not None for p in when):
                    item = {k: str(v) for k, p in emit.items() if (v := get(x, p)) is not None}
                    mark = item.get(dedupe_by) if dedupe_by else None
                    if mark is None or mark not in seen:
                        seen.add(mark)
                        out.append(item)
                        if max_items and len(out) >= max_items:
                            return out
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for i, text in zip(pdf["id"], pdf["json"], strict=True):
                try:
                    found += [(i, k, e) for k, e in enumerate(walk(json.loads(text or "null")))]
                except ValueError:
                    continue
            yield pd.DataFrame(found, columns=["id", "pos", "emitted"])

    return rows.select("id", "json").mapInPandas(run, _WALK)


_GROUND = "id bigint, field string, value string, start int, stop int"


def grounded_fields(rows: DataFrame) -> DataFrame:
    """rows (id, json, source) -> (id, field, value, start, stop): scalars by dotted path and where the source
    holds them: exactly, else in any case, else with white space collapsed (offsets then into that text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, source in zip(pdf["id"], pdf["json"], pdf["source"], strict=True):
                try:
                    stack = [("", json.loads(text or "null"))]
                except ValueError:
                    continue
                source = source or ""
                flat = " ".join(source.split())
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, dict):
                        stack.extend((f"{path}.{k}" if path else k, x) for k, x in reversed(list(v.items())))
                    elif isinstance(v, list):
                        stack.extend((f"{path}[{k}]", x) for k, x in reversed(list(enumerate(v))))
                    elif v is not None:
                        s = str(v).lower() if isinstance(v, bool) else str(v)
                        at = source.find(s)
                        if at < 0:
                            at = source.lower().find(s.lower())
                        if at < 0:
                            s2 = " ".join(s.split())
                            at = flat.lower().find(s2.lower())
                        out.append((i, path, s, at if at >= 0 and s else None, at + len(s) if at >= 0 and s else None))
            yield pd.DataFrame(out, columns=["id", "field", "value", "start", "stop"]).astype({"start": "Int32", "stop": "Int32"})

    return rows.select("id", "json", "source").mapInPandas(run, _GROUND)
