"""Text as column expressions: normal form, token estimate, lines, sections, excerpts, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
PREVIEW_BYTES, PREVIEW_LINES = 50 * 1024, 2000
MAX_CHARS = 50_000


def normalize_whitespace(text: Column) -> Column:
    """LF line ends, blanks collapsed and cut at line ends, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[\t ]+", " "), " *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def dedupe_lines(text: Column) -> Column:
    """Trimmed lines, each once, in their first order, without empty ones."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")), "\n")


def preview(text: Column, chars: int = PREVIEW_BYTES, lines: int = PREVIEW_LINES) -> Column:
    """The first lines, and of these the first characters (one byte each at least)."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n"), 1, chars)


def snapshot_text(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), F.trim), lambda x: x != ""), "\n")


def matching_lines(text: Column, needle: str, context: int = 0, case_sensitive: bool = False) -> Column:
    """Array of struct(line, text, before, after) of the lines that hold the needle; NULL gives NULL."""
    all_lines = lines_of(text)
    wanted = needle if case_sensitive else needle.lower()

    def one(line: Column, i: Column) -> Column:
        low = F.greatest(i - context, F.lit(0))
        none = F.array().cast("array<string>")
        return F.struct(
            (i + 1).alias("line"),
            line.alias("text"),
            (F.slice(all_lines, low + 1, i - low) if context else none).alias("before"),
            (F.slice(all_lines, i + 2, F.lit(context)) if context else none).alias("after"),
        )

    numbered = F.transform(all_lines, one)
    return F.filter(numbered, lambda x: F.instr(x["text"] if case_sensitive else F.lower(x["text"]), wanted) > 0)


def section_between(text: Column, start: str, end: str | None = None, include_start: bool = True, include_end: bool = False, max_chars: int = 40_000) -> Column:
    """struct(start_index, end_index, found, truncated, text) of the range between two markers; 0-based."""
    at = F.instr(text, start) - 1
    begin = at if include_start else at + len(start)
    if end:
        rest = F.substr(text, at + len(start) + 1, F.length(text))
        found_end = F.instr(rest, end)
        raw_end = F.when(found_end > 0, at + len(start) + found_end - 1)
        finish = F.coalesce(raw_end + (len(end) if include_end else 0), F.length(text))
    else:
        raw_end = F.lit(None).cast("int")
        finish = F.length(text)
    bounded = F.least(finish, begin + max_chars)
    return F.when(
        text.isNotNull(),
        F.struct(
            at.alias("start_index"),
            F.when(at >= 0, raw_end).alias("end_index"),
            (at >= 0).alias("found"),
            ((at >= 0) & (bounded < finish)).alias("truncated"),
            F.when(at >= 0, F.substr(text, begin + 1, bounded - begin)).alias("text"),
        ),
    )


def excerpts(text: Column, needle: str, before: int = 200, after: int = 200, max_occurrences: int = 10, case_sensitive: bool = False) -> Column:
    """Array of struct(occurrence, index, start, end, text): non-overlapping occurrences, 0-based."""
    hay = text if case_sensitive else F.lower(text)
    wanted = needle if case_sensitive else needle.lower()
    pieces = F.split(hay, F.lit("\\Q" + wanted + "\\E"), -1)
    ends = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.struct(i.alias("i"), F.length(p).alias("n")))
    places = F.aggregate(ends, F.array().cast("array<int>"), lambda acc, e: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(needle), F.lit(0)) + e["n"]).cast("int"))))
    found = F.slice(places, 1, max_occurrences)
    return F.transform(
        found,
        lambda at, i: F.struct(
            (i + 1).alias("occurrence"),
            at.alias("index"),
            F.greatest(at - before, F.lit(0)).alias("start"),
            F.least(at + len(needle) + after, F.length(text)).alias("end"),
            F.substr(text, F.greatest(at - before, F.lit(0)) + 1, F.least(at + len(needle) + after, F.length(text)) - F.greatest(at - before, F.lit(0))).alias("text"),
        ),
    )


def marker_index(text: Column, marker: str, case_sensitive: bool = True) -> Column:
    """0-based index of the first occurrence, -1 if there is none."""
    return (F.instr(text, marker) if case_sensitive else F.instr(F.lower(text), marker.lower())) - 1


def regex_values(text: Column, pattern: str, group: int = 0, limit: int = 5) -> Column:
    """Trimmed non-blank matches, at most limit."""
    return F.slice(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.trim), lambda x: x != ""), 1, limit)


def plain_text_from_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[*_`>~-]", " "), r"\s+", " "))


def strip_mdx(text: Column) -> Column:
    """MDX without imports, exports and component tags."""
    out = F.regexp_replace(text, r"(?m)^\s*import\s+.*$", "")
    out = F.regexp_replace(out, r"(?m)^\s*export\s+.*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)^\s*<[A-Z][\s\S]*?>\s*$", ""), r"</?[A-Z][A-Za-z0-9.]*\b[^>]*>", "")


def decode_xml(text: Column) -> Column:
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def line_similarity(left: Column, right: Column) -> Column:
    """The greater of 1 - edit distance / longer length and the Jaccard similarity of the lines' words."""
    longest = F.greatest(F.length(left), F.length(right))
    chars = 1 - F.levenshtein(left, right) / longest
    words = [F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) for x in (left, right)]
    union = F.size(F.array_union(*words))
    jaccard = F.when((F.size(words[0]) > 0) & (F.size(words[1]) > 0), F.size(F.array_intersect(*words)) / union).otherwise(0.0)
    return F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0).otherwise(F.greatest(chars, jaccard))
