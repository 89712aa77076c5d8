"""What changed between two states of the same pages, and merges of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: so many added or removed headings or links are told.
LISTED = 25


def _known(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())


def missing_from(left: Column, right: Column, fold: bool = False) -> Column:
    """Distinct elements of left that right lacks, at most LISTED of them; with fold in any case of letters."""
    if fold:
        have = F.transform(_known(right), F.lower)
        return F.slice(F.array_distinct(F.filter(_known(left), lambda x: ~F.array_contains(have, F.lower(x)))), 1, LISTED)
    return F.slice(F.array_except(_known(left), _known(right)), 1, LISTED)


def metadata_changes(previous: Column, current: Column) -> Column:
    """Full outer comparison of two maps of strings: array of struct(key, kind), by key; NULL maps are empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(previous, empty), F.coalesce(current, empty)
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    kind = lambda k: F.when(~F.map_contains_key(a, k), "added").when(~F.map_contains_key(b, k), "removed").when(~F.element_at(a, k).eqNullSafe(F.element_at(b, k)), "changed")
    return F.slice(F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), kind(k).alias("kind"))), lambda x: x["kind"].isNotNull()), 1, 50)


def change_summary(pairs: DataFrame) -> DataFrame:
    """pairs (id, previous, current: structs of title, content_hash, normalized_hash, paragraphs, links) -> what
    changed: links, paragraphs as a multiset of lines, metadata, and whether it was the hash alone."""
    p, c = (lambda f: F.col(f"previous.{f}")), (lambda f: F.col(f"current.{f}"))
    lines = lambda x: F.array_sort(F.filter(_known(x), lambda y: y != ""))
    other_hash = ~p("content_hash").eqNullSafe(c("content_hash"))
    meta = lambda z: F.map_filter(F.create_map(F.lit("title"), z("title")), lambda k, v: v.isNotNull())
    return pairs.select(
        "id",
        F.size(missing_from(c("links"), p("links"))).alias("links_added"),
        F.size(missing_from(p("links"), c("links"))).alias("links_removed"),
        F.array_join(F.transform(metadata_changes(meta(p), meta(c)), lambda x: F.concat_ws(":", x["key"], x["kind"])), ",").alias("metadata"),
        (other_hash & p("normalized_hash").eqNullSafe(c("normalized_hash"))).alias("unchanged_after_normalization"),
        (other_hash & (lines(p("paragraphs")) == lines(c("paragraphs")))).alias("hash_only_change"),
    )


def last_wins(rows: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """Of each key the row that comes last by order: merging states in which a later one overwrites. One map-side
    combined maximum."""
    return rows.groupBy(key.alias("key")).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("r")).select("key", *[F.col(f"r.{c}") for c in keep])


def unique_append(rows: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(key, values): each key's distinct values in the order in which they came first; NULL values are left out.
    Distinct by an aggregation first, so that a key's copies cost no memory."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("v")).agg(F.min(order).alias("o"))
    return first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "v")))["v"].alias("values"))


def field_matches(rows: DataFrame, fields: list[str], word: str) -> DataFrame:
    """(field, matches): in how many rows each field holds the word, in any case."""
    counts = rows.agg(*[F.count_if(F.lower(F.col(f)).contains(word.lower())).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("matches")) for f in fields])).alias("x")).select("x.*")
