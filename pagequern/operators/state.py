"""State tables: keyed upserts, the latest state as of a time, TTL caches, jobs and cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequern.session import settle


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with new rows; of a key the row with the largest order stays, new before old at ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [order, "_new"]).drop("_new")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a map-side combined maximum, without a window over hot keys."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return packed.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def as_of(rows: DataFrame, keys: list[str], at: str, now: Column, ttl_seconds: Column | None = None) -> DataFrame:
    """The newest row of each key not after now, if its age is within the TTL."""
    found = latest(rows.where(F.col(at) <= now), keys, [at])
    if ttl_seconds is None:
        return found
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1_000_000
    return found.where(age <= ttl_seconds)


def cacheable(ttl: Column, cache_control: Column, size: Column) -> Column:
    return (ttl > 0) & ~F.coalesce(F.lower(cache_control).rlike("no-store|private"), F.lit(False)) & (size > 0)


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert and to delete so that old becomes new."""
    gone = old.join(new, keys, "left_anti").select(*keys, F.lit("delete").alias("op"))
    return new.join(old, keys, "left_anti").select(*keys, F.lit("insert").alias("op")).unionByName(gone)


def redact(entries: Column) -> Column:
    """A map without the values of keys that look like secrets."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("token|secret|password|authorization|cookie|api[-_]?key"), "[redacted]").otherwise(v))


def cookie_jar(headers: DataFrame) -> DataFrame:
    """headers (host, seq, set_cookie) -> the last cookie of each name, domain and path."""
    h = F.col("set_cookie")
    attr = lambda name: F.nullif(F.trim(F.regexp_extract(h, rf"(?i);\s*{name}=([^;]*)", 1)), F.lit(""))
    parsed = headers.select(
        "host", "seq", F.trim(F.regexp_extract(h, "^([^=;]+)=", 1)).alias("name"), F.regexp_extract(h, "^[^=;]+=([^;]*)", 1).alias("value"),
        F.coalesce(F.lower(F.regexp_replace(attr("Domain"), r"^\.", "")), F.lower("host")).alias("domain"), attr("Domain").isNull().alias("host_only"), F.coalesce(attr("Path"), F.lit("/")).alias("path"), h.rlike(r"(?i);\s*secure(;|$)").alias("secure"),
    ).where("name <> ''")
    return latest(parsed, ["name", "domain", "host_only", "path"], ["seq"])


def cookies_for(jar: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (url, host, path, https) with the cookies that go with each: by domain, path and security."""
    own = urls.withColumn("domain", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("host", r"\.")) - 1), lambda i: F.array_join(F.slice(F.split("host", r"\."), i + 1, F.lit(50)), "."))))
    joined = own.join(jar.withColumnRenamed("path", "cookie_path").withColumnRenamed("host", "set_by"), "domain")
    ok = (~F.col("host_only") | (F.col("host") == F.col("domain"))) & F.col("path").startswith(F.col("cookie_path")) & (~F.col("secure") | F.col("https"))
    return joined.where(ok).select("url", "name", "value")


def turn_windows(rows: DataFrame, key: str, order: str, delay_ms: int) -> DataFrame:
    """A schedule that keeps delay_ms between the requests of one key.

    Rows are ranged by key and order, so that a key with a third of all rows spans several tasks; each task
    numbers its own part, and the parts before it add their counts.
    """
    ranged = settle(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(key, "_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(order))
    numbered = ranged.withColumn("_own", own).join(offsets, [key, "_part"])
    return numbered.withColumn("slot_ms", (F.col("_own") + F.col("_before") - 1) * delay_ms).select(*rows.columns, "slot_ms")
