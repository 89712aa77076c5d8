"""Streams: windowed counts with late data, snapshot changes with keyed state, per-host concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequern.session import scratch


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a written table, and read it back. The checkpoint lies in
    the shared folder, so a lost executor or driver resumes where the last batch ended; forget_settled
    deletes both."""
    spark = stream.sparkSession
    base = scratch(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    # a pattern, since the file source wants a folder where a path names one file
    return spark.readStream.schema(schema).parquet(f"{base}/{name}.parque[t]")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; windows close once the watermark passes them."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def first_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


_CHANGE = "url string, name string, snapshot_id bigint, change string"


def _against_last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["delivery", "taken_at", "snapshot_id"])
    last = state.get[0] if state.exists else None
    out = []
    for i, h in zip(rows["snapshot_id"], rows["h"], strict=True):
        out.append((key[0], key[1], i, "first" if last is None else "same" if h == last else "changed"))
        last = h
    state.update((int(last),))
    yield pd.DataFrame(out, columns=["url", "name", "snapshot_id", "change"])


def snapshot_stream(snapshots: DataFrame) -> DataFrame:
    """Each arriving snapshot against the last one of its URL and name, which is the key's only state."""
    rows = snapshots.select("url", F.coalesce("snapshot_name", F.lit("")).alias("name"), "snapshot_id", "delivery", "taken_at", F.xxhash64("paragraphs").alias("h"))
    return rows.groupBy("url", "name").applyInPandasWithState(_against_last, _CHANGE, "h bigint", "append", GroupStateTimeout.NoTimeout)


def politeness(log: DataFrame, base: int = 2) -> DataFrame:
    """log (host, seq, status) -> (host, requests, limit): the concurrency of each host after its log: halved by
    429, one more up to base by each 2xx or 3xx. A fold over a host's requests in order, made by composing
    clamped functions, so that it also runs as an aggregation over ordered arrays of bounded blocks."""
    block = F.floor(F.col("seq") / 4096)
    parts = log.groupBy("host", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("rows"))
    # within a block, the state after it for each possible state before it (1..base)
    step = lambda s, r: F.when(r["status"] == 429, F.greatest(F.lit(1), F.floor(s / 2).cast("int"))).when(r["status"].between(200, 399), F.least(F.lit(base), s + 1)).otherwise(s)
    maps = parts.select("host", "block", F.size("rows").alias("n"), F.array(*[F.aggregate("rows", F.lit(s), step) for s in range(1, base + 1)]).alias("m"))
    whole = maps.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("block", "n", "m"))).alias("blocks"))
    return whole.select("host", F.aggregate("blocks", F.lit(0), lambda a, b: a + b["n"]).alias("requests"), F.aggregate("blocks", F.lit(base), lambda a, b: F.get(b["m"], a - 1)).alias("limit"))
