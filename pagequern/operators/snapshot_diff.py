"""What changed between full snapshots (problem 2).

Each row becomes a few numbers: two 64-bit hashes of its key, and hashes of what is compared. Of a key's
rows in one delivery the last counts; that is a map-side combined maximum, so a key that holds a third of
all rows costs a partial aggregate per task. The compact rows are hashed into buckets of bounded size; in
each bucket numpy sorts the keys once and finds, delivery by delivery, what searchsorted does not meet in
the one before. Only for the keys that differ are the full values read, by row id: the differences are
written and measured, and while small sent to the scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequern.functions.url import url_key
from pagequern.functions.volatile import bare_link, mask_lines
from pagequern.session import key128, measured_join

#: Compact rows (about 60 bytes) in a bucket.
BUCKET_ROWS = 250_000

_CHANGES = "id bigint, d int, change string"


def _diff_bucket(low: int, high: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k1, k2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)
        order = np.lexsort((k2, k1))
        new = np.ones(len(order), bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(new)
        d, ids = pdf["d"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        known = {c: pdf[f"{c}_known"].to_numpy(bool) for c in "pn"}
        value = {c: pdf[c].to_numpy(np.int64) for c in "pnl"}
        at = {}
        for x in range(low, high + 1):
            rows = np.flatnonzero(d == x)
            at[x] = rows[np.argsort(key[rows], kind="stable")]
        out: list[tuple[np.ndarray, int, str]] = []
        for x in range(low + 1, high + 1):
            a, b = at[x - 1], at[x]
            ka, kb = key[a], key[b]
            where = np.searchsorted(ka, kb)
            met = np.zeros(len(kb), bool)
            inside = where < len(ka)
            met[inside] = ka[where[inside]] == kb[inside]
            gone = np.ones(len(ka), bool)
            gone[where[met]] = False
            out += [(ids[b[~met]], x, "added"), (ids[a[gone]], x, "removed")]
            i, j = a[where[met]], b[met]
            by_hash = known["n"][i] & known["n"][j] & (value["n"][i] != value["n"][j])
            differs = np.where(known["p"][i] & known["p"][j], value["p"][i] != value["p"][j], by_hash) | (value["l"][i] != value["l"][j])
            out.append((ids[j[differs]], x, "changed"))
        return pd.DataFrame(
            {
                "id": np.concatenate([o[0] for o in out]) if out else np.array([], np.int64),
                "d": np.concatenate([np.full(len(o[0]), o[1], np.int32) for o in out]) if out else np.array([], np.int32),
                "change": np.array([o[2] for o in out for _ in range(len(o[0]))], dtype=object),
            }
        )

    return run


def snapshot_changes(rows: DataFrame, *, row_id: str, delivery: str, taken: Column, key: list[Column], parts: Column, parts_hash: Column, links: Column) -> DataFrame:
    """(row id, delivery, change) of every key added, removed or changed against the delivery before.

    parts: hash of the compared list, NULL if unknown; then parts_hash stands for it, and if that is NULL
    too, nothing is said of the list. links: hash of the compared set. Of a key's rows in a delivery the
    one with the largest taken counts, at ties the one with the largest row id. A delivery that is missing
    between two others counts as empty. Rows without a delivery belong to none. Empty input: no rows.
    """
    k1, k2 = key128(*key)
    compact = rows.where(F.col(delivery).isNotNull()).select(
        F.col(delivery).cast("int").alias("d"), k1.alias("k1"), k2.alias("k2"), F.struct(taken.alias("t"), F.col(row_id).cast("bigint").alias("id"), parts.alias("p"), parts_hash.alias("n"), links.alias("l")).alias("r")
    )
    # no NULL reaches pandas, where it would turn 64-bit hashes into floats
    last = compact.groupBy("d", "k1", "k2").agg(F.max("r").alias("r")).select(
        "d", "r.id", "k1", "k2", F.coalesce("r.p", F.lit(0)).alias("p"), F.col("r.p").isNotNull().alias("p_known"), F.coalesce("r.n", F.lit(0)).alias("n"), F.col("r.n").isNotNull().alias("n_known"), F.coalesce("r.l", F.lit(0)).alias("l")
    )
    low, high, count = rows.agg(F.min(delivery), F.max(delivery), F.count(F.lit(1))).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], _CHANGES)
    buckets = count // BUCKET_ROWS + int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return last.groupBy(F.pmod("k1", F.lit(buckets)).alias("bucket")).applyInPandas(_diff_bucket(int(low), int(high)), _CHANGES)


def page_snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(url_key, snapshot_name, delivery, change, snapshot_id) of page snapshots.

    NULL names count as ''. Paragraphs are compared trimmed and masked, links as a set of URLs without
    tracking and session parameters (NULL links as none). A normalized hash is compared without its prefix
    and case, as far as both rows have one of the same kind (SHA-256); else it says nothing.
    """
    masked = mask_lines(F.col("paragraphs"))
    urls = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(F.col("links.url"), F.array().cast("array<string>")), lambda x: x.isNotNull()), bare_link)))
    given = F.lower(F.regexp_replace(F.col("normalized_hash"), "(?i)^sha-?256[:=]", ""))
    rows = snapshots.select("snapshot_id", "delivery", "taken_at", url_key(F.col("url")).alias("u"), F.coalesce("snapshot_name", F.lit("")).alias("nm"), masked.alias("m"), given.alias("g"), urls.alias("ls"))
    comparable = F.col("g").rlike("^[0-9a-f]{64}$")
    changes = snapshot_changes(
        rows,
        row_id="snapshot_id",
        delivery="delivery",
        taken=F.col("taken_at"),
        key=[F.col("u"), F.col("nm")],
        parts=F.when(F.col("m").isNotNull(), F.xxhash64("m")),
        parts_hash=F.when(comparable, F.xxhash64("g")),
        links=F.xxhash64("ls"),
    )
    # full values are read for the differing rows alone, and what is derived from them is computed after the join
    full = measured_join(snapshots.select(F.col("snapshot_id").cast("bigint").alias("id"), "url", "snapshot_name"), changes, ["id"])
    return full.select(url_key(F.col("url")).alias("url_key"), F.coalesce("snapshot_name", F.lit("")).alias("snapshot_name"), F.col("d").alias("delivery"), "change", F.col("id").alias("snapshot_id"))
