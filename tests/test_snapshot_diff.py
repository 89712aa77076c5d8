import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagequern.operators.snapshot_diff import page_snapshot_changes, snapshot_changes

SCHEMA = "snapshot_id bigint, delivery int, url string, snapshot_name string, normalized_hash string, paragraphs array<string>, links array<struct<url:string,text:string,rel:string>>, taken_at timestamp_ntz, k1 string, p string, id bigint"
T = dt.datetime(2025, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(i, d, u, n, h, p, None if l is None else [(x, None, None) for x in l], T + dt.timedelta(hours=t), "clash", "clash", 7) for i, (d, u, n, h, p, l, t) in enumerate(rows, 1)], SCHEMA)


def changes(spark, rows):
    return {(r["url_key"], r["snapshot_name"], r["delivery"], r["change"]) for r in page_snapshot_changes(table(spark, rows)).collect()}


def test_edges(spark):
    u, h, g = "https://a.example/x", "a" * 64, "B" * 64
    rows = [
        (1, u, None, h, ["one", " two "], ["https://a/1", "https://a/2?utm_source=q"], 0),
        (2, u + "/?utm_source=z", "", h, ["one", "two", ""], ["https://a/2", "https://a/1", "https://a/1"], 1),
        (2, u, "", h, ["stale"], [], 0),
        (3, u, "", "sha256:" + h.upper(), None, ["https://a/1", "https://a/2"], 0),
        (4, u, "", g, None, ["https://a/1", "https://a/2"], 0),
        (5, u, "", None, None, None, 0),
        (1, "https://b.example/", "n", None, None, None, 0),
        (3, "https://b.example", "n", None, [], None, 0),
        (4, None, None, None, None, None, 0),
        (None, "https://c.example/", None, None, None, None, 0),
    ]
    assert changes(spark, rows) == {
        (u, "", 4, "changed"), (u, "", 5, "changed"),
        ("https://b.example/", "n", 2, "removed"), ("https://b.example/", "n", 3, "added"), ("https://b.example/", "n", 4, "removed"),
        ("", "", 4, "added"), ("", "", 5, "removed"),
    }


def test_ties_and_copies(spark):
    rows = [(1, "https://a.example/", None, None, ["x"], None, 0)] * 3 + [(2, "https://a.example/", None, None, ["y"], None, 5), (2, "https://a.example/", None, None, ["x"], None, 5)]
    assert changes(spark, rows) == set()  # the larger snapshot_id decides between equal times


def test_empty(spark):
    assert changes(spark, []) == set()


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 4), f"k{rng.randint(0, 25)}", rng.choice([None, 1, 2]), rng.choice([None, 5, 6]), rng.randint(0, 1), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, d int, k string, p bigint, n bigint, l bigint, t int")
    got = snapshot_changes(df, row_id="id", delivery="d", taken=F.col("t"), key=[F.col("k")], parts=F.col("p"), parts_hash=F.col("n"), links=F.col("l"))
    got = {(r["id"], r["d"], r["change"]) for r in got.collect()}
    last = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        last[r[2], r[1]] = r
    want = set()
    for d in range(2, 5):
        for k in {r[2] for r in rows}:
            a, b = last.get((k, d - 1)), last.get((k, d))
            if b and not a:
                want.add((b[0], d, "added"))
            elif a and not b:
                want.add((a[0], d, "removed"))
            elif a and b:
                differs = a[3] != b[3] if a[3] is not None and b[3] is not None else a[4] is not None and b[4] is not None and a[4] != b[4]
                if differs or a[5] != b[5]:
                    want.add((b[0], d, "changed"))
    assert got == want


def test_long_values(spark):
    long = "word " * 200_000
    rows = [(1, "https://a.example/", None, None, [long], None, 0), (2, "https://a.example/", None, None, [long + "x"], None, 0)]
    assert changes(spark, rows) == {("https://a.example/", "", 2, "changed")}
