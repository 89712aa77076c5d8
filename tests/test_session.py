"""Joins beyond the broadcast limit, sizes, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from pagequern import session


@pytest.fixture(scope="module")
def sides(spark):
    # a third of the large side holds one key; one key has no partner, one is NULL, two rows are the same
    big = spark.createDataFrame([(1 if i % 3 == 0 else i, f"v{i}") for i in range(300)] + [(None, "n"), (2, "v2"), (2, "v2")], "k bigint, v string")
    small = spark.createDataFrame([(i, f"s{i}") for i in range(1, 200)] + [(7, "again")], "k bigint, s string")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_both_ways_give_the_same(sides, how):
    big, small = sides
    want = sorted(map(str, big.join(small, ["k"], how).collect()))
    near = session.measured_join(big, small, ["k"], how)
    far = session.measured_join(big, small, ["k"], how, limit=0)
    assert sorted(map(str, near.collect())) == want == sorted(map(str, far.collect()))
    assert sorted(far.columns) == sorted(near.columns)


def test_a_hot_key_is_spread(sides):
    big, small = sides
    far = session.measured_join(big, small.where("k = 1"), ["k"], limit=0)
    salted = [r for r in far._jdf.queryExecution().toString().split("\n") if "xxhash64(k" in r and "v" in r]
    assert salted and far.count() == 101


def test_other_kinds_are_refused(sides):
    with pytest.raises(ValueError):
        session.measured_join(*sides, ["k"], "full")


def test_bytes_of(spark):
    df = spark.createDataFrame([(1, "abc", [1, 2]), (None, None, None)], "a bigint, b string, c array<int>")
    assert session.bytes_of(df) == (16 + 8 + 19 + 48) + (16 + 8)
    assert session.bytes_of(df.limit(0)) == 0
    assert session.bytes_of(df.select(F.array(F.lit("ab"), F.lit("c")).alias("x"))) == 2 * (16 + 16 + 32 + 3)


def test_no_machine_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError):
        session.shared_dir(Session())
