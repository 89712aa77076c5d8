"""Session helpers: reading tables, cutting lineage, and joins that broadcast only after a size check."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was written and measured, and holds at most this many bytes.
BROADCAST_BYTES = 64 << 20
#: Copies of the small side, and random shares of the large one, in a salted join.
SALT = 16


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and bench runs on one machine."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("pagequern").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A folder of our own is set only where the session names none, and only
    if its executors run on this machine; a cluster without a shared folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagequern-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the settled tables."""
    path = f"{shared_dir(spark).rstrip('/')}/pagequern-{uuid.uuid4().hex}"
    _settled.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, and several consumers read
    columns of compressed parquet instead of computing them again. Survives the loss of executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_settled = True
    return out


_settled: list[str] = []


def forget_settled(spark: SparkSession) -> None:
    """Delete all tables settled so far; call it when no plan that reads them will run again."""
    jvm = spark.sparkContext._jvm
    for path in _settled:
        with contextlib.suppress(Exception):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _settled.clear()


@atexit.register
def _sweep() -> None:
    """Settled tables on a local or mounted shared folder go when the driver ends."""
    for path in _settled:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows of df: eight for a fixed-width value, the length of strings and binaries, the
    elements of arrays (of strings: sixteen each and their letters), and sixteen for each of those."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c) + 16
        if isinstance(kind, (T.ArrayType, T.MapType)):
            letters = F.octet_length(F.array_join(c, "")) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType) else F.lit(0)
            return F.size(c) * 16 + letters + 16
        return F.lit(8)

    row = sum((F.coalesce(width(F.col(f.name), f.dataType), F.lit(0)).cast("bigint") for f in df.schema.fields), F.lit(16).cast("bigint"))
    return df.agg(F.sum(row)).first()[0] or 0


def measured_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join (inner, left, left_semi, left_anti) a large table with a side that is usually small.

    small is settled, unless it is already, and its bytes are added up: within the limit it is broadcast;
    beyond it both sides are shuffled with a salt, the hash of the whole row of big, so that a key holding a
    third of big is spread over SALT tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no measured join of kind {how}")
    if not getattr(small, "_is_settled", False):
        small = settle(small)
    if bytes_of(small) <= limit:
        return big.join(F.broadcast(small), on, how)
    whole = [F.col(f.name) for f in big.schema.fields if not isinstance(f.dataType, T.MapType)]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*whole), F.lit(SALT)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def key128(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns."""
    return F.xxhash64(F.lit(17), *columns), F.xxhash64(F.lit(4211), *columns)


_shipped: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's folder or path."""
    context = spark.sparkContext
    if id(context) in _shipped:
        return
    _shipped.add(id(context))
    from pathlib import Path

    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pagequern-zip-"))
    bare = target / "src"
    shutil.copytree(here, bare / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(target / here.name), "zip", bare))
