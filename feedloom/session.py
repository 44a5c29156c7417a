"""Session helpers: where lineage is cut and where written tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: str = "8", app: str = "feedloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    On a cluster the session has to name one; only a local session, where driver and
    executors are one process, gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    A columnar table rather than ``checkpoint()``: it is smaller, prunes columns when it
    is read back, and its size is known to the planner.  Types that Parquet does not
    hold fall back to a checkpoint.
    """
    spark = df.sparkSession
    if any(_has_void(f.dataType) for f in df.schema.fields):
        shared_folder(spark)
        return df.checkpoint(eager=True)
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _has_void(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_void(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_void(kind.keyType) or _has_void(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_void(f.dataType) for f in kind.fields)
    return isinstance(kind, T.NullType)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a table that is written once."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def width(spark: SparkSession) -> int:
    """Number of pieces a big frame is cut into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a frame read from few splits before costly work on its rows.

    Big inputs already come in many splits and are left alone.
    """
    n = width(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` materialised, and marked for broadcast only if it has at most ``rows`` rows.

    Past that bound the join shuffles both sides, as any other.
    """
    held = settle(df)
    return F.broadcast(held) if held.count() <= rows else held
