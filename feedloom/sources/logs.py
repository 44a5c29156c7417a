"""Decision logs, label snapshots and state snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "at TIMESTAMP, anchor STRING, lag_s DOUBLE, text STRING, notify BOOLEAN, level STRING, "
    "alarm STRING, reason STRING, said STRING, who STRING, warm BOOLEAN, sky STRING, since LONG"
)


def write_decisions(df: DataFrame, path: str) -> None:
    """One JSON row per message and recipient; never overwrites."""
    df.write.mode("append").json(path)


def read_decisions(spark: SparkSession, *paths: str, keys: tuple[str, ...] = ("anchor",)) -> DataFrame:
    """Overlapping logs as one: broken lines and warm rows dropped, first line of the first file wins."""
    raw = (
        spark.read.schema(LOG_SCHEMA + ", _corrupt STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(list(paths))
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_line", F.monotonically_increasing_id())  # a block is read by one task, in order
    )
    good = raw.filter(
        F.col("_corrupt").isNull() & ~F.coalesce("warm", F.lit(False)) & F.col("anchor").isNotNull())
    rest = [c for c in good.columns if c not in (*keys, "_file", "_block", "_line", "_corrupt")]
    first = good.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("_file", "_block", "_line")).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def newest_snapshot(rows: DataFrame, night: str, stamp: str) -> DataFrame:
    """Per night only the rows of the newest snapshot that mentions it."""
    newest = rows.groupBy(night).agg(F.max(stamp).alias("_newest"))
    return rows.join(newest, night).filter(F.col(stamp) == F.col("_newest")).drop("_newest")


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per night the rows of the newest snapshot, a folder of any number of part files.

    A snapshot is as new as its newest file.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumns({
        "_time": F.col("_metadata.file_modification_time"), "_folder": F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1)})
    age = rows.groupBy("_folder").agg(F.max("_time").alias("_newest_file"))
    rows = rows.join(age, "_folder").withColumn("_stamp", F.struct("_newest_file", "_folder"))
    return newest_snapshot(rows, "night", "_stamp").drop("_stamp", "_time", "_folder", "_newest_file")


def latest_state(df: DataFrame, key: str, at: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_s")).select(
        key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def newer_files(df: DataFrame, days: int) -> DataFrame:
    """Rows of files written in the last ``days``; whole files are skipped at the scan."""
    return df.filter(F.col("_metadata.file_modification_time") >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def newer_rows(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the newest one."""
    top = df.agg(F.max(at).alias("_top"))
    return df.join(F.broadcast(top), F.col(at) >= F.col("_top") - days * 86400).drop("_top")
