"""The test tables seen as a feed, with the same views written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..session import spread
from .registry import table

EPOCH0 = 1704067200  # 2024-01-01 00:00:00 UTC, the first day of the feed
ZONE = "Europe/Kyiv"

# Promo rule pack for the demo texts: license and rights lines, bare links.
PROMO = (
    "(?i)(?:released|licensed) under the [a-z ]*license|version [0-9.]+"
    "|all rights reserved|^\\s*https?://\\S+\\s*$"
)


def feed(spark: SparkSession, d: str) -> DataFrame:
    """events as messages: channel, message_id, ts, ts_s, who, n, value."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("channel"),
        F.col("event_id").alias("message_id"),
        "ts",
        clock.epoch_s(F.col("ts")).alias("ts_s"),
        F.col("user_id").alias("who"),
        F.get_json_object("props", "$.k").cast("long").alias("n"),
        "value",
    )


FEED = """feed AS (
  SELECT event_type AS channel, event_id AS message_id, ts,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts_s, user_id AS who,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, value
  FROM events)"""


def posts(spark: SparkSession, d: str) -> DataFrame:
    """documents as messages: channel, message_id, ts_s, text."""
    return spread(table(spark, d, "documents")).select(
        F.col("source").alias("channel"),
        F.col("doc_id").alias("message_id"),
        (F.col("doc_id") + EPOCH0).alias("ts_s"),
        "text",
        "lang",
    )


POSTS = f"""posts AS (
  SELECT source AS channel, doc_id AS message_id, doc_id + {EPOCH0} AS ts_s, text, lang
  FROM documents)"""


def sql(body: str, *ctes: str) -> str:
    """``body`` behind its common parts; a body may go on with parts of its own."""
    return "WITH " + ",\n".join(ctes) + "\n" + body
