"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Documents hash to CELLS cells of a ring; each shard owns many virtual nodes on it.  A cell
belongs to the next virtual node clockwise.  A shard takes cells only up to its capacity,
(1 + EPS) of the mean; cells that overflow a full shard go on clockwise to the next one, so
no shard exceeds the bound and only overflowing cells ever leave their home.

Everything per document is one pass, a partial aggregation over cells, a join with the
cell table and a numbering inside cells.  The ring walk itself works on CELLS rows, a
constant whatever the data, and so does every broadcast.

Defined cases: a null text counts as no bytes (size 1, checksum 0); null doc_id rows are placed by
their text; repeated rows get slots of their own; an empty table gives an empty result.
A very long text is a size like any other; further columns are not read, whatever their names.
The law is ``bytes``: sizes of shards are near equal; ``grown_shard`` is always null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

CELLS = 1 << 16
VIRTUAL = 128  # virtual nodes of a shard
EPS = 0.002


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (bytes + 1), text_crc32 and the ring cell of each row."""
    raw = F.col(text)
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id", raw), 48).cast("int").alias("cell"),
    )


def ring(spark, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(cell, walk): the shards a cell meets, in clockwise order from where it lies."""
    nodes = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(1), F.lit(virtual))).alias("copy"))
        .groupBy(F.shiftrightunsigned(F.xxhash64("shard", "copy"), 48).cast("int").alias("at"))
        .agg(F.min("shard").alias("shard"))  # virtual nodes of one cell: the smallest shard has it
    )
    whole = nodes.agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("nodes"))  # shards x virtual at most
    arcs = whole.select("nodes", F.posexplode("nodes").alias("i", "node"))
    order = F.concat(
        F.expr("slice(nodes.shard, i + 1, size(nodes))"), F.when(F.col("i") > 0, F.expr("slice(nodes.shard, 1, i)")).otherwise(F.array().cast("array<int>"))
    )
    arcs = arcs.withColumns({"walk": F.array_distinct(order), "from": F.when(F.col("i") > 0, F.expr("nodes[i - 1].at + 1")).otherwise(F.lit(0))})
    inner = arcs.select(F.explode(F.sequence("from", "node.at")).alias("cell"), "walk")
    last = F.expr("nodes[size(nodes) - 1].at")  # cells after the last node wrap to the first
    wrapped = arcs.filter((F.col("i") == 0) & (last < CELLS - 1)).select(F.explode(F.sequence(last + 1, F.lit(CELLS - 1))).alias("cell"), "walk")
    return inner.unionAll(wrapped)


def place(loads: DataFrame, shards: int, eps: float = EPS) -> DataFrame:
    """(cell, size, n, shard) of every cell in ``loads`` (cell, size, n).

    One round a step of the walk: each shard admits its waiting cells, largest first, as
    long as they fit; the others go on.  A second walk, with one largest cell more of
    capacity, admits what single large documents left over; by counting, it admits all.
    """
    spark = loads.sparkSession
    waiting = settle(loads.join(ring(spark, shards), "cell").withColumn("tie", F.xxhash64("cell")))
    total, largest = waiting.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    base = -int(-(total * (1 + eps)) // shards)
    done: DataFrame | None = None
    by = W.partitionBy("shard").orderBy(F.desc("size"), "tie", "cell").rowsBetween(W.unboundedPreceding, 0)
    for step in range(2 * shards):
        capacity = base + (largest if step >= shards else 0)
        asked = waiting.withColumn("shard", F.element_at("walk", step % shards + 1))
        held = F.lit(0)
        if done is not None:
            asked = asked.join(F.broadcast(done.groupBy("shard").agg(F.sum("size").alias("held"))), "shard", "left")
            held = F.coalesce("held", F.lit(0))
        asked = settle(asked.select(*waiting.columns, "shard", (F.sum("size").over(by) + held <= capacity).alias("fits")))
        got = asked.filter("fits").select("cell", "size", "n", "shard")
        done = got if done is None else done.unionAll(got)
        waiting = asked.filter("not fits").select(*waiting.columns)
        if waiting.isEmpty():
            break
    return done


def shard(docs: DataFrame, shards: int = 8, eps: float = EPS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard."""
    rows = settle(measured(docs))
    cells = place(rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")), shards, eps)
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    starts = cells.select("cell", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("cell").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(starts), "cell").select(  # CELLS rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + inside - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
