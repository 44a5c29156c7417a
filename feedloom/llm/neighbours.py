"""Approximate nearest neighbours by inner product: an HNSW graph per shard, results merged.

Equal vectors are one node of the graph, so a vector that stands in a third of the rows
does not fill its neighbours' lists; its rows come back at the end, the smallest ids first.
Distinct vectors are dealt to shards of about SHARD_ROWS by hash.  A task builds the graph
of a shard and writes it as one row of flat arrays; queries meet every shard in blocks of
about QUERY_ROWS, so a task holds one shard and one block, and the best of all shards are
merged by score.  Inner product becomes cosine by one more component, which lifts every
vector to the greatest length found.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows with a null id; each length has graphs of its own, which only queries of
that length meet; a query without a valid vector returns nothing; rows that share an id are candidates each;
equal scores go to the smaller id; an empty table gives an empty result.
There are no texts; columns besides the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .hnsw import Graph

SHARD_ROWS = 8192
QUERY_ROWS = 512
M, REACH, SEARCH = 16, 64, 112

_INDEX = "shard int, ids binary, vectors binary, dim int, longest double, sizes array<int>, links binary, nodes binary"


def valid(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(vec)
    ok = df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).select("vec_id", v.cast("array<double>").alias("v"))
    return ok.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    longest = float(pdf["longest"].iloc[0])
    g = Graph(_lift(x, longest), M, REACH)
    row = {"shard": int(pdf["shard"].iloc[0]), "ids": pdf["node"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), "dim": x.shape[1], "longest": longest}
    return pd.DataFrame([row | g.dump()])


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose cosine with a query orders like the inner product of ``x``."""
    y = x / longest
    return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]


def build(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: one row a shard, from distinct vectors (node, v)."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    widths = nodes.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard_rows).alias("shards"), F.max(length).alias("longest"))
    dealt = nodes.withColumn("dim", F.size("v")).join(F.broadcast(settle(widths)), "dim")  # one row a length
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    return settle(dealt.groupBy("dim", "shard").applyInPandas(_build, _INDEX))


def _search(k: int, reach: int):
    def run(batches):
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.vectors).reshape(-1, r.dim)
                ids = np.frombuffer(r.ids, np.int64)
                g = Graph.load(_lift(x, r.longest), M, list(r.sizes), r.links, r.nodes)
                for q in r.queries:
                    v = np.asarray(q["v"], np.float64)
                    near = g.search(np.append(v / np.linalg.norm(v), 0), k, reach)
                    out += zip([q["vec_id"]] * len(near), ids[near].tolist(), [r.dim] * len(near), (x[near] * v).sum(1).tolist())
            kinds = {"query_id": "int64", "node": "int64", "dim": "int32", "score": "float64"}
            yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return run


def search(index: DataFrame, queries: DataFrame, k: int, reach: int = SEARCH) -> DataFrame:
    """(query_id, node, dim, score): the ``k`` best nodes of each query (vec_id, v) over all shards."""
    shards = settle(index.select("dim", "shard"))  # two numbers a shard
    n = shards.count()
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    if not n:
        return queries.sparkSession.createDataFrame([], "query_id long, node long, dim int, score double")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select(block, F.size("v").alias("dim"), F.struct("vec_id", "v").alias("q")).groupBy("block", "dim").agg(F.collect_list("q").alias("queries"))  # QUERY_ROWS or so
    asked = asked.join(F.broadcast(shards), "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = held.hint("shuffle_hash").join(asked, ["dim", "shard", "block"]).repartition(n * blocks, "dim", "shard", "block")
    found = met.select("ids", "vectors", "dim", "sizes", "links", "nodes", "longest", "queries").mapInPandas(_search(k, reach), "query_id long, node long, dim int, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def nearest(df: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each query, itself left out."""
    rows = settle(valid(df))
    # of equal vectors the first k + 1 ids can be in an answer; the limit is applied before the shuffle
    by = W.partitionBy("v").orderBy("vec_id")
    copies = settle(rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1).withColumn("node", F.min("vec_id").over(W.partitionBy("v"))))
    nodes = copies.filter("r = 1").select("node", "v")
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"])
    found = search(build(nodes), queries, k + 1)
    every = found.join(copies.select("node", F.size("v").alias("dim"), "vec_id"), ["node", "dim"]).filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
