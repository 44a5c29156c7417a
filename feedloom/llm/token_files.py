"""Token ids in files of independently coded, checksummed blocks.

Documents are range-partitioned and sorted by doc_id; a task encodes its texts and writes
segments.  A segment is one row of a Parquet file and stands by itself: part and number,
the doc_id and length of each of its documents, and the blocks of its ids, each with its
payload, number of ids and crc32.  A document never crosses a segment, and no block needs
another, so any segment can be read alone and a damaged block is found and named.

Defined cases: a null or empty text is one end id; repeated rows follow each other; null
doc_id rows come first; an empty table gives an empty file set and result.  Very long texts
are encoded whole and span many blocks; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh_path, small_side
from . import range_coder
from .tokens import Encoder, with_end

TOKENIZER = "byte_bpe_50k.json"
SEGMENT = 6_000_000  # ids after which a segment ends, at the end of a document
TEXTS = 256

_BLOCK = pa.struct([("n", pa.int32()), ("crc32", pa.int64()), ("payload", pa.binary())])
_FIELDS = "part int, segment int, lengths array<int>, blocks array<struct<n:int,crc32:bigint,payload:binary>>"


def _write(name: str, id_kind: pa.DataType, segment: int):
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("lengths", pa.list_(pa.int32())), ("blocks", pa.list_(_BLOCK)), ("doc_ids", pa.list_(id_kind))])

    def row(part, number, ids, docs):
        flat = np.concatenate(docs)
        cut = [flat[i : i + range_coder.BLOCK] for i in range(0, len(flat), range_coder.BLOCK)]
        coded = [
            {"n": len(x), "crc32": range_coder.checksum(x), "payload": p} for x, p in zip(cut, range_coder.encode(cut))
        ]
        cols = [[part], [number], [[len(d) for d in docs]], [coded], [ids]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, 0
        encoder, ids, docs = Encoder.of(name), [], []
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                ids += some.column(0).to_pylist()
                for x in encoder.encode(some.column(1).to_pylist()):
                    docs.append(with_end(x).astype(np.uint16))
                    held += len(docs[-1])
                if held >= segment:
                    yield row(part, number, ids, docs)
                    number, held, ids, docs = number + 1, 0, [], []
        if docs:
            yield row(part, number, ids, docs)

    return run


def write(docs: DataFrame, path: str, text: str = "text", tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> None:
    """Write the ids of all documents, in ascending doc_id order, to segment files at ``path``."""
    rows = docs.select("doc_id", F.col(text).alias("_text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    rows.mapInArrow(_write(tokenizer, arrow, segment), f"{_FIELDS}, doc_ids array<{kind}>").write.parquet(path)


def _read(batches):
    for b in batches:
        for at in range(b.num_rows):
            part, number, lengths, blocks, ids = (c[at].as_py() for c in b.columns)
            got = range_coder.decode([x["payload"] for x in blocks], [x["n"] for x in blocks])
            for i, (x, block) in enumerate(zip(got, blocks)):
                if range_coder.checksum(x) != block["crc32"]:
                    raise ValueError(f"block {i} of segment {number} of part {part} is damaged")
            flat = np.concatenate(got).astype("<u4")
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(flat[z - n : z].tobytes()) for n, z in zip(lengths, ends.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(ids, b.column(4).type.value_type),
                 pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    files = spark.read.parquet(path).select("part", "segment", "lengths", "blocks", "doc_ids")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    docs = files.mapInArrow(_read, f"part int, segment int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # one row a part meets in one task: millions of times fewer than ids
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = parts.select("part", before.alias("before"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = small_side(sizes.withColumn("inner", inner).join(heads, "part").select("part", "segment", (F.col("before") + F.col("inner")).alias("at")), 100_000)
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path)
    return read(docs.sparkSession, path)
