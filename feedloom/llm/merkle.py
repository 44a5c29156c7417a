"""Merkle manifest of a dataset: leaves, subroots per language, one root, and proofs that fold.

A leaf is the SHA-256 of a row's fields.  The leaves of a language stand in order of doc_id;
every 8 neighbours make a parent until one node, the subroot, is left; the subroots make the
root in the same way.  A parent is hashed child by child, and a copy of the hash state is kept
before each child slot.  To fold a changed child in, the state of its slot is taken up again
and fed with the replacement and the siblings to its right; nothing to the left is read twice.

The tree is built in chunks of FAN ** DEPTH leaves, so a task holds one chunk at a time, whatever the
size of a language.  Chunk tops are the leaves of the tree above them.  Going down, each chunk
gets the states and siblings of the nodes above its top as one row, a few kilobytes; all folds
of its leaves, up to the root, happen in its task, and no task sees them all.

Defined cases: null fields count as ``-``; a null language is the first one, a null doc_id the
first leaf of its language; rows that share a doc_id stand by leaf, equal rows are leaves
each; a row with a null doc_id is never tampered with; an empty table gives an empty result;
very long texts are hashed in the JVM; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.scan import row_index, scan
from ..session import settle

FAN = 8
DEPTH = 4  # levels built in one task
ROWS = 4096  # of a batch that leaves a task
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


PATH = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))  # a level: what stands left, what stands right
_HEAD = -1  # place of a chunk's head among its rows


def leaf_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each its UTF-8 length, a colon and its value, or ``-`` if null."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf of the tampered row (null where none was)."""
    cols = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = [*cols[:-1], F.when(hit, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))]
    return docs.select("doc_id", "lang", leaf_hash(cols).alias("leaf"), F.when(hit, leaf_hash(other)).alias("now"))


class Parent:
    """A node with the states of its hash before each child slot."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        h = hashlib.sha256()
        for c in children:
            self.states.append(h.copy())
            h.update(c.encode())
        self.digest = h.hexdigest()

    def folded(self, slot: int, node: str) -> str:
        """The digest with another child at ``slot``."""
        h = self.states[slot].copy()
        h.update("".join([node, *self.children[slot + 1 :]]).encode())
        return h.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


def levels_of(n: int) -> int:
    """How often ``n`` nodes are taken together until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def grown(nodes: list[str], levels: int) -> list[list[Parent]]:
    """The parents above the neighbouring ``nodes``, level by level."""
    out = []
    for _ in range(levels):
        row = [Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(row)
        nodes = [p.digest for p in row]
    return out


def _chunk_of(idx, depth: int) -> Column:
    return F.floor(idx / FAN**depth).cast("long")


def sizes(nodes: DataFrame, depth: int) -> DataFrame:
    """(grp, chunk, n): a head for each chunk, with the number of nodes of its group."""
    n = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    return n.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), _chunk_of(F.col("n") - 1, depth))).alias("chunk"), "n")


def _dealt(nodes: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """Nodes (grp, idx, ...) by chunk, in order, each chunk behind its head (grp, chunk, n, ...)."""
    rows = nodes.withColumn("chunk", _chunk_of(F.col("idx"), depth))
    both = rows.unionByName(heads.withColumn("idx", F.lit(_HEAD).cast("long")), allowMissingColumns=True)
    return both.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "idx")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, list]]]:
    """(head, columns of the nodes) of each chunk."""
    head, held = None, None
    for batch in batches:
        names = batch.schema.names
        at = names.index("idx")
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[at] == _HEAD:
                if head is not None:
                    yield head, dict(zip(names, zip(*held)))
                head, held = dict(zip(names, row)), []
            else:
                held.append(row)
    if head is not None:
        yield head, dict(zip(names, zip(*held)))


def _mapped(df: DataFrame, out: T.StructType, fn, depth: int) -> DataFrame:
    """``fn`` (head, columns, parents level by level) to rows, chunk by chunk."""
    names, kinds = out.names, [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        held: list[tuple] = []
        for head, cols in _chunks(batches):
            held += fn(head, cols, grown(list(cols["node"]), min(depth, levels_of(head["n"]))))
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return df.mapInArrow(run, out)


def _top(head: dict, cols: dict[str, list], rows: list[list[Parent]]) -> list[tuple]:
    return [(head["grp"], head["chunk"], rows[-1][0].digest if rows else cols["node"][0])]


def _paths(head: dict, cols: dict[str, list], rows: list[list[Parent]]) -> list[tuple]:
    out = []
    for i, idx in enumerate(cols["idx"]):
        path, at = [], i
        for row in rows:
            p, slot = row[at // FAN], at % FAN
            path.append([p.children[:slot], p.children[slot + 1 :]])
            at //= FAN
        out.append((head["grp"], idx, path + head["up"], head["root"]))
    return out


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def tops(nodes: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """(grp, idx, node): the node over each chunk of ``nodes`` (grp, idx from 0, node)."""
    return _mapped(_dealt(nodes, heads, depth), _fields(grp=T.BinaryType(), idx=T.LongType(), node=T.StringType()), _top, depth)


def paths(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(grp, idx, path, root): for each node its siblings on every level up to the root of its group."""
    heads = settle(sizes(nodes, depth))
    if heads.filter("n > 1").isEmpty():
        return nodes.select("grp", "idx", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    up = paths(settle(tops(nodes, heads, depth)), depth)
    up = up.select("grp", F.col("idx").alias("chunk"), F.col("path").alias("up"), "root")
    out = _fields(grp=T.BinaryType(), idx=T.LongType(), path=PATH, root=T.StringType())
    return settle(_mapped(_dealt(nodes, heads.join(up, ["grp", "chunk"]), depth), out, _paths, depth))


class Climb:
    """The way from a chunk's top to the root: one hash state before the own slot a level."""

    def __init__(self, path: list[list[list[str]]]):
        self.steps = [(hashlib.sha256("".join(left).encode()), "".join(right).encode()) for left, right in path]
        self.siblings = "".join(c for level in path for side in level for c in side).encode()

    def folded(self, node: str) -> str:
        for state, right in self.steps:
            h = state.copy()
            h.update(node.encode())
            h.update(right)
            node = h.hexdigest()
        return node


def _proved(head: dict, cols: dict[str, list], rows: list[list[Parent]]) -> list[tuple]:
    climb, out = Climb(head["up"]), []
    for i, (leaf, now) in enumerate(zip(cols["node"], cols["now"])):
        proof, node, at = hashlib.sha256(), now or leaf, i
        for row in rows:
            p, slot = row[at // FAN], at % FAN
            proof.update(p.siblings(slot).encode())
            node = p.folded(slot, node)
            at //= FAN
        proof.update(climb.siblings)
        node = climb.folded(node)
        out.append((cols["doc_id"][i], leaf, head["subroot"], head["root"], proof.hexdigest(), node, node == head["root"]))
    return out


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    named = leaves(docs).select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).cast("binary").alias("grp"),
        "doc_id", "now", F.col("leaf").alias("node"), F.monotonically_increasing_id().alias("tie"),
    )
    at = scan(named, ["grp"], ["doc_id", "node", "tie"], at=row_index())
    nodes = settle(at.select("grp", (F.col("at") - 1).alias("idx"), "doc_id", "node", "now"))
    heads = settle(sizes(nodes, depth))

    low = settle(paths(settle(tops(nodes.select("grp", "idx", "node"), heads, depth)), depth))
    subs = settle(low.filter("idx = 0").select(F.col("grp").alias("lang"), F.col("root").alias("node"), F.lit(b"").alias("grp")))
    ordered = settle(scan(subs, ["grp"], ["lang"], at=row_index()).select("lang", "grp", (F.col("at") - 1).alias("idx"), "node"))
    high = paths(ordered.select("grp", "idx", "node"), depth).select("idx", F.col("path").alias("high"), "root")
    high = high.join(ordered.select("idx", F.col("lang").alias("grp")), "idx").drop("idx")
    up = low.join(high.withColumnRenamed("root", "whole"), "grp").select(
        "grp", F.col("idx").alias("chunk"), F.concat("path", "high").alias("up"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )
    text = T.StringType()
    out = _fields(
        doc_id=docs.schema["doc_id"].dataType, leaf=text, subroot=text, root=text, proof_sha256=text, folded_root=text, verified=T.BooleanType()
    )
    return _mapped(_dealt(nodes, heads.join(up, ["grp", "chunk"]), depth), out, _proved, depth)
