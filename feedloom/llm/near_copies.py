"""SimHash near duplicates: fingerprints linked at few differing bits, and their components.

Equal fingerprints are folded first, so a text posted a million times is one code.  Two
codes that differ in at most ``limit`` of 64 bits agree in at least two of ``limit + 2``
equal blocks; every code is therefore dealt to one bucket for each pair of blocks, and a
bucket is searched with a Gray-order index.  A bucket over BIG codes is dealt again by the
blocks of its remaining bits until it is small or no bits are left to divide, so no task
gets an unbounded group.  Links leave a task as a spanning forest (local union-find), not
as all pairs; nothing is capped.  Components are found by alternating star contraction on
written tables.

Defined cases: a null or empty text has fingerprint zero and links like any other; null
doc_id rows take part and a component's id is its smallest non-null doc_id (null if all
are null); repeated rows are returned as often as they occur; an empty table gives an empty
result.  Very long texts are hashed in blocks of words; in ``near_duplicates`` further columns are
not read, in ``keep_one`` they come back as they are, whatever their names.

``keep_one`` is not bound to the contract above: its groups are the components of texts whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them, each pair
verified on the whole sets (``shingle_sets``).  The SimHash links come first, each verified like
that; pairs beyond its few bits are then found by their leading shingles.  Texts with equal sets are one node, so exact
copies are compared once; nodes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, small_side
from . import shingle_sets
from .fingerprints import signed, simhash
from .hamming import close_pairs
from .rows import boxed, map_texts, most, unboxed

LIMIT = 2
BIG = 20_000
CODES_AT_ONCE = 400_000  # codes of whole buckets indexed at once in a task
LOOK = 4  # one text in so many is looked at to learn which shingles are common
COMMON_TEXTS, COMMON_MOST = 8, 500_000  # texts of those that lead with a common shingle; longs sent to each task
PIVOTS, MORE_PIVOTS = 64, 8  # of a crowded shingle in the second round; times as many in each round after
SENT = 1_000_000  # doc_ids that may be sent to every task; more are joined


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``code``, the SimHash as a signed long."""
    out = T.StructType([T.StructField("code", T.LongType())])
    return map_texts(df, text, lambda texts: ((signed(simhash(t)),) for t in texts), out, keep)


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of the given bit positions."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed_lit(mask: int):
    return F.lit(signed(mask)).cast("long")


def _deal(codes: DataFrame, limit: int) -> DataFrame:
    """(bucket mask, bucket bits, code): equal bits under a mask put codes together."""
    blocks = _blocks(list(range(64)), limit + 2)
    masks = [a | b for a, b in combinations(blocks, 2)] if limit else [(1 << 64) - 1]
    return codes.select("code", F.explode(F.array(*[_signed_lit(m) for m in masks])).alias("mask")).withColumn(
        "bits", F.col("code").bitwiseAND(F.col("mask"))
    )


def _deal_again(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one bucket by the blocks of the bits outside its mask.

    The codes differ in at most ``limit`` of those bits, so one of ``limit + 1`` runs of
    them agrees.
    """
    free = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(mask, b) & 1L) = 0)")
    n = F.size("free")
    part = F.expr(
        f"transform(sequence(0, {limit}), i -> aggregate("
        f"slice(free, cast(size(free) * i / {limit + 1} as int) + 1,"
        f" cast(size(free) * (i + 1) / {limit + 1} as int) - cast(size(free) * i / {limit + 1} as int)),"
        f" mask, (m, b) -> m | shiftleft(1L, b)))"
    )
    return (
        rows.withColumn("free", free)
        .filter(n > 0)
        .select("code", F.explode(part).alias("mask"))
        .withColumn("bits", F.col("code").bitwiseAND(F.col("mask")))
    )


class _Forest:
    """Union-find over the codes of one task; yields each link that joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _search(limit: int):
    def run(batches):
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(parts):
            mask, bits, code = (np.concatenate(x) for x in zip(*parts))
            new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]
            bucket = np.cumsum(new)
            crowd = np.bincount(bucket)[bucket] > 1
            forest, links = _Forest(), []
            if crowd.any():
                for a, b in close_pairs(bucket[crowd], code[crowd].view(np.uint64), limit):
                    links += [(x, y) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()) if forest.join(x, y)]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

        for batch in batches:  # sorted by (mask, bits): a bucket is a run of rows
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            rows += batch.num_rows
            if rows >= CODES_AT_ONCE:
                mask, bits, code = (np.concatenate(x) for x in zip(*held))
                edge = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]))
                cut = int(edge[-1]) + 1 if len(edge) else 0
                if cut:
                    yield from flush([(mask[:cut], bits[:cut], code[:cut])])
                held, rows = [(mask[cut:], bits[cut:], code[cut:])], len(code) - cut
        if rows:
            yield from flush(held)

    return run


def links(codes: DataFrame, limit: int = LIMIT, big: int = BIG) -> DataFrame:
    """Spanning links (a, b) between distinct codes at 1 to ``limit`` differing bits."""
    dealt = _deal(codes, limit)
    found = None
    while True:
        crowded = settle(dealt.groupBy("mask", "bits").count().filter(F.col("count") > big))
        over = crowded.agg(F.count("*")).first()[0]
        small = dealt.join(crowded.select("mask", "bits"), ["mask", "bits"], "left_anti") if over else dealt
        part = (
            small.repartition("mask", "bits")
            .sortWithinPartitions("mask", "bits")
            .select("mask", "bits", "code")
            .mapInArrow(_search(limit), "a long, b long")
        )
        found = part if found is None else found.unionAll(part)
        if not over:
            return settle(found.distinct())
        dealt = settle(_deal_again(dealt.join(crowded.select("mask", "bits"), ["mask", "bits"], "left_semi"), limit).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node reaches over ``edges`` (a, b).

    Alternating large-star and small-star steps; each round is a written table, the number
    of rounds grows with the logarithm of the longest path.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = settle(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        same = nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty()
        e = nxt
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(code, root, component_id) of every distinct code in ``prints`` (doc_id, code).

    ``root`` tells components apart even where rows of two of them share a doc_id.
    """
    least = settle(prints.groupBy("code").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("code"), limit))
    placed = settle(
        least.join(roots, least["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("code", "root", "component_id")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, ["doc_id"]))
    return prints.join(classes(prints, limit), "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


_NODE = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lead", T.ArrayType(T.LongType())),
    T.StructField("bits", T.ArrayType(T.LongType())),
])
_CODE = T.StructType([*_NODE.fields, T.StructField("code", T.LongType())])
_WORDS = shingle_sets.BITS // 64


def _nodes(df: DataFrame, keep: list[str], common: np.ndarray, text: str = "text", coded: bool = False) -> DataFrame:
    """``keep`` columns, the node of each text, the size of its set, its leading shingles and its bitmap; ``coded``: its SimHash."""
    sc = df.sparkSession.sparkContext
    sent = sc.broadcast(common)

    def of(texts):
        for t in texts:
            found = shingle_sets.shingle_set(t)
            lead = shingle_sets.leading(found, sent.value)
            node = shingle_sets.name(found), len(found), lead.view(np.int64), shingle_sets.bitmap(found)
            yield (*node, signed(simhash(t))) if coded else node

    return map_texts(df, text, of, _CODE if coded else _NODE, keep)


def _near_codes(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the SimHash links: spanning links of codes, and a node of each code with its others."""
    codes = settle(prints.groupBy("code").agg(F.min("node").alias("node")))
    same = prints.select("code", F.col("node").alias("b")).join(codes.select("code", F.col("node").alias("a")), "code").select("a", "b")
    a, b = (codes.select(F.col("code").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab")
    near = links(codes.select("code")).join(a, "a").join(b, "b")
    near = near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return settle(same.unionAll(near).filter("a <> b").distinct())


def _folded(nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, place): the leading shingles of each distinct set."""
    one = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("lead").alias("lead"))
    return one.select(F.posexplode("lead").alias("place", "shingle"), "node", "n").select("shingle", "node", "n", F.col("place").cast("long").alias("place"))


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that many texts lead with, sorted; they only order the others (``shingle_sets``)."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0)
    count = _folded(_nodes(some, [], np.empty(0, np.uint64))).groupBy("shingle").count().filter(F.col("count") >= COMMON_TEXTS)
    rows = most(settle(count), "count", COMMON_MOST)[0].select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, found): the whole sets of the ``wanted`` nodes, from one text of each."""
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("found", T.ArrayType(T.LongType()))])

    def of(texts):
        for t in texts:
            found = shingle_sets.shingle_set(t)
            yield shingle_sets.name(found), found.view(np.int64)

    ids = prints.select("node", "doc_id").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id"))
    ids = small_side(ids.select("_id").distinct(), SENT)  # texts stay where they are while those are few
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = map_texts(rows, "text", of, out, [], 64)  # an id may stand for other texts as well
    return settle(made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found")))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar, row by row in the JVM."""
    up, down = shingle_sets.SIMILAR
    a, b = (sets.select(F.col("node").alias(x), F.col("found").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    made = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("all"))
    return settle(made.filter(down * F.col("both") >= up * (F.col("all") - F.col("both"))).select("a", "b"))


def _met(rows: DataFrame, facts: DataFrame, roots: DataFrame, pivots: int, all_pairs: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a leading shingle, are not of one group yet, and can be similar; how often they met (c)."""
    facts = facts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    words = [F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(_WORDS)]
    dealt = rows.join(facts, "node").select("shingle", "node", "n", "place", "root", *words)
    placed = dealt.repartition("shingle").sortWithinPartitions("shingle", "node")
    met = placed.mapInArrow(shingle_sets.candidates(pivots, all_pairs), "a long, b long")
    return met.groupBy("a", "b").agg(F.count("*").alias("c"))


def similar_groups(docs: DataFrame, prints: DataFrame, all_pairs: int = shingle_sets.ALL_PAIRS) -> DataFrame:
    """(node, root) of every node of ``prints`` that is similar to another one.

    Pairs that the SimHash links are verified first.  Then rounds over the shingles that several
    nodes lead with.  In the first, one node of each
    shingle meets the others, and of those a node has met it is compared with the one it met
    most often, so that a group of copies costs a pair a copy; in the second
    those that are still apart meet each with each, or, of more than ``all_pairs``, a few
    with all; and then more and more of those, until they lie in one group or all have met.
    """
    rows = _folded(prints).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(
        shingle_sets.shared, "shingle long, node long, n long, place long")
    rows = settle(rows)
    facts = prints.select("node", "bits").join(rows.select("node").distinct(), "node", "left_semi")
    facts = settle(facts.groupBy("node").agg(F.first("bits").alias("bits")))
    known = _near_codes(prints)
    sets = _sets(docs, prints, settle(known.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    edges = _verify(known, sets)
    roots = components(edges)
    pivots, tried, first = 1, 1, True
    while True:
        pairs = _met(rows, facts, roots, pivots, 1 if first else all_pairs).join(known, ["a", "b"], "left_anti")
        if first:
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
        pairs = settle(pairs.select("a", "b"))
        known = known.unionAll(pairs)
        wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        new = settle(wanted.join(sets.select("node"), "node", "left_anti"))
        if not new.isEmpty():
            sets = sets.unionAll(_sets(docs, prints, new))
        edges = edges.unionAll(_verify(pairs, sets))
        roots = components(edges)
        at = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = at.groupBy("shingle").agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
        rows = settle(rows.join(open_.filter((F.col("x") != F.col("y")) & (F.col("size") > tried)).select("shingle"), "shingle", "left_semi"))
        if rows.isEmpty():
            return roots
        pivots, first = PIVOTS if first else pivots * MORE_PIVOTS, False
        tried = max(all_pairs, pivots)


def keep_one(docs: DataFrame, all_pairs: int = shingle_sets.ALL_PAIRS) -> DataFrame:
    """One document of each group of similar texts stays: the one with the smallest doc_id.

    Which row stays is settled on narrow rows; texts are read once more, without those whose
    doc_id goes.  Rows that share the doc_id of the one that stays are told apart by their
    node; of rows equal in both, one stays.
    """
    common = _common(docs)
    prints = settle(_nodes(docs, ["doc_id"], common, coded=True))
    group = similar_groups(docs, prints, all_pairs)
    named = prints.select("doc_id", "node").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = settle(named.groupBy("root").agg(F.min(place).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.node").alias("_node")))
    doubled = settle(prints.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")))
    rows = boxed(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    if doubled.isEmpty():
        gone = prints.select("doc_id").join(first, same, "left_anti").select(F.col("doc_id").alias("_id"))
        return unboxed(rows.join(small_side(gone, SENT), same, "left_anti"))
    made = _nodes(rows, ["_row", "doc_id"], common).drop("lead", "bits", "n")
    return unboxed(made.join(first, same & (F.col("node") == F.col("_node")), "left_semi").dropDuplicates(["doc_id", "node"]))
