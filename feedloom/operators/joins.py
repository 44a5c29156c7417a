"""Joins of the feed with itself, with another feed, and with spans and labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import settle, width
from .asof import within
from .scan import last_before, max_so_far, scan

LEAD_WINDOW_S = 300
DUPLICATE_WINDOW_S = 300
DUPLICATE_JACCARD = 0.5
CROWD = 2048  # wordings of a slot that may meet in one task
COLUMNS = 2048  # words compared at once there
CARRY_TTL_S = 900
EDGE_TOLERANCE_S = 120
NEVER_S = 1 << 62  # the end of a span that is still open


def with_parent(m: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each reply next to its parent in the same channel (null when not stored)."""
    parent = m.select(
        F.col("channel"), F.col("message_id").alias("reply_to"),
        *[F.col(c).alias(f"parent_{c}") for c in keep])
    return m.filter("reply_to IS NOT NULL").join(parent, ["channel", "reply_to"], "left")


class ReplyChains:
    """Roots, depths and longest paths of reply trees by pointer doubling.

    Each round doubles the distance every row has jumped, so a chain of a million
    replies takes twenty rounds; each round is one join, materialised.
    """

    def __init__(self, m: DataFrame):
        nodes = m.select("channel", "message_id", "reply_to")
        known = nodes.select("channel", F.col("message_id").alias("reply_to"), F.lit(True).alias("_known"))
        step = nodes.join(known, ["channel", "reply_to"], "left").select(
            "channel", "message_id",
            F.when(F.col("_known") & (F.col("reply_to") < F.col("message_id")), F.col("reply_to")).alias("up"))
        jump = settle(step.select(
            "channel", "message_id", F.coalesce("up", "message_id").alias("top"),
            F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("dist")))
        self.parents = step
        self.jumps = []
        while True:
            far = jump.select(
                "channel", F.col("message_id").alias("top"), F.col("top").alias("_top"), F.col("dist").alias("_d"))
            nxt = settle(jump.join(far, ["channel", "top"]).select(
                "channel", "message_id", F.col("_top").alias("top"), (F.col("dist") + F.col("_d")).alias("dist"),
                (F.col("_d") > 0).alias("moved")))
            self.jumps.append(jump)
            if nxt.filter("moved").isEmpty():
                break
            jump = nxt.drop("moved")
        self.nodes = jump.select("channel", "message_id", F.col("top").alias("root"), F.col("dist").alias("depth"))

    def leaves(self) -> DataFrame:
        inner = self.nodes.join(self.parents, ["channel", "message_id"]).filter("up IS NOT NULL").select(
            "channel", F.col("up").alias("message_id")).distinct()
        return self.nodes.join(inner, ["channel", "message_id"], "left_anti")

    def chains(self) -> DataFrame:
        """Per root with replies: messages, deepest path length, ends, the deepest end."""
        size = self.nodes.groupBy("channel", "root").agg(F.count("*").alias("messages"))
        ends = self.leaves().groupBy("channel", "root").agg(
            F.count("*").alias("ends"), (F.max("depth") + 1).alias("length"),
            F.min_by("message_id", F.struct(-F.col("depth"), F.col("message_id"))).alias("deepest"))
        return size.join(ends, ["channel", "root"]).filter("messages > 1")

    def longest_paths(self) -> DataFrame:
        """The messages on the path to each chain's deepest end, one row per step."""
        on_path = self.chains().select("channel", F.col("deepest").alias("message_id"))
        for jump in reversed(self.jumps):
            up = on_path.join(jump.filter("dist > 0"), ["channel", "message_id"]).select(
                "channel", F.col("top").alias("message_id"))
            on_path = on_path.unionByName(up).distinct()
        return on_path.join(self.nodes, ["channel", "message_id"]).select(
            "channel", "root", F.col("depth").alias("step"), "message_id")


def _alike_in_turn(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs at ``threshold`` or more from rows (at, slot, wording, hashes of its words) sorted by ``at``.

    Rows of slot ``at`` meet each other and those of the next slot.  What two rows have in common
    is a product of a matrix of rows and words, some words at a time.
    """
    def met(at, parts):
        rows = pa.Table.from_batches(parts)
        slot, wording = rows.column(1).to_numpy(), np.array(rows.column(2).to_pylist(), object)
        order = np.lexsort((wording, slot))
        words = rows.column(3).combine_chunks()
        sizes = pc.list_value_length(words).to_numpy()
        row = np.repeat(np.argsort(order), sizes)
        slot, wording, n = slot[order], wording[order], sizes[order].astype(np.int64)
        _, col, df = np.unique(words.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = (df > 1)[col]
        row, col = row[shared], np.cumsum(df > 1)[col[shared]] - 1
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
        mine = int((slot == at).sum())
        both = np.zeros((mine, len(slot)), np.float32)  # exact up to 2 ** 24
        for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            x, y = np.searchsorted(col, [first, first + COLUMNS])
            m = np.zeros((len(slot), COLUMNS), np.float32)
            m[row[x:y], col[x:y] - first] = 1
            both += m[:mine] @ m.T
        own = np.arange(mine)
        both[own, own] = n[:mine]  # a wording next to itself, also where no other row has its words
        jac = both.astype(np.float64) / (n[:mine, None] + n[None, :] - both)
        x, y = np.nonzero((jac >= threshold) & (own[:, None] <= np.arange(len(slot))[None, :]))
        return pa.RecordBatch.from_arrays([
            pa.array(wording[x], pa.string()), pa.array(wording[y], pa.string()), pa.array(slot[x], pa.int64()),
            pa.array(slot[y], pa.int64()), pa.array(jac[x, y], pa.float64())], names=["wa", "wb", "sa", "sb", "jaccard"])

    now, held = None, []
    for batch in batches:
        ats = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(ats[1:] != ats[:-1]) + 1).tolist(), len(ats)]
        for x, y in zip(edges, edges[1:]):
            if y == x:
                continue
            if ats[x] != now and held:
                yield met(now, held)
                held = []
            now = ats[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield met(now, held)


def _alike_by_rare_words(sets: DataFrame, slots: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Pairs of which the earlier slot is one of ``first``, found by the rarest words of either."""
    share = F.lit(Decimal(str(threshold)))  # exact, so that no rounding lifts a bound
    freq = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = (
        sets.select("wording", F.explode("words").alias("word"))
        .join(freq, "word")
        .groupBy("wording")
        .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    )
    n = F.size("r")
    prefix = ranked.select(
        "wording", n.alias("n"),
        F.explode(F.slice("r", F.lit(1), (n - F.ceil(n * share) + 1).cast("int"))).alias("p"),
    ).select("wording", "n", F.col("p.word").alias("word"))

    spots = prefix.join(slots, "wording")
    a = spots.join(first, "slot", "left_semi").select(
        "word", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("at"),
        F.col("wording").alias("wa"), F.col("n").alias("na"), F.col("slot").alias("sa"))
    b = spots.select("word", F.col("slot").alias("at"), F.col("wording").alias("wb"),
                     F.col("n").alias("nb"), F.col("slot").alias("sb"))
    near_size = (F.col("na") * share <= F.col("nb")) & (F.col("nb") * share <= F.col("na"))
    alike = (
        a.join(b, ["word", "at"]).filter(near_size)
        .filter((F.col("sa") < F.col("sb")) | (F.col("wa") <= F.col("wb")))
        .select("wa", "wb", "sa", "sb").distinct()
        .join(sets.select(F.col("wording").alias("wa"), F.col("words").alias("x")), "wa")
        .join(sets.select(F.col("wording").alias("wb"), F.col("words").alias("y")), "wb")
    )
    both = F.size(F.array_intersect("x", "y"))
    jac = both / (F.size("x") + F.size("y") - both)
    return alike.withColumn("jaccard", jac).filter(F.col("jaccard") >= threshold).drop("x", "y")


def near_duplicates(m: DataFrame, window_s: int = DUPLICATE_WINDOW_S,
                    threshold: float = DUPLICATE_JACCARD, min_len: int = 4, crowd: int = CROWD) -> DataFrame:
    """Points of different channels, close in time, whose word sets are alike.

    A point is (channel, second, wording) with the number of ``copies`` in it, so a
    wording posted a million times is compared once; ``pairs`` is the number of
    message pairs a row stands for.  The wordings of a slot of ``window_s`` and the next
    meet in one task, words being told apart there by 64-bit hashes; only pairs that are alike
    leave it.  Where a slot has more than ``crowd`` wordings they are matched on their rarest words
    instead, over all tasks: two sets with Jaccard >= t must share one of the first n - ceil(t n) + 1.
    """
    words = F.array_sort(F.array_distinct(F.filter(
        F.transform(tokens(F.col("text")), F.lower), lambda w: F.length(w) >= min_len)))
    said = m.select("channel", "message_id", "ts_s", words.alias("words")).filter(F.size("words") > 0)
    said = said.withColumn("wording", F.md5(F.array_join("words", " "))).withColumn(
        "slot", F.floor(F.col("ts_s") / window_s))
    said = settle(said)
    points = settle(said.groupBy("wording", "channel", "ts_s", "slot").agg(
        F.count("*").alias("copies"), F.min("message_id").alias("first_id")))
    slots = points.select("wording", "slot").distinct()

    full = slots.groupBy("slot").count().filter(F.col("count") > crowd)
    crowded = settle(full.select(F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot")).distinct())
    some = not crowded.isEmpty()
    # one message of each wording and slot brings the words
    hashed = said.select("wording", "slot", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    hashed = hashed.groupBy("slot", "wording").agg(F.first("words").alias("words"))
    dealt = hashed.select(F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("at"), "slot", "wording", "words")
    if some:
        dealt = dealt.join(crowded.withColumnRenamed("slot", "at"), "at", "left_anti")
    placed = dealt.repartition(width(m.sparkSession), "at").sortWithinPartitions("at")
    alike = placed.mapInArrow(lambda batches: _alike_in_turn(batches, threshold), "wa string, wb string, sa long, sb long, jaccard double")
    if some:
        sets = said.groupBy("wording").agg(F.first("words").alias("words"))
        alike = alike.unionByName(_alike_by_rare_words(sets, slots, crowded, threshold))

    def side(tag: str) -> DataFrame:
        return points.select(
            F.col("wording").alias(f"w{tag}"), F.col("slot").alias(f"s{tag}"),
            F.col("channel").alias(f"channel_{tag}"), F.col("ts_s").alias(f"ts_{tag}"),
            F.col("first_id").alias(f"id_{tag}"), F.col("copies").alias(f"copies_{tag}"))

    pairs = alike.join(side("a"), ["wa", "sa"]).join(side("b"), ["wb", "sb"])
    pairs = pairs.filter(
        (F.col("channel_a") != F.col("channel_b"))
        & (F.abs(F.col("ts_a") - F.col("ts_b")) <= window_s)
        # One row per pair where a wording meets itself or its twin in one slot.
        & ((F.col("sa") < F.col("sb")) | (F.col("wa") < F.col("wb"))
           | (F.struct("ts_a", "channel_a") < F.struct("ts_b", "channel_b"))))
    swap = F.struct("ts_a", "id_a") > F.struct("ts_b", "id_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        pick("channel_a", "channel_b").alias("first_channel"), pick("id_a", "id_b").alias("first_id"),
        pick("channel_b", "channel_a").alias("second_channel"), pick("id_b", "id_a").alias("second_id"),
        F.abs(F.col("ts_b") - F.col("ts_a")).alias("lag_s"), "jaccard",
        (F.col("copies_a") * F.col("copies_b")).alias("pairs"))


def lead_table(mine: DataFrame, theirs: DataFrame, keys: Sequence[str], ident: Sequence[str],
               window_s: int = LEAD_WINDOW_S) -> DataFrame:
    """Each of my mentions with the earliest of theirs inside the window, and my lead."""
    hit = within(mine, theirs, keys, F.col("ts_s"), F.col("ts_s"), window_s, window_s, ident, "their_ts")
    return hit.withColumn("lead_s", F.col("their_ts") - F.col("ts_s"))


def lead_any_key(mine: DataFrame, theirs: DataFrame, keys_col: str, ident: Sequence[str],
                 window_s: int = LEAD_WINDOW_S) -> DataFrame:
    """As :func:`lead_table` where a message has several keys: the best over them."""
    one = mine.withColumn("_key", F.explode(keys_col)).drop(keys_col)
    other = theirs.select("ts_s", F.explode(keys_col).alias("_key"))
    hit = lead_table(one, other, ["_key"], [*ident, "_key"], window_s)
    rest = [c for c in mine.columns if c not in (*ident, keys_col)]
    return hit.groupBy(*ident).agg(
        *[F.first(c).alias(c) for c in rest], F.min("their_ts").alias("their_ts")
    ).withColumn("lead_s", F.col("their_ts") - F.col("ts_s"))


def alone(leads: DataFrame) -> DataFrame:
    return leads.filter("their_ts IS NULL")


def carry_context(m: DataFrame, order: Sequence[str], stated: Column, scope: Column,
                  clear: Column, ttl_s: int = CARRY_TTL_S, keys: Sequence[str] = ()) -> DataFrame:
    """What a row inherits from earlier rows: the last stated class and scope, if
    young enough and not reset by a clear word in between."""
    def fact(x: Column) -> Column:
        return F.when(clear | x.isNotNull(), F.struct(
            F.col("ts_s").alias("at"), F.when(~clear, x).alias("value")))

    out = scan(m, keys, order, _class=last_before(fact(stated)), _scope=last_before(fact(scope)))

    def young(c: str) -> Column:
        return F.when(F.col("ts_s") - F.col(f"{c}.at") <= ttl_s, F.col(f"{c}.value"))

    return out.withColumn("inherited_class", young("_class")).withColumn(
        "inherited_scope", young("_scope")).drop("_class", "_scope")


def on_span(events: DataFrame, spans: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Whether an event lies in [start, end) of any span; an open end never closes.

    Of the spans that start no later, the one that ends last decides: spans may overlap, and
    several may start in one second.
    """
    own = [f"_o{i}" for i in range(len(ident))]
    mine = events.select(F.col("ts_s").alias("_at"), F.lit(1).alias("_side"), *[F.col(c).alias(o) for c, o in zip(ident, own)],
                         F.struct(*events.columns).alias("_left"))
    theirs = spans.filter("start_s IS NOT NULL").select(
        F.col("start_s").alias("_at"), F.lit(0).alias("_side"), F.coalesce("end_s", F.lit(NEVER_S)).alias("_end"))
    done = scan(mine.unionByName(theirs, allowMissingColumns=True), [], ["_at", "_side", *own],
                _until=max_so_far(F.col("_end"), inclusive=False))
    inside = F.coalesce(F.col("_at") < F.col("_until"), F.lit(False))
    return done.filter("_left IS NOT NULL").select("_left.*", inside.alias("inside"))


def match_edges(ours: DataFrame, edges: DataFrame, tol_s: int = EDGE_TOLERANCE_S) -> DataFrame:
    """Our rings and their edges: both, only us, only them."""
    a = within(ours.select("ts_s", "ident"), edges, [], F.col("ts_s"), F.col("ts_s"), tol_s, tol_s, ["ident"], "near")
    b = within(edges.select("ts_s", "ident"), ours, [], F.col("ts_s"), F.col("ts_s"), tol_s, tol_s, ["ident"], "near")
    return a.select("ident", F.when(F.col("near").isNull(), "only us").otherwise("both").alias("kind")).unionByName(
        b.filter("near IS NULL").select("ident", F.lit("only them").alias("kind")))


def ring_touch(m: DataFrame, ring: DataFrame, places: str) -> DataFrame:
    """Messages naming at least one place of the ring."""
    hit = m.select("channel", "message_id", F.explode(places).alias("place")).join(
        ring.select("place"), "place", "left_semi").select("channel", "message_id").distinct()
    return m.join(hit, ["channel", "message_id"], "left_semi")


def row_differs(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, [~p.eqNullSafe(q) for p, q in zip(a, b)])


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two snapshots."""
    o = old.select(key, F.struct(*fields).alias("_o"))
    n = new.select(key, F.struct(*fields).alias("_n"))
    kind = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
            .when(~F.col("_o").eqNullSafe(F.col("_n")), "changed"))
    return o.join(n, key, "full_outer").select(key, kind.alias("change")).filter("change IS NOT NULL")


def orphans(state: DataFrame, known: DataFrame, key: str, fallback: str) -> DataFrame:
    """State rows whose recipient is gone; none when only the fallback is known."""
    others = known.filter(F.col(key) != fallback).select(F.lit(True).alias("_any")).limit(1)
    return state.join(known.select(key), key, "left_anti").join(F.broadcast(others), F.lit(True), "left_semi")
