"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Leaves are (domain, lang, source).  A leaf can give its tokens ``epochs`` times.  The
budget flows down the tree by weight; at every node it is filled among the children with
their own supply as the ceiling, so a shortage is first taken up by siblings and reaches
an ancestor only when all of them are exhausted.  Filling is exact: children are sorted by
supply over weight, and the level at which the budget is met is found with running sums.

A leaf's budget is whole epochs plus a prefix of one more epoch, whose order is a hash of
the seed, the epoch and the document.  The prefix is found in two steps, first over ranges
of that hash and then inside the one range where it ends, so a hot leaf is never
sorted in one task.

Defined cases: null lang or source is a leaf of its own; a null or empty text has no
tokens and is taken with the whole epochs and with a prefix that reaches it; repeated rows
are separate rows of the prefix; an empty table gives an empty result; a leaf of weight
zero gets nothing unless all of its siblings weigh zero, when they share alike.
A very long text is a number of tokens like any other; in ``mix`` further columns come back as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, small_side
from .rows import boxed

SEED = 7
EPOCHS = 4
SHARE = 0.8  # of all tokens, when no target is given
BUCKET_BITS = 12
BROADCAST_LEAVES = 20_000
DOMAINS = 4
LEVELS = ("domain", "lang", "source")


def demo_weights() -> dict[str, Column]:
    """Targets for the corpus at hand: a weight for each level of the tree."""
    return {
        "domain": F.element_at(F.array(*map(F.lit, (40, 30, 20, 10))), F.col("domain") + 1),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2),
        "source": F.lit(1),
    }


def domain_of(source: Column) -> Column:
    """A stand-in for the domain table: the source's number, a null source counting as 0."""
    return F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0)) % DOMAINS


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parent: list[str], level: str, weight: Column) -> DataFrame:
    """``budget`` of each node: min(supply, level * weight), the level meeting the parent's.

    ``nodes`` has parent columns, ``level``, ``supply`` and ``given`` (the parent's budget).
    """
    w = nodes.withColumn("w", weight.cast("double"))
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    w = w.withColumn("w", F.when(F.sum("w").over(by) > 0, F.col("w")).otherwise(F.lit(1.0)))
    w = w.withColumn("ratio", F.when(F.col("w") > 0, F.col("supply") / F.col("w")).otherwise(F.lit(float("inf"))))
    run = by.orderBy("ratio", level)
    before, after = run.rowsBetween(W.unboundedPreceding, -1), run.rowsBetween(W.currentRow, W.unboundedFollowing)
    w = w.withColumn("rest", F.col("given") - F.coalesce(F.sum("supply").over(before), F.lit(0)))
    w = w.withColumn("mine", F.when(F.col("w") > 0, F.col("rest") * F.col("w") / F.sum("w").over(after)).otherwise(F.lit(0.0)))
    # up to the first node whose share stays below its supply nodes are full; from it on shares are final
    full = F.col("mine") >= F.col("supply")
    open_ratio = F.min(F.when(~full, F.struct("ratio", level, (F.col("rest") / F.sum("w").over(after)).alias("line")))).over(by)
    w = w.withColumn("open", open_ratio)
    share = F.floor(F.col("w") * F.col("open.line")).cast("long")
    return w.withColumn("budget", F.when(F.col("open").isNull() | full, F.col("supply")).otherwise(F.least("supply", share))).drop(
        "w", "ratio", "rest", "mine", "open"
    )


def budgets(leaves: DataFrame, weights: Mapping[str, Column], target: Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf in ``leaves`` (.., tokens)."""
    supply = leaves.withColumn("supply", F.col("tokens") * epochs)
    tops = supply.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    total = tops.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    given = total.select(F.floor(target).cast("long").alias("given"))
    domains = fill(tops.crossJoin(F.broadcast(given)), [], "domain", weights["domain"])  # one row
    done = domains.select("domain", F.col("budget").alias("given"))
    langs = supply.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(done, "domain")
    langs = fill(langs, ["domain"], "lang", weights["lang"])
    up = langs.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("budget").alias("given"))
    leaf = supply.join(up, (F.col("domain") == F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    return fill(leaf, ["domain", "lang"], "source", weights["source"]).select(*LEVELS, "tokens", "budget")


def select(
    docs: DataFrame, weights: Mapping[str, Column] | None = None, tokens: int | None = None, epochs: int = EPOCHS, seed: int = SEED,
    keep: str | None = None,
) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies and the leaf's budget of each row.

    ``copies`` is how often the mixture takes the row: once for each whole epoch, and once
    more if the prefix reaches it.  The document in which a prefix ends is taken whole if at
    least half of it lies inside.
    """
    weights = weights or demo_weights()
    rows = docs.select(
        "doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", words(F.col("text")).alias("tokens"),
        F.md5("text").alias("same"), *([keep] if keep else []),
    )
    rows = settle(rows) if keep is None else rows
    narrow = rows.drop(keep) if keep else rows
    target = F.lit(tokens) if tokens is not None else F.col("all") * SHARE
    plan = budgets(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, target, epochs)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(F.lit(0)).cast("int")
    plan = small_side(
        plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("tokens").alias("leaf_tokens"), "budget")
        .withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens")),
        BROADCAST_LEAVES,
    )
    same_leaf = F.lit(True)
    for c in LEVELS:
        same_leaf &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "whole", "doc_id", "same"))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits
    bucket = F.shiftright("order", 60 - BUCKET_BITS).cast("int")
    placed = rows.join(plan, same_leaf).drop(*[f"_{c}" for c in LEVELS]).withColumn("order", order).withColumn("bucket", bucket)
    sums = placed.filter("rest > 0").groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    run = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # 2 ** BUCKET_BITS rows a leaf at most
    edge = sums.withColumn("left", F.col("rest") - F.coalesce(F.sum("n").over(run), F.lit(0)))
    edge = edge.filter("left > 0 and left <= n").select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("bucket").alias("edge"), "left")
    return _prefix(placed, small_side(edge, BROADCAST_LEAVES), same_leaf)


def _prefix(placed: DataFrame, edge: DataFrame, same_leaf: Column) -> DataFrame:
    """Rows before the edge bucket are in; those of the edge bucket by their running sum."""
    met = placed.join(edge, same_leaf, "left").drop(*[f"_{c}" for c in LEVELS])
    inside = met.filter("bucket = edge")
    run = W.partitionBy(*LEVELS).orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("left") - F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    counted = inside.withColumn("_more", ((F.col("left") > 0) & (2 * F.col("left") >= F.col("tokens"))).cast("int"))
    others = met.filter("edge is null or bucket <> edge").withColumn("_more", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    return others.unionByName(counted).withColumn("copies", F.col("whole") + F.col("_more")).drop(
        "same", "order", "bucket", "edge", "left", "_more", "whole", "rest", "leaf_tokens"
    )


def mix(docs: DataFrame, weights: Mapping[str, Column] | None = None, tokens: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as the mixture takes them: a row once for each of its copies."""
    rows = boxed(docs, "doc_id", "text", "lang", "source")
    picked = select(rows, weights, tokens, epochs, seed, keep="_row").filter("copies > 0")
    return picked.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
