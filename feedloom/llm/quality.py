"""Quality rules with thresholds learned per language and source from quantile sketches.

Each text is measured once.  Fixed base rules throw out what is too short or repeats
itself; of the rest, KLL sketches per (lang, source) hold the distribution of each ratio.
Sketches merge, so a source with few rows takes the thresholds of its language, and a
language with few rows those of the whole corpus.  A document is kept if every ratio lies
inside the fence of its own group.

Quartiles say nothing about a ratio that is zero in half of the texts or more: they are all
zero, or, with over a quarter of junk, those of the junk.  There the fence is learned from
the values above zero (a sketch of their own, merged up like the others): NEAR_ZERO of
their lower TAIL quantile, at least the slack, so that it lies between zero and the mode of
the deviating texts however many a group has.  A count in a short text is uncertain: the
symbols a text may hold are never fewer than DEVIATIONS standard deviations, and one, above
what the slack gives for its length; and a high mean length of the words is held against a text only
if it stays when the longest word is left out.

Defined cases: a null or empty text has zero words and fails the base rules; null lang or
source forms a group of its own; repeated rows are judged one by one; an empty table gives
an empty result.  Very long texts are measured whole, one at a time; columns of any further
name are kept in ``keep_good`` and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, small_side
from .measures import FIELDS, measure
from .rows import boxed, map_texts, unboxed

MIN_WORDS = 10
REPEAT_PERCENT = 20


class Fence(NamedTuple):
    """``reach`` interquartile ranges plus ``slack`` beyond the quartiles still pass."""

    reach: float
    slack: float
    below: bool = False


FENCES: Mapping[str, Fence] = {
    "symbol_ratio": Fence(8, 0.02),
    "upper_ratio": Fence(8, 0.15),
    "copied_lines": Fence(4, 0.5),
    "word_length": Fence(8, 0.5, below=True),
    "longest_word": Fence(8, 20),
}
ZERO_HEAVY = ("symbol_ratio", "upper_ratio", "copied_lines")  # ratios that most texts may have at zero
TAIL, NEAR_ZERO = 0.1, 0.5
DEVIATIONS = 3
SKETCH_K = 4000  # rank error under 0.1 %
MIN_ROWS = 100  # a group with fewer measured rows takes the thresholds above it
BROADCAST_GROUPS = 50_000

_OUT = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def with_measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus the measures and ratios of each whole text."""
    m = map_texts(df, text, lambda texts: map(measure, texts), _OUT, keep)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return m.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "symbol_ratio": F.col("n_symbols") / chars,
        "upper_ratio": F.col("n_upper") / chars,
        "copied_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "word_length": F.col("word_chars") / words,
        "longest_word": F.col("max_word").cast("double"),
    })


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): low and high fence of each ratio.

    The sketches are made once per group with partial aggregation; the wider levels merge
    sketches, never rows.  Groups whose rows all failed the base rules appear as well.
    """
    ok = ~F.col("base_failed")
    own = settle(
        measured.groupBy("lang", "source").agg(
            F.count_if(ok).alias("n"),
            *[F.kll_sketch_agg_double(F.when(ok, F.col(c)), F.lit(SKETCH_K)).alias(c) for c in FENCES],
            *[F.count_if(ok & (F.col(c) > 0)).alias(f"{c}_n") for c in ZERO_HEAVY],
            *[F.kll_sketch_agg_double(F.when(ok & (F.col(c) > 0), F.col(c)), F.lit(SKETCH_K)).alias(f"{c}_some") for c in ZERO_HEAVY],
        )
    )

    def wider(level: str):
        sketches = [*FENCES, *[f"{c}_some" for c in ZERO_HEAVY]]
        counts = [F.sum(f"{c}_n").alias(f"{c}_n_{level}") for c in ZERO_HEAVY]
        return [F.kll_merge_agg_double(c).alias(f"{c}_{level}") for c in sketches] + counts

    lang = own.groupBy("lang").agg(F.sum("n").alias("n_lang"), *wider("up"))
    top = own.agg(F.sum("n").alias("n_all"), *wider("top"))
    wide = (
        own.alias("g")
        .join(lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")))
        .crossJoin(F.broadcast(top))  # one row
    )

    def quantile(c: str, at: float, own_n, lang_n, all_n):
        return (
            F.when(own_n >= min_rows, F.kll_sketch_get_quantile_double(F.col(c), F.lit(at)))
            .when(lang_n >= min_rows, F.kll_sketch_get_quantile_double(F.col(f"{c}_up"), F.lit(at)))
            .when(all_n > 0, F.kll_sketch_get_quantile_double(F.col(f"{c}_top"), F.lit(at)))
        )

    def fences(c: str, f: Fence):
        rows = [F.col(n) for n in ("n", "n_lang", "n_all")]
        q = [quantile(c, at, *rows) for at in (0.25, 0.75)]
        span = (q[1] - q[0]) * f.reach + f.slack
        low = q[0] - span if f.below else F.lit(None).cast("double")
        high = q[1] + span
        if c in ZERO_HEAVY:
            tail = quantile(f"{c}_some", TAIL, *[F.col(f"{c}_n{level}") for level in ("", "_up", "_top")])
            learned = F.greatest(F.lit(f.slack), NEAR_ZERO * tail)  # no value above zero: the slack
            high = F.when(quantile(c, 0.5, *rows) == 0, learned).otherwise(high)
        return [low.alias(f"{c}_low"), high.alias(f"{c}_high")]

    return wide.select(F.col("g.lang"), F.col("g.source"), *[x for c, f in FENCES.items() for x in fences(c, f)])


def _short(c: str, high: Column) -> Column:
    """Whether a value above the fence may be due to few characters or words only."""
    if c == "symbol_ratio":
        usual = FENCES[c].slack * F.col("word_chars")
        return F.col("n_symbols") <= usual + DEVIATIONS * F.sqrt(usual) + 1
    if c == "word_length":
        return F.col("word_chars") - F.col("max_word_chars") <= high * (F.col("n_words") - 1)
    return F.lit(False)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: false for the base rules, else inside every fence.

    Limits are broadcast up to BROADCAST_GROUPS groups; beyond that the join shuffles, and
    a hot group is split by the adaptive skew join.
    """
    near = small_side(limits, BROADCAST_GROUPS).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for c in FENCES:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        inside &= (low.isNull() | (F.col(c) >= low)) & (high.isNull() | (F.col(c) <= high) | _short(c, high))
    return (
        measured.join(near, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("_lang", "_source")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """Narrow verdict rows: doc_id, the measures, base_failed, kept and the ratios."""
    measured = settle(with_measures(docs, ["doc_id", "lang", "source"]))
    return judge(measured, thresholds(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` only.

    Texts are read twice, once to learn and once to judge, and never shuffled.
    """
    limits = thresholds(with_measures(docs, ["lang", "source"]))
    rows = boxed(docs, "text")
    measured = with_measures(rows, ["_row"]).withColumns({"lang": F.col("_row.lang"), "source": F.col("_row.source")})
    return unboxed(judge(measured, limits).filter("kept"))
