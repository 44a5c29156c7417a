"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regex yields the trigrams a matching text must contain (``trigrams.required``).
The index holds postings (trigram, row key) for those trigrams; the postings of a rule are
intersected, alternatives united, and only the candidates are run through the regex.  A
rule without mandatory trigrams is run over every text.

Candidates are broadcast up to BROADCAST_KEYS rows (counted first); beyond that the texts
are shuffled to meet them.  Row keys hash (doc_id, text), so rows are never merged: equal
keys mean equal rows, and a collision only adds a candidate.

Defined cases: a null or empty text has no spans; null doc_id and repeated rows each give
their own row; spans of different kinds may overlap and are all reported.  Very long
texts are searched whole, by the JVM's regular expressions; further columns are not read, and in
``redact`` come back as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .rows import boxed
from .trigrams import required

BROADCAST_KEYS = 200_000


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules, then well-known key formats.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


def postings(docs: DataFrame, grams: Sequence[str], text: str = "text") -> DataFrame:
    """(gram, key): the index, of the given trigrams."""
    low = docs.select(F.xxhash64("doc_id", text).alias("key"), F.lower(F.col(text)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", found.alias("grams")).select("key", F.explode("grams").alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """(key, rules): which rules with mandatory trigrams may match a row."""
    need = {r.kind: required(r.pattern) for r in rules}
    asks = [
        (g, kind, c, a, len(alt), len(clauses))
        for kind, clauses in need.items() for c, clause in enumerate(clauses) for a, alt in enumerate(clause) for g in alt
    ]
    names = ("gram", "kind", "clause", "alt", "grams", "clauses")
    ask = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x)]) for x in asks or [("", "", 0, 0, 1, 1)]])
    wanted = docs.sparkSession.range(1).select(F.inline(ask))
    index = postings(docs, sorted({x[0] for x in asks}), text)
    met = (
        index.join(F.broadcast(wanted), "gram")  # as many rows as the rules have trigrams
        .groupBy("key", "kind", "clause", "alt", "grams", "clauses")
        .agg(F.count_distinct("gram").alias("n"))
        .filter("n = grams")
    )
    return (
        met.groupBy("key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses")
        .groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("rules"))  # at most one entry a rule
    )


def _hits(text: Column, r: Rule, may: Column) -> Column:
    """(match, tested group) of every leftmost non-overlapping match."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(r.pattern), F.lit(g))
    whole = all_of(0)
    return F.when(may, F.arrays_zip(whole.alias("hit"), all_of(r.group).alias("part")) if r.group else F.arrays_zip(whole.alias("hit"), whole.alias("part")))


def _spans(text: Column, r: Rule, order: int, hits: str) -> Column:
    """Spans of the matches long enough: split() gives the stretches between the matches."""
    gaps = F.split(text, r.pattern, -1)
    step = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.col(f"{hits}.hit").alias("hit"), F.col(f"{hits}.part").alias("part"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")

    def walk(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), F.lit(r.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= r.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(hits) > 0, F.aggregate(step, start, walk, lambda acc: acc["out"])).otherwise(empty)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``_row`` (all columns), ``doc_id``, ``text`` and ``spans`` (start, kind_no, kind, end), sorted.

    Positions are code points, end exclusive.
    """
    rows = boxed(docs, "doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64("doc_id", text).alias("_key"))
    may = small_side(candidates(docs, rules, text), BROADCAST_KEYS).withColumnRenamed("key", "_key")
    rows = rows.join(may, "_key", "left")
    full = {r.kind for r in rules if not required(r.pattern)}
    hits = rows.select("*", *[
        _hits(F.col("text"), r, F.lit(True) if r.kind in full else F.array_contains("rules", r.kind)).alias(f"_hits{i}") for i, r in enumerate(rules)
    ])
    spans = [_spans(F.col("text"), r, i, f"_hits{i}") for i, r in enumerate(rules)]
    return hits.select("_row", "doc_id", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, number of spans of each base kind, base_sha256 and all spans as text."""
    base = [r.kind for r in rules if r.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scan(docs, rules).select(
        "doc_id",
        *[_of_kind(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span replaced by its kind; overlapping spans are one cut.

    ``n_chars``, where there is one, follows the new text.  A null text stays null.
    """

    def cut(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    done = scan(docs, rules).withColumn("_new", F.when(F.size("spans") > 0, clean).otherwise(F.col("_row.text")))
    new = {"text": F.col("_new"), "n_chars": F.coalesce(F.length("_new").cast(dict(docs.dtypes).get("n_chars", "long")), F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])
