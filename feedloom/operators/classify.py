"""Rule packs: vocabulary as data, evaluation as columns.

A pack is rows of (family, priority, pattern, label), small by nature: it is what
people write by hand.  Families hold ordered patterns; the functions below say how a
family is read.  Everything is regular expressions and array functions in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, mask, squeezed_length
from .entities import bare_list, by_position  # noqa: F401

NONE, UNSURE = "none", "unknown"
PROSE_CHARS = 150
BURIED_CHARS = 140
HEADLINE_CHARS = 70
SOCIAL_TERMS_MIN = 3


@dataclass(frozen=True)
class Pack:
    """Ordered (pattern, label) rows per family."""

    families: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, rows: DataFrame) -> Pack:
        """From a rule table; it is hand-written vocabulary, so it fits the driver."""
        out: dict[str, list[tuple[int, str, str]]] = {}
        for r in rows.select("family", "priority", "pattern", "label").collect():
            out.setdefault(r.family, []).append((r.priority, r.pattern, r.label))
        return cls({k: tuple((p, l) for _, p, l in sorted(v)) for k, v in out.items()})

    def rules(self, family: str) -> tuple[tuple[str, str], ...]:
        return self.families.get(family, ())

    def one(self, family: str) -> str | None:
        """The family as one alternation, or None when the pack has no such family."""
        got = [p for p, _ in self.rules(family)]
        return "|".join(f"(?:{p})" for p in got) if got else None


def hits(c: Column, pack: Pack, family: str) -> Column:
    pattern = pack.one(family)
    return F.lit(False) if pattern is None else c.rlike(pattern)


def first_match(c: Column, pack: Pack, family: str = "class", default: str = NONE) -> Column:
    """Label of the first pattern that stands; an override with a veto is asked first."""
    out = F.lit(default)
    for pattern, label in reversed(pack.rules(family)):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    for pattern, label in reversed(pack.rules("override")):
        out = F.when(c.rlike(pattern) & ~hits(c, pack, "override_veto"), label).otherwise(out)
    return out


def blank(c: Column, pack: Pack, family: str) -> Column:
    for pattern, _ in pack.rules(family):
        c = F.regexp_replace(c, pattern, " ")
    return c


def without_level(c: Column, pack: Pack) -> Column:
    """The level phrase blanked in place, so that positions survive."""
    pattern = pack.one("level")
    return c if pattern is None else mask(c, pattern)


def stated_class(c: Column, pack: Pack) -> Column:
    return first_match(blank(c, pack, "level"), pack)


def class_hint(c: Column, pack: Pack) -> Column:
    """A class outside conditional clauses wins; if there is none, one inside does."""
    return let(blank(c, pack, "denied"), lambda plain: F.coalesce(
        F.nullif(stated_class(blank(plain, pack, "conditional"), pack), F.lit(NONE)), stated_class(plain, pack)))


def all_labels(c: Column, pack: Pack, family: str) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(l)) for p, l in pack.rules(family)]), lambda x: x.isNotNull())


def match_starts(c: Column, pattern: str) -> Column:
    """0-based starts of all matches."""
    parts = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(parts, found, lambda p, h: F.struct(
        F.length(p).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + x["hit"]).alias("at"),
                        F.when(x["hit"] > 0, F.concat(acc["out"], F.array(at))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def _distances(c: Column, pack: Pack) -> Column:
    """struct(dist, prio, label) of every class word, by distance from the first clear word."""
    clear_at = F.least(*[
        F.nullif(F.instr(F.lower(c), p), F.lit(0)) for p, _ in pack.rules("clear")] * 2) - 1
    rules = list(pack.rules("override")) + list(pack.rules("class"))

    def of(prio: int, pattern: str, label: str, at: Column) -> Column:
        return F.transform(match_starts(c, pattern), lambda s: F.struct(
            F.abs(s - at).alias("dist"), F.lit(prio).alias("prio"), F.lit(label).alias("label")))

    return F.when(clear_at >= 0, let(clear_at, lambda at: F.concat(
        *[of(i, p, l, at) for i, (p, l) in enumerate(rules)])))


def awaiting(c: Column, pack: Pack) -> Column:
    return hits(c, pack, "awaiting") & ~hits(c, pack, "canonical")


def clear_opinion(c: Column, pack: Pack) -> Column:
    return hits(c, pack, "opinion") & ~hits(c, pack, "canonical")


def says_clear(c: Column, pack: Pack) -> Column:
    out = F.lit(False)
    for term, _ in pack.rules("clear"):
        out = out | F.lower(c).contains(term)
    return out


def partial_clear(c: Column, pack: Pack, hint: Column | None = None) -> Column:
    """A clear for one class, not for the whole; waiting for one is not having one.

    ``hint`` is the class hint where it is already at hand as a column.
    """
    hint = class_hint(c, pack) if hint is None else hint
    return says_clear(c, pack) & ~awaiting(c, pack) & ~clear_opinion(c, pack) & (hint != NONE)


def cleared_class(c: Column, pack: Pack, partial: Column | None = None) -> Column:
    """The class named nearest to the clear word of a partial clear."""
    near = let(without_level(c, pack), lambda m: F.array_min(_distances(m, pack))["label"])
    return F.when(partial_clear(c, pack) if partial is None else partial, near)


def active_class(c: Column, pack: Pack, hint: Column | None = None, partial: Column | None = None) -> Column:
    """What is still up: the nearest class that is not the one being lifted."""
    def rest(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["dist"].alias("dist"), x["label"].alias("label"))))
        return let(ordered, lambda o: F.coalesce(
            F.get(F.filter(o, lambda x: x["label"] != F.get(o, F.lit(0))["label"]), F.lit(0))["label"], F.lit(NONE)))

    hint = class_hint(c, pack) if hint is None else hint
    partial = partial_clear(c, pack) if partial is None else partial
    lifted = F.when(partial, let(_distances(c, pack), lambda f: F.when(F.size(f) > 0, rest(f))))
    return F.coalesce(lifted, hint)


def alert_state(c: Column, pack: Pack) -> Column:
    """clear, alert or null; vetoes first, and a canonical form escapes most of them."""
    canonical = hits(c, pack, "canonical")
    level_only = (hits(c, pack, "level") & says_clear(c, pack)
                  & (first_match(without_level(c, pack), pack) == NONE))
    vetoed = ((hits(c, pack, "awaiting") | hits(c, pack, "opinion") | hits(c, pack, "advice")
               | hits(c, pack, "retracted") | level_only) & ~canonical) | hits(c, pack, "forecast_phrase")
    return F.when(vetoed, F.lit(None).cast("string")).when(says_clear(c, pack), "clear").when(
        hits(c, pack, "alert"), "alert")


def forecast(c: Column, pack: Pack) -> Column:
    return hits(c, pack, "forecast") & ~hits(c, pack, "forecast_past")


def forecast_eta(c: Column, after: str, before: str, unit: str) -> Column:
    """"a–b unit" from either word order, null when no time is said."""
    a, b = F.regexp_extract(c, after, 1), F.regexp_extract(c, after, 2)
    lead = F.regexp_extract(c, before, 1)
    return (
        F.when((a != "") & (b != ""), F.concat(a, F.lit("–"), b, F.lit(f" {unit}")))
        .when(a != "", F.concat(a, F.lit(f" {unit}")))
        .when(lead != "", F.concat(lead, F.lit(f" {unit}")))
    )


def nothing_tracked(c: Column, pack: Pack) -> Column:
    return (hits(c, pack, "work_report") & ~hits(c, pack, "work_as_warning")) | hits(c, pack, "gone")


def recheck(c: Column, pack: Pack) -> Column:
    return hits(c, pack, "recheck") | nothing_tracked(c, pack) | clear_opinion(c, pack)


def reappeared(c: Column, pack: Pack) -> Column:
    return hits(c, pack, "reappear")


def generic_only(c: Column, pack: Pack) -> Column:
    return ~hits(c, pack, "specific")


def live_shapes(c: Column, mentions: Column, pack: Pack, filler: Sequence[str], slack: int = 3) -> Column:
    """Names of the structural evidence found; one weak shape alone in prose is dropped."""
    placed = F.size(mentions) > 0
    bare = blank(c, pack, "negated")
    parts = [
        F.when(bare.rlike(p) & (placed if label == "place-with-threat" else F.lit(True)), F.lit(label))
        for p, label in pack.rules("shape")
    ]
    parts += [
        F.when(bare_list(c, mentions, filler, slack), "bare-place-list"),
        F.when(hits(c, pack, "marker") & placed, "emoji-with-place"),
        F.when(hits(c, pack, "beside") & placed, "threat-with-place"),
        F.when(hits(c, pack, "loud") & placed, "loud-over-place"),
    ]
    found = F.filter(F.array(*parts), lambda x: x.isNotNull())
    weak_alone = ["emoji-with-place", "phase-word"]
    return let(found, lambda f: F.when(
        (F.size(f) == 1) & F.get(f, F.lit(0)).isin(*weak_alone) & (squeezed_length(c) > PROSE_CHARS),
        F.array().cast("array<string>")).otherwise(f))


def live_strength(shapes: Column, strong: Sequence[str]) -> Column:
    return (F.when(F.arrays_overlap(shapes, F.array(*[F.lit(s) for s in strong])), "strong")
            .when(F.size(shapes) > 0, "weak").otherwise(NONE))


def strongly_social(c: Column, pack: Pack) -> Column:
    low = F.lower(c)
    terms = F.array(*[F.when(low.contains(p), F.lit(1)) for p, _ in pack.rules("social")])
    return hits(c, pack, "social_opener") | (
        F.size(F.filter(terms, lambda x: x.isNotNull())) >= SOCIAL_TERMS_MIN)


def modality(c: Column, looks_live: Column, hint: Column, pack: Pack) -> Column:
    """live-threat, aftermath, summary-news or non-threat; the order is the design."""
    h = lambda fam: hits(c, pack, fam)
    low = F.lower(c)
    social = F.lit(False)
    for term, _ in pack.rules("social"):
        social = social | low.contains(term)
    return (
        F.when(h("summary") | h("outlook"), "summary-news")
        .when(h("weather"), "non-threat")
        .when(h("ours"), "non-threat")
        .when(h("retracted"), "non-threat")
        .when(h("promo"), "non-threat")
        .when(h("impact"), "live-threat")
        .when(strongly_social(c, pack), "non-threat")
        .when(social & ~looks_live, "non-threat")
        .when(h("aftermath"), "aftermath")
        .when(h("resolved") | h("lost"), "live-threat")
        .when(looks_live, "live-threat")
        .when(hint != NONE, "live-threat")
        .otherwise("non-threat")
    )


def certainty(c: Column, placed: Column, pack: Pack) -> Column:
    h = lambda fam: hits(c, pack, fam)
    return (
        F.when(h("lost"), "lost")
        .when(nothing_tracked(c, pack), "lost")
        .when(h("resolved"), "clear")
        .when(h("impact") & ~placed, "lost")
        .when(h("anticipated"), "probable")
        .when(h("possible"), "probable")
        .when(h("hedge"), "probable")
        .otherwise("confirmed")
    )


def buried(c: Column, label: str, pack: Pack) -> Column:
    """Long, and its first line is not about the class."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return (F.length(c) > BURIED_CHARS) & ~(
        (F.length(first) <= HEADLINE_CHARS) & (active_class(first, pack) == label))


def says_new(c: Column, pack: Pack) -> Column:
    return hits(blank(c, pack, "duration"), pack, "novel") & ~hits(c, pack, "ordinal")


def says_launch(c: Column, mentions: Column, far_tier: int, pack: Pack) -> Column:
    return hits(c, pack, "launch") & F.forall(mentions, lambda m: m["tier"] == far_tier)


def landed_word(c: Column, impact: Column, pack: Pack, hit: str, boom: str) -> Column:
    return F.when(impact & hits(c, pack, "hit"), hit).when(impact, boom)


def tone_of(state: Column, cls: Column, tones: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in tones.items() for x in kv])
    return F.when(state.isNotNull(), state).otherwise(F.coalesce(F.try_element_at(table, cls), F.lit(default)))


def classify(df: DataFrame, text: str, pack: Pack, tones: dict[str, str], strong: Sequence[str],
             filler: Sequence[str], far_tier: int, near: Sequence[int], default_tone: str = "drone",
             slack: int = 3) -> DataFrame:
    """One row per message with everything later steps read; needs ``mentions``.

    Shared flags are columns of an earlier projection, so each pattern runs once.
    """
    c = F.col(text)
    placed = F.size("mentions") > 0
    flagged = df.withColumns({
        "shapes": live_shapes(c, F.col("mentions"), pack, filler, slack),
        "_hint": class_hint(c, pack),
        "alert_state": alert_state(c, pack),
        "_impact": hits(c, pack, "impact"),
    }).withColumn("_partial", partial_clear(c, pack, F.col("_hint"))).withColumns({
        "_active": active_class(c, pack, F.col("_hint"), F.col("_partial")),
        "cleared": cleared_class(c, pack, F.col("_partial")),
    })
    live = F.size("shapes") > 0
    named = F.when((F.col("_active") == NONE) & (live | F.col("_impact")), UNSURE).otherwise(F.col("_active"))
    cls = F.when((named == UNSURE) & F.coalesce(F.col("alert_state") == "clear", F.lit(False)), NONE).otherwise(named)
    return flagged.withColumn("class", cls).withColumns({
        "strength": live_strength(F.col("shapes"), strong),
        "tone": tone_of(F.col("alert_state"), F.col("class"), tones, default_tone),
        "modality": modality(c, live, F.col("_hint"), pack),
        "certainty": certainty(c, placed, pack),
    }).drop("_hint", "_active", "_impact", "_partial")
