"""Names in text: dictionary matching, roles, scope, misspellings.

A span is counted in words of the flattened text, hyphens parting words; so in a
hyphenated pair both names are found.  Matching explodes words, joins them to the
stems on a short prefix (a plain equi-join; Spark broadcasts the dictionary when
its measured size allows) and folds the few candidates of a message in one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flatten, let
from ..session import settle, small_side, width

UNKNOWN = 9
BROADCAST_STEMS = 200_000
BROADCAST_RINGS = 500_000
KEY_LEN = 5  # letters of a longer stem that a word must share before the two are compared
AHEAD = 4  # words after a word that go with it; what a wider stem has beyond them is looked up in the text
MARKER_WINDOW = 22
COUNT_REACH = 30
LOOK_BACK_WORDS = 16


def expand_stems(place: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Places with the extra stems that vowel changes at the end call for."""
    def varied(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for end, repl in reversed(rules):
            out = F.when(s.endswith(end), F.concat(F.left(s, F.length(s) - len(end)), F.lit(repl))).otherwise(out)
        return out

    more = F.filter(F.transform("stems", varied), lambda s: s.isNotNull())
    return place.withColumn("stems", F.array_union("stems", more))


def words_of(text: Column) -> Column:
    return F.split(flatten(text), "[ \\-]+")


def stem_rows(place: DataFrame) -> DataFrame:
    """One row per stem, cut into words; ``key`` is where a word has to begin."""
    one = place.withColumn("stem", F.explode("stems")).withColumn("parts", F.split("stem", "[ \\-]+"))
    return one.select(
        F.left(F.element_at("parts", 1), F.lit(KEY_LEN)).alias("key"), "parts", F.size("parts").alias("width"),
        F.length("stem").alias("stem_len"), "name", "tier", "landmark", "origin", "ambiguous", "exact")


def following(words: Column, at: Column, n: int) -> Column:
    """The ``n`` words after one, null beyond the end; by index, as ``slice`` copies the whole text each time."""
    return F.array(*[F.get(words, at + k) for k in range(1, n + 1)]).cast("array<string>")


def before(words: Column, at: Column, n: int) -> Column:
    """The ``n`` words before one, joined; fewer at the beginning."""
    return F.array_join(F.array(*[F.get(words, at - k) for k in range(n, 0, -1)]), " ")


def stem_matches(df: DataFrame, key: Sequence[str], text: str, place: DataFrame) -> DataFrame:
    """Every word-aligned stem occurrence, whatever its length and number of words.

    Words meet stems on the first letters of the stem's first word.  How many letters that
    takes, and how many words after it a stem can reach, is read off the dictionary.
    """
    stems = small_side(stem_rows(place), BROADCAST_STEMS)
    wide = F.col("width") > AHEAD + 1
    shape = stems.agg(F.collect_set(F.when(~wide, F.length("key"))).alias("sizes"), F.max("width").alias("widest")).first()  # KEY_LEN numbers at most
    sizes, widest = sorted(shape["sizes"]) or [KEY_LEN], shape["widest"] or 1
    if widest <= AHEAD + 1:
        return _narrow_matches(df, key, text, stems, sizes, widest - 1)
    narrow = _narrow_matches(df, key, text, stems.filter(~wide), sizes, AHEAD)
    return narrow.unionByName(_wide_matches(df, key, text, stems.filter(wide)))


def _word_rows(df: DataFrame, key: Sequence[str], text: str, more: int) -> DataFrame:
    """Every word with its place and the ``more`` words after it."""
    pairs = let(words_of(F.col(text)), lambda w: F.transform(w, lambda x, i: F.struct(
        i.alias("at"), x.alias("w"), following(w, i, more).alias("then"))))
    return df.select(*key, F.explode(pairs).alias("p")).select(*key, "p.*").filter("w <> ''")


def _stands(words: Column, at: Column) -> Column:
    """Whether the stem of ``parts`` stands at ``at``."""
    last, part = F.get(words, at + F.col("width") - 1), F.element_at("parts", -1)
    head = F.slice(words, at + 1, F.col("width") - 1) == F.slice("parts", 1, F.col("width") - 1)
    return F.coalesce(head & F.when(F.col("exact"), last == part).otherwise(last.startswith(part)), F.lit(False))


def _found(key: Sequence[str]) -> list:
    return [*key, F.col("at").alias("start"), (F.col("at") + F.col("width")).alias("end"), "stem_len",
            "name", "tier", "landmark", "origin", "ambiguous"]


def _narrow_matches(df: DataFrame, key: Sequence[str], text: str, stems: DataFrame, sizes: Sequence[int], more: int) -> DataFrame:
    rows = _word_rows(df, key, text, more)
    # a word shorter than a size gives the same key as the size below, once
    keys = F.array_distinct(F.array(*[F.left("w", F.lit(n)) for n in sizes]))
    hit = rows.withColumn("key", F.explode(keys) if len(sizes) > 1 else F.left("w", F.lit(sizes[0]))).join(stems, "key")
    return hit.filter(_stands(F.concat(F.array("w"), "then"), F.lit(0))).select(*_found(key))


def _wide_matches(df: DataFrame, key: Sequence[str], text: str, stems: DataFrame) -> DataFrame:
    """Stems of more than AHEAD + 1 words: those words find the places, the rest is compared in the text itself.

    A place belongs to a key and a text, as messages of one key can have several texts.
    """
    own = [*key, "_text_id"]
    known = df.withColumn("_text_id", F.xxhash64(text))
    begun = _word_rows(known, own, text, AHEAD).withColumn("_begin", F.array_join(F.concat(F.array("w"), "then"), " "))
    places = settle(begun.join(stems.withColumn("_begin", F.array_join(F.slice("parts", 1, AHEAD + 1), " ")), "_begin").drop("_begin", "then", "key"))
    texts = known.select(*[F.col(k).alias(f"_of{n}") for n, k in enumerate(own)], F.col(text).alias("_text"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(and_, [a[f"_of{n}"].eqNullSafe(b[k]) for n, k in enumerate(own)])

    asked = places.select(*own).distinct()
    texts = texts.join(asked, same(texts, asked), "left_semi").groupBy(*[f"_of{n}" for n in range(len(own))]).agg(F.first("_text").alias("_text"))
    words = texts.withColumn("_words", words_of(F.col("_text"))).drop("_text")
    return words.join(places, same(words, places)).filter(_stands(F.col("_words"), F.col("at"))).select(*_found(key))


def stem_totals(df: DataFrame, text: str, place: DataFrame) -> DataFrame:
    """(name, found, starts, words): the matches of every name counted, their starts and their words summed up.

    Stems of one word are the same for every occurrence of a word, so they meet distinct words.
    """
    parts = F.split("stem", "[ \\-]+")
    each = place.withColumn("stem", F.explode("stems"))
    several = stem_matches(df, [], text, each.filter(F.size(parts) > 1).withColumn("stems", F.array("stem")).drop("stem"))
    several = several.groupBy("name").agg(
        F.count("*").alias("found"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("words"))
    words = df.select(F.posexplode(words_of(F.col(text))).alias("at", "w")).filter("w <> ''")
    words = words.groupBy("w").agg(F.count("*").alias("n"), F.sum(F.col("at").cast("long")).alias("at"))
    stems = small_side(each.filter(F.size(parts) == 1).select(
        F.left("stem", F.lit(KEY_LEN)).alias("key"), "stem", "name", "exact"), BROADCAST_STEMS)
    sizes = F.sequence(F.lit(1), F.least(F.length("w"), F.lit(KEY_LEN)))
    one = words.withColumn("key", F.explode(F.transform(sizes, lambda n: F.left(F.col("w"), n)))).join(stems, "key")
    one = one.filter(F.when(F.col("exact"), F.col("w") == F.col("stem")).otherwise(F.col("w").startswith(F.col("stem"))))
    one = one.groupBy("name").agg(F.sum("n").alias("found"), F.sum("at").alias("starts"), F.sum("n").alias("words"))
    return one.unionByName(several).groupBy("name").agg(*[F.sum(c).alias(c) for c in ("found", "starts", "words")])


def place_spans(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Longest stem first, then leftmost; a span overlapping a taken one is dropped.

    Only candidates that hang together by overlaps are held against each other.  The array
    keeps that order; :func:`by_position` re-sorts it.
    """
    along = Window.partitionBy(*key).orderBy("start")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = matches.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    parted = parted.withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    cand = F.struct((-F.col("stem_len")).alias("rank"), "start", "name", "end", "tier", "landmark", "origin", "ambiguous")
    per = parted.groupBy(*key, "_group").agg(F.array_sort(F.collect_list(cand)).alias("c"))

    def take(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda t: (x["start"] < t["end"]) & (x["end"] > t["start"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    kind = per.schema["c"].dataType.simpleString()
    taken = F.when(F.size("c") == 1, F.col("c")).otherwise(F.aggregate("c", F.array().cast(kind), take))
    return per.select(*key, taken.alias("c")).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("mentions"))


def with_mentions(df: DataFrame, key: Sequence[str], text: str, place: DataFrame) -> DataFrame:
    """``df`` plus ``mentions`` in resolution order (an empty array where none)."""
    spans = place_spans(stem_matches(df, key, text, place), key)
    kind = spans.schema["mentions"].dataType.simpleString()
    return df.join(spans, list(key), "left").withColumn(
        "mentions", F.coalesce("mentions", F.array().cast(kind)))


def names(mentions: Column) -> Column:
    """Names in resolution order, each once."""
    return F.array_distinct(F.transform(mentions, lambda m: m["name"]))


def by_position(mentions: Column) -> Column:
    return F.array_sort(F.transform(mentions, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["name"].alias("name"), m["tier"].alias("tier"))))


def resolve_scope(mentions: Column, far_tier: int) -> Column:
    """Most relevant tier; settlements beat landmarks, a far name settles ambiguous ones."""
    def settled(found: Column) -> Column:
        towns = F.filter(found, lambda m: ~m["landmark"])
        return F.when((F.size(towns) > 0) & (F.size(towns) < F.size(found)), towns).otherwise(found)

    def scoped(found: Column) -> Column:
        far = F.filter(found, lambda m: m["tier"] == far_tier)
        near = F.filter(found, lambda m: m["tier"] != far_tier)
        vague = F.exists(found, lambda m: m["ambiguous"]) & F.forall(near, lambda m: m["ambiguous"])
        used = F.when((F.size(far) > 0) & vague, far).otherwise(found)
        return F.coalesce(F.array_min(F.transform(used, lambda m: m["tier"])), F.lit(UNKNOWN))

    return let(settled(mentions), scoped)


def is_relevant(scope: Column, far_tier: int) -> Column:
    return scope < far_tier


def infrastructure(text: Column, stems: Sequence[tuple[str, str]]) -> Column:
    flat = flatten(text)
    return let(flat, lambda t: F.filter(
        F.array(*[F.when(t.contains(s), F.lit(n)) for n, s in stems]), lambda x: x.isNotNull()))


def stated_count(text: Column, mentions: Column, tiers: Sequence[int], count_of) -> Column:
    """Largest number standing shortly before a near place; 1 without a number, 0 without a place."""
    def counted(w: Column) -> Column:
        def near(m: Column) -> Column:
            back = F.array_compact(F.array(*[F.get(w, m["start"] - k) for k in range(LOOK_BACK_WORDS, 0, -1)]))

            def reach(word: Column, i: Column) -> Column:
                rest = F.array_join(F.slice(back, i + 2, LOOK_BACK_WORDS), " ")
                dist = F.when(rest == "", 1).otherwise(F.length(rest) + 2)
                return F.when(dist <= COUNT_REACH, count_of(word))

            return F.array_max(F.transform(back, reach))

        near_ones = F.filter(mentions, lambda m: m["tier"].isin(*tiers))
        best = F.array_max(F.transform(near_ones, near))
        return F.when(F.size(near_ones) == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(best, F.lit(0)), F.lit(1)))

    return let(words_of(text), counted)


def mention_roles(text: Column, mentions: Column, dest: Sequence[str], origin: Sequence[str],
                  conj: Sequence[str]) -> Column:
    """Mentions by position with a role each: the longest marker ending right before
    the name wins, and a role spreads over a bare list ("to A, B and C")."""
    marks = [("dest", m) for m in dest] + [("origin", m) for m in origin]

    def role_of(window: Column) -> Column:
        out = F.lit("position")
        for role, mark in sorted(marks, key=lambda x: len(x[1])):
            out = F.when(window.endswith(mark), role).otherwise(out)
        return out

    def told(w: Column) -> Column:
        def own(m: Column) -> Column:
            window = F.right(before(w, m["start"], LOOK_BACK_WORDS), F.lit(MARKER_WINDOW - 1))
            return F.struct(*[m[c].alias(c) for c in ("start", "end", "name", "tier")], let(window, role_of).alias("role"))

        def spread(acc: Column, m: Column) -> Column:
            gap = m["start"] - acc["end"]
            joined = (gap == 0) | ((gap == 1) & F.get(w, acc["end"]).isin(*conj))
            led = (m["role"] == "position") & acc["role"].isin("dest", "origin") & joined
            role = F.when(led, acc["role"]).otherwise(m["role"])
            row = F.struct(*[m[c].alias(c) for c in ("start", "end", "name", "tier")], role.alias("role"))
            return F.struct(m["end"].alias("end"), role.alias("role"), F.concat(acc["out"], F.array(row)).alias("out"))

        start = F.struct(
            F.lit(-1).alias("end"), F.lit("").alias("role"),
            F.array().cast("array<struct<start:int,end:int,name:string,tier:int,role:string>>").alias("out"))
        return F.aggregate(F.transform(by_position(mentions), own), start, spread, lambda a: a["out"])

    return let(words_of(text), told)


def heading(roles: Column, text: Column, near: Sequence[int], loiter: Sequence[str]) -> Column:
    """toward, away, loitering, position or unknown, relative to the near places."""
    is_near = lambda m: m["tier"].isin(*near)
    toward = F.exists(roles, lambda m: is_near(m) & (m["role"] == "dest"))
    left = F.exists(roles, lambda m: is_near(m) & (m["role"] == "origin"))
    far_at = F.array_min(F.transform(F.filter(
        roles, lambda m: ~is_near(m) & (m["role"] == "dest")), lambda m: m["start"]))
    here_at = F.array_min(F.transform(F.filter(
        roles, lambda m: is_near(m) & (m["role"] == "position")), lambda m: m["start"]))
    present = F.exists(roles, is_near)
    circling = F.lit(False)
    for term in loiter:
        circling = circling | flatten(text).contains(term)
    return (
        F.when(toward, "toward")
        .when((left & far_at.isNotNull()) | F.coalesce(here_at < far_at, F.lit(False)), "away")
        .when(present & circling, "loitering")
        .when(present, "position")
        .otherwise("unknown")
    )


def origin_names(roles: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        F.filter(roles, lambda m: m["role"] == "origin"), lambda m: m["name"])))


def origin_only(mentions: Column, far_tier: int) -> Column:
    return (F.size(mentions) > 0) & F.forall(mentions, lambda m: m["origin"] & (m["tier"] == far_tier))


def nationwide(cls: Column, mentions: Column, classes: Sequence[str], far_tier: int) -> Column:
    """A country-wide class with no far target named before the first local name."""
    local = lambda m: m["tier"] != far_tier
    verdicts = F.filter(F.transform(mentions, lambda m: F.when(local(m), True).when(~m["origin"], False)),
                        lambda v: v.isNotNull())
    return cls.isin(*classes) & F.coalesce(F.get(verdicts, F.lit(0)), F.lit(True))


def bare_list(text: Column, mentions: Column, filler: Sequence[str], slack: int = 3) -> Column:
    """Nothing but names and filler words: what is left is at most ``slack`` letters."""
    def left(w: Column) -> Column:
        named = F.flatten(F.transform(mentions, lambda m: F.sequence(m["start"], m["end"] - 1)))
        free = F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), named), lambda i: F.get(w, i))
        rest = F.filter(free, lambda x: ~x.isin(*filler))
        return F.length(F.array_join(rest, "")) <= slack

    return (F.size(mentions) > 0) & let(words_of(text), left)


def personal_scope(static: Column, named: Column, ring: Column, near: Sequence[int], mine: int, city: int) -> tuple[Column, Column]:
    """(scope, ring places) as they look to one recipient: an own ring replaces the
    dictionary's near tiers in both directions."""
    own = F.size(ring) > 0
    hit = F.array_intersect(named, ring)
    scope = (
        F.when(own & (F.size(hit) > 0), mine).when(own & static.isin(*near), city).otherwise(static)
    )
    return scope, F.when(own, hit)


def typo_candidates(df: DataFrame, key: Sequence[str], text: str, place: DataFrame, min_count: int = 1,
                    min_len: int = 5) -> DataFrame:
    """Capitalised words one edit away from a stem, none at zero; best stem and count.

    Words and stems within one edit share a string once a letter is dropped from
    either, so the comparison is an equi-join on those strings, exact and without
    pairing every word with every stem.
    """
    pattern = "\\p{Lu}[\\p{Ll}'\\-]{%d,}" % (min_len - 1)
    every = place.select("name", "tier", F.explode("stems").alias("stem"))
    stems = every.filter((F.length("stem") >= min_len) & ~F.col("stem").contains(" "))
    # A token is known if a stem of a place found in its message starts it, or shares its
    # first ``min_len`` letters: in either case the stem's first letters start the token.
    named = with_mentions(df.select(*key, text), key, text, place).select(*key, F.explode(names(F.col("mentions"))).alias("name"))
    heads = named.join(every, "name").groupBy(*key).agg(F.collect_set(F.left("stem", F.lit(min_len))).alias("known"))
    tokens = df.select(*key, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("tokens")).filter(F.size("tokens") > 0)

    def new(token: Column, known: Column) -> Column:
        low = F.lower(token)
        return ~F.coalesce(F.arrays_overlap(F.array(*[F.left(low, F.lit(i)) for i in range(1, min_len + 1)]), known), F.lit(False))

    left_over = tokens.join(heads, list(key), "left").select(F.explode(F.filter("tokens", lambda t: new(t, F.col("known")))).alias("token"))
    words = left_over.groupBy("token", F.lower("token").alias("low")).agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)

    def dropped(c: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(
            F.left(c, i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_union(F.array(c), cuts)

    # Prefixes of every length that a stem has; the lengths are few whatever the dictionary.
    lengths = stems.agg(F.collect_set(F.length("stem")).alias("lengths"))
    heads = words.crossJoin(F.broadcast(lengths)).withColumn("size", F.explode(F.filter("lengths", lambda n: n <= F.length("low") + 1)))
    heads = heads.drop("lengths").withColumn("prefix", F.left("low", F.col("size")))
    near = heads.withColumn("v", F.explode(dropped(F.col("prefix")))).join(
        stems.withColumn("size", F.length("stem")).withColumn("v", F.explode(dropped(F.col("stem")))),
        ["size", "v"]).drop("v").distinct()
    near = near.withColumn("distance", F.levenshtein("prefix", "stem", 1)).filter("distance >= 0")
    best = near.groupBy("token", "low", "count").agg(
        F.min("distance").alias("distance"),
        F.min_by(F.struct("name", "stem", "tier", "prefix"), F.struct("distance", "name", "stem")).alias("b"))
    return best.filter("distance = 1").select(
        "token", "count", F.col("b.name").alias("suggests"), F.col("b.stem").alias("stem"),
        F.col("b.tier").alias("tier"), keyboard_slip(F.col("b.prefix"), F.col("b.stem")).alias("keyboard"))


# The rows of a Latin keyboard.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def adjacent_keys(rows: Sequence[str] = KEYBOARD) -> list[str]:
    """Pairs of letters one key apart, sideways or straight up and down."""
    at = {(r, c): ch for r, row in enumerate(rows) for c, ch in enumerate(row)}
    return sorted(
        ch + at[(r + dr, c + dc)]
        for (r, c), ch in at.items()
        for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))
        if (r + dr, c + dc) in at)


def keyboard_slip(a: Column, b: Column, rows: Sequence[str] = KEYBOARD) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y)))
    diffs = F.filter(pairs, lambda p: p.isNotNull())
    return (F.length(a) == F.length(b)) & (F.size(diffs) == 1) & F.coalesce(
        F.get(diffs, F.lit(0)).isin(*adjacent_keys(rows)), F.lit(False))


def place_catalogue(place: DataFrame, points: DataFrame) -> DataFrame:
    """All places with their coordinates and whether one can be a home."""
    return place.join(points, "name", "left").select(
        "name", "tier", "lat", "lon", F.col("lat").isNotNull().alias("can_be_home")).orderBy("tier", "name")


def fan_out(readings: DataFrame, recipients: DataFrame, places: str, ring: str, most: int = BROADCAST_RINGS) -> DataFrame:
    """Each reading for every recipient it can concern, once.

    A reading that names places meets the recipients whose ring has one of them; one
    that names none concerns everybody.  Both are one equi-join on the place, with a
    wildcard for "everybody", so nothing pairs unrelated rows.
    """
    every = F.array(F.lit("*"))
    left = readings.withColumn("_key", F.explode(
        F.when(F.size(places) == 0, every).otherwise(F.array_distinct(places))))
    right = settle(recipients.select("recipient", F.explode(F.array_union(F.col(ring), every)).alias("_key")))
    keep = [c for c in readings.columns if c not in ("channel", "message_id")]
    if right.count() <= most:
        hits = left.join(F.broadcast(right), "_key")
    else:
        # Too many recipients to send around: every key, the wildcard above all, is
        # split over salts so that no place gathers in one task.
        salts = width(readings.sparkSession)
        left = left.withColumn("_salt", F.pmod(F.xxhash64("channel", "message_id"), F.lit(salts)))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        hits = left.join(right, ["_key", "_salt"]).drop("_salt")
    return hits.groupBy("channel", "message_id", "recipient").agg(
        F.sort_array(F.collect_set("_key")).alias("touched"), *[F.first(c).alias(c) for c in keep])
