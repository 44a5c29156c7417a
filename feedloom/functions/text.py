"""Text columns: cleaning, fingerprints, tokens, n-grams.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that carry no meaning, spaces that must become plain
# ones, the apostrophe variants, and the symbol ranges used as decoration.
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
NBSP = "\u00a0\u2007\u202f"
APOSTROPHES = "’ʼ‘´`"
DECOR = (
    "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{2190}-\\x{21FF}"
    "\\x{FE0F}\\x{20E3}\\x{25AA}-\\x{25FF}]+"
)
PROMO_RESIDUE = 12
RESIDUE_PUNCT = "[\\s|/:,.!()\\[\\]\\\\–—•·-]+"
URL = "https?://\\S+"
WORD = "[\\p{L}\\p{N}_]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_invisible(c: Column) -> Column:
    bare = F.regexp_replace(c, INVISIBLE, "")
    return F.translate(bare, NBSP, " " * len(NBSP))


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))


def plain_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def collapse_lines(c: Column) -> Column:
    """One space for runs inside a line, trimmed lines, no blank lines."""
    lines = F.split(plain_newlines(c), "\n")
    tidy = F.transform(lines, lambda x: trim_space(F.regexp_replace(x, "[ \\t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def strip_decor(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, DECOR, " "))


def is_footer(line: Column, promo: str, residue: int = PROMO_RESIDUE) -> Column:
    left = F.regexp_replace(strip_decor(line), promo, " ")
    return line.rlike(promo) & (
        F.length(F.regexp_replace(left, RESIDUE_PUNCT, "")) <= residue
    )


def strip_footer(c: Column, promo: str) -> Column:
    """Drop blank and promo lines from the end only."""
    def cut(lines: Column) -> Column:
        kept = F.transform(
            lines,
            lambda x, i: F.when((trim_space(x) != "") & ~is_footer(x, promo), i + 1),
        )
        last = F.coalesce(F.array_max(kept), F.lit(0))
        return F.array_join(F.slice(lines, F.lit(1), last), "\n")

    return let(F.split(c, "\n", -1), cut)


def normalize_text(c: Column, promo: str) -> Column:
    body = plain_newlines(fold_apostrophes(clean_invisible(F.coalesce(c, F.lit("")))))
    return collapse_lines(strip_footer(body, promo))


def squeeze(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, "\\s+", " "))


def fingerprint(c: Column, promo: str) -> Column:
    """Loose key for equal wording: no case, links, punctuation or decoration."""
    low = F.lower(strip_decor(normalize_text(c, promo)))
    bare = F.regexp_replace(F.regexp_replace(low, URL, " "), "[^\\p{L}\\p{N}_\\s]", " ")
    return squeeze(bare)


def flatten(c: Column) -> Column:
    """The space dictionary spans are counted in: words parted by one space."""
    low = F.lower(F.translate(c, APOSTROPHES + "'", ""))
    return squeeze(F.regexp_replace(low, "[^\\p{L}\\p{N}\\- ]+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{WORD}+(?:['’-]{WORD}+)*"), F.lit(0))


def is_capitalised(word: Column) -> Column:
    return word.rlike("^\\p{Lu}")


def stem_key(word: Column, n: int = 6) -> Column:
    return F.substring(F.lower(word), 1, n)


def gram_text(c: Column) -> Column:
    """What n-grams are cut from: lower, squeezed, a blank on either side."""
    return F.concat(F.lit(" "), squeeze(F.lower(c)), F.lit(" "))


def char_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """All grams of ``lo``..``hi`` characters of the padded, squeezed, lower text."""

    def grams(letters: Column, n: int) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.concat(x, *[F.get(letters, i + k) for k in range(1, n)])

        return F.filter(F.transform(letters, at), lambda g: g.isNotNull())

    # Letters once, then neighbours by index: linear in the text, whatever its script.
    return let(
        F.split(gram_text(c), ""),
        lambda letters: F.concat(*[grams(letters, n) for n in range(lo, hi + 1)]),
    )


def n_char_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """How many ``char_ngrams`` a text has, by its length alone."""
    return let(F.length(gram_text(c)), lambda n: reduce(add, [F.greatest(n - k + 1, F.lit(0)) for k in range(lo, hi + 1)]))


def squeezed_length(c: Column) -> Column:
    return F.length(squeeze(c))


def preview(c: Column, n: int) -> Column:
    return F.left(F.replace(c, F.lit("\n"), F.lit(" / ")), F.lit(n))


def mask(c: Column, pattern: str) -> Column:
    """Blank each match with spaces of its own length, so positions survive."""
    parts = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    woven = F.zip_with(
        parts,
        hits,
        lambda p, h: F.concat(p, F.when(h.isNull(), F.lit("")).otherwise(
            F.rpad(F.lit(""), F.length(h), F.lit(" ")))),
    )
    return F.array_join(woven, "")


def any_of(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term stands anywhere in the lower-cased text."""
    low = F.lower(c)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def format_line(sentence: Column, source: Column, audible: Column, recheck: Column,
                frame: Column, limit: int) -> Column:
    """Head mark, sentence, source; the source is trimmed, never the sentence."""
    head = F.concat(
        F.when(audible, F.concat(F.lit("\U0001F514 "), frame))
        .when(recheck, F.lit("\U0001F4E1 "))
        .otherwise(frame),
        sentence,
    )
    tail = F.concat(F.lit("— "), source)
    whole = F.concat(head, F.lit("\n"), tail)
    room = F.greatest(F.lit(limit) - F.length(head) - 3, F.lit(0))
    cut = F.concat(F.regexp_replace(F.left(tail, room), "\\s+$", ""), F.lit("…"))
    plain = (source == "") | F.contains(sentence, source)
    return (
        F.when(plain, head)
        .when(F.length(whole) <= limit, whole)
        .otherwise(F.concat(head, F.lit("\n"), cut))
    )


def spell_duration(s: Column, h: str = "h", m: str = "min", sec: str = "s") -> Column:
    hours = F.floor(s / 3600)
    minutes = F.floor((s % 3600) / 60)
    return (
        F.when((hours > 0) & (minutes > 0),
               F.concat(hours.cast("string"), F.lit(f" {h} "), minutes.cast("string"), F.lit(f" {m}")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit(f" {h}")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit(f" {m}")))
        .otherwise(F.concat(s.cast("string"), F.lit(f" {sec}")))
    )
