"""Raw HTML pages to message rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that count without a semicolon, the longest first.
BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
ENTITY = f"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{BARE}))"
DIV = "(?i)<(/?)div\\b[^>]*>"


def split_posts(pages: DataFrame, marker: str, html: str = "html") -> DataFrame:
    """One row per post marker: page columns, ``pos``, ``ident`` (the marker's first
    group) and ``chunk`` (text up to the next marker)."""
    parts = F.split(F.col(html), marker, -1)
    idents = F.regexp_extract_all(F.col(html), F.lit(marker), F.lit(1))
    both = F.zip_with(
        idents,
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda i, c: F.struct(i.alias("ident"), c.alias("chunk")),
    )
    return pages.select(
        *[c for c in pages.columns if c != html], F.posexplode(both).alias("pos", "_p")
    ).select("*", "_p.ident", "_p.chunk").drop("_p")


def page_to_messages(pages: DataFrame, marker: str, stamp: str, html: str = "html") -> DataFrame:
    """Posts that carry a stamp; the others are dropped."""
    rows = split_posts(pages, marker, html).withColumn("stamp", F.regexp_extract("chunk", stamp, 1))
    return rows.filter(F.col("stamp") != "")


def html_to_text(c: Column, names: Mapping[str, str] | None = None) -> Column:
    """Line breaks kept, tags stripped, entities decoded: all, or only those of ``names``."""
    out = F.regexp_replace(c, "(?i)<br\\s*/?>", "\n")
    out = F.regexp_replace(out, "(?i)</(p|div)\\s*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return decode_entities(out) if names is None else decode_named(out, names)


def decode_named(c: Column, names: Mapping[str, str]) -> Column:
    """The references of ``names`` (``lt``, ``#39``), each with its semicolon and decoded once; all else stays."""
    chars = F.create_map(*[F.lit(x) for n, char in names.items() for x in (f"&{n};", char)])
    ref = f"&(?:{'|'.join(names)});"
    found = F.transform(F.regexp_extract_all(c, F.lit(ref), F.lit(0)), lambda x: F.element_at(chars, x))
    text = F.zip_with(F.split(c, ref, -1), found, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(text, "")).otherwise(c)


def _windows(code: int) -> str:
    """What the numbers 128 to 159 are taken for."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal references, each decoded once, as browsers do.

    The semicolon may be missing after numbers and after the names that once did without it
    (also as the beginning of an unknown name); unknown names stay.  Numbers that are no
    character become U+FFFD, control characters and non-characters nothing.
    """
    known = {f"&{k}": v for k, v in html5.items()}
    named = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    windows = F.create_map(*[F.lit(x) for n in range(128, 160) for x in (n, _windows(n))])

    def number(ref: Column) -> Column:
        hexed = F.lower(F.substring(ref, 3, 1)) == "x"
        digits = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
        short = F.length(digits) <= F.when(hexed, 6).otherwise(7)
        hexes = F.when(hexed, F.upper(digits)).otherwise(F.conv(digits, 10, 16))
        code = F.conv(F.when(short & (digits != ""), hexes).otherwise("0"), 16, 10).cast("int")
        is_char = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        char = F.decode(F.unhex(F.lpad(hexes, 8, "0")), "UTF-32")
        return F.when(~is_char, "\ufffd").when(code.between(128, 159), F.element_at(windows, code)).when(nothing, "").otherwise(char)

    def name(ref: Column) -> Column:
        head = F.regexp_extract(ref, f"^&(?:{BARE})", 0)
        bare = F.when(head != "", F.concat(F.element_at(named, head), F.substring(ref, F.length(head) + 1, F.length(ref))))
        return F.coalesce(F.element_at(named, ref), bare, ref)

    refs = F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), lambda ref: F.when(ref.startswith("&#"), number(ref)).otherwise(name(ref)))
    gaps = F.split(c, ENTITY, -1)
    text = F.zip_with(gaps, refs, lambda gap, ref: F.concat(gap, F.coalesce(ref, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(text, "")).otherwise(c)


def block_text(c: Column, marker: str) -> Column:
    """Inner HTML of every ``<div>`` whose tag holds ``marker``, by counting depth.

    The text is cut at the tags; a fold over them carries the depth, the block that is open
    and the blocks found.  A block still open at the end of the text is taken as well.
    """
    tags, gaps = F.regexp_extract_all(c, F.lit(DIV), F.lit(0)), F.split(c, DIV, -1)
    steps = F.zip_with(tags, F.slice(gaps, 2, F.size(tags)), lambda t, g: F.struct(t.alias("tag"), g.alias("gap")))
    none = F.array().cast("array<string>")

    def state(depth, block, found):
        return F.struct(depth.cast("int").alias("depth"), block.alias("block"), found.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        closes = x["tag"].startswith("</")
        depth = acc["depth"] + F.when(closes, -1).otherwise(1)
        return (
            F.when((acc["depth"] == 0) & ~closes & x["tag"].contains(marker), state(F.lit(1), x["gap"], acc["found"]))
            .when(acc["depth"] == 0, acc)
            .when(depth == 0, state(depth, F.lit(""), F.concat(acc["found"], F.array(acc["block"]))))
            .otherwise(state(depth, F.concat(acc["block"], x["tag"], x["gap"]), acc["found"]))
        )

    def finish(acc: Column) -> Column:
        found = F.when(acc["depth"] > 0, F.concat(acc["found"], F.array(acc["block"]))).otherwise(acc["found"])
        return F.array_join(F.filter(found, lambda x: x.rlike("(?U)\\S")), "\n")

    return F.aggregate(steps, state(F.lit(0), F.lit(""), none), step, finish)


def media_type(c: Column, markers: Sequence[tuple[str, str]]) -> Column:
    """Name of the first marker of the list that stands in the text."""
    out = F.lit(None).cast("string")
    for name, marker in reversed(markers):
        out = F.when(c.contains(marker), name).otherwise(out)
    return out


def extract_ref(c: Column, pattern: str) -> Column:
    """First group of an anchored pattern, null where it does not stand."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def page_cursors(pages: DataFrame, messages: DataFrame, key: str, ident: str,
                 older: Column, newer: Column) -> DataFrame:
    """Older and newer cursor per page; older falls back to the least message id."""
    least = messages.groupBy(key).agg(F.min(ident).alias("_least"))
    return pages.join(least, key, "left").select(
        key,
        F.coalesce(older, F.col("_least")).alias("before"),
        newer.alias("after"),
    )
