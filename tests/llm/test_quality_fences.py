"""Fences of ratios that are zero in most texts, and short clean texts."""

import pytest

from feedloom.llm import quality

PROSE = "the river runs past an old mill where people of both towns used to meet and talk about the weather"


def junk(i):
    return " ".join(f"{w}{'#%&$'[i % 4] * 3}" for w in PROSE.split())


@pytest.fixture(scope="module")
def kept(spark):
    """Source ``bad`` is 30 % junk, the others 5 %; each holds short clean texts with a table line or a key."""
    rows = [(s, i, junk(i) if i % 100 < share else f"{PROSE} {i} {PROSE.title() if i % 9 == 0 else PROSE[::-1]}")
            for s, share in (("bad", 30), ("a", 5), ("b", 5), ("c", 5)) for i in range(200)]
    rows += [(s, 1000, "One text of a few words is here.\nmill | town | road\nThe rest is plain words again.") for s in ("bad", "a")]
    rows += [(s, 1001, "My own key is " + "0a1b2c3d" * 3 + " and no one but me may read or use it") for s in ("bad", "a")]
    docs = spark.createDataFrame([(s, i, t, "en") for s, i, t in rows], "source string, doc_id long, text string, lang string")
    return {(r["source"], r["doc_id"]) for r in quality.keep_good(docs).collect()}


def test_junk_goes_however_much_of_a_group_it_is(kept):
    assert not [x for x in kept if x[1] < 5 or x[0] == "bad" and x[1] % 100 < 30 and x[1] < 200]
    assert len([x for x in kept if x[1] < 1000]) == 140 + 3 * 190


def test_short_clean_texts_stay(kept):
    assert {(s, i) for s in ("bad", "a") for i in (1000, 1001)} <= kept
