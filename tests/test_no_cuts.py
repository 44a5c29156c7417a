"""Rows that earlier limits would have lost."""

import time

from pyspark.sql import functions as F

from feedloom.operators import entities as en
from feedloom.operators import geo_jobs as gj
from feedloom.operators import joins
from feedloom.sources import logs, pages, settings

PLACE = "name string, tier int, stems array<string>, landmark boolean, origin boolean, ambiguous boolean, exact boolean"


def places(spark, **stems):
    return spark.createDataFrame([(n, 0, s if isinstance(s, list) else [s], False, False, False, False) for n, s in stems.items()], PLACE)


def found(spark, text, place):
    m = en.stem_matches(spark.createDataFrame([(1, text)], "id long, text string"), ["id"], "text", place)
    return sorted((r["name"], r["start"], r["end"]) for r in m.collect())


def test_stems_of_any_width_and_length(spark):
    p = places(spark, five="alpha beta gamma delta eps", four="alpha beta gamma delta", kyiv="kyiv", ab="ab", long="q" * 40)
    text = "Kyiv alpha beta gamma delta epsilon abba " + "q" * 41
    assert found(spark, text, p) == [("ab", 6, 7), ("five", 1, 6), ("four", 1, 5), ("kyiv", 0, 1), ("long", 7, 8)]


def test_a_stem_of_more_words_than_go_with_a_word(spark):
    text = "x a b c d e f g a b c d e f go a b c d e f"
    p = places(spark, seven="a b c d e f g", six="a b c d e f", other="a b c d e x", one="g")
    assert found(spark, text, p) == [("one", 7, 8), ("one", 14, 15), ("seven", 1, 8), ("seven", 8, 15), ("six", 1, 7), ("six", 8, 14), ("six", 15, 21)]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "y a b c d e f"), (None, "a b c d e f")]  # copies, one key for two texts, no key
    got = en.stem_matches(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", p).collect()
    assert sorted((r["id"] or 0, r["start"]) for r in got) == [(0, 0), (1, 0), (1, 0), (1, 1)]


def test_every_beginning_of_an_item_is_a_stem(spark, tmp_path):
    from feedloom.plans import entity_jobs as ej

    item = " ".join(["abcdefgh"] + ["x"] * 29)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "s", "en", item), (2, "s", "en", "ab " + item)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["name"]: (r["found"], r["starts"], r["words"]) for r in ej.g02_shapes(spark, str(tmp_path)).collect()}
    assert got["n1_30"] == (2, 1, 60) and got["n1_1"] == (2, 1, 2) and got["s1_2"] == (3, 1, 3) and got["s1_8"] == (2, 1, 2)
    assert len(got) == 30 + 7


def test_a_phrase_at_the_end_of_a_text(spark):
    assert found(spark, "alpha beta", places(spark, three="alpha beta gamma", two="alpha be")) == [("two", 0, 2)]


def test_typos_of_long_stems(spark):
    stem = "abcdefghijklmnopqrstuvwxyzab"
    df = spark.createDataFrame([(1, "X" + stem[1:]), (2, "Kyivska and Kyivshe nothing")], "id long, text string")
    got = en.typo_candidates(df, ["id"], "text", places(spark, long=stem, town=["kyiv", "kyivski"]))
    assert {(r["token"], r["suggests"]) for r in got.collect()} == {("X" + stem[1:], "long")}


def test_labels_of_several_part_files(spark, tmp_path):
    rows = [("a", "n1"), ("b", "n1")]
    df = spark.createDataFrame(rows, "id string, night string")
    df.filter("id = 'a'").write.json(str(tmp_path / "old"))
    time.sleep(0.05)
    df.repartition(2, "id").write.json(str(tmp_path / "new"))
    time.sleep(0.05)
    df.filter("id = 'b'").write.mode("append").json(str(tmp_path / "new"))
    got = logs.read_labels(spark, str(tmp_path), "id STRING, night STRING")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "b"]


def test_first_line_of_a_log_wins(spark, tmp_path):
    lines = ['{"anchor": "x", "text": "first", "at": "2024-01-02T00:00:00"}', '{"anchor": "x", "text": "second", "at": "2024-01-01T00:00:00"}']
    (tmp_path / "log.json").write_text("\n".join(lines))
    assert [r["text"] for r in logs.read_decisions(spark, str(tmp_path)).collect()] == ["first"]


def test_over_the_180th_meridian(spark):
    home = spark.createDataFrame([("r", 50.0, 0.0, 179.9), ("w", 50.0, 0.0, -179.9)], "recipient string, radius_km double, home_lat double, home_lon double")
    spots = spark.createDataFrame([("east", 0.0, -179.9), ("west", 0.0, 179.9), ("far", 0.0, 178.0)], "name string, lat double, lon double")
    got = {(r["recipient"], r["name"]) for r in gj.within_radius(home, spots).collect()}
    assert got == {(a, b) for a in "rw" for b in ("east", "west")}


def test_a_bound_is_not_lifted_by_rounding(spark):
    """11 of 20 words shared: just 0.55 alike."""
    both = [f"word{chr(97 + i)}{chr(97 + i)}" for i in range(11)]
    rows = [("a", 1, 10, " ".join(both)), ("b", 2, 11, " ".join(both + [f"other{chr(97 + i)}" for i in range(9)]))]
    m = spark.createDataFrame(rows, "channel string, message_id long, ts_s long, text string")
    assert joins.near_duplicates(m, threshold=0.55).count() == 1


def test_references_of_every_kind(spark):
    html = "&amp;lt; &#1070;&#x1F600; &Eacute;&nosuch; a&b; &#0; &euro;"
    got = spark.range(1).select(pages.html_to_text(F.lit(html))).first()[0]
    assert got == "&lt; Ю😀 É&nosuch; a&b; � €"


def test_blocks_that_nest(spark):
    html = 'x<div class="q">a<DIV>b</DIV>c</div><div class="q"> </div>y<div class="q">open'
    rows = spark.createDataFrame([(html,), (None,), ("no block",)], "html string")
    got = [r[0] for r in rows.select(pages.block_text(F.col("html"), 'class="q"')).collect()]
    assert got == ["a<DIV>b</DIV>c\nopen", None, ""]


def test_a_clipped_list_says_so(spark):
    raw = spark.createDataFrame([('["aa","bbbb"]',), ('["a"]',), ("7",), (None,)], "raw string")
    value, note = settings.clean_names(F.col("raw"), F.array(F.lit("d")), max_len=1, max_name=3)
    assert [tuple(r) for r in raw.select(value, note).collect()] == [(["aa"], "clipped"), (["a"], None), (["d"], "type"), (["d"], None)]


def test_both_ways_to_fan_out(spark):
    readings = spark.createDataFrame(
        [("c", i, ["p1"] if i % 3 else []) for i in range(60)] + [("c", 99, ["p1", "p2", "none"])], "channel string, message_id long, places array<string>")
    people = spark.createDataFrame([(f"r{i}", ["p1"] if i % 2 else ["p2", "p1"]) for i in range(6)], "recipient string, ring array<string>")
    ways = [
        sorted((r["message_id"], r["recipient"], tuple(r["touched"])) for r in en.fan_out(readings, people, "places", "ring", most).collect())
        for most in (en.BROADCAST_RINGS, 0)
    ]
    assert ways[0] == ways[1] and len(ways[0]) == 61 * 6


def test_spans_that_start_in_one_second_or_overlap(spark):
    spans = spark.createDataFrame([(10, 20), (10, 10), (12, 13), (30, 30), (30, None)], "start_s long, end_s long")
    for rows, want in (([(1, 9), (2, 10), (3, 15), (4, 19), (5, 20), (6, 31)], {2, 3, 4, 6}), ([(1, None)], set())):
        got = joins.on_span(spark.createDataFrame(rows, "message_id long, ts_s long"), spans, ["message_id"])
        assert {r["message_id"] for r in got.collect() if r["inside"]} == want


def test_rows_of_one_recipient_add_up_to_one_ring(spark):
    """Copies of a recipient and of a circle: one row a recipient, and every name of all its rows."""
    spots = spark.createDataFrame([(f"p{i}", 50.0 + i / 100, 30.0) for i in range(20)], "name string, lat double, lon double")
    rows = [("a", 2.0, "p0", 50.0, 30.0, ["x"], ["p1"]), ("a", 2.0, "p10", 50.1, 30.0, ["y"], []), ("b", 2.0, "p0", 50.0, 30.0, ["x"], ["p1"]),
            ("c", 0.0, "p0", 50.0, 30.0, None, None), ("d", 3.0, None, None, None, ["z"], [])]
    people = spark.createDataFrame(rows, "recipient string, radius_km double, home string, home_lat double, home_lon double, ring array<string>, ring_drop array<string>")
    got = sorted((r["recipient"], r["ring"]) for r in gj.ring_names(people, spots).collect())
    assert got == [("a", ["p0", "p10", "p11", "p9", "x", "y"]), ("b", ["p0", "x"]), ("c", ["p0"]), ("d", ["z"])]
