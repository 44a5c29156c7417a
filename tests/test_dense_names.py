"""Texts full of names: the same spans as by hand, in time that grows with the text."""

import random
import time

from pyspark.sql import functions as F

from feedloom.operators import entities as en

PLACE = "name string, stems array<string>, tier int, landmark boolean, origin boolean, ambiguous boolean, exact boolean"


def places(spark, *stems):
    return spark.createDataFrame([(s.replace(" ", "_"), [s], 0, False, False, False, True) for s in stems], PLACE)


def test_overlaps_that_hang_together(spark):
    stems = ["a b", "b c d", "d e", "e", "c", "a"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdex") for _ in range(60)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "message_id long, text string")
    got = {r["message_id"]: [(m["start"], m["end"], m["name"]) for m in r["mentions"]] for r in en.with_mentions(rows, ["message_id"], "text", places(spark, *stems)).collect()}
    for i, text in enumerate(texts):
        words, found = text.split(), []
        for s in stems:
            n = s.count(" ") + 1
            found += [(-len(s), at, at + n, s.replace(" ", "_")) for at in range(len(words) - n + 1) if words[at : at + n] == s.split()]
        taken = []
        for _, start, end, name in sorted(found, key=lambda x: (x[0], x[1], x[3])):
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, name))
        assert got[i] == taken


def test_a_long_text_of_names_only(spark):
    place, roles = places(spark, "alpha", "beta"), en.mention_roles(F.col("text"), F.col("mentions"), ["to"], ["from"], ["and"])
    for times in (10, 6000):  # the first one warms up
        at = time.time()
        rows = spark.createDataFrame([(1, "to alpha beta and " * times)], "message_id long, text string")
        df = en.with_mentions(rows, ["message_id"], "text", place)
        got = df.select(F.size("mentions").alias("n"), en.bare_list(F.col("text"), F.col("mentions"), ["to", "and"]).alias("bare"),
                        F.size(F.filter(roles, lambda m: m["role"] == "dest")).alias("dest")).first()
        assert (got["n"], got["bare"], got["dest"]) == (2 * times, True, 2 * times)
    assert time.time() - at < 15
