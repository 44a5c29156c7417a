"""Chunked running values against a plain loop, with one key holding most rows."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from feedloom.operators.asof import asof, within
from feedloom.operators.order_stats import P90, UPPER_MEDIAN, picks
from feedloom.operators.scan import last_before, max_so_far, next_after, row_index, scan, sum_so_far


def rows_of(n, seed):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(50), i, r.choice([None, 1, 2, 3])) for i in range(n)]


def test_scan_equals_loop(spark):
    rows = rows_of(300, 1)
    df = spark.createDataFrame(rows, "k STRING, t LONG, i LONG, v LONG")
    got = {r.i: r for r in scan(df, ["k"], ["t", "i"], pieces=7, prev=last_before(F.col("v")), nxt=next_after(F.col("v")),
                                total=sum_so_far(F.col("v")), top=max_so_far(F.col("v"), inclusive=False), at=row_index()).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for pos, r in enumerate(mine):
            before = [x[3] for x in mine[:pos] if x[3] is not None]
            after = [x[3] for x in mine[pos + 1:] if x[3] is not None]
            upto = before + ([r[3]] if r[3] is not None else [])
            g = got[r[2]]
            assert g.prev == (before[-1] if before else None)
            assert g.nxt == (after[0] if after else None)
            assert g.total == (sum(upto) if upto else None)
            assert g.top == (max(before) if before else None)
            assert g.at == pos + 1


def test_scan_without_keys_and_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)], "k STRING, t LONG")
    assert [r.s for r in scan(df, [], ["t"], pieces=5, s=row_index()).orderBy("t").collect()] == list(range(1, 41))
    assert [r.s for r in scan(df, ["k"], ["t"], pieces=5, s=row_index()).orderBy("t").collect()] == list(range(1, 41))


def test_asof_directions(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 10, 2), ("x", 10, 3)], "k STRING, t LONG, id LONG")
    right = spark.createDataFrame([("k", 5, 50), ("k", 9, 90), ("k", 10, 100)], "k STRING, t LONG, v LONG")

    def run(**kw):
        out = asof(left, right, ["k"], F.col("t"), F.col("t"), ["v"], ["id"], "hit", **kw)
        return {r.id: (r.hit.v if r.hit else None) for r in out.collect()}

    assert run() == {1: 50, 2: 100, 3: None}
    assert run(strict=True) == {1: None, 2: 90, 3: None}
    assert run(forward=True) == {1: 50, 2: 100, 3: None}
    assert run(forward=True, strict=True) == {1: 90, 2: None, 3: None}


def test_within_takes_the_earliest(spark):
    left = spark.createDataFrame([("k", 100, 1), ("k", 500, 2)], "k STRING, t LONG, id LONG")
    right = spark.createDataFrame([("k", 80), ("k", 95), ("k", 111)], "k STRING, t LONG")
    out = within(left, right, ["k"], F.col("t"), F.col("t"), 10, 12, ["id"], "hit")
    assert {r.id: r.hit for r in out.collect()} == {1: 95, 2: None}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40))
def test_picks_equal_sorted_list(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k STRING, v LONG")
    got = picks(df, ["k"], "v", mid=UPPER_MEDIAN, p90=P90).collect()[0]
    ordered = sorted(values)
    assert got.n == len(values)
    assert got.mid == ordered[len(values) // 2]
    assert got.p90 == ordered[int(len(values) * 0.9)]
