"""Rows within a window of the last kept one: short and long stretches, and none by a Python walk."""

import numpy as np
import pytest

from feedloom.streaming import fold


def plain(rows, window):
    last, out = {}, []
    for key, ts, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        kept = key not in last or ts - last[key] > window
        if kept:
            last[key] = ts
        out.append((i, kept))
    return sorted(out)


@pytest.mark.parametrize("short", [256, 3, 0])
def test_kept_rows(spark, short):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", None], 300), rng.integers(0, 2000, 300)))]
    rows += [("dense", 7 * i, 1000 + i) for i in range(200)]  # no gap in it
    df = spark.createDataFrame(rows, "key string, ts_s long, message_id long").repartition(5)
    got = fold.suppress_within(df, ["key"], ["ts_s", "message_id"], 30, ["message_id"], short)
    assert sorted((r["message_id"], r["kept"]) for r in got.collect()) == plain(rows, 30)
    assert "MapInPandas" not in got._jdf.queryExecution().toString()
