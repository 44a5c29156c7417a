"""near_duplicates gives the same pairs whether a slot's wordings meet in a task or by their rare words."""

import numpy as np
import pytest

from feedloom.operators import joins


@pytest.fixture(scope="module")
def feed(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, int(rng.integers(1, 25))))
        for channel in rng.choice(list("abc"), int(rng.integers(1, 3)), replace=False):
            rows.append((str(channel), len(rows), int(i * 3 + rng.integers(0, 200)), text))
    return spark.createDataFrame(rows, "channel string, message_id long, ts_s long, text string"), rows


def plain(rows, window_s=300):
    found = []
    for x, a in enumerate(rows):
        for b in rows[x + 1 :]:
            p, q = set(a[3].split()), set(b[3].split())
            if a[0] != b[0] and abs(a[2] - b[2]) <= window_s and len(p & q) / len(p | q) >= 0.5:
                f, s = sorted((a, b), key=lambda r: (r[2], r[1]))
                found.append((f[0], f[1], s[0], s[1], s[2] - f[2], round(len(p & q) / len(p | q), 6)))
    return sorted(found)


@pytest.mark.parametrize("crowd", [2048, 70, 0])
def test_same_pairs_on_every_way(feed, crowd):
    df, rows = feed
    got = joins.near_duplicates(df, crowd=crowd).collect()
    assert sorted((*r[:5], round(r["jaccard"], 6)) for r in got) == plain(rows)


def test_small_slots_write_no_candidates(feed, monkeypatch):
    def no(*_):
        raise AssertionError("pairs of candidates are written")

    monkeypatch.setattr(joins, "_alike_by_rare_words", no)
    assert joins.near_duplicates(feed[0]).count() > 0
