"""keep_one leaves one text of every group at five-word Jaccard 0.8 or more."""

import numpy as np
import pytest

from feedloom.llm import near_copies
from feedloom.llm.near_copies import keep_one


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_of(texts):
    sets, up = [five(t) for t in texts], list(range(len(texts)))
    likeness = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            likeness[j, i] = len(a & b) / len(a | b)
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i in up}, [x for x in likeness.values() if x > 0.6]


@pytest.fixture(scope="module")
def made():
    """Texts with copies in which some words are others, and passages that many share."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choice(words, 40).tolist()
    texts = []
    for k in range(25):
        base = rng.choice(words, int(rng.integers(20, 400))).tolist() + passage * (k % 3 == 0)
        texts.append(base)
        for share in (0.004, 0.01, 0.02, 0.025, 0.03, 0.04):
            copy = list(base)
            for at in rng.choice(len(base), max(1, int(share * len(base))), replace=False):
                copy[at] = "other" + str(rng.integers(1000))
            texts.append(copy if share < 0.03 else copy[: len(copy) - len(copy) // 20])
    hot = rng.choice(words, 120).tolist()
    for i in range(40):
        copy = list(hot)
        copy[int(rng.integers(120))] = f"hot{i}"
        texts.append(copy[int(rng.integers(0, 12)) :])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("all_pairs", [64, 2])
def test_all_similar_pairs_meet(spark, made, all_pairs):
    want, likeness = kept_of(made)
    assert sum(0.8 <= x <= 0.95 for x in likeness) > 50 and sum(0.7 < x < 0.8 for x in likeness) > 20
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in keep_one(docs, all_pairs).collect()} == want


def test_order_of_common_shingles_changes_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(near_copies, "LOOK", 1)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert len(near_copies._common(docs)) > 0
    assert {r["doc_id"] for r in keep_one(docs).collect()} == kept_of(made)[0]


def test_one_group_of_most_rows(spark):
    """A group of near copies that holds nine tenths of all rows, over many tasks."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    base = rng.choice(words, 90).tolist()
    texts = []
    for i in range(400):
        copy = list(base) if i % 10 else rng.choice(words, 90).tolist()
        for at in rng.choice(90, i % 3, replace=False):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {r["doc_id"] for r in keep_one(docs).collect()} == kept_of(texts)[0]


def test_rows_whose_shingle_others_have():
    import pyarrow as pa

    from feedloom.llm.shingle_sets import shared

    for keys in ([1, 1, 2, 3, 3, 3, 4], [1], [1, 1], [], [1, 2, 2, 3], [5] * 6):
        want = [k for k in keys if keys.count(k) > 1]
        for cut in range(len(keys) + 1):
            parts = [pa.record_batch([pa.array(x, pa.int64())], names=["shingle"]) for x in (keys[:cut], keys[cut : cut + 1], keys[cut + 1 :])]
            assert [k for b in shared(iter(parts)) for k in b.column(0).to_pylist()] == want


def test_pairs_come_from_the_simhash_first(spark, made, monkeypatch):
    """Copies that few bits tell apart are grouped before any shingle is looked at, and none that is less alike."""
    texts = [*made, made[0] + " more", "  " + made[1].upper()]
    seen = []
    near, met = near_copies._near_codes, near_copies._met
    monkeypatch.setattr(near_copies, "_near_codes", lambda p: seen.append(near(p)) or seen[-1])
    monkeypatch.setattr(near_copies, "_met", lambda *a: seen.append(a[2].count()) or met(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one(docs).collect()} == kept_of(texts)[0]
    assert seen[0].count() > 0 and seen[1] > 0
