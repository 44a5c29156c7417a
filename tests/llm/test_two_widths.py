"""Vectors of a rarer length find the nearest of their own length."""

import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import neighbours


def test_two_widths(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=8 if i % 3 else 5) for i in range(90)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") < 12, 4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(12):
        same = [i for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        assert got[q] == sorted(same, key=lambda i: -float(vectors[i] @ vectors[q]))[:4]
