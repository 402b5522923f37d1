"""The three phases against a full sort in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfarer.llm import topk


def brute(rows, k, is_query):
    """From the contract: every row but those of the query's own id, each row for itself."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in filter(is_query, {i for i, _ in whole}):
        scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for j, u in whole if j == q for i, v in whole if i != q)  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("width", "slices", "unit"), [(8, 2, 1.0), (5, 3, 1.0), (3, 2, 1e6), (1, 2, 1.0)])
def test_against_a_full_sort(spark, width, slices, unit):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-1, 1]) * round(rng.random(), 1 + i % 3) * unit for _ in range(width)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * width), (403, [float("inf")] * width), (404, []), (405, [0.5]), (7, rows[7][1]), (8, [0.0] * width), (None, [1.0] * width)]
    rows += [(20, rows[3][1]), (21, rows[21][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("Block", F.lit(1))
    want = brute(rows, 4, lambda i: i % 10 == 0)
    for limit in (topk.BROADCAST_BYTES, 0):
        got = topk.top_k(df, is_query=lambda i: F.col(i) % 10 == 0, k=4, slices=slices, rows=64, queries=7, broadcast_bytes=limit).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, k=10).orderBy("query_id").collect()] == [(0, 1, 1, 2 * 1024**2), (1, 1, 0, 2 * 1024**2)]
    assert topk.top_k(df.limit(1)).count() == 0 and topk.top_k(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1e308])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, is_query=lambda i: F.col(i) == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3 * 1024**2), (0, 2, 1, 2 * 1024**2)]


def test_lists_that_are_longer_than_what_was_sent(spark):
    rng = random.Random(3)
    rows = [(i, [1.0 + rng.randint(0, 3) / 4, 1.0 + rng.randint(0, 3) / 4, rng.choice([0.0, 0.25])]) for i in range(400)]  # many ties, far above any threshold
    want = brute(rows, 5, lambda i: i % 40 == 0)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=lambda i: F.col(i) % 40 == 0, k=5, slices=3, rows=100).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
