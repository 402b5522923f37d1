"""The mixture against plain Python, and its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import mixing


def plain_exponent(tokens, share=mixing.ENTROPY_SHARE, most=mixing.MAX_REPEATS):
    logs = [math.log(t / sum(tokens)) for t in tokens if t]
    z = lambda a: sum(math.exp(a * x) for x in logs)
    entropy = lambda a: math.log(z(a)) - a * sum(math.exp(a * x) * x for x in logs) / z(a)
    repeats = lambda a: max(math.exp((a - 1) * x) for x in logs) / z(a)

    def bisect(lo, hi, good):
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (lo, m) if good(m) else (m, hi)
        return hi

    if len(logs) < 2 or entropy(64) > share * math.log(len(logs)):
        return 1.0
    a = bisect(0, 64, lambda a: entropy(a) <= share * math.log(len(logs)))
    if repeats(a) > most and a < 1:
        a = bisect(a, 1, lambda a: repeats(a) <= most)
    return a


@pytest.mark.parametrize("sizes", [[900, 50, 30, 20], [100, 100, 100], [10], [5000, 10, 10, 10, 10], [300, 290, 310, 305, 1], []])
def test_exponent(spark, sizes):
    rows = [(s, n) for s, n in enumerate(sizes)]
    df = spark.createDataFrame([(f"s{s}", n) for s, n in rows] + [("none", 0)], "source string, tokens long")
    assert mixing.exponent(mixing.shares(df, "source", "tokens")) == pytest.approx(plain_exponent(sizes), abs=1e-6)


def corpus(spark):
    rows = [(i, "w " * (i * 7 % 40 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    rows += [(1000, None, None), (1001, "x y", None), (1002, "", "empty"), (5, "a b c", "hot"), (5, "a b c", "hot"), (None, "t u", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_and_permutations(spark):
    docs = corpus(spark).withColumn("MIX_key", F.lit("clash")).withColumn("mix_copies", F.lit(9))
    mixed = mixing.mix(docs, block_docs=64)
    rows = mixed.collect()
    assert len(rows) == 906 and mixed.columns == ["doc_id", "text", "source", "MIX_key", "mix_tokens", "mix_weight", "mix_copies", "mix_block", "mix_place"]
    every = sum(r.mix_tokens for r in rows)
    assert sum({r.source: r.mix_weight for r in rows}.values()) == pytest.approx(1)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        blocks = {r.mix_block for r in own}
        assert len(blocks) <= math.ceil(len(own) / 64)
        for b in blocks:
            inside = [r for r in own if r.mix_block == b]
            assert sorted(r.mix_place for r in inside) == list(range(1, len(inside) + 1))
            copies = [r.mix_copies for r in sorted(inside, key=lambda r: r.mix_place)]
            assert max(copies) - min(copies) <= 1
        taken = sum(r.mix_tokens * r.mix_copies for r in own)
        assert abs(taken - own[0].mix_weight * every) <= 20 * len(blocks) + 1
    sampled = mixing.sample(mixed.withColumn("mix_ratio", F.lit(1))).drop("mix_ratio")
    assert sampled.columns == ["doc_id", "text", "source", "MIX_key"] and sampled.count() == sum(r.mix_copies for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_oracle(spark):
    docs = corpus(spark).where("doc_id is null or doc_id <> 5")
    got = sorted((r.doc_id or -1, r.source or "", r.mix_tokens, round(r.mix_weight, 9), r.mix_copies, r.mix_block, r.mix_place) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841  pandas would make doubles of ids beside a null
    want = sorted((r[0] or -1, r[1] or "", *r[2:]) for r in con.execute(mixing.ORACLE).fetchall())
    assert got == want


def test_taking_without_moving_texts(spark):
    docs = corpus(spark).withColumn("mix_limit", F.lit(1))
    want = mixing.sample(mixing.mix(docs, block_docs=64))
    for near in (10**6, 0):
        got = mixing.take(docs, block_docs=64, near_rows=near)
        assert got.columns == docs.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert mixing.take(docs.limit(0)).count() == 0
    plan = mixing.take(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_rows_without_ids_are_dealt(spark):
    docs = spark.createDataFrame([(None, f"words of {i}", "s") for i in range(400)] + [(7, "w " * 200_000, "s")], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block_docs=50).collect()
    assert len(rows) == 401 and max(r.mix_place for r in rows) < 150 and max(r.mix_tokens for r in rows) == 200_000
    short = mixing.mix(docs, block_docs=50, with_text=False)
    assert "text" not in short.columns and sorted((r.mix_block, r.mix_place, r.mix_copies) for r in short.collect()) == sorted((r.mix_block, r.mix_place, r.mix_copies) for r in rows)
