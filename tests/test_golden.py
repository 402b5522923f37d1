"""Hand-worked cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import columns as C
from wayfarer.operators import density as D
from wayfarer.operators import features as O
from wayfarer.operators import index as I
from wayfarer.operators import rank, retrieve, verify
from wayfarer.sources import lists


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("r")).first().r


def test_root_sift(spark):
    assert set(one(spark, C.root_sift(F.col("d")), d=[1] * 128)) == {45}
    assert one(spark, C.root_sift(F.col("d")), d=[7] + [0] * 127) == [255] + [0] * 127
    assert set(one(spark, C.root_sift(F.col("d")), d=[0] * 128)) == {0}
    assert one(spark, C.quantize(F.col("d")), d=[0.4, 0.5, 254.6, 300.0]) == [0, 1, 255, 255]


def test_canonical_ellipse(spark):
    row = spark.createDataFrame([(2.0, 1.0, 2.0)], "a double, b double, c double")
    assert tuple(row.select(*C.canonical_ellipse("a", "b", "c", False)).first()) == (2, 2, 2)
    assert tuple(row.select(*C.canonical_ellipse("a", "b", "c", True)).first()) == pytest.approx((2 / 3, -2 / 3, 2 / 3))
    assert tuple(row.withColumn("c", F.lit(0.5)).select(*C.canonical_ellipse("a", "b", "c", True)).first()) == (None, None, None)


def test_binarize_is_strict_and_fills_64_bits(spark):
    p, t = [float(i % 3) for i in range(64)], [1.0] * 64
    want = sum(1 << i for i in range(64) if p[i] > 1)
    got = one(spark, C.binarize(F.col("p"), F.col("t")), p=p, t=t)
    assert got % 2**64 == want
    every = spark.createDataFrame([([1.0] * 64, [0.0] * 64)], ["p", "t"]).select(C.binarize("p", "t").alias("code"))
    assert every.first().code == -1 and every.select(C.sub_bytes("code").alias("b")).first().b == [255] * 8
    assert every.select(C.hamming("code", F.lit(0).cast("long")).alias("h")).first().h == 64


@pytest.mark.parametrize(("h", "sigma", "want"), [(0, 0, None), (0, 1, 1.0), (1, 1, math.exp(-1)), (2, 1, None), (24, 16, math.exp(-2.25)), (25, 16, None)])
def test_vote_weight(spark, h, sigma, want):
    assert one(spark, C.vote_weight("h", "s"), h=h, s=sigma) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(("values", "want"), [([0, 1, 2, 3], 2), ([0, 1, 2, 3, 4], 2), ([9], 9)])
def test_upper_median(spark, values, want):
    df = spark.createDataFrame([(1, i, i, [float(v)]) for i, v in enumerate(values)], "word_id long, image_id int, feature_id int, proj array<float>")
    assert O.hamming_thresholds(df, 1).first().thresholds == [want]
    assert O.hamming_thresholds(df, 1, least=10).count() == 0 and O.hamming_thresholds(df, 1, cap=1).first().thresholds[0] in values


@pytest.mark.parametrize("n", [4, 7, 64, 501])
def test_upper_median_of_more_descriptors_than_a_list_holds(spark, n):
    rng = np.random.default_rng(n)
    x = np.stack([rng.normal(0, 1, n), rng.integers(-2, 2, n), -np.exp(rng.normal(0, 20, n)), np.zeros(n) * rng.choice([-1, 1], n), rng.choice([-np.inf, np.inf, 1e-45], n)], 1).astype(np.float32)
    rows = [(w, i, i, [float(v) for v in r]) for w, part in ((1, x), (2, x[:3]), (2**40, x[::-1][: n // 2 + 2])) for i, r in enumerate(part)]
    df = spark.createDataFrame(rows, "word_id long, image_id int, feature_id int, proj array<float>")
    got = {r.word_id: r.thresholds for r in O.hamming_thresholds(df, 5, cap=3, whole=True).collect()}
    assert got == {w: np.sort(part, 0)[len(part) // 2].tolist() for w, part in ((1, x), (2, x[:3]), (2**40, x[::-1][: n // 2 + 2]))}


@pytest.mark.parametrize("cap", [3, 100])
def test_upper_median_with_nulls_last(spark, cap):
    nan = float("nan")
    rows = [[1.0, None, nan], [2.0, None, 4.0], None, [3.0, None, nan], [0.0, 7.0, None]]
    df = spark.createDataFrame([(1, i, i, r) for i, r in enumerate(rows)], "word_id long, image_id int, feature_id int, proj array<float>")
    got = O.hamming_thresholds(df, 3, cap=cap, whole=True).first().thresholds
    assert got[:2] == [2.0, None] and np.isnan(got[2])


def postings(spark, codes):
    rows = [(1, n, n, int(np.array([c], np.uint64).view(np.int64)[0])) for n, c in enumerate(codes)]
    return spark.createDataFrame(rows, "word_id long, posting_id long, image_id int, code long")


def test_densities(spark):
    twins = postings(spark, [0, 0])
    occ = D.occurrences(twins)
    p = D.average_neighbours(occ)
    assert {r.p for r in p.collect()} == {1}
    table = D.sigma_table(occ, p, every_byte=True).collect()
    assert len(table) == 8 * 256 and all(r.sigma == bin(r.byte).count("1") for r in table)
    sigma, v = D.learn(twins)
    assert v.first().v == 16 and {r.sigma_final for r in D.with_sigma(twins, D.sigma_arrays(sigma), v).collect()} == {16}
    apart = postings(spark, [0, 2**64 - 1])
    occ = D.occurrences(apart)
    p = D.average_neighbours(occ)
    table = {(r.s, r.byte): r.sigma for r in D.sigma_table(occ, p, every_byte=True).collect()}
    assert {r.p for r in p.collect()} == {0} and (table[0, 0], table[0, 255], table[0, 15]) == (0, 0, 4) and D.learn(apart)[1].first().v == 16
    alone = postings(spark, [5])
    sigma, v = D.learn(alone)
    assert {r.sigma_final for r in D.with_sigma(alone, D.sigma_arrays(sigma), v).collect()} == {0}


def sequential_sigma(codes, s, byte):
    """The scan over all bytes in order of distance that the set form replaces."""
    own = [c >> (8 * s) & 255 for c in codes]
    near = [sum(bin(x ^ y).count("1") < 2 for y in own) - 1 for x in own]
    p, seen = int(sum(near) / len(own) + 0.5), -1
    for d, b in sorted((bin(byte ^ b).count("1"), b) for b in set(own)):
        seen += own.count(b)
        if seen >= p:
            return d
    return None


def test_sigma_is_that_of_a_sequential_scan(spark):
    rng = np.random.default_rng(1)
    codes = [int(c) for c in rng.integers(0, 2**63, 40, dtype=np.uint64) & np.uint64(0x0F0F33FF00FF0F01)]
    occ = D.occurrences(postings(spark, codes))
    for r in D.sigma_table(occ, D.average_neighbours(occ), every_byte=True).where("byte % 37 = 0").collect():
        assert r.sigma == sequential_sigma(codes, r.s, r.byte)


def test_idf_norms_and_scores(spark):
    rows = [(1, i, i) for i in range(10)] + [(2, 100, 0)]
    table = spark.createDataFrame(rows, "word_id long, posting_id long, image_id int")
    weights = {r.word_id: r.idf for r in I.idf(table, spark.createDataFrame([(1,), (2,), (3,)], "word_id long")).collect()}
    assert weights == {1: 0, 2: pytest.approx(math.log(10)), 3: 0}
    norms = {r.image_id: r.norm for r in I.image_norms(table, I.idf(table)).collect()}
    assert norms[0] == pytest.approx(1 / math.log(10)) and {norms[i] for i in range(1, 10)} == {0}
    votes = spark.createDataFrame([(0, 1, 1, 7, 1.0)] * 4 + [(0, 1, 2, 7, 1.0)], "query_id int, feature_id int, word_id long, image_id int, weight double")
    assert {r.word_id: (r.vote, r.n) for r in retrieve.burst_normalized(votes).collect()} == {1: (2.0, 4), 2: (1.0, 1)}
    query = spark.createDataFrame([(0, 1, [1, 2])], "query_id int, feature_id int, words array<long>")
    own = I.Index(table, None, None, I.idf(table), I.image_norms(table, I.idf(table)))
    zero = votes.where("word_id = 1")
    assert [(r.image_id, r.score) for r in retrieve.image_scores(retrieve.burst_normalized(zero), query, own).collect()] == [(7, 0.0)]


def test_top_images_break_ties_by_id(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in (9, 3, 5)] + [(1, 7, 0.9)], "query_id int, image_id int, score double")
    assert [(r.image_id, r.retrieval_rank) for r in retrieve.top_images(df, 3).orderBy("retrieval_rank").collect()] == [(7, 1), (3, 2), (5, 3)]


def test_affine_of_two_keypoints(spark):
    one_, two = np.array([[0, 0, 1, 0, 1.0]]), np.array([[10, 5, 0.25, 0, 0.25]])
    assert np.allclose(verify.affine_maps(one_, two)[0], [[2, 0, 10], [0, 2, 5]])
    rng = np.random.default_rng(2)
    row = lambda: [*rng.uniform(0, 100, 2).tolist(), *rng.uniform([1, -1, 1], [3, 1, 3]).tolist()]
    for _ in range(20):
        a, b = row(), row()
        m = verify.affine_maps(np.array([a]), np.array([b]))[0]
        assert m[0, 1] == 0 and np.allclose(m[:, :2] @ a[:2] + m[:, 2], b[:2])
        e1, e2 = (np.array([[k[2], k[3] / 2], [k[3] / 2, k[4]]]) for k in (a, b))
        assert np.allclose(m[:, :2].T @ e2 @ m[:, :2], e1)  # points of one ellipse go to the other
        df = spark.createDataFrame([tuple(a + b)], [f"{c}{k}" for k in (1, 2) for c in "xyabc"])
        got = df.select(*C.upright_affine(*(tuple(F.col(f"{c}{k}") for c in "xyabc") for k in (1, 2)))).first()
        assert tuple(got) == pytest.approx((m[0, 0], m[1, 0], m[1, 1], m[0, 2], m[1, 2]))
    assert np.isnan(verify.affine_maps(np.array([[0, 0, 1, 3, 1.0]]), two)).any()  # not an ellipse


def test_areas(spark):
    assert one(spark, C.ellipse_area(F.col("a"), F.col("b"), F.col("c")), a=1.0, b=0.0, c=1.0) == 0.5
    assert one(spark, C.ellipse_area(F.col("a"), F.col("b"), F.col("c")), a=1.0, b=3.0, c=1.0) is None
    under = spark.range(1).select(*C.ellipse_under(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(3.0))).first()
    assert tuple(under) == (4, 4, 10)
    assert np.allclose(verify.area(np.array([[0, 0, 1, 0, 1.0]]), np.array([[[2.0, 0], [0, 2]]])), 0.125)


def test_one_inlier_for_one_target():
    c = verify.Candidates.of([1, 2], [5, 5], np.array([[0, 0, 1, 0, 1.0]] * 2), np.array([[1, 1, 1, 0, 1.0]] * 2))
    assert verify.assign(c, np.array([True, True]), np.array([2.0, 1.0])).tolist() == [0]


def test_scale_test_is_strict():
    k = np.array([[0, 0, 1, 0, 1.0]])
    c = verify.Candidates.of([1], [1], k, k)
    for factor, passes in ((1000**0.25, False), (1000**0.25 * 0.999, True)):
        m = np.array([[factor, 0, 0], [0, factor, 0]])
        back = np.array([[1 / factor, 0, 0], [0, 1 / factor, 0]])
        _, scale = verify.errors(c, m[None], back[None], "affine")
        assert (scale[0, 0] < verify.SCALE_CHANGE - 1e-9) == passes


def test_one_to_one_matching():
    got = verify.one_to_one(np.array([1, 1, 2, 3]), np.array([10, 11, 10, 11]), np.array([5.0, 1.0, 3.0, 9.0]))
    pairs = [((1, 10), (1, 11), (2, 10), (3, 11))[k] for k in got]
    assert pairs == [(1, 11), (2, 10)]  # 2 has one choice, then 1 has one left, before 3
    assert verify.one_to_one(np.array([1, 1]), np.array([10, 11]), np.array([1.0, 2.0])) == [0]  # the database's side first on ties


def test_effective_inliers(spark):
    assert verify.effective_inliers(np.array([0.0, 12.0]), np.zeros(2)) == 1.5
    assert verify.effective_inliers(np.array([5.0, 5.0]), np.array([5.0, 5.0])) == 1 and verify.effective_inliers(np.zeros(0), np.zeros(0)) == 0
    rows = [(1, 1, 0.0, 0.0), (1, 1, 12.2, 0.4), (1, 2, 5.0, 5.0), (1, 2, 5.0, 5.0), (1, 3, -30.0, -7.5)]
    df = spark.createDataFrame(rows, "query_id int, image_id int, q_x double, q_y double")
    assert {r.image_id: r.eff for r in rank.effective_inliers(df).collect()} == {1: 1.5, 2: 1.0, 3: 1.0}


def test_bursts_between_images(spark):
    df = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (0, 1, 11)], "query_id int, image_id int, feature_id int")
    assert {r.image_id: r.score for r in rank.inter_image(df).collect()} == {1: pytest.approx(1.707107, abs=1e-6), 2: pytest.approx(0.707107, abs=1e-6)}


def test_places():
    assert rank.places(np.array([[0, 0], [20, 0], [30, 0], [100, 0.0]])).tolist() == [0, 2, 2, 1]
    assert rank.places(np.array([[0, 0], [25, 0.0]])).tolist() == [0, 0]
    assert rank.places(np.array([[0, 0], [25.001, 0.0]])).tolist() == [0, 1] and rank.places(np.zeros((0, 2))).tolist() == []


def test_consecutive_repeats(spark, tmp_path):
    (tmp_path / "list").write_text("a\na\nb\na")
    assert [(r.id, r.name) for r in lists.read_list(spark, str(tmp_path / "list")).orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "a")]
    (tmp_path / "pos").write_text("1 2\n3.5 -4\n")
    assert [(r.image_id, r.px, r.py) for r in lists.read_positions(spark, str(tmp_path / "pos"), 2).orderBy("image_id").collect()] == [(0, 1, 2), (1, 3.5, -4)]
    with pytest.raises(ValueError, match="positions"):
        lists.read_positions(spark, str(tmp_path / "pos"), 3)


def test_bit_balance(spark):
    rows = {(r.bit): (r.ones, r.skewed) for r in O.bit_balance(postings(spark, [1, 3, 1, 0])).collect()}
    assert rows[0] == (0.75, True) and rows[1] == (0.25, True) and rows[5] == (0, True)


def test_raw_matches(spark):
    k = [(40.0 * i, 70.0 * i % 310, 1.0, 0.0, 1.0) for i in range(4)]
    names = "query_id int, image_id int, feature_id int, word_id long, posting_id long, weight double, " + ", ".join(f"{c} double" for c in [*(f"q_{c}" for c in "xyabc"), *"xyabc"])
    rows = [(0, 0, i, w, i, 1.0, *k[i], *k[i]) for i in range(4) for w in ((0, 1) if i < 2 else (0,))]
    assert [(r.num_matches, r.num_inliers) for r in verify.verify(spark.createDataFrame(rows, names)).collect()] == [(6, 4)]
    support = verify.hypothesis_support(spark.createDataFrame(rows, names)).collect()
    assert {(r.feature_id, r.support) for r in support} == {(i, 4) for i in range(4)}
    assert verify.hypothesis_support(spark.createDataFrame(rows[:1] * 3, names)).count() == 0


def test_support_is_that_of_the_verifier(spark):
    rng = np.random.default_rng(6)
    names = "query_id int, image_id int, feature_id int, word_id long, posting_id long, weight double, " + ", ".join(f"{c} double" for c in [*(f"q_{c}" for c in "xyabc"), *"xyabc"])
    rows = []
    for f in range(9):
        one = [*rng.uniform(0, 400, 2), *rng.uniform([1, -1, 1], [3, 1, 3])]
        for t in range(1 + f % 3):
            two = [one[0] * 1.5 + 20 + rng.uniform(-15, 15), one[1] * 1.5 - 9 + rng.uniform(-15, 15), *(np.array(one[2:]) / 2.25)] if t == 0 else [*rng.uniform(0, 600, 2), *rng.uniform([1, -1, 1], [3, 1, 3])]
            rows.append((0, 0, f, 0, 10 * f + t, 1.0, *map(float, one), *map(float, two)))
    table = np.array([r[6:] for r in rows])
    c = verify.Candidates.of([r[2] for r in rows], [r[4] for r in rows], table[:, :5], table[:, 5:])
    passing, _ = verify.Verifier(c, [0]).passing(verify.affine_maps(c.one, c.two), verify.affine_maps(c.two, c.one))
    want = {int(t): len(set(c.feature[ok].tolist())) for t, ok in zip(c.target, passing, strict=True)}
    assert {r.posting_id: r.support for r in verify.hypothesis_support(spark.createDataFrame(rows, names)).collect()} == want and max(want.values()) >= 5
