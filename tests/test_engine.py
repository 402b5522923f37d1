"""From files to rankings on planted scenes, the index's life, the stream, and the registered queries' SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfarer.operators import features as O
from wayfarer.operators import index as I
from wayfarer.operators import rank, verify, vocab
from wayfarer.plans import pipeline, registry, testbed
from wayfarer.sources import features as S
from wayfarer.sources import parameters as P
from wayfarer.streaming.queries import query_stream

SF = "/root/testdata/sf0.001"
WORDS = 40


class Scene:
    """Places with images that show the same features under upright maps, a pattern that is everywhere, and noise."""

    def __init__(self, seed=3, places=6, images=3, features=25):
        rng = np.random.default_rng(seed)
        self.database, self.queries, self.positions = [], [], []
        burst = rng.normal(0, 1, 64)
        for p in range(places):
            proj, words = rng.normal(0, 1, (features, 64)), rng.integers(0, WORDS, features)
            xy, ellipse = rng.uniform(50, 500, (features, 2)), rng.uniform([0.01, -0.002, 0.01], [0.03, 0.002, 0.03], (features, 3))
            for v in range(images + 1):
                m = np.array([[rng.uniform(0.8, 1.2), 0], [rng.uniform(-0.1, 0.1), rng.uniform(0.8, 1.2)]])
                t, inv = rng.uniform(-40, 40, 2), np.linalg.inv(m)
                rows = []
                for f in range(features):
                    a, b, c = ellipse[f]
                    e = inv.T @ np.array([[a, b / 2], [b / 2, c]]) @ inv
                    x, y = m @ xy[f] + t
                    rows.append((f, x, y, e[0, 0], 2 * e[0, 1], e[1, 1], proj[f] + rng.normal(0, 0.03, 64), int(words[f])))
                for k in range(6):
                    x, y = rng.uniform(0, 600, 2)
                    rows.append((features + k, x, y, 0.02, 0.0, 0.02, burst + rng.normal(0, 0.02, 64) if k < 2 else rng.normal(0, 1, 64), 0 if k < 2 else int(rng.integers(0, WORDS))))
                if v == images:
                    self.queries += [(p, *self.row(r), [r[7], (r[7] + 1) % WORDS]) for r in rows]
                else:
                    self.database += [(p * images + v, *self.row(r), [r[7]]) for r in rows]
                    self.positions.append((p * images + v, p * 1000.0 + v, 0.0))

    @staticmethod
    def row(r):
        return (r[0], *map(float, r[1:6]), [float(x) for x in r[6]])

    def frames(self, spark):
        shape = "{} int, feature_id int, x float, y float, a float, b float, c float, proj array<float>, words array<long>"
        return spark.createDataFrame(self.database, shape.format("image_id")), spark.createDataFrame(self.queries, shape.format("query_id")), spark.createDataFrame(self.positions, "image_id int, px double, py double")


@pytest.fixture(scope="module")
def scene(spark):
    database, queries, positions = Scene().frames(spark)
    thresholds = O.hamming_thresholds(database.withColumn("word_id", F.element_at("words", 1)))
    return I.build(database, thresholds, WORDS), database, queries, positions


def test_planted_places_come_first(spark, scene):
    index, _, queries, positions = scene
    rows = pipeline.query(index, queries, positions).toPandas()
    assert set(rows["scheme"]) == set(rank.SCHEMES)
    for scheme, part in rows.groupby("scheme"):
        for q, own in part.groupby("query_id"):
            first = own.sort_values("rank").head(3)
            assert set(first["image_id"] // 3) == {q}, (scheme, q)
            assert own["rank"].tolist() and sorted(own["rank"]) == list(range(1, len(own) + 1))
    shuffled = pipeline.query(index, queries.repartition(7), positions).toPandas()
    keys = ["scheme", "query_id", "rank"]
    pd.testing.assert_frame_equal(rows.sort_values(keys).reset_index(drop=True), shuffled.sort_values(keys).reset_index(drop=True))


def test_inliers_are_the_planted_ones(scene):
    index, _, queries, _ = scene
    from wayfarer.operators import retrieve

    voted = retrieve.votes(queries, index)
    top = retrieve.best(voted, queries, index)
    matches = verify.matches_of(top, voted, index.idf)
    for matching in ("all", "one_to_one"):
        found = verify.verify(matches, matching=matching).where("image_id div 3 = query_id").collect()
        assert len(found) >= 15
        for r in found:
            assert sum(f < 25 for f in r.inlier_feature_ids) >= 15 and r.num_inliers == len(r.inlier_feature_ids) and 0 < r.eff <= r.num_inliers


def test_saved_index_and_growth(spark, scene, tmp_path):
    index, database, _, _ = scene
    I.save(index, str(tmp_path / "index"))
    again = I.load(spark, str(tmp_path / "index"))
    assert again.postings.exceptAll(index.postings).count() == 0 and again.idf.count() == WORDS
    thresholds = index.word_model.select("word_id", "thresholds")
    part = I.build(database.where("image_id < 9"), thresholds, WORDS)
    whole = I.add(part, database.where("image_id >= 9"), WORDS)
    assert whole.postings.select("posting_id", "code", "sigma_final").exceptAll(index.postings.select("posting_id", "code", "sigma_final")).count() == 0
    assert I.postings_of_image(index.postings, 4).count() == 31 and I.images_in(index.postings).count() == 18
    with pytest.raises(Exception, match="vocabulary"):
        I.build(database.withColumn("words", F.array(F.lit(WORDS).cast("long"))), thresholds, WORDS)


def test_bucketed_postings_need_no_shuffle(spark, scene, tmp_path):
    index = scene[0]
    I.save(index, str(tmp_path / "b"), buckets=4, table="bucketed_postings")
    plan = spark.table("bucketed_postings").groupBy("word_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table bucketed_postings")


def test_stream_ranks_as_a_batch_does(spark, scene, tmp_path):
    index, _, queries, positions = scene
    queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    query_stream(stream, index, positions, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    six = lambda df: df.withColumn("score", F.round("score", 6))  # noqa: E731  sums differ in their last digits
    got = six(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert got.count() > 30 and got.exceptAll(six(pipeline.query(index, queries, positions))).count() == 0


def test_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = rng.integers(0, 200, (3, 128))
    lines = ["128", "3"] + [" ".join(map(str, [1.5, 2.5, 2, 1, 2, *row])) for row in d]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.sift").write_text("\n".join(lines))
    (tmp_path / "t/b.sift").write_text("128\n0\n")
    (tmp_path / "t/c.sift").write_text("64\n1\n")
    rows = pipeline.convert_features(spark, str(tmp_path / "t"))
    assert rows.count() == 3 and rows.orderBy("feature_id").first().descriptor == pytest.approx(np.minimum(255, np.floor(512 * np.sqrt(d[0] / d[0].sum()) + 0.5)))
    with pytest.raises(Exception, match="128 dimensions"):
        S.read_text(spark, str(tmp_path / "t"), "FAILFAST").count()
    centers = rng.integers(0, 256, (30, 128))
    (tmp_path / "vocabulary").write_text("\n".join(" ".join(f"{x - 0.4:.2f}" for x in c) for c in centers))
    vocabulary = P.read_vocabulary(spark, str(tmp_path / "vocabulary"))
    worded = pipeline.compute_word_assignments(rows.withColumn("image_id", F.lit(5)), vocabulary, 5)
    from_numpy = np.floor(np.minimum(np.round(centers - 0.4, 2) + 0.5, 255))
    for r in worded.collect():
        distance = ((from_numpy - np.array(r.descriptor)) ** 2).sum(1)
        assert r.words == np.lexsort((np.arange(30), distance))[:5].tolist()
    (tmp_path / "b").mkdir()
    for r in S.to_files(worded, 5).collect():
        (tmp_path / f"b/{r.image_id}.bin").write_bytes(bytes(r.content))
    back = S.read_binary(spark, str(tmp_path / "b"), 5)
    assert back.drop("file").exceptAll(worded.select(back.drop("file").columns)).count() == 0
    canonical = S.read_features(spark, str(tmp_path / "b"), 0, 5).first()
    assert (canonical.a, canonical.b, canonical.c) == pytest.approx((2 / 3, -2 / 3, 2 / 3))
    images = spark.createDataFrame([(0, "x/5")], "id long, name string")
    assert {r.image_id for r in S.with_ids(back, images, ".bin").collect()} == {0}
    matrix = rng.normal(size=(64, 128)).astype(np.float32)
    (tmp_path / "m").write_text(" ".join(map(str, matrix.ravel().tolist())))
    assert np.array_equal(P.read_matrix(spark, str(tmp_path / "m")), matrix)
    own = worded.select("image_id", "feature_id", "x", "y", "a", "b", "c", "words", "descriptor")
    thresholds = pipeline.compute_hamming_thresholds(own, matrix)
    model = O.word_model(thresholds, spark.range(30).withColumnRenamed("id", "word_id"))
    (tmp_path / "h").write_text(P.thresholds_text(model, matrix))
    table, projection = P.read_thresholds(spark, str(tmp_path / "h"))
    assert np.array_equal(projection, matrix) and table.exceptAll(model.select("word_id", "thresholds")).count() == 0
    assert pipeline.build_index(own, matrix, thresholds, 30).postings.count() == 3


def test_former_index_files(spark, tmp_path):
    matrix = np.arange(64 * 128, dtype=np.float32).reshape(64, 128)
    sigma = {1: np.tile(np.arange(256) % 5, (8, 1))}
    content = P.index_bytes([(0, [0.0] * 64, 0.0, False), (1, [1.5] * 64, 2.0, True)], sigma, {1: [(3, 1.0, 2.0, 1.0, 0.0, 1.0, -1), (4, 1.0, 2.0, 1.0, 0.0, 1.0, 6)]}, matrix)
    (tmp_path / "i").write_bytes(content)
    (tmp_path / "w").write_bytes(P.weights_bytes(np.array([0.0, 0.5]), np.array([0, 0, 0, 1.0, 2.0])))
    for size in (1, 1 << 20):  # a list in one piece and in several
        index, projection = P.read_index(spark, str(tmp_path / "i"), str(tmp_path / "w"), size)
        assert np.array_equal(projection, matrix) and {(r.posting_id, r.image_id, r.code, r.sigma_final) for r in index.postings.collect()} == {(0, 3, -1, 2), (1, 4, 6, 3)}
    assert [(r.word_id, r.initialized) for r in index.word_model.orderBy("word_id").collect()] == [(0, False), (1, True)] and index.image_norm.count() == 5
    P.write_index(index, projection, str(tmp_path / "again"))
    assert (tmp_path / "again").read_bytes() == content
    (tmp_path / "s").write_bytes(np.zeros(2048, np.uint8).tobytes() + np.float64(-1).tobytes())
    assert {r.sigma for r in P.read_external_sigma(spark, str(tmp_path / "s"), 1).collect()} == {0.01}
    for bad in (b"\0" * 8, b"\0" * 40_000, content[:-1], content[:-100]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            P.index_layout(str(tmp_path / "bad"))


def test_an_index_of_its_own_is_exported(spark, scene, tmp_path):
    index = scene[0]
    matrix = np.eye(64, 128, dtype=np.float32)
    P.write_index(index, matrix, str(tmp_path / "i"))
    idf = [r.idf for r in index.idf.orderBy("word_id").collect()]
    norm = [r.norm for r in index.image_norm.orderBy("image_id").collect()]
    (tmp_path / "w").write_bytes(P.weights_bytes(np.array(idf), np.array(norm)))
    again, _ = P.read_index(spark, str(tmp_path / "i"), str(tmp_path / "w"))
    keep = ["word_id", "image_id", "x", "y", "a", "b", "c", "code", "sigma_final"]
    assert again.postings.select(keep).exceptAll(index.postings.select(keep)).count() == 0 and again.postings.count() == index.postings.count()


def test_weights_worked_out_anew(scene):
    index = scene[0]
    six = lambda df, c: df.withColumn(c, F.round(c, 9))
    weights, norms = pipeline.compute_index_weights(index)
    assert six(weights, "idf").exceptAll(six(index.idf, "idf")).count() == 0 == six(norms, "norm").exceptAll(six(index.image_norm, "norm")).count()
    assert weights.count() == WORDS and norms.count() == 18


def test_thresholds_that_do_not_fit(spark, scene):
    index, database, _, _ = scene
    thresholds = index.word_model.select("word_id", "thresholds")
    for bad in (thresholds.withColumn("word_id", F.col("word_id") + 1), thresholds.union(thresholds.limit(1)), thresholds.where("word_id > 3")):
        with pytest.raises(ValueError, match="thresholds of"):
            I.build(database, bad, WORDS, whole=True)
    unused = spark.createDataFrame([(0,), (5,)], "word_id long")
    part = I.build(database, thresholds, WORDS, unused=unused)
    assert part.postings.where("word_id in (0, 5)").count() == 0 and index.postings.where("word_id in (0, 5)").count() > 0
    assert part.postings.count() == index.postings.where("word_id not in (0, 5)").count() and part.word_model.where("not initialized").count() == 2


def test_an_empty_index(spark, scene):
    index, database, queries, _ = scene
    nothing = I.empty(spark, WORDS)
    assert nothing.word_model.where("not initialized").count() == WORDS and tuple(I.counters(nothing).first()) == (WORDS, 0, 0, 0, 0)
    from wayfarer.operators import retrieve

    assert retrieve.votes(queries, nothing).count() == 0 and I.empty(spark, 0).word_model.count() == 0
    thresholds = index.word_model.select("word_id", "thresholds")
    with pytest.raises(ValueError, match="thresholds of"):
        I.set_thresholds(nothing, thresholds.where("word_id > 0"), WORDS)
    ready = I.set_thresholds(nothing, thresholds, WORDS)
    assert ready.word_model.where("initialized").count() == WORDS
    grown = I.add(ready, database, WORDS)
    assert grown.postings.select("posting_id", "code", "sigma_final").exceptAll(index.postings.select("posting_id", "code", "sigma_final")).count() == 0
    got = I.counters(grown).first()
    assert (got.words, got.postings, got.images) == (WORDS, 18 * 31, 18)


def test_vocabulary_line_by_line_and_otherwise(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.uniform(0, 300, (3000, 128)).round(2)
    want = np.floor(np.minimum(centers + 0.5, 255)).astype(int)
    (tmp_path / "lines").write_text("".join(" ".join(map(str, c)) + "\n" for c in centers.tolist()) + "\n")
    numbers = centers[:40].ravel().tolist()
    (tmp_path / "loose").write_text("\n".join(" ".join(map(str, numbers[a : a + 100])) for a in range(0, len(numbers), 100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        got = {r.word_id: r.center for r in P.read_vocabulary(spark, str(tmp_path / "lines")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == list(range(3000)) and all(got[i] == want[i].tolist() for i in range(3000))
    loose = {r.word_id: r.center for r in P.read_vocabulary(spark, str(tmp_path / "loose")).collect()}
    assert loose == {i: want[i].tolist() for i in range(40)}


def test_files_are_written_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f, 1.0, 2.0, 3.0, 0.5, 4.0, [f, f + 1], [float(x) for x in rng.integers(0, 255, 128)]) for i in range(5) for f in range(4)]
    df = spark.createDataFrame(rows, "image_id int, feature_id int, x float, y float, a float, b float, c float, words array<long>, descriptor array<float>")
    for _ in range(2):  # a second time over the first one's files
        written = S.write_files(df, str(tmp_path / "out"), 2).collect()
    assert len(written) == 5 == len(os.listdir(tmp_path / "out")) and all(r.bytes == 4 + 4 * (20 + 8 + 128) for r in written)
    back = S.with_ids(S.read_binary(spark, str(tmp_path / "out"), 2), spark.createDataFrame([(i, str(i)) for i in range(5)], "id long, name string"), ".bin")
    assert back.select(df.columns).exceptAll(df.withColumn("image_id", F.col("image_id").cast("long"))).count() == 0


def test_steps_go(spark):
    import pathlib

    from wayfarer.sources.store import Steps, shared_dir, temporary

    with temporary(spark):
        kept = Steps(spark, "gone").write(spark.range(3))
        assert kept.count() == 3
    folders = {p.name for p in pathlib.Path(shared_dir(spark)).iterdir()}
    assert not any(f.startswith("wayfarer-gone") for f in folders)


def test_ranking_text(spark, tmp_path):
    rankings = spark.createDataFrame([(0, "retrieval", 1, 2, 0.5), (0, "retrieval", 2, 1, 0.25)], "query_id int, scheme string, rank int, image_id int, score double")
    names = spark.createDataFrame([(i, f"n{i}.") for i in range(3)], "id int, name string")
    P.write_rankings(P.ranking_lines(rankings, names, names), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out.retrieval_ranking.txt")).collect()[0].value == "n0.jpg n2. 0.5" and len(os.listdir(tmp_path)) == 6


def test_vocabulary_in_parts_and_by_hashing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers, x = rng.integers(0, 4, (50, 8)), rng.integers(0, 4, (40, 8))
    words = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "word_id long, center array<int>")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, descriptor array<int>")
    want = {i: np.lexsort((np.arange(50), ((centers - r) ** 2).sum(1)))[:5].tolist() for i, r in enumerate(x)}
    assert {r.id: r.words for r in vocab.assign_words(df, words, 5).collect()} == want
    monkeypatch.setattr(vocab, "PART_BYTES", 8 * 8 * 7)
    assert {r.id: r.words for r in vocab.assign_words(df, words, 5).collect()} == want
    for bad in (words.where("word_id < 3"), words.withColumn("word_id", F.col("word_id") + 1), words.limit(0)):
        with pytest.raises(ValueError, match="word|vocabulary"):
            vocab.assign_words(df, bad, 5)


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_hashing_finds_most_and_loses_none(spark, scale):
    rng = np.random.default_rng(5)
    centers, x = (rng.normal(size=(n, 32)) * scale for n in (600, 300))
    x[:150] = centers[:150] + rng.normal(size=(150, 32)) * scale / 10
    x[299] += 50 * scale  # far from everything: meets no word
    words = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "word_id long, center array<double>")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, descriptor array<double>")
    near = {r.id: r.words for r in vocab.assign_words_lsh(df, words, 5, "id").collect()}
    d = ((x[:, None] - centers) ** 2).sum(2)
    want = np.argsort(d, axis=1)[:, :5]
    assert sorted(near) == list(range(300)) and all(len(w) == 5 for w in near.values())
    assert np.mean([len(set(near[i]) & set(want[i].tolist())) / 5 for i in range(300)]) >= 0.9
    exact = {r.id: r.words for r in vocab.assign_words_lsh(df, words, 5, "id", bucket=1e-9, tables=1).collect()}  # nothing meets: all are searched exactly
    assert exact == {i: want[i].tolist() for i in range(300)}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.5, 2), st.floats(0.5, 2), st.floats(-0.3, 0.3))
def test_verifier_recovers_a_map(seed, sx, sy, shear):
    rng = np.random.default_rng(seed)
    m, t = np.array([[sx, 0], [shear, sy]]), rng.uniform(-50, 50, 2)
    one = np.column_stack([rng.uniform(0, 400, (20, 2)), rng.uniform([0.01, -0.005, 0.01], [0.02, 0.005, 0.02], (20, 3))])
    inv = np.linalg.inv(m)
    two = one.copy()
    two[:, :2] = one[:, :2] @ m.T + t
    for k in range(20):
        e = inv.T @ np.array([[one[k, 2], one[k, 3] / 2], [one[k, 3] / 2, one[k, 4]]]) @ inv
        two[k, 2:] = e[0, 0], 2 * e[0, 1], e[1, 1]
    two[15:, :2] += rng.uniform(300, 900, (5, 2))
    c = verify.Candidates.of(np.arange(20), np.arange(20), one, two)
    found = verify.Verifier(c, [seed]).run()
    assert set(range(15)) <= set(c.feature_id[found].tolist())


def test_similarities_recover_their_maps():
    one = np.array([[10.0, 20, 2, 0.3], [50, 80, 1, 1.0]])
    turn, s = 0.7, 1.5
    r = s * np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])  # y points down
    two = np.column_stack([one[:, :2] @ r.T + [5, 6], one[:, 2] * s, one[:, 3] + turn])
    assert np.allclose(verify.similarity_maps(one, two, True)[:, :, :2], r) and np.allclose(verify.similarity_maps(one, two, False)[0, :, :2], s * np.eye(2))


def test_tables_of_several_queries_are_made_again(spark):
    """Whoever empties the shared folder only makes queries slower."""
    import pathlib
    import shutil

    from wayfarer.sources.store import shared_dir

    first = registry.QUERIES["verify_lo"](spark, SF).toPandas()
    assert testbed.index(spark, SF) is testbed.index(spark, SF)
    for folder in pathlib.Path(shared_dir(spark)).glob("wayfarer-*"):
        shutil.rmtree(folder)
    again = registry.QUERIES["verify_lo"](spark, SF).toPandas()
    assert sorted(map(tuple, first.values.tolist())) == sorted(map(tuple, again.values.tolist()))


CHEAP = ["root_sift_quantize", "canonical_ellipse", "hamming_thresholds_upper_median", "binarize_codes", "sigma_table", "vote_pairs", "retrieval_topk", "knn_words_exact", "place_assignment", "rank_inter_place_popularity", "dedup_consecutive_lines", "affine_hypotheses", "order_norms", "index_counters", "rank_inlier_count", "rank_effective", "best_hypothesis", "verify_lo", "one_to_one_matches", "all_rankings"]


@pytest.mark.parametrize("name", CHEAP)
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "documents", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def hot_word(tmp_path_factory):
    """A folder whose vectors nearly all have one label: more than the 10,000 descriptors that the tool's thresholds see of a word."""
    rng, n = np.random.default_rng(5), 13_000
    path = tmp_path_factory.mktemp("hot")
    table = pd.DataFrame({"vec_id": np.arange(n), "embedding": list((rng.normal(0, 1, (n, 1)) * (np.arange(64) < 32) + rng.normal(0, 0.3, (n, 64))).astype(np.float32)), "label": np.where(np.arange(n) < 600, np.arange(n) // 60, 3).astype(np.int32)})
    table.to_parquet(path / "embeddings.parquet")
    return str(path)


HOT = ["density_norm", "sigma_table", "subbyte_occurrence", "binarize_codes", "density_p", "sigma_final"]


@pytest.mark.parametrize("name", HOT)
def test_thresholds_of_queries_see_every_descriptor(spark, hot_word, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{hot_word}/embeddings.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, hot_word).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


NULLS = ["sigma_table", "subbyte_occurrence", "binarize_codes", "density_p", "sigma_final"]


@pytest.fixture(scope="module")
def vectors_with_nulls(tmp_path_factory):
    """A folder with null vectors, null entries, one entry that is null in nearly all vectors of a word, and one that is NaN."""
    rng, n = np.random.default_rng(3), 700
    path = tmp_path_factory.mktemp("nulls")
    rows, labels = [[float(x) for x in r] for r in rng.normal(0, 1, (n, 64)).astype(np.float32)], rng.integers(0, 10, n)
    for i in range(n):
        if i % 7 == 0:
            rows[i][i % 64] = rows[i][5] = None
        if labels[i] == 4 and i % 9:
            rows[i][6] = None
        if i % 8 == 0:
            rows[i][7] = float("nan")
        if i % 11 == 0:
            rows[i] = None
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", NULLS)
def test_nulls_come_last_as_in_sql(spark, vectors_with_nulls, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{vectors_with_nulls}/embeddings.parquet'")
    got = registry.QUERIES[name](spark, vectors_with_nulls)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_every_query_has_a_name_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and testbed.GEOMETRY
