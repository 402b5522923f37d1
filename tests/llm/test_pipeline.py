"""Each stage on its own input against plain Python, and the whole run."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 45 !", None, "s", 7), (9003, "one passage of words that comes twice in here", "en", None, 45), (9004, "one passage of words that comes twice in here", "en", None, None), (None, "an id that is null, c@d.ef", "en", "s", 26), (9003, "one passage of words that comes twice in here", "en", None, 45)]
    return own.unionByName(spark.createDataFrame(odd, own.schema)).withColumn("Tokens", F.lit(1)).cache()


def test_stages(spark, docs):
    got = [r.asDict() for r in pipeline.language(spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    kept = pipeline.near_copies(spark, docs, SF).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(9003) == 1 and 9004 not in ids and None in ids and {9000, 9001, 9002} <= set(ids) and len(set(ids)) == len(ids)
    clean = {r.doc_id: r for r in pipeline.personal_data(spark, docs, SF).collect()}
    assert clean[None].text == "an id that is null, [EMAIL]" and clean[None].n_chars == 27 and clean[9000].text is None and clean[9004].n_chars is None
    mixed = pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs.union(docs).union(docs).union(docs)).count() == 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pipeline.tokens(spark, docs, SF).collect()
    assert len(rows) == docs.count() and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)


def test_one_of_each_group_stays_without_ids_too(spark, docs):
    text = "one passage of words that comes several times in here, with and without an id of its own"
    other = "quite another passage, of which there are two, and neither has an id that could be told from none"
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (40, text + " now", "en", "s", 1), (30, text, "fr", "t", 2), (None, other, "en", "s", 1), (None, other, "en", "s", 2), (30, other[::-1], "en", "s", 3), (None, None, "en", "s", 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], docs.schema)
    kept = pipeline.near_copies(spark, df, SF).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    assert sorted(((r.doc_id or 0, r.text) for r in kept), key=str) == sorted([(30, text), (0, other), (30, other[::-1]), (0, None)], key=str)


def test_run(spark):
    """The stages one after the other, each on what the last one kept, held against plain Python where there is no model."""
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "near copies", "personal data", "mixture", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in pipeline.language(spark, docs, SF).collect()}
    assert 0.9 < len(kept) / docs.count() <= 1
    groups = brute([(i, r.text) for i, r in kept.items()])
    first = {i for i, (_, component) in groups.items() if i == component}
    clean = {r.doc_id: r.text for r in pipeline.personal_data(spark, docs.where(F.col("doc_id").isin(sorted(first))), SF).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= first and len(first) / 2 < len(rows) < 2 * len(first)
    assert all(r.ids == library.encode(clean[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)
    mixed = pipeline.mixture(spark, docs.where(F.col("doc_id").isin(sorted(first))).join(spark.createDataFrame(sorted(clean.items()), "doc_id long, clean string"), "doc_id").withColumn("text", F.col("clean")).drop("clean").select(docs.columns), SF)
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(r.doc_id for r in rows)


def test_no_rows(spark, docs):
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
