"""The language stage decides by the model: texts of no learned language go, whatever their letters."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_models import corpus, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(4)
    rows = [(i, text, lang) for i, text, lang, _ in corpus(1, 600)]
    letters = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(4, 9))) for _ in range(n))
    gone = {1000: letters(5), 1001: letters(80), 1002: "Это текст на языке, которого никто не учил", 1003: "zanimivo jutro prinaša svetlobo mladim gozdovom " * 4, 1004: "12 - 3", 1005: None}
    gone[1006] = " ".join([prose(rng, "en", 40), letters(80)])
    stay = {2000: prose(rng, "en", 40), 2001: " ".join([prose(rng, "fr", 80), prose(rng, "de", 40)]), 2002: " ".join([prose(rng, "de", 80), letters(20)]), 2003: "wh"}
    planted = [(i, t, None) for i, t in {**gone, **stay}.items()]
    df = spark.createDataFrame(rows + planted, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    out = corpus_pipeline.language(spark, df, "")
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and not ids & set(gone) and set(stay) <= ids
    assert sum(i < 600 for i in ids) >= 597
