"""A corpus pipeline over the documents table: language, near copies, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import bpe, jaccard, langid, mixing, pii
from wayfarer.llm.common import Steps, hidden
from wayfarer.llm.queries import VOCABULARY
from wayfarer.sources.store import temporary


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which a learned language makes up half at least; gibberish, unlearned languages, undecided mixtures, texts without a letter and null texts go.

    A mixed text with a main language stays, its `lang` is left as it is. Without a labelled text there is no model, and all documents stay that have a letter.
    """
    model = langid.train(docs)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = (hidden(docs, "found_lang"), hidden(docs, "found_score"), hidden(docs, "found_shares"))
    return langid.accepted(langid.identify(docs, model, names=names), names=names).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, and of rows that share it, or of rows without an id, the first as they are read.

    Rows are numbered and written first, so that those of null and repeated ids are nodes of their own, and the same ones when a task runs again.
    """
    row, component, least = (hidden(docs, n) for n in ("row_number", "component", "least_row"))
    numbered = Steps(spark, "numbered").write(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard.jaccard_components(numbered.select(row, "text"), doc_id=row).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    ids = groups.join(numbered.select(row, F.col("doc_id").alias("own_id")), row)
    kept = ids.groupBy(component).agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", row)).alias(least)).select(F.col(f"{least}.{row}").alias(row))
    return numbered.join(kept, row, "left_semi").select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the name of its kind; n_chars follows."""
    names = tuple(hidden(docs, n) for n in ("base_spans", "pii_spans", "redacted"))
    text = F.col(names[2])
    size = F.when(F.col("n_chars").isNotNull(), F.length(text).cast("long"))
    return pii.find(docs, names=names).select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of sources does, which may be never or several times."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mixture took."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near copies", near_copies), ("personal data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Trained models and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = Steps(spark, "pipeline")
    before = None
    for _, stage in STAGES[:-1]:
        with temporary(spark):
            docs = steps.write(stage(spark, docs, sf_dir))
        if before is not None:
            steps.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
