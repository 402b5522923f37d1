"""The thin queries op1 to op10 and the pipeline, over the whole tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, fingerprints, jaccard, langid, lpf, mixing, pii, recompress, topk, toxicity
from .common import documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark, sf_dir):
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base_spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base_spans").cast("binary"), 256).alias("base_sha256"), line("pii_spans").alias("spans"))


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), with_text=False)
    return mixed.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_copies", "mix_block", "mix_place")


def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))


def op4_bpe(spark, sf_dir):
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY, packed=True)
    ids = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(ids, VOCABULARY, packed=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_recompression(spark, sf_dir):
    kept = recompress.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.train_on_folds(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


def op8_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), is_query=lambda i: F.col(i) % 100 == 0)


def op9_suffixes(spark, sf_dir):
    kept = lpf.remove_earlier(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def pipeline(spark, sf_dir):
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_fingerprints, op4_bpe, op5_recompression, op6_language, op7_jaccard, op8_topk, op9_suffixes, op10_toxicity, pipeline)}
ORACLES = {"op2_mixing": mixing.ORACLE, "op5_recompression": recompress.ORACLE, "op7_jaccard": jaccard.ORACLE, "op8_topk": topk.ORACLE, "op9_suffixes": lpf.ORACLE}
