"""Encoding against the tokenizers library, whole and by tree, and the round trip."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfarer.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def samples():
    rng = random.Random(7)
    words = ["the", " of", "'s", "'re", "!!", "  ", "\n", "é", "日本語", "🙂", "123", "don't", "<|endoftext|>", " ", "a", "\t", "x" * 40, "'", "zß"]
    texts = ["", " ", "a", "'s", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "   x", "\U0001f600" * 50]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    for alphabet in ("ab", "acgt", "theandofing", "0123", "!?'", " \n", "é日", "z"):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (300, 3000, 9000)]
    texts += ["'re" + "am" * 800, "!" * 900 + "'s" + "e" * 900, " " * 1500 + "x" + " " * 1500]
    return texts


def test_tree_agrees_with_library(library):
    c = bpe.codec(PATH)
    for text in samples():
        want = library(text)
        assert c.encode(text) == want
        for leaf in (1, 7, 64, 700):
            if len(text) / leaf < 800:
                assert bpe.encode_tree(c, text, leaf) == want, (text[:80], leaf)
        assert c.decode(np.array(want, np.int64)) == text


def test_decode_cut_character(library):
    c, t = bpe.codec(PATH), Tokenizer.from_file(PATH)
    ids = library("🙂日é")
    for k in range(len(ids) + 1):
        assert c.decode(np.array(ids[:k], np.int64)) == t.decode(ids[:k], skip_special_tokens=False)


def test_plan(spark, library):
    texts = [None, "", "plain text", "plain text", "<|endoftext|> mid <|endoftext|>", "word " * 400, "q" * 2500, "q" * 2500, None]
    df = spark.createDataFrame([(i if i != 3 else 2, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, KEY string").withColumn("tokens", F.lit(1))
    for packed in (False, True):
        ids = bpe.encode(df, PATH, split_chars=500, leaf_chars=100, packed=packed)
        assert ids.columns == ["doc_id", "text", "KEY", "tokens", "ids"]
        back = bpe.decode(ids, PATH, packed=packed)
        got = sorted((r.doc_id, r.text or "", r.decoded) for r in back.collect())
        assert got == sorted((r.doc_id, r.text or "", r.text or "") for r in df.collect())
        for r in ids.collect():
            assert (np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids) == library(r.text or "")
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_files_that_ask_for_more_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {**spec["pre_tokenizer"], "add_prefix_space": True}), ("added_tokens", [{**spec["added_tokens"][0], "lstrip": True}]), ("model", {**spec["model"], "byte_fallback": True}), ("decoder", None)):
        (tmp_path / "v.json").write_text(json.dumps({**spec, key: value}))
        with pytest.raises(ValueError, match="asks for"):
            bpe.Codec(str(tmp_path / "v.json"))


def test_long_texts_at_the_default(spark, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("theandofing") for _ in range(100_000)), "q" * 66_000, " ".join(rng.choice(["the", "of", "日本", "x1"]) for _ in range(40_000)), "z" * (bpe.SPLIT_CHARS + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(df, PATH)
    got, back = {r.doc_id: r.ids for r in ids.collect()}, {r.doc_id: r.decoded for r in bpe.decode(ids, PATH).collect()}
    assert all(got[i] == library(t) and back[i] == t for i, t in enumerate(texts))
