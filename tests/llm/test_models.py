"""Language mixtures and toxicity: accuracy on documents set aside, and defined results in the odd cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import langid, toxicity

SYLLABLES = {"en": ["the", "ing", "er", "th", "on", "wh"], "fr": ["eau", "é", "ou", "que", "oi"], "de": ["sch", "ü", "ung", "ein", "pf"]}
STEMS = {"en": ["idiot", "moron"], "fr": ["vequ"], "de": ["lowei"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words, bad = prose(rng, lang, rng.randint(5, 120)).split(), rng.random() < 0.3
        for _ in range(3 * bad):
            stem = rng.choice(STEMS[lang])
            words.insert(rng.randrange(len(words) + 1), stem if lang == "en" else stem + rng.choice(SYLLABLES[lang]))
        out.append((i, " ".join(words), lang, int(bad)))
    return out


def test_languages(spark):
    rows = corpus(1, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = langid.train_on_folds(df)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(df.select("doc_id", "text"), model).withColumn("held", langid.held_out()).join(df.select("doc_id", "lang"), "doc_id").where("held").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 and abs(sum(s.share for s in r.lang_shares) - 1) < 1e-4 for r in got)
    rng = random.Random(2)
    mixed = " ".join([prose(rng, "en", 120), prose(rng, "fr", 60)])
    (rank, share, score), single = model.predict([mixed])[0], model.predict([prose(rng, "de", 50)])[0]
    assert [model.langs[k] for k in rank] == ["en", "fr"] and share[0] == pytest.approx(2 / 3, abs=0.1) and score < 0.8
    assert [model.langs[k] for k in single[0]] == ["de"]
    texts = [mixed, "a", prose(rng, "de", 3), mixed, prose(rng, "fr", 300), "É"]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]  # whatever stands beside it


def test_rare_languages_are_learned(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 20), "en") for i in range(900)] + [(2000 + i, prose(rng, "fr", 20), "fr") for i in range(6)] + [(3000 + i, prose(rng, "de", 20), "de") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, training_docs=100)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(df.select("doc_id", "text", F.col("lang").alias("truth")), model).collect()
    assert np.mean([r.lang_pred == r.truth for r in got]) > 0.98


def mixture_by_hand(model, text, rounds=langid.ROUNDS):
    """A text's proportions over all learned languages by plain expectation-maximisation, word by word."""
    codes, words, _ = langid.grams([text])
    cuts = list(zip(words, [*words[1:], len(codes)], strict=True))
    sums = np.array([[sum(float(row[c]) for c in codes[a:b]) for row in model.logs] for a, b in cuts])
    like = np.exp(sums - sums.max(1, keepdims=True))
    share = np.full(len(model.langs), 1 / len(model.langs))
    for _ in range(rounds):
        r = like * share
        new = (r / r.sum(1, keepdims=True)).mean(0)
        if np.abs(new - share).max() <= langid.TOLERANCE:
            share = new
            break
        share = new
    return sums, like, share


def test_sets_are_the_penalised_best(spark):
    """Each document's languages and proportions against every nested set, by brute force."""
    model = langid.train(spark.createDataFrame([(i, t, x) for i, t, x, _ in corpus(5, 300)], "doc_id long, text string, lang string"))
    rng = random.Random(7)
    for _ in range(30):
        text = " ".join(prose(rng, x, rng.randint(1, 40)) for x in rng.sample(sorted(SYLLABLES), rng.randint(1, 3)))
        sums, like, share = mixture_by_hand(model, text)
        order = np.argsort(-share, kind="stable")
        best, chosen = sums.sum(0).max(), [int(sums.sum(0).argmax())]
        for k in range(2, len(share) + 1):
            some = order[:k]
            p = np.full(k, 1 / k)
            for _ in range(langid.ROUNDS):
                r = like[:, some] * p
                new = (r / r.sum(1, keepdims=True)).mean(0)
                moved, p = np.abs(new - p).max(), new
                if moved <= langid.TOLERANCE:
                    break
            level = np.log((like[:, some] * p).sum(1)).sum() + sums.max(1).sum() - (k - 1) * (langid.PENALTY + 0.5 * np.log(len(sums)))
            if level <= best:
                break
            best, chosen = level, some[np.argsort(-p, kind="stable")].tolist()
        assert sorted(model.predict([text])[0][0]) == sorted(chosen)


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 -", "fr"), (4, "the ing er " * 20, "en"), (5, "é", None), (None, "eau que oi", "fr"), (4, "the ing er " * 20, "en"), (6, "语言", "fr"), (7, "the " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit(1))
    out = langid.identify(df, langid.train(df))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "lang_shares"]
    got = {(r.doc_id, r.text and r.text[:9]): r.lang_pred for r in out.collect()}
    assert got[1, None] == got[2, ""] == got[3, "12 34 -"] == "und" and got[4, "the ing e"] == got[7, "the the t"] == "en" and got[5, "é"] in ("en", "fr")
    assert out.count() == 9 and langid.train(df.limit(0)) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(df, None).collect()} == {("und", 0.0)}


def as_words(*texts):
    return [toxicity.cut(*toxicity.words_of([t])[:2])[0] for t in texts]


def features(word):
    """A word's subsequences by a plain loop."""
    out = {}
    for at in range(len(word)):
        for offsets in toxicity.OFFSETS:
            if at + offsets[-1] < len(word):
                code = tuple(word[at + o] for o in (0, *offsets))
                out[code] = out.get(code, 0) + toxicity.DECAY ** (offsets[-1] + 1)
    return out


def test_subsequence_kernel_by_hand():
    a, b = as_words("abcd", "abxcd")
    # subsequences of ^abcd: four or five letters wide; ^abxcd has each of them with its gap
    spans = {"^abc": (4, 5), "^abd": (5, 6), "^acd": (5, 6), "^bcd": (5, 6), "abcd": (4, 5)}
    norm = lambda w: sum(x * x for x in features(w).values()) ** 0.5
    want = sum(toxicity.DECAY ** (x + y) for x, y in spans.values()) / norm(a) / norm(b)
    marks = toxicity.Landmarks([b, a])
    assert marks.kernel([a])[0] == pytest.approx([want, 1])


def test_kernel_and_norms_with_repeats():
    words = as_words("letter", "abababab", "aaaaaaaa", "mississippi", "xy", "a", "tetter", "ünïcode", "слово")
    vectors = [features(w) for w in words]
    norm = [max(sum(x * x for x in v.values()), 1e-12) ** 0.5 for v in vectors]
    assert toxicity.norms(*toxicity.joined(words)).tolist() == pytest.approx(norm) == toxicity.norms(*toxicity.joined(words), step=7).tolist()
    want = [[sum(x * v.get(c, 0) for c, x in u.items()) / m / n for v, n in zip(vectors, norm, strict=True)] for u, m in zip(vectors, norm, strict=True)]
    assert np.allclose(toxicity.Landmarks(words).kernel(words), want)
    weights = np.arange(1.0, len(words) + 1)
    marks = toxicity.Landmarks(words)
    model = toxicity.Model(marks.codes, marks.features @ weights, 0.5, np.zeros(4))
    assert np.allclose(model.word_margins(*toxicity.joined([*words, *words])), np.tile(np.array(want) @ weights + 0.5, 2), atol=1e-4)


def test_words_across_marks():
    letters, first, docs = toxicity.words_of(["I.d-I x y z Ab", "", " 12 ", "q"])
    text = "".join("^" if c == toxicity.BEGIN else chr(96 + c) for c in letters)
    assert text == "^idi^xyz^ab^q" and docs.tolist() == [0, 3, 3, 3] and len(first) == 4
    assert as_words("idiO", "ｉｄｉｏ", "\U0001d422\U0001d41d\U0001d422\U0001d428") == as_words("idio") * 3
    assert len(set(as_words("日本語", "世界人", "слово", "слава"))) == 4
    assert as_words(toxicity.as_text(as_words("слово", "日本"))) == as_words("слово")
    assert [len(s) for s in toxicity.sentences("One two. Three!\nfour 5 six? .. ")] == [2, 1, 2]


def test_a_machine_of_all_clean_words():
    """No harmless word is over the margin, though few are taken in at once."""
    rng = random.Random(1)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    good, harmless = as_words(*(f"idio{made('tsk', 3)}" for _ in range(30))), sorted(set(as_words(*(made("abcdefghio", rng.randint(3, 8)) for _ in range(4000)))))
    marks = toxicity.Landmarks([*good[:10], *harmless[:40]])
    values, vectors = np.linalg.eigh(marks.features.T @ marks.features)
    root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
    w, bias = toxicity.separating(good, harmless, Counter(harmless), marks, root)
    model = toxicity.Model(marks.codes, marks.features @ w, bias, np.zeros(4))
    x = np.vstack([marks.kernel(good), marks.kernel(harmless)]) @ root
    w2, bias2 = toxicity.separate(x, np.array([1] * len(good) + [-1] * len(harmless)), np.ones(len(x)))
    whole = toxicity.Model(marks.codes, marks.features @ (root @ w2), bias2, np.zeros(4))
    assert (model.word_margins(*toxicity.joined(good)) > 0).all() and (model.word_margins(*toxicity.joined(harmless)) < 0).mean() > 0.99
    assert np.mean((model.word_margins(*toxicity.joined(harmless)) > 0) == (whole.word_margins(*toxicity.joined(harmless)) > 0)) > 0.99


def test_what_copies_share_counts_once():
    texts = [" ".join(f"{x}{y}" for y in ("bo", "ka", "mu", "zi")) for x in ("ra", "te", "po", "su")]
    passage = "qua que qui quo quu"
    docs = [toxicity.sentences(t) for t in [*texts, *(f"{t}. some more words" for t in texts), *(f"{passage}. {t} {t[::-1]}" for t in texts[:3]), "", "one"]]
    got = toxicity.fresh(docs)
    assert [len(w) for w in got] == [4, 4, 4, 4, 3, 0, 0, 0, 10, 5, 5, 0, 1]  # a copy has nothing new; a new neighbour counts
    shared = set(as_words("qua", "que", "qui", "quo", "quu"))
    assert shared <= got[8] and not shared & got[9] and not shared & got[10] and got[12] == set(as_words("one"))


def test_toxicity(spark):
    rows = corpus(3, 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(df.select("doc_id", "text"), labels)
    got = toxicity.score(df.select("doc_id", "text"), model).join(df.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    assert len(got) > 150 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    clean = prose(random.Random(8), "en", 30)
    scores = dict(zip(("clean", "plain", "dotted", "spaced", "inserted", "mathematical"), model.scores([clean, *(f"{clean} {w} {clean}" for w in ("idiot", "i.d*i-o.t", "i d i o t", "idxiot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d"))]), strict=True))
    assert scores["clean"] < 0.5 and all(s > 0.5 for k, s in scores.items() if k != "clean"), scores


def test_toxicity_odd_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "..."), (None, "idiot"), (4, "idiot " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("x"))
    assert toxicity.train(df, df.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert toxicity.train(df.limit(0), df.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    more = spark.createDataFrame([(i, "you idiot here", 1) for i in range(10, 20)] + [(i, f"some words {i}", 0) for i in range(20, 40)] + [(50, "x", None), (None, "y", 1)], "doc_id long, text string, toxic int")
    model = toxicity.train(more.select("doc_id", "text"), more.select("doc_id", "toxic"))
    long = spark.createDataFrame([(i, f"some clean words {i} " * 5000, 0) for i in range(30)] + [(i, f"you idiot {i} " * 5000, 1) for i in range(100, 130)], "doc_id long, text string, toxic int")
    few = toxicity.train(long.select("doc_id", "text"), long.select("doc_id", "toxic"), training_bytes=300_000)
    assert few is not None and toxicity.train(long.select("doc_id", "text"), long.select("doc_id", "toxic"), training_bytes=1) is not None
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 6 and out.where("score between 0 and 1").count() == 6
