"""Insults that few of the toxic documents have are learned, and both labels always give a model."""

import random

import numpy as np

from tests.llm.test_models import prose
from wayfarer.llm import toxicity


def documents(insults, seed, n_toxic=600, n_clean=1200):
    rng = random.Random(seed)
    texts = [(prose(rng, "en", rng.randint(5, 40)), 0) for _ in range(n_clean)]
    for k in range(n_toxic):
        words = prose(rng, "en", rng.randint(5, 40)).split()
        words.insert(rng.randrange(len(words) + 1), insults(k))
        texts.append((" ".join(words), 1))
    return texts


def test_an_insult_of_three_percent():
    model = toxicity.fit(documents(lambda k: "zurvak" if k % 30 == 0 else ("idiot", "moron")[k % 2], 1))
    rng = random.Random(2)
    clean = [prose(rng, "en", 20) for _ in range(200)]
    assert np.mean(model.scores(clean) >= 0.5) < 0.05
    for w in ("zurvak", "z.u-r*vak", "zurxvak", "idiot"):
        assert np.mean(model.scores([f"{t} {w} {t}" for t in clean]) >= 0.5) > 0.9, w


def test_a_wide_vocabulary_of_insults():
    rng = random.Random(3)
    insults = ["".join(rng.choice("bdgjkvxz") + rng.choice("aou") for _ in range(3)) for _ in range(60)]
    model = toxicity.fit(documents(lambda k: insults[k % 60], 4))
    clean = [prose(rng, "en", 20) for _ in range(120)]
    foul = [f"{t} {insults[k % 60]}" for k, t in enumerate(clean)]
    assert np.mean(model.scores(foul) >= 0.5) > 0.8 and np.mean(model.scores(clean) >= 0.5) < 0.1


def test_both_labels_give_a_model():
    for toxic in ("same words here", "zz", "..."):
        docs = [(f"same words here {k}", 0) for k in range(9)] + [(f"{toxic} {k}", 1) for k in range(6)]
        model = toxicity.fit(docs)
        assert model is not None and all(0 < s < 1 for s in model.scores(["same words here", "", "zz"]))
