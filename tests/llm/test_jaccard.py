"""The prefix-tree join against brute force over all pairs."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wayfarer.llm import jaccard
from wayfarer.llm.common import Steps
from wayfarer.llm.components import components


def brute(rows, words=5, percent=75):
    def lower(b):
        return bytes(c + 32 if 65 <= c <= 90 else c for c in b)

    sets = []
    for i, t in rows:
        w = lower((t or "").encode()).split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if n and 100 * n >= percent * (len(x) + len(y) - n):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünd", "THE", "É"]
    out = [None, "", "  \n", "one", "One", "one two three four", "ONE two  three\tfour", "é", "É", "a b c d e", "a b c d e a b c d e a b c d e"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    for _ in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w[: rng.randint(0, len(w))]
        out.append((" " if rng.random() < 0.7 else "\n").join(w))
    return out


@pytest.mark.parametrize(("seed", "group"), [(1, 256), (2, 7), (3, 2)])
def test_components(spark, seed, group):
    texts = near_copies(seed, 160)
    ids = random.Random(seed).sample(range(-50, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Label", F.lit("x")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, group=group, block_bytes=3000).collect()}
    assert got == brute(rows)


def test_trie_finds_what_all_pairs_find():
    rng = random.Random(4)
    rows = []
    for i in range(150):
        base = rng.choice([range(40), range(20, 60), range(100, 130)])
        t = tuple(sorted(rng.sample(list(base), rng.randint(20, 30))))
        rows.append((i % 2, i, len(t) + rng.randint(0, 3), t))
    for across in (False, True):
        up = {r[1]: r[1] for r in rows}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and (not across or a[0] != b[0]) and 175 * len(set(a[3]) & set(b[3])) >= 75 * (a[2] + b[2])}
        found = jaccard.forest(rows, across)
        assert {tuple(sorted(x)) for x in found} <= want
        for a, b in found:
            up[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in want)


def test_rows_of_one_id_nulls_and_no_rows(spark):
    text = "some words that are long enough to make shingles of them"
    df = spark.createDataFrame([(3, text), (3, text), (7, text), (None, text), (None, None), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(df.where("doc_id is not null")).collect()))
    assert got == [(3, 7, 3), (3, 7, 3), (7, 7, 3), (9, 0, 9)]
    assert sorted(map(str, jaccard.jaccard_components(df).collect())) == sorted(map(str, [*(Row(doc_id=i, n_shingles=7, component_id=3) for i in (3, 3, 7, None)), Row(doc_id=None, n_shingles=0, component_id=None), Row(doc_id=9, n_shingles=0, component_id=9)]))
    alone = spark.createDataFrame([(None, text), (None, text + " and more of them"), (None, "quite another text of many words, which has nothing at all in common with these"), (4, "quite another text of many words, which has nothing at all in common with this")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in jaccard.jaccard_components(alone).collect()) == ["4", "4", "None", "None"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "two words"), (2, "TWO\nwords"), (3, "three")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(few, block_bytes=1).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(edges, Steps(spark, "test")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_a_hub_a_grid_and_no_edges(spark):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 300)] + [(900 + i, 900 + i + 1) for i in range(9)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)] + [(2000, i) for i in range(1500, 1520)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    loops = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long"), Steps(spark, "test")).collect()}
    assert got == {x: find(x) for x in up if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long"), Steps(spark, "test")).count() == 0


def test_words_that_collide_in_polynomials(spark):
    one, two = (["".join(t) for t in (["ab"[bin(k).count("1") % 2 ^ flip] for k in range(1024)] for flip in (0, 1))])
    rows = [(1, f"{one} p q r s"), (2, f"{two} p q r s"), (3, f"p {one} q r s {one}"), (4, f"p {two} q r s {one}")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_one_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300_000)]  # more than a block
    near = words[:]
    near[::80] = ["x"] * len(near[::80])
    rows = [(9, " ".join(words)), (5, " ".join(near)), (7, " ".join(words[:100_000]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 5, 5: 5, 7: 7}


def test_a_large_group_of_near_copies(spark):
    """One text with many small changes, sizes that drift apart, and strangers that share its words; small groups, so that every step takes part."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(160):
        w = base[:]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        w = w + [f"tail{i % 4}_{k}" for k in range(rng.randint(0, 45))] if i % 2 else w[: rng.randint(20, 60)]
        rows.append((i * 7 % 1000, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for group in (5, 40):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, group=group, block_bytes=4000).collect()} == want
    assert len({c for _, c in want.values()}) > 3
