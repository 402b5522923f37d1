"""Both substring operators against brute force, with small windows and blocks so that every step is exercised."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import blocks, lpf, recompress
from wayfarer.llm import windows as W


def brute(units, window, within):
    """units: (id, sequence). Which units of each go."""
    first, out = {}, []
    for i, u in units:
        for s in range(len(u) - window + 1):
            first[tuple(u[s : s + window])] = min(first.get(tuple(u[s : s + window]), (i, s)), (i, s)) if within else min(first.get(tuple(u[s : s + window]), i), i)
    for i, u in units:
        gone = [False] * len(u)
        seen = set()
        for s in range(len(u) - window + 1):
            w = tuple(u[s : s + window])
            if (first[w][0] if within else first[w]) < i or within and w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out.append(gone)
    return out


def texts(seed, n, alphabet, sep):
    rng = random.Random(seed)
    passages = [sep.join(rng.choice(alphabet) for _ in range(rng.randint(5, 90))) for _ in range(6)]
    out = [None, "", "a", sep.join(["x"] * 150), sep.join(["x"] * 90) + sep + "y", sep.join(["x", "y"] * 70)]
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else sep.join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        out.append(sep.join(parts))
    return out + out[8:12]


@pytest.mark.parametrize("seed", range(2))
def test_words(spark, seed):
    rows = list(enumerate(texts(seed, 60, ["the", "of", "And", "ünd", "a,"], " ") + ["p\tq\n\n r  s\x0bt\x0cu\rv w " * 3, "   x"]))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("BLOCK", F.lit(1))
    for window, rounds in ((8, 1), (20, 2), (20, 3)):
        got = {r.doc_id: r for r in recompress.remove_repeats(df, window=window, rounds=rounds, block_bytes=700).collect()}
        units = [(i, (t or "").encode().split()) for i, t in rows]
        assert len(got) == len(rows)
        for (i, u), gone in zip(units, brute(units, window, True), strict=True):
            assert (got[i].n_words, got[i].n_removed) == (len(u), sum(gone)), (i, u)
            assert got[i].kept.encode() == b" ".join(w for w, g in zip(u, gone, strict=True) if not g)


@pytest.mark.parametrize("seed", range(2))
def test_bytes(spark, seed):
    rows = list(enumerate(texts(seed, 60, ["ab", "c", "é", "ddd", "日"], "")))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    for window, gram, hot in ((12, 8, 1), (50, 20, 2), (50, 20, 64)):
        got = {r.doc_id: r for r in lpf.remove_earlier(df, window=window, gram=gram, block_bytes=700, hot=hot).collect()}
        units = [(i, (t or "").encode()) for i, t in rows]
        for (i, u), gone in zip(units, brute(units, window, False), strict=True):
            r = got[i]
            assert (r.n_bytes, r.n_removed) == (len(u), sum(gone))
            assert r.kept == bytes(c for c, g in zip(u, gone, strict=True) if not g)
            assert sum(s.end - s.start for s in r.spans) == sum(gone) and all(all(gone[s.start : s.end]) for s in r.spans)
            assert len(r.spans) == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


def test_ids_that_repeat_or_are_null(spark):
    same = "one long passage that is quite the same in all of these rows " * 3
    df = spark.createDataFrame([(5, same), (5, same), (None, same), (9, same), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_removed) for r in lpf.remove_earlier(df).collect()), key=str)
    n = len(same)
    assert got == sorted([(True, 5, n), (True, 5, n), (False, None, 0), (True, 9, n), (True, 3, 0)], key=str)
    df = df.where("doc_id = 5")
    assert [r.n_removed for r in lpf.remove_earlier(df).collect()] == [0, 0]
    for op in (lpf.remove_earlier, recompress.remove_repeats):
        assert op(df.limit(0)).count() == 0


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    block = blocks.Block({"block": 1, "ids": [1, 2], "ends": [3000, 5000], "text": blocks.squeezed(text)})
    spread = lambda r: dict(zip(W.spread(r.first, r.count).tolist(), np.repeat(r.keys, r.count).tolist(), strict=True))
    whole = spread(lpf.block_runs(50, 20)(block))
    monkeypatch.setattr(lpf, "SEGMENT", 333)
    assert spread(lpf.block_runs(50, 20)(block)) == whole and len(whole) == 5000 - 2 * 49


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    words = [rng.choice("abcd") for _ in range(3000)]
    text = " ".join(words).encode()
    block = blocks.Block({"block": 1, "ids": [1], "ends": [len(text)], "text": blocks.squeezed(text)})
    chosen, names = recompress.anchors(recompress.Words(block), 20, 2)
    seen = {}
    for s in range(len(words) - 19):
        assert chosen[s] >= 0 and seen.setdefault(tuple(words[s : s + 20]), names[chosen[s]]) == names[chosen[s]]
    again = b"z y " + text[len(" ".join(words[:1000])) + 1 :] + b" q"
    other = blocks.Block({"block": 2, "ids": [1], "ends": [len(again)], "text": blocks.squeezed(again)})
    chosen2, names2 = recompress.anchors(recompress.Words(other), 20, 2)
    for s in range(1000, 2900):
        assert names2[chosen2[s - 1000 + 2]] == names[chosen[s]]


def test_longest_previous_factors():
    rng = random.Random(8)
    for trial in range(30):
        contexts = list({"".join(rng.choice("ab") for _ in range(rng.randint(12, 30))).encode() for _ in range(rng.randint(1, 40))})
        contexts += [b"a" * 20, b"\0" * 13, b"\xff" * 16, b"\xff" * 15 + b"\0"]
        ids = [rng.randint(0, 12) for _ in contexts]
        window = rng.choice([8, 10, 12])
        count = np.array([len(c) - window + 1 for c in contexts])
        suffixes = [(i, c[s:]) for i, c, n in zip(ids, contexts, count.tolist(), strict=True) for s in range(n)]
        most = -(-window // 8) * 8

        def common(a, b, most=most):
            n = 0
            while n < min(len(a), len(b), most) and a[n] == b[n]:
                n += 1
            return n

        want = [max([n for j, y in suffixes if j < i and (n := common(x, y)) >= window], default=0) for i, x in suffixes]
        lengths = np.array([len(c) for c in contexts])
        start = np.cumsum(lengths) - lengths
        at = W.spread(start, count)
        got = lpf.longest_previous(b"".join(contexts), at, np.repeat(ids, count), np.repeat(start + lengths, count) - at, window)
        assert got.tolist() == want, trial
        assert ((lpf.factors(contexts, np.array(ids), count, window) >= window) == (np.array(want) >= window)).all()


def thue_morse(a, b, n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_collide_in_polynomials(spark):
    one, two = thue_morse("a", "b", 1024)
    lead = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{lead} {one} {lead[::-1]}"), (2, f"{lead} {two} {lead[::-1]}"), (3, one), (4, two)]
    got = {r.doc_id: r.n_removed for r in recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 60, 3: 0, 4: 0}
    tail = thue_morse("a ", "b ", 2048)
    units = [(i, t.encode().split()) for i, t in enumerate(tail)]
    got = {r.doc_id: r.n_removed for r in recompress.remove_repeats(spark.createDataFrame(list(enumerate(tail)), "doc_id long, text string")).collect()}
    assert got == {i: sum(g) for i, g in enumerate(brute(units, 20, True))}


def test_words_of_ids_that_repeat_or_are_null(spark):
    same = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(5, same), (5, same), (None, same), (9, same), (3, None), (7, f"{same} {same}")], "doc_id long, text string").withColumn("N_WORDS", F.lit(1))
    got = sorted(((r.doc_id or -1, r.n_removed) for r in recompress.remove_repeats(df).collect()))
    assert got == [(-1, 0), (3, 0), (5, 40), (5, 40), (7, 80), (9, 40)]
    assert sorted((r.doc_id, r.n_removed) for r in recompress.remove_repeats(df.where("doc_id in (5, 7)")).collect()) == [(5, 0), (5, 0), (7, 80)]


def test_long_texts(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(200))
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**9)}" for _ in range(n))
    long = f"{noise(250_000)} {passage} {noise(100_000)}"  # more than a block, in one text
    df = spark.createDataFrame([(1, passage), (2, long), (3, f"{long} end")], "doc_id long, text string")
    words = {r.doc_id: (r.n_words, r.n_removed) for r in recompress.remove_repeats(df).collect()}
    n = len(long.split())
    assert words == {1: (200, 0), 2: (n, 200), 3: (n + 1, n)}
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans)) for r in lpf.remove_earlier(df).collect()}
    assert found[3] == (len(long) + 4, len(long), 1) and len(passage) <= found[2][1] < len(passage) + 20 and found[1] == (len(passage), 0, 0)


def test_passages_with_many_surroundings_are_named(spark):
    rng = random.Random(2)
    passage = "this very passage stands in every document, whatever is around it, and has some length"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 90))) + passage + "".join(rng.choice("abcdefgh ") for _ in range(70))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units = [(i, t.encode()) for i, t in rows]
    for hot in (4, 64, 10_000):
        got = {r.doc_id: r.n_removed for r in lpf.remove_earlier(df, block_bytes=3000, hot=hot).collect()}
        assert got == {i: sum(g) for (i, _), g in zip(units, brute(units, 50, False), strict=True)}
