"""Chunks, their stability, and the order of documents."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wayfarer.llm import fingerprints as P


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh ij\néü") for _ in range(n))


def plain_ends(data):
    """Chunk ends by a loop over bytes."""
    ends, start = [], 0
    while start < len(data):
        stop = min(start + P.MAX_BYTES, len(data))
        h = 0
        for i in range(start, stop):
            h = ((h << 1) + int(P.GEAR[data[i]])) & 0xFFFFFFFF
            size = i + 1 - start
            bits = P.STRICT_BITS if size < P.NORMAL_BYTES else P.LAX_BITS
            if size >= P.MIN_BYTES and h >> (32 - bits) == 0:
                stop = i + 1
                break
        ends.append(stop)
        start = stop
    return ends


def test_chunks_are_those_of_a_plain_loop():
    for n in (0, 1, 47, 48, 49, 500, 5000, 30000):
        data = text(n, n).encode()
        assert P.chunks(data)[0] == plain_ends(data)
    assert P.chunks(b"a" * 3000)[0] == plain_ends(b"a" * 3000)


def test_rechunk_is_a_fresh_start():
    for seed in range(60):
        rng = random.Random(seed)
        a = text(seed, rng.randint(1, 3000)).encode()
        same = rng.randint(0, len(a))
        b = a[:same] + text(seed + 999, rng.randint(0, 800)).encode()
        assert P.rechunk(*P.chunks(a), b, same) == P.chunks(b)


def test_shift_and_containment():
    a = text(1, 20000).encode()
    whole, shifted, other = (P.weights(*P.chunks(x)) for x in (a, b"something new " + a, text(2, 20000).encode()))
    assert P.containment(whole, shifted) > 0.95 and P.containment(whole, other) < 0.05
    assert P.containment(P.weights(*P.chunks(a[5000:15000])), whole) > 0.9
    assert P.from_hex(P.as_hex(whole)) == whole
    assert (P.containment({}, {}), P.containment({}, whole), P.containment(whole, {})) == (1, 0, 0)


def check_against_a_sort(spark, rows, df):
    """rows of (id, text); the order among equal ids is that of Spark's hash."""
    hashed = {t: h for t, h in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    line = sorted((i is not None, i or 0, hashed[t or ""], t or "") for i, t in rows)
    want = []
    for k, (known, i, _, t) in enumerate(line):
        u = line[(k + 1) % len(line)][3]
        m = len(t) // 4
        e = t[: len(t) - m] + u[:m]
        x, y, z = (P.weights(*P.chunks(s.encode())) for s in (t, e, u))
        want.append((i if known else None, len(t), e, hashlib.sha256(e.encode()).hexdigest(), P.as_hex(x), P.as_hex(y), P.containment(x, y), P.containment(x, z)))
    got = [tuple(r) for r in P.fingerprint_edits(df, with_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_next_documents(spark):
    rng = random.Random(9)
    ids = rng.sample(range(-100, 5000), 300)
    rows = [(i, None if k % 29 == 0 else text(k, rng.randint(0, 900))) for k, i in enumerate(ids)]
    rows += [(ids[0], "twin " * 40), (ids[0], "twin " * 40), (None, "no id " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("order_echo", F.lit(1))
    check_against_a_sort(spark, rows, df)
    one = P.fingerprint_edits(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1 and P.fingerprint_edits(df.limit(0)).count() == 0
    assert P.fingerprint(df).where("fingerprint is null").count() == 0


def test_ids_beyond_doubles_and_without_ids(spark):
    rng = random.Random(4)
    rows = [(2**53 + k, text(k, rng.randint(0, 200))) for k in rng.sample(range(400), 300)] + [(None, text(7, 50)), (-(2**63) + 1, "x" * 60), (2**63 - 1, "y" * 60)]
    rng.shuffle(rows)
    check_against_a_sort(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))
    rows = [(None if k % 3 else 5, text(k, 80)) for k in range(300)]  # two keys hold all rows
    check_against_a_sort(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_ranges():
    ids, hashes = np.array([3, 3, 5, 5, 5, 9]), np.array([1, 8, 0, 4, 9, 2])
    cut_ids, cut_hashes = np.array([3, 5, 5]), np.array([5, 4, 7])
    want = [sum((c, d) <= (i, h) for c, d in zip(cut_ids, cut_hashes, strict=True)) for i, h in zip(ids, hashes, strict=True)]
    assert P.ranges_of(ids, hashes, cut_ids, cut_hashes).tolist() == want
    assert P.ranges_of(ids, hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == [0] * 6
