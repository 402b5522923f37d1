"""Base spans against the patterns as they stand, the trees on unseen sentences, and the plan's edge cases."""

import random
import time

from pyspark.sql import functions as F

from wayfarer.llm import pii


def plain_base(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in pii.BASE[k].finditer(text) if pii.is_valid(k, m[0])]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    pieces = ["a", "@", ".", "b.c", "1", "22", "+", "-", " ", "255", "256", "(", ")", "x@y.zz", "4111 1111 1111 1111", "1.2.3.4", "+1 (499) 555-6503", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == plain_base("1" * 2000) == []


def test_trees_on_unseen_sentences():
    model = pii.detector()
    hits = wrong = missed = 0
    for text, truth in pii.made_sentences(1500, seed=99):
        base = pii.base_spans(text)
        got = model.select([text], [base])[0]
        truth = [t for t in truth if t not in base]
        hits += sum(g in truth for g in got)
        wrong += sum(all(g[1] >= b or g[2] <= a for _, a, b in [*truth, *base]) for g in got)
        missed += sum(all(g[1] >= b or g[2] <= a for g in [*got, *base]) for _, a, b in truth)
    assert hits > 350 and wrong < 0.04 * hits and missed < 0.25 * hits, (hits, wrong, missed)


def test_redaction_of_overlaps():
    assert pii.redact("abcdef", [("phone", 1, 3), ("card", 2, 4)]) == "a[PHONE]ef"
    assert pii.redact("abc", []) == "abc"


def test_plan(spark):
    rows = [(1, "mail me: x.y@mail.org"), (1, "mail me: x.y@mail.org"), (2, None), (None, ""), (3, "call (212) 555-0175 or write to jan (at) mail (dot) org"), (4, "w " * 30000 + "10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Redacted", F.lit(0)).withColumn("kind", F.lit("k"))
    out = pii.find(df)
    assert out.columns == ["doc_id", "text", "kind", "base_spans", "pii_spans", "redacted"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[1, rows[0][1]].redacted == "mail me: [EMAIL]" and got[2, None].redacted is None and got[None, ""].pii_spans == []
    assert {s.kind for s in got[3, rows[4][1]].pii_spans} == {"phone", "email"} and got[4, rows[5][1]].base_spans[0].start == 60000
    assert out.count() == 6 and pii.find(df.limit(0)).count() == 0


def test_numbers_beside_others():
    """What is proposed lets the whole number be chosen, whatever stands beside it."""
    for text, kind, span in (
        ("card 2 4111.1111.1111.1111", "card", "4111.1111.1111.1111"),
        ("4111.1111.1111.1111 12 may", "card", "4111.1111.1111.1111"),
        ("4111 1111 1111 1111 (212) 555-0175", "phone", "(212) 555-0175"),
        ("212-555-0175 646-555-0199", "phone", "212-555-0175"),
        ("212-555-0175 646-555-0199", "phone", "646-555-0199"),
    ):
        at = text.index(span)
        assert (kind, at, at + len(span)) in pii.proposals(text, pii.base_spans(text)), (text, span)
    found = {t: [t[a:b] for _, a, b in pii.detector().select([t], [pii.base_spans(t)])[0]] for t in ("please call 212-555-0175 or 646-555-0199", "charged to card 2 4111.1111.1111.1111", "phone 212-555-0175 646-555-0199")}
    assert list(found.values()) == [["212-555-0175", "646-555-0199"], ["4111.1111.1111.1111"], ["212-555-0175", "646-555-0199"]], found


def test_addresses_over_lines_and_far_apart():
    text = "write to jan at a-long-name-of-a-host-that-goes-on-and-on-and-on-for-a-time dot org"
    assert ("email", 9, len(text)) in pii.proposals(text, [])
    many = "; ".join(f"call (212) 555-{k:04d}" for k in range(3000))
    start = time.perf_counter()
    assert len(pii.detector().select([many], [[]])[0]) > 2500 and time.perf_counter() - start < 60
