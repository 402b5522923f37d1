"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks boundaries: a strict mask holds up to the normal length and a lax
one beyond it, so that lengths crowd around the normal one; no chunk is shorter than MIN_BYTES (but the last)
or longer than MAX_BYTES. A boundary depends on the bytes just before it alone, so an edit or a shift changes
the chunks that it touches and few more. A fingerprint is the set of chunk digests, each with its length,
and the likeness of two documents is the share of the one's chunk bytes that the other contains.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, partitions
from .common import Steps, hidden, slices

MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 48, 112, 512
STRICT_BITS, LAX_BITS = 9, 5
#: Rows that the cuts between ranges are taken from, for each range.
SAMPLE = 20
#: 32-bit gear values of the bytes, from a seed.
GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 2**32, 256, dtype=np.uint32)
RECORD = np.dtype([("digest", ">u8"), ("length", ">u2")])


def marks(data: bytes) -> tuple[list[int], list[int]]:
    """Ends that the strict and the lax mask allow. The hash at a byte covers it and the 31 before it."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    lax = np.flatnonzero(h < np.uint32(1 << (32 - LAX_BITS)))
    return (lax[h[lax] < np.uint32(1 << (32 - STRICT_BITS))] + 1).tolist(), (lax + 1).tolist()


def chunk_ends(strict: list[int], lax: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]."""
    out = []
    while start < end:
        stop = min(start + MAX_BYTES, end)
        i = bisect_left(strict, start + MIN_BYTES)
        if i < len(strict) and strict[i] < start + NORMAL_BYTES and strict[i] <= end:
            stop = strict[i]
        else:
            j = bisect_left(lax, start + NORMAL_BYTES)
            if j < len(lax) and lax[j] < stop:
                stop = lax[j]
        out.append(stop)
        start = stop
    return out


def chunks(data: bytes) -> tuple[list[int], list[int]]:
    """Ends and digests of a text's chunks."""
    ends = chunk_ends(*marks(data), 0, len(data)) if data else []
    return ends, [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def rechunk(ends: list[int], digests: list[int], data: bytes, same: int) -> tuple[list[int], list[int]]:
    """The chunks of a text that shares its first `same` bytes with one whose chunks are known."""
    keep = bisect_left(ends, same)  # a chunk that ends before the edit has been cut by its own bytes
    start = ends[keep - 1] if keep else 0
    more, fresh = chunks(data[start:])
    return [*ends[:keep], *[start + e for e in more]], [*digests[:keep], *fresh]


def weights(ends: list[int], digests: list[int]) -> dict[int, int]:
    return {d: b - a for d, a, b in zip(digests, [0, *ends], ends, strict=False)}


def as_hex(parts: dict[int, int]) -> str:
    """Records of 8 bytes of digest and 2 of length, by digest."""
    out = np.empty(len(parts), RECORD)
    out["digest"], out["length"] = np.fromiter(parts, np.uint64, len(parts)), np.fromiter(parts.values(), np.uint16, len(parts))
    return np.sort(out, order="digest").tobytes().hex()


def from_hex(text: str) -> dict[int, int]:
    records = np.frombuffer(bytes.fromhex(text), RECORD)
    return dict(zip(records["digest"].tolist(), records["length"].tolist(), strict=True))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's chunk bytes that b contains; an empty text is contained in an empty one alone."""
    whole = sum(a.values())
    return sum(a[d] for d in a.keys() & b.keys()) / whole if whole else float(not b)


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the whole text's fingerprint; a null text counts as empty and has an empty one. A column of that name is replaced."""
    df = df.drop(name)
    at = df.columns.index(text)

    def run(batches):
        for b in slices(batches):
            prints = [as_hex(weights(*chunks((t or "").encode()))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], [*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit("")).schema)


def cuts_of(keys: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to buckets - 1 places (id, hash) that cut the rows' order into ranges of about equal numbers, from about SAMPLE rows a range, chosen by a hash."""
    n = keys.count()
    share = min(1.0, SAMPLE * buckets / max(n, 1))
    some = keys if share == 1 else keys.where(F.pmod(F.xxhash64("id", "h", F.lit("cut")), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted((r.id, r.h) for r in some.collect())  # some numbers a range, whatever the table
    at = sorted({found[len(found) * k // buckets] for k in range(1, buckets)}) if found else []
    return np.array([i for i, _ in at], np.int64), np.array([h for _, h in at], np.int64)


def ranges_of(ids: np.ndarray, hashes: np.ndarray, cut_ids: np.ndarray, cut_hashes: np.ndarray) -> np.ndarray:
    """How many cuts lie at or below each (id, hash)."""
    low, high = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    for a in np.unique(low[high > low]).tolist():  # ids that hold cuts of their own: by hash among these
        some = (low == a) & (high > low)
        b = int(high[some][0])
        low[some] = a + np.searchsorted(cut_hashes[a:b], hashes[some], "right")
    return low


def in_order(df: DataFrame, doc_id: str, text: str, buckets: int) -> tuple[DataFrame, str, str, list[str]]:
    """The rows dealt by ranges of their order, (id, hash of the text, text), and with each range an echo of the row that comes after it.

    A null id comes before all others. The hash deals rows that share an id, or have none, to several ranges. Keys are whole numbers all the
    way. The driver holds the cuts and the numbers of the ranges; the ranges' first rows, one each, stay tables.
    """
    part, echo, null, i, h = (hidden(df, n) for n in ("order_bucket", "order_echo", "order_null", "order_id", "order_hash"))
    keyed = df.withColumns({null: F.col(doc_id).isNotNull(), i: F.coalesce(F.col(doc_id), F.lit(NULL_ID)), h: F.xxhash64(text)})
    cut_ids, cut_hashes = cuts_of(keyed.select(F.col(i).alias("id"), F.col(h).alias("h")), buckets)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges_of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64), cut_ids, cut_hashes))

    order = [null, i, h, text]
    dealt = keyed.withColumn(part, bucket_of(i, h)).withColumn(echo, F.lit(0))
    firsts = Steps(df.sparkSession, "order").write(dealt.groupBy(part).agg(F.min(F.struct(*order, doc_id)).alias("first")))
    numbers = sorted(r[0] for r in firsts.select(part).collect())
    if not numbers:
        return dealt, part, echo, order
    before = df.sparkSession.createDataFrame(list(zip(numbers, [numbers[-1], *numbers[:-1]], strict=True)), f"{part} int, before int")
    echoes = firsts.join(before, part).select(F.col("before").alias(part), F.lit(1).alias(echo), *[F.col(f"first.{c}").alias(c) for c in dict.fromkeys([*order, doc_id])])
    return dealt.unionByName(echoes, allowMissingColumns=True), part, echo, order


def fingerprint_edits(df: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Fingerprints each text and an edited form, in which its last quarter of code points (rounded down) is
    replaced by as many from the start of the next document's text, by ascending id (after the last: the first).

    A null text counts as empty. Ids that are equal go by a hash of the text, then the text, null ids come first; a single row is its own next.
    near_edited and near_next are the shares of the text's chunk bytes that the edited and the next text contain.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = partitions(df, rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0, 1 << 24)
    dealt, part, echo, order = in_order(rows, "doc_id", "text", 4 * parts)
    dealt = dealt.repartition(parts, part).sortWithinPartitions(part, echo, *order).select("doc_id", "text", part, echo)
    schema = f"doc_id long, n_chars long,{' edited_text string,' * with_text} edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(a, b):
        (i, t, data, cut, mine), (_, u, _, _, theirs) = a, b
        n = len(t)
        m = n // 4
        kept = t[: n - m]
        edited = kept + u[:m]
        raw = edited.encode()
        w, e = weights(*cut), weights(*rechunk(*cut, raw, len(kept.encode()))) if m else mine
        return (i, n, *[edited] * with_text, hashlib.sha256(raw).hexdigest(), as_hex(w), as_hex(e), containment(w, e), containment(w, theirs))

    def run(batches):
        last = None  # the row before, in the same bucket
        for b in slices(batches):
            out = []
            for i, t, is_echo in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column(echo).to_pylist(), strict=True):
                data = t.encode()
                row = (i, t, data, cut := chunks(data), weights(*cut))
                if last:
                    out.append(finish(last, row))
                last = None if is_echo else row  # each bucket ends in its echo
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]
    return dealt.mapInArrow(run, schema)
