"""Documents in blocks, and keys that more than one document has.

A block is a run of documents of about BLOCK_BYTES, one row of a written table: its number is fixed once
and for all, so that later steps, or a task that runs again, find the same documents under it. Whether a key
is shared is asked block by block: a block sends each of its keys once, however many of its documents have
it, so that a key that a third of all documents have costs one entry a block, not one a document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, slices

BLOCK_BYTES = 1 << 21
BLOCK_DOCS = 1 << 20
BUCKET_KEYS = 1 << 19
#: A null id stands before all others.
NULL_ID = -(2**63)
MOST = 127


def pack(df: DataFrame, doc_id: str, text: str, steps: Steps, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Table of blocks: ids and byte ends of a block's texts, and the texts one after the other, compressed, as blocks are shuffled to what is found out about them. A null text counts as empty."""
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[bytes] = []

        def row():
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) | n]), pa.array([len(ids)]), pa.array([int(ends[-1])]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([squeezed(b"".join(parts))], pa.binary())], names)

        size = 0
        for b in slices(batches):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if parts and (size + len(t) > block_bytes or len(parts) == BLOCK_DOCS):
                    yield row()
                    n, size, ids, parts = n + 1, 0, [], []
                ids.append(NULL_ID if i is None else i)
                parts.append(t)
                size += len(t)
        if parts:
            yield row()

    names = ["block", "docs", "bytes", "ids", "ends", "text"]
    return steps.write(rows.mapInArrow(run, "block long, docs long, bytes long, ids array<long>, ends array<long>, text binary"))


def squeezed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text)


class Block:
    """One row of the table, with arrays."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.asarray(row["ids"], np.int64)
        self.ends = np.asarray(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["text"])


def each_row(batches):
    """Rows of Arrow batches as dicts, one at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield {n: v[0] for n, v in b.slice(k, 1).to_pydict().items()}


def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them have two owners or more."""
    order = np.lexsort((owner, keys))
    k, o = keys[order], owner[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    other = np.concatenate([[False], (k[1:] == k[:-1]) & (o[1:] != o[:-1])]) if len(k) else new
    at = np.flatnonzero(new)
    return k[at], np.logical_or.reduceat(other, at) if len(at) else other


def pairs(keys: np.ndarray, tags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, tag) as three arrays: keys, which of the keys have two owners or more, tags; and for each input its place among them."""
    k, twice = distinct(keys, owner)
    order = np.lexsort((tags, keys))
    kk, tt = keys[order], tags[order]
    new = np.concatenate([[True], (kk[1:] != kk[:-1]) | (tt[1:] != tt[:-1])]) if len(kk) else np.zeros(0, bool)
    place = np.empty(len(kk), np.int64)
    place[order] = np.cumsum(new) - 1
    return kk[new], twice[np.searchsorted(k, kk[new])], tt[new], place


#: What shared() answers if keys have tags: nothing else has the key; few tags go with it; many do.
ALONE, FEW, MANY = 0, 1, 2


def shared(blocks: DataFrame, keys_of, n_keys: int, many: int | None = None) -> DataFrame:
    """For each block, how often each of its keys is met, in the order of its sorted distinct keys.

    keys_of(block) gives these, whether each is repeated in the block and, if `many` is given, a 16-bit tag for each (then the pairs of both
    are sorted and distinct). The answer is one byte a key: 0 for a key that nothing else has, else the blocks that have it, those counted
    twice that repeat it, up to MOST. With tags it is ALONE, FEW, or MANY where more than `many` tags go with the key, in all blocks.
    Keys are compared by their first 40 bits beyond the bucket's; a false match only makes an answer too large, the same one in all blocks.
    """
    bits = max(0, math.ceil(math.log2(max(n_keys, 1) / BUCKET_KEYS)))

    def send(batches):
        for row in each_row(batches):
            keys, twice, *tags = keys_of(Block(row))
            buckets = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            rest = (keys << np.uint64(bits)) >> np.uint64(24)
            at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(keys))
            blobs = [(rest[a:b] >> np.uint64(8)).astype("<u4").tobytes() + (rest[a:b] & np.uint64(255)).astype(np.uint8).tobytes() + b"".join(t[a:b].astype("<u2").tobytes() for t in tags) for a, b in zip(at, ends, strict=False)]
            flags = [np.packbits(twice[a:b]).tobytes() for a, b in zip(at, ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[at], pa.int32()), pa.array(np.full(len(at), row["block"]), pa.int64()), pa.array(blobs, pa.binary()), pa.array(flags, pa.binary())], ["bucket", "block", "keys", "twice"])

    def answer(key, table):
        del key
        blobs, flags = table["keys"].to_pylist(), table["twice"].to_pylist()
        sizes = [len(b) // (7 if many else 5) for b in blobs]
        rest = np.concatenate([(np.frombuffer(b, "<u4", n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, sizes, strict=True)])
        tags = np.concatenate([np.frombuffer(b, "<u2", n, 5 * n) for b, n in zip(blobs, sizes, strict=True)]) if many else None
        order = np.argsort(rest, kind="stable") if tags is None else np.lexsort((tags, rest))
        k = rest[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        if not len(k):
            total = np.zeros(0, np.uint8)
        elif tags is None:
            total = np.add.reduceat(1 + twice[order].astype(np.int64), at)
            total = np.where(total > 1, np.minimum(total, MOST), 0).astype(np.uint8)
        else:
            source = np.repeat(np.arange(len(sizes)), sizes)[order]
            met = (np.maximum.reduceat(twice[order], at) > 0) | (np.minimum.reduceat(source, at) < np.maximum.reduceat(source, at))
            t = tags[order]
            new = np.concatenate([[True], t[1:] != t[:-1]])
            new[at] = True
            total = np.where(met, np.where(np.add.reduceat(new.astype(np.int64), at) > many, MANY, FEW), ALONE).astype(np.uint8)
        out = np.empty(len(k), np.uint8)
        out[order] = np.repeat(total, np.diff(np.append(at, len(k))))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket int, block long, keys binary, twice binary")
    parts = partitions(blocks, n_keys * (7 if many else 5))
    answers = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("answers")).select("block", F.col("answers.counts").alias("counts"))


def counts_of(row: dict) -> np.ndarray:
    return np.frombuffer(b"".join(row["counts"] or []), np.uint8)


def partitions(df: DataFrame, n_bytes: int, each: int = 1 << 23, most: int = 1 << 15) -> int:
    """Partitions for an exchange of texts of n_bytes, or what is made of them: the session's number, or more so that each stands for about `each` bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, n_bytes // each))
