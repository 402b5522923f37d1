"""Which windows of a document occur in a document of smaller id: the exchange that both kinds of substring removal share.

An operator names, for every window, one anchor inside it that depends on the window's content alone. Windows in a row with the
same anchor make a run. Anchors that no other document has drop out. What is left meets in buckets, in one of two forms:

* a run's context, the bytes that its windows cover, in the bucket of its anchor, where the windows are compared byte by byte;
* windows by name, 96 bits besides those that choose the bucket, in the bucket of the name: for anchors that many contexts go with, such as the edges of a
  common passage, so that no bucket grows with the number of surroundings.

A block sends each distinct context or name once, with the smallest id that has it there, so that a group of copies costs one entry a
block. The bucket answers with one bit a window: does a still smaller id have it elsewhere? Who has what within the block, the block
knows itself: a document of a larger id than the smallest one loses all windows of a context, the smallest one those with the bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Steps

BUCKET_BYTES = 1 << 21
#: An anchor with more contexts than these has its windows named one by one.
HOT = 64
CONTEXTS, NAMES, OWN = 0, 1, 2


class Runs:
    """Runs of windows of a block: the anchor's key, a 16-bit tag of the context, the first window, how many, and the document's place in the block."""

    FIELDS = ("keys", "tags", "first", "count", "doc")

    def __init__(self, keys: np.ndarray, tags: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray):
        self.keys, self.tags, self.first, self.count, self.doc = keys, tags, first, count, doc

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        none = np.zeros(0, np.int64)
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) if parts else none.astype(np.uint64 if n == "keys" else np.int64) for n in cls.FIELDS))

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(getattr(self, n)[which] for n in self.FIELDS))


def runs_in_order(anchor: np.ndarray, valid: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> Runs:
    """Runs from each window's anchor, whether it is a window at all, its document, and the anchors' keys. Tags are left at 0."""
    if not len(valid):
        return Runs.joined([])
    same = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]) & valid[:-1]
    first = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    goes_on = np.concatenate([same & valid[1:], [False]])
    last = np.flatnonzero(valid & ~goes_on)
    return Runs(keys[anchor[first]], np.zeros(len(first), np.int64), first, last - first + 1, doc[first].astype(np.int64))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def cut(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def squeezed(data: bytes) -> bytes:
    """The data after a byte that says whether it is compressed; short data isn't."""
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(data) if len(data) > 400 else b"\0" + data


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"\1" else data[1:]


def least_of(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of names in two columns: where each distinct name stands, its smallest id, and for each input which of these names is its own."""
    order = np.argsort(b)
    x, y = a[order], b[order]
    if ((y[1:] == y[:-1]) & (x[1:] != x[:-1])).any():  # names that agree in one column alone
        order = np.lexsort((a, b))
        x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.zeros(0, bool)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids, own


def merged(contexts: list[bytes], ids: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct contexts, the smallest id of each, and for each input which of these is its own."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(c, len(number)) for c in contexts), np.int64, len(contexts))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, own, np.asarray(ids, np.int64))
    return list(number), least, own


class Offer:
    """What a block sends, and what it makes of the answers; both need the same order, so both start here."""

    def __init__(self, block: B.Block, plain: Runs, windows: np.ndarray, owners: np.ndarray, contexts_of, names_of, n_buckets: int):
        self.plain, self.windows, self.owners, self.ids = plain, windows, owners, block.ids
        found = contexts_of(block, self.plain) if len(self.plain.keys) else []
        self.contexts, self.least, own = merged(found, block.ids[self.plain.doc].tolist())
        key = np.zeros(len(self.contexts), np.uint64)
        key[own] = self.plain.keys
        self.order, self.cuts = self.dealt((key % np.uint64(n_buckets)).astype(np.int64), self.least)
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.own = self.place[own]  # contexts by their place in what is sent
        self.a, self.b = names_of(block, self.windows) if len(self.windows) else (np.zeros(0, np.uint64),) * 2
        at, least, name = least_of(self.a, self.b, self.owners)
        self.name_order, self.name_cuts = self.dealt(((self.a[at] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), least)
        self.sent, self.first_ids = at[self.name_order], least[self.name_order]
        place = np.empty(len(at), np.int64)
        place[self.name_order] = np.arange(len(at))
        self.name = place[name]

    @staticmethod
    def dealt(bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by bucket, then id, and (bucket, start, end) of each bucket in it."""
        order = np.lexsort((ids, bucket))
        b = bucket[order]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        return order, list(zip(b[at].tolist(), at.tolist(), np.append(at[1:], len(b)).tolist(), strict=False))

    def rows(self):
        """(bucket, kind, data, lengths, ids) for each bucket that the block has something for."""
        steps = lambda x: squeezed(np.diff(x, prepend=0).astype("<i8").tobytes())
        for bucket, a, b in self.cuts:
            some = self.order[a:b]
            parts = [self.contexts[k] for k in some.tolist()]
            yield bucket, CONTEXTS, squeezed(b"".join(parts)), squeezed(np.array([len(c) for c in parts], "<i4").tobytes()), steps(self.least[some])
        for bucket, a, b in self.name_cuts:
            some = self.sent[a:b]
            yield bucket, NAMES, self.b[some].astype("<u8").tobytes() + self.a[some].astype("<u4").tobytes(), b"", steps(self.first_ids[a:b])

    def removed(self, answers: dict[tuple[int, int], bytes], windows_in) -> np.ndarray:
        """The windows that go, sorted. answers: bits by kind and bucket, where any is set."""
        count = windows_in([self.contexts[k] for k in self.order.tolist()])
        start = np.cumsum(count) - count
        bits = np.zeros(int(count.sum()), np.uint8)
        for bucket, a, b in self.cuts:
            if said := answers.get((CONTEXTS, bucket)):
                n = int(count[a:b].sum())
                bits[start[a] : start[a] + n] = np.unpackbits(np.frombuffer(said, np.uint8), count=n)
        later = self.ids[self.plain.doc] > self.least[self.order][self.own]
        n = self.plain.count
        gone = np.repeat(later, n) | (bits[spread(start[self.own], n)] > 0)
        found = [spread(self.plain.first, n)[gone]]
        bits = np.zeros(len(self.name_order), np.uint8)
        for bucket, a, b in self.name_cuts:
            if said := answers.get((NAMES, bucket)):
                bits[a:b] = np.unpackbits(np.frombuffer(said, np.uint8), count=b - a)
        found.append(self.windows[(self.owners > self.first_ids[self.name]) | (bits[self.name] > 0)] if len(self.windows) else self.windows)
        return np.sort(np.concatenate(found))


def decide(rows: list[dict], windows_in, has_earlier) -> list[bytes]:
    """A bucket's answers, one for each row: a bit for each window of its contexts, or for each of its names; empty where no bit is set. What a block keeps for itself comes back as it is."""
    ids = [np.cumsum(np.frombuffer(expanded(r["ids"]), "<i8")) if r["ids"] else None for r in rows]
    said = [r["data"] if r["kind"] == OWN else b"" for r in rows]
    some = [k for k, r in enumerate(rows) if r["kind"] == CONTEXTS]
    if some:
        parts = [cut(expanded(rows[k]["data"]), np.frombuffer(expanded(rows[k]["lengths"]), "<i4")) for k in some]
        contexts, least, own = merged([c for p in parts for c in p], np.concatenate([ids[k] for k in some]).tolist())
        count = windows_in(contexts)
        start = np.cumsum(count) - count
        earlier = has_earlier(contexts, least, count)
        at = 0
        for k, p in zip(some, parts, strict=True):
            mine, at = own[at : at + len(p)], at + len(p)
            n = count[mine]
            bits = earlier[spread(start[mine], n)] | np.repeat(ids[k] > least[mine], n)
            said[k] = np.packbits(bits).tobytes() if bits.any() else b""
    some = [k for k, r in enumerate(rows) if r["kind"] == NAMES]
    if some:
        sizes = [len(rows[k]["data"]) // 12 for k in some]
        b = np.concatenate([np.frombuffer(rows[k]["data"], "<u8", n) for k, n in zip(some, sizes, strict=True)])
        a = np.concatenate([np.frombuffer(rows[k]["data"], "<u4", n, 8 * n) for k, n in zip(some, sizes, strict=True)])
        every = np.concatenate([ids[k] for k in some])
        _, first, own = least_of(a, b, every)
        bits = every > first[own]
        at = 0
        for k, n in zip(some, sizes, strict=True):
            mine, at = bits[at : at + n], at + n
            said[k] = np.packbits(mine).tobytes() if mine.any() else b""
    return said


class Exchange:
    """The steps between packed blocks and the windows that go.

    runs_of(block) -> Runs; contexts_of(block, runs) -> the bytes of each; windows_in(contexts) -> how many windows each has;
    has_earlier(contexts, ids, counts) -> for all their windows whether a smaller id has them; names_of(block, windows) -> two columns of
    64 bits that name each window's content; anchors: about how many runs there are; hot: how many contexts make an anchor hot. If it is
    None, all windows are named; then size_of(block) -> the numbers that windows have, at most, and docs_of(block, windows) -> their documents.
    """

    def __init__(self, n_bytes: int, anchors: int, runs_of, names_of, contexts_of=lambda block, runs: [], windows_in=lambda contexts: np.zeros(len(contexts), np.int64), has_earlier=None, hot: int | None = HOT, size_of=None, docs_of=None):
        self.runs_of, self.names_of, self.contexts_of, self.windows_in, self.has_earlier, self.hot, self.size_of, self.docs_of = runs_of, names_of, contexts_of, windows_in, has_earlier, hot, size_of, docs_of
        self.n_buckets, self.anchors, self.n_bytes = max(1, n_bytes // BUCKET_BYTES), anchors, n_bytes

    def keys_of(self, block: B.Block):
        runs = self.runs_of(block)
        return B.distinct(runs.keys, runs.doc) if self.hot is None else B.pairs(runs.keys, runs.tags, runs.doc)[:3]

    def offer(self, row: dict) -> tuple[B.Block, Offer]:
        """A block with its `counts` and what it sends."""
        block = B.Block(row)
        runs, said = self.runs_of(block), B.counts_of(row)
        if not len(runs.keys):
            states = np.zeros(0, np.uint8)
        elif self.hot is None:
            states = np.where(said[np.searchsorted(np.unique(runs.keys), runs.keys)] > 0, B.MANY, B.ALONE)
        else:
            states = said[B.pairs(runs.keys, runs.tags, runs.doc)[3]]
        hot = runs.take(states == B.MANY)
        windows, docs = spread(hot.first, hot.count), np.repeat(hot.doc, hot.count)
        return block, Offer(block, runs.take(states == B.FEW), windows, block.ids[docs], self.contexts_of, self.names_of, self.n_buckets)

    def own(self, block: B.Block, offer: Offer):
        """What a block keeps for itself, so that its runs need no second search: a bit for each window that it has named."""
        mask = np.zeros(self.size_of(block), bool)
        mask[offer.windows] = True
        yield block.number % self.n_buckets, OWN, squeezed(np.packbits(mask).tobytes()), b"", b""

    def again(self, row: dict) -> tuple[B.Block, Offer]:
        """The same offer as before, from what the block kept for itself."""
        block = B.Block(row)
        kept = next(s["said"] for s in row["said"] if s["kind"] == OWN)
        windows = np.flatnonzero(np.unpackbits(np.frombuffer(expanded(kept), np.uint8), count=self.size_of(block)))
        return block, Offer(block, Runs.joined([]), windows, block.ids[self.docs_of(block, windows)], self.contexts_of, self.names_of, self.n_buckets)

    def run(self, packed: DataFrame, steps: Steps) -> DataFrame:
        """The blocks with what removed() needs."""
        parts = B.partitions(packed, self.n_bytes)
        counts = steps.write(B.shared(packed, self.keys_of, self.anchors, self.hot))

        def send(batches):
            for row in B.each_row(batches):
                block, offer = self.offer(row)
                out = [*offer.rows(), *(self.own(block, offer) if self.hot is None else ())]
                for at in range(0, len(out), 4096):
                    bucket, kind, *rest = zip(*out[at : at + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([row["block"]] * len(bucket), pa.int64()), pa.array(kind, pa.int32()), *[pa.array(c, pa.binary()) for c in rest]], ["bucket", "block", "kind", "data", "lengths", "ids"])

        def answer(key, table):
            del key
            said = decide(table.select(["kind", "data", "lengths", "ids"]).to_pylist(), self.windows_in, self.has_earlier)
            whole = pa.table({"block": table["block"], "kind": table["kind"], "bucket": table["bucket"], "said": pa.array(said, pa.binary())})
            return whole.filter(pa.array([len(s) > 0 for s in said]))

        blocks = packed.repartition(parts, "block")  # the answers of a partition's blocks are hashed, its texts neither sorted nor copied
        sent = blocks.join(counts.hint("shuffle_hash"), "block", "left").mapInArrow(send, "bucket long, block long, kind int, data binary, lengths binary, ids binary")
        decided = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, "block long, kind int, bucket long, said binary")
        said = steps.write(decided.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "said")).alias("said")))
        return (blocks if self.hot is None else blocks.join(counts.hint("shuffle_hash"), "block", "left")).join(said.hint("shuffle_hash"), "block", "left")

    def removed(self, row: dict) -> tuple[B.Block, np.ndarray]:
        """A block of run()'s result and its windows that go."""
        block, offer = self.again(row) if self.hot is None else self.offer(row)
        return block, offer.removed({(s["kind"], s["bucket"]): s["said"] for s in row["said"] or []}, self.windows_in)
