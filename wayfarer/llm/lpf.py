"""Removal of byte strings that an earlier document has, by longest previous factors.

The longest previous factor of a suffix is its longest beginning that also starts earlier. In suffix order it is shared with one of two
neighbours: the nearest of smaller position before it or after it. Only documents count as earlier or later here, so a position is its
document's id, and only factors up to the window need telling apart: a suffix is known by the bytes of its window, filled up to whole words
of 8. Each window is sent to the bucket of its anchor, the gram of the smallest hash in it, leftmost of equals, which windows of the same
bytes have in common; there the suffixes of all contexts are sorted, the common beginnings of neighbours measured, and the previous and
next smaller positions found by jumps over what is larger. A window goes whose factor is as long as itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import windows as W
from .common import POWERS, Steps, mix, table_of_bytes

WINDOW = 50
GRAM = 20
SEGMENT = 1 << 17
#: A block has a window for each byte, so it is half as large as where words are counted.
BLOCK_BYTES = B.BLOCK_BYTES // 2
LETTERS = table_of_bytes(41)


def smallest(keys: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive keys."""
    have = 1
    while have * 2 <= n:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (n - have)], keys[n - have :]) if have < n else keys


def prefix_sums(text: np.ndarray) -> np.ndarray:
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(LETTERS[text] * POWERS.get(len(text))[0], out=total[1:])
    return total


def segment_anchors(text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the text the position of its anchor, the hash of the gram at each position, and the text's prefix sums."""
    total = prefix_sums(text)
    h = total[gram:] - total[:-gram]
    h *= POWERS.get(len(text))[1][: len(h)]
    h = mix(h)
    low = np.uint64(0xFFFFFFFF)
    keys = h & ~low
    keys |= np.arange(len(h), dtype=np.uint64)
    return smallest(keys, window - gram + 1).astype(np.uint32), h, total


def segments(block: B.Block, overlap: int):
    """Parts of a block's text, so that one very long text needs no more memory than many short ones."""
    text = np.frombuffer(block.text, np.uint8)
    for a in range(0, max(0, len(text) - overlap), SEGMENT):
        yield a, text[a : a + SEGMENT + overlap]


def block_runs(window: int, gram: int):
    def runs_of(block: B.Block) -> W.Runs:
        """Runs of the block's windows."""
        found = []
        for a, part in segments(block, window - 1):
            anchor, h, total = segment_anchors(part, window, gram)
            stop = np.clip(block.ends - a, 0, len(anchor))
            doc = np.repeat(np.arange(len(stop), dtype=np.int32), np.diff(stop, prepend=0))
            valid = np.zeros(len(anchor) + 1, np.int8)  # windows that end within their document
            begin, end = np.clip(block.starts - a, 0, len(anchor)), np.clip(block.ends - a - window + 1, 0, len(anchor))
            some = begin < end
            np.add.at(valid, begin[some], 1)
            np.add.at(valid, end[some], -1)
            runs = W.runs_in_order(anchor, np.cumsum(valid[:-1], dtype=np.int8) > 0, doc, h)
            tag = total[runs.first + runs.count + window - 1] - total[runs.first]
            runs.tags = (mix(tag * POWERS.get(len(part))[1][runs.first]) >> np.uint64(48)).astype(np.int64)
            runs.first, runs.keys = runs.first + a, mix(runs.keys ^ LETTERS[0])  # smallest hashes crowd together, keys must not
            found.append(runs)
        return W.Runs.joined(found)

    return runs_of


def words_at(buffer: bytes, at: np.ndarray, window: int, cap: np.ndarray | None = None) -> list[np.ndarray]:
    """The bytes from each position on as words of 8, as many as the window needs; bytes beyond `cap` count as 0. The buffer has 8 bytes to spare."""
    every = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    out = []
    for o in range(0, window, 8):
        w = every[np.minimum(at + o, len(every) - 1)].astype(np.uint64)
        if o + 8 > window:
            left = np.clip((window if cap is None else cap) - o, 0, 8).astype(np.uint64)
            w &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(1) >> (left * np.uint64(8) - np.uint64(1)))
        out.append(w)
    return out


def names_of(window: int):
    keys = np.random.Generator(np.random.PCG64(59)).integers(0, 2**63, (2, 2, -(-window // 8)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def name(block: B.Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two columns of 64 bits that name the windows at these positions: sums of finalised words, each under keys of its own."""
        text = block.text + b"\0" * 8
        out = np.empty((2, len(at)), np.uint64)
        for k in range(0, len(at), SEGMENT):  # some at a time, for their words take much room
            words = words_at(text, at[k : k + SEGMENT], window)
            for lane, (first, second) in zip(out, keys, strict=True):
                total = np.zeros(len(words[0]), np.uint64)
                for w, x, m in zip(words, first, second, strict=True):
                    total += mix(w ^ x) * m
                lane[k : k + SEGMENT] = mix(total)
        return out[0], out[1]

    return name


def factors(contexts: list[bytes], ids: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The longest previous factors of longest_previous(), where windows that no other has, by a hash, are left out and get 0: their factors are shorter than the window."""
    out = np.zeros(int(count.sum()), np.int64)
    if not len(out):
        return out
    lengths = np.array([len(c) for c in contexts])
    start, first = np.cumsum(lengths) - lengths, np.cumsum(count) - count
    text = b"".join(contexts)
    at = W.spread(start, count)
    key = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(text), SEGMENT)).tolist()  # some contexts at a time, for the sums take 8 bytes a letter
    for a, b in zip(cuts, [*cuts[1:], len(contexts)], strict=True):
        if a < b:
            part = np.frombuffer(text, np.uint8)[start[a] : start[b - 1] + lengths[b - 1]]
            total, down = prefix_sums(part), POWERS.get(len(part))[1]
            own = at[first[a] : first[b - 1] + count[b - 1]] - start[a]
            key[first[a] : first[b - 1] + count[b - 1]] = (total[own + window] - total[own]) * down[own]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    some = np.zeros(len(out), bool)
    some[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    at = at[some]
    del key, order, same
    out[some] = longest_previous(text, at, np.repeat(ids, count)[some], np.repeat(start + lengths, count)[some] - at, window)
    return out


def longest_previous(text: bytes, at: np.ndarray, position: np.ndarray, cap: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For the suffixes at these places of the text the length of the longest previous factor, in suffixes of smaller position, as far as whole words of the
    window tell. cap: the length of each suffix; factors shorter than the window count as 0."""
    if not len(at):
        return np.zeros(0, np.int64)
    words = words_at(text + b"\0" * 8, at, window, cap)
    order = np.lexsort(words[::-1])
    n = len(order)
    # common beginnings of neighbours in suffix order
    same = np.zeros(n, np.int64)
    open_ = np.ones(n - 1, bool)
    for w in words:
        w = w[order]
        x = w[1:] ^ w[:-1]
        whole = x == 0
        zeros = 7 - (np.frexp((x >> np.uint64(11)).astype(np.float64))[1] + 10) // 8  # leading bytes that agree, for x >= 2**11
        zeros = np.where(x < np.uint64(1 << 11), np.where(x < np.uint64(256), 7, 6), zeros)
        same[1:] += np.where(open_, np.where(whole, 8, zeros), 0)
        open_ &= whole
    cap = cap[order]
    same[1:] = np.minimum(same[1:], np.minimum(cap[1:], cap[:-1]))
    position = position[order]
    best = np.zeros(n, np.int64)
    for turn in (1, -1):  # the previous smaller positions, then the next ones, as the previous ones of the reverse
        p = position[::turn]
        common = same if turn > 0 else np.concatenate([[0], same[1:][::-1]])
        jump = np.arange(n) - 1  # the place before, until it holds a smaller position; whatever is jumped over is as large
        least = common.copy()  # the shortest common beginning on the way
        live = np.flatnonzero((jump >= 0) & (least >= window))
        while len(live := live[p[jump[live]] >= p[live]]):
            via = jump[live]
            least[live] = np.minimum(least[live], least[via])
            jump[live] = jump[via]
            live = live[(jump[live] >= 0) & (least[live] >= window)]
        length = np.where((jump >= 0) & (p[jump] < p), least, 0)
        best = np.maximum(best, length[::turn])
    out = np.empty(n, np.int64)
    out[order] = np.where(best >= window, best, 0)
    return out


def remove_earlier(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = W.HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, kept (bytes), spans (of removed bytes, maximal, ends exclusive).

    Every byte covered by a string of `window` bytes that also starts in a document of smaller id goes; the first document keeps it.
    A null text counts as empty. Rows of equal id never remove from one another; a null id comes before all others.
    """
    if not 8 <= gram <= window:
        raise ValueError("a gram has 8 bytes at least and fits into the window")
    steps = Steps(df.sparkSession, "lpf")
    packed = B.pack(df, doc_id, text, steps, block_bytes)
    total = packed.agg(F.sum("bytes").alias("n")).first().n or 0
    contexts_of = lambda block, runs: [block.text[a : a + n + window - 1] for a, n in zip(runs.first.tolist(), runs.count.tolist(), strict=True)]
    windows_in = lambda contexts: np.array([len(c) - window + 1 for c in contexts], np.int64)
    has_earlier = lambda contexts, ids, count: factors(contexts, ids, count, window) >= window
    exchange = W.Exchange(total, int(total * 2 / (window - gram + 2)), block_runs(window, gram), names_of(window), contexts_of, windows_in, has_earlier, hot)

    def finish(batches):
        for row in B.each_row(batches):
            block, starts = exchange.removed(row)
            edge = np.zeros(len(block.text) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            letters = np.frombuffer(block.text, np.uint8)
            rows = []
            for i, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
                g = gone[a:b]
                if not g.any():
                    rows.append((i, b - a, 0, block.text[a:b], []))
                    continue
                turns = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                rows.append((i, b - a, int(g.sum()), letters[a:b][~g].tobytes(), [{"start": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()]))
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), types, strict=True)], names)

    names = ["id", "n_bytes", "n_removed", "kept", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    out = exchange.run(packed, steps).mapInArrow(finish, "id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("id") != B.NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "kept", "spans")


#: The same in SQL, byte by byte in hexadecimal.
ORACLE = f"""
with t as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), b as (
  select doc_id, n, i, substr(h, 2 * i + 1, 2) as byte, case when i <= n - {WINDOW} then md5(substr(h, 2 * i + 1, {2 * WINDOW})) end as w from (select *, unnest(range(0, n)) as i from t) x
), first as (
  select w, min(doc_id) as doc_id from b where w is not null group by w
), gone as (
  select b.doc_id, n, i, byte, coalesce(max(case when first.doc_id < b.doc_id then i end) over (partition by b.doc_id order by i) >= i - {WINDOW} + 1, false) as gone
  from b left join first on b.w = first.w
), spans as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from gone
), sums as (
  select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_spans, string_agg(byte, '' order by i) filter (where not gone) as kept from spans group by doc_id
)
select t.doc_id, t.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from t left join sums using (doc_id)
"""
