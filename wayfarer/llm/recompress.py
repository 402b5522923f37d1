"""Removal of repeated word sequences, by recompression.

Each round renames a document's symbols, words at first, the same way everywhere: runs of equal symbols become
one, then pairs of neighbours of which the first falls left and the second right of a split of all names. Names
come from what they stand for, so that every task gives equal sequences equal names without a table of them. A
symbol whose neighbourhood lies within a window is there wherever that window occurs. Of these interior symbols
of the highest round each window picks the one of the smallest name, of a lower round where it has none; windows
of equal words pick the same, so that symbols that two documents have reveal where repeats can be. These windows
are verified by what all their words say: more than 96 bits, from two columns of names that are worked out apart
from each other. Symbols themselves only choose what is compared, so the 64 bits of one column do for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import windows as W
from .common import SECOND_POWERS, Steps, lanes_of, mix, range_hash, table_of_bytes, word_spans

WINDOW = 20
ROUNDS = 2
NAMES = table_of_bytes(61)


class Symbols:
    """Names of a block's symbols, the words [low, high) that each one's existence depends on, and their documents."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray):
        self.name, self.low, self.high, self.doc = name, low, high, doc


def around(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The extent of each symbol with its neighbours; beyond an edge of the document a word that no window has."""
    same = s.doc[1:] == s.doc[:-1]
    low, high = edge_low[s.doc] - 1, edge_high[s.doc] + 1
    low[1:][same] = s.low[:-1][same]
    high[:-1][same] = s.high[1:][same]
    return low, high


def compress_runs(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray, most: int, level: int) -> Symbols:
    """One symbol for each run of equal ones; runs of `most` and more, which no window goes beyond, share a name."""
    if not len(s.name):
        return s
    new = np.flatnonzero(np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])]))
    count = np.diff(np.append(new, len(s.name)))
    low, high = around(s, edge_low, edge_high)
    name = np.where(count > 1, mix(s.name[new] ^ NAMES[level] + np.minimum(count, most).astype(np.uint64)), s.name[new])
    return Symbols(name, low[new], high[new + count - 1], s.doc[new])


def compress_pairs(s: Symbols, edge_low: np.ndarray, edge_high: np.ndarray, level: int) -> Symbols:
    """One symbol for each neighbours of which the first is left and the second right."""
    n = len(s.name)
    if n < 2:
        return s
    right = (mix(s.name ^ NAMES[64 + level]) & np.uint64(1)).astype(bool)
    pair = np.zeros(n, bool)  # at the first of a pair
    pair[:-1] = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1])
    second = np.concatenate([[False], pair[:-1]])
    low, high = around(s, edge_low, edge_high)
    follower = np.minimum(np.arange(n) + 1, n - 1)
    name = np.where(pair, mix(s.name * NAMES[128 + level] + mix(s.name[follower])), s.name)
    # a left symbol stays alone for what follows it, a right one for what comes before
    own_low = np.where(right & ~second, np.minimum(low, s.low), s.low)
    own_high = np.where(pair, s.high[follower], np.where(right, s.high, np.maximum(high, s.high)))
    keep = ~second
    return Symbols(name[keep], own_low[keep], own_high[keep], s.doc[keep])


class Words:
    """Words of a block: their names in two columns, documents, and each document's range of words."""

    def __init__(self, block: B.Block):
        none = np.zeros(0, np.int64)
        start, end, self.doc = word_spans(np.frombuffer(block.text, np.uint8), block.ends) if block.text else (none, none, none)
        self.name, self.other = lanes_of(block.text, start, end)
        docs = np.arange(len(block.ids))
        self.low, self.high = np.searchsorted(self.doc, docs), np.searchsorted(self.doc, docs, "right")


def words_in(block: B.Block) -> Words:
    """The block's words, found once."""
    if not hasattr(block, "words"):
        block.words = Words(block)
    return block.words


def window_names(words: Words, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns that name the windows that begin at these words."""
    end = np.minimum(at + window, len(words.name))
    return range_hash(words.name, at, end), range_hash(words.other, at, end, SECOND_POWERS)


def anchors(words: Words, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word that begins a window the number of its anchor among all symbols (-1: none), and these symbols' names."""
    n = len(words.name)
    at = np.arange(n)
    s = Symbols(words.name, at, at + 1, words.doc)
    levels = [s]
    for k in range(1, rounds + 1):
        s = compress_pairs(compress_runs(s, words.low, words.high, window, 2 * k), words.low, words.high, 2 * k + 1)
        levels.append(s)
    chosen, names, base = np.full(n, -1, np.int64), [], 0
    begins = at <= words.high[words.doc] - window  # words at which a window begins
    for k, s in reversed(list(enumerate(levels))):
        best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        first = np.maximum(s.high - window, words.low[s.doc])
        last = np.minimum(s.low, words.high[s.doc] - window)  # windows [first, last] hold all that the symbol depends on
        without = np.concatenate([[0], np.cumsum(begins & (chosen < 0))])  # windows that no higher round has a symbol for
        inside = np.flatnonzero((first <= last) & (without[np.maximum(last, -1) + 1] > without[np.minimum(first, n)]))
        key = (s.name[inside] & ~np.uint64(0xFFFFFFFF)) | inside.astype(np.uint64)
        at, until = first[inside], last[inside]
        while len(at):  # one window of each symbol at a time, which keeps memory at the number of symbols
            np.minimum.at(best, at, key)
            more = at < until
            at, until, key = at[more] + 1, until[more], key[more]
        free = (chosen < 0) & (best != np.iinfo(np.uint64).max)
        chosen[free] = base + (best[free] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        names.append(mix(s.name + NAMES[200 + k]))
        base += len(s.name)
    return chosen, np.concatenate(names)


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, rounds: int = ROUNDS, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (its remaining words, one space between them).

    Every word covered by a window whose words also start in a document of smaller id, or further up in the same one, goes.
    A null text has no words. Rows of equal id never remove from one another; a null id comes before all others.
    """
    steps = Steps(df.sparkSession, "recompress")
    packed = B.pack(df, doc_id, text, steps, block_bytes)
    total = packed.agg(F.sum("bytes").alias("n")).first().n or 0

    def runs_of(block):
        words = words_in(block)
        chosen, names = anchors(words, window, rounds)
        return W.runs_in_order(chosen, chosen >= 0, words.doc, names)

    names_of = lambda block, at: window_names(words_in(block), window, at)
    exchange = W.Exchange(total, total // 24, runs_of, names_of, hot=None, size_of=lambda block: len(words_in(block).name), docs_of=lambda block, at: words_in(block).doc[at])

    def repeated(words: Words) -> np.ndarray:
        """The windows that start further up in the same document too."""
        size = words.high - words.low
        some = size >= window
        at = W.spread(words.low[some], size[some] - window + 1)
        if not len(at):
            return at
        a, b = window_names(words, window, at)
        order = np.argsort(a)
        same = a[order][1:] == a[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # few as a rule
        order = order[np.lexsort((at[order], b[order], a[order], words.doc[at[order]]))]
        a, b, doc = a[order], b[order], words.doc[at[order]]
        return at[order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (doc[1:] == doc[:-1])]]

    def finish(batches):
        for row in B.each_row(batches):
            block, found = exchange.removed(row)
            words = words_in(block)
            edge = np.zeros(len(words.name) + 1, np.int32)
            for starts in (found, repeated(words)):
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.minimum(starts + window, len(words.name)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows = []
            for i, a, b, low, high in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), words.low.tolist(), words.high.tolist(), strict=True):
                own, g = block.text[a:b].split(), gone[low:high]
                n = int(g.sum())
                kept = own if not n else [own[k] for k in np.flatnonzero(~g).tolist()]
                rows.append((i, len(own), n, b" ".join(kept).decode("utf-8", "replace")))
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), types, strict=True)], names)

    names, types = ["id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = exchange.run(packed, steps).mapInArrow(finish, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != B.NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


#: The same in SQL.
ORACLE = rf"""
with ws as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), pos as (
  select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from ws where len(w) >= {WINDOW}
), win as (
  select doc_id, i, md5(array_to_string(w[i:i + {WINDOW} - 1], ' ')) as h from pos
), gone as (
  select doc_id, i from win qualify row_number() over (partition by h order by doc_id, i) > 1
), cover as (
  select distinct doc_id, unnest(range(i, i + {WINDOW})) as k from gone
), each as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from ws
)
select ws.doc_id, len(ws.w)::bigint as n_words, count(cover.k)::bigint as n_removed,
  sha256(coalesce(string_agg(each.word, ' ' order by each.k) filter (where cover.k is null), '')) as kept_sha256
from ws left join each using (doc_id) left join cover on cover.doc_id = each.doc_id and cover.k = each.k
group by ws.doc_id, ws.w
"""
