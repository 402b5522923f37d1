"""Byte-level BPE encoding and decoding by tree concatenation.

Texts of up to `split_chars` characters are encoded in one go. Longer ones are halved down to leaves
that any executor encodes; neighbours are then joined, pair by pair up the tree. A join re-encodes a
window around the cut and widens it until both sides agree exactly:

* where the text splits (a place at which no pre-token can continue, whatever stands around it), the
  window runs from the last such place on the left to the first on the right;
* in a long unsplit run, tokens on either side of the cut are merged anew until the window's first and
  last token are those of the two sides. A token sequence is the encoding of its text if and only if each
  pair of neighbours is the encoding of theirs, and each pair then lies in the left, the window or the right.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hidden, slices

SPLIT_CHARS = 1 << 16
LEAF_CHARS = 1 << 14
WINDOW = 256

#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places where a pre-token ends in any context.
SYNC = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
#: Runs inside which no pre-token ends.
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Refuses what a file may ask for and isn't done here: a normalizer, other ways of splitting, flags of added tokens, other models."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [
        spec.get("normalizer") and "a normalizer",
        (split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)) and "a pre-tokenizer other than plain ByteLevel",
        (spec.get("decoder") or {}).get("type") != "ByteLevel" and "a decoder other than ByteLevel",
        any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")) and "flags of added tokens",
        (model.get("type", "BPE") != "BPE" or any(model.get(flag) for flag in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))) and "a model other than plain BPE",
    ]
    if any(wrong):
        raise ValueError("this vocabulary file asks for " + ", ".join(w for w in wrong if w))


class Codec:
    """A vocabulary, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        check(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        if not all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids must follow the order of merges")
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})
        everything = pieces | {t.encode(): i for t, i in self.special.items()}
        self.pieces = [b""] * (max(everything.values()) + 1)
        for b, i in everything.items():
            self.pieces[i] = b
        self.lengths = np.array([len(b) for b in self.pieces])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.letters = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def plain(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def segments(self, text: str) -> list[str]:
        """Plain text and special tokens by turns, plain text first."""
        if not self.cut or not any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, text: str) -> list[int]:
        parts = self.segments(text)
        if len(parts) == 1:
            return self.plain(text)
        return [i for k, p in enumerate(parts) for i in ([self.special[p]] if k % 2 else self.plain(p))]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        at = np.cumsum(lengths) - lengths
        return self.letters[np.repeat(self.starts[ids] - at, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The encoding of a + b, from the encodings of both."""
        if not left or not right:
            return [*left, *right]
        wide = WINDOW
        while wide < 2 * max(len(a), len(b)):
            x, y = a[-wide:], b[:wide]
            p = max((m.start() for m in SYNC.finditer(x)), default=None)
            q = next((m.start() for m in SYNC.finditer(y) if m.start()), None)
            if p is not None and q is not None:
                keep, go = self.tokens_in(left[::-1], len(x[p:].encode())), self.tokens_in(right, len(y[:q].encode()))
                return [*left[: len(left) - keep], *self.plain(x[p:] + y[:q]), *right[go:]]
            if (joined := self.join_run(x, left, y, right, wide // 8)) is not None:
                return joined
            wide *= 2
        return self.plain(a + b)

    def tokens_in(self, ids: list[int], n_bytes: int) -> int:
        """How many of the first tokens make so many bytes."""
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.pieces[ids[n]])
            n += 1
        if n_bytes:
            raise AssertionError("a window cuts a token")
        return n

    def join_run(self, x: str, left: list[int], y: str, right: list[int], width: int) -> list[int] | None:
        """The same for a cut inside one unsplit run, from `width` tokens of each side; None where they don't agree."""
        l, r = left[-width:], right[:width]
        before, after = b"".join(map(self.pieces.__getitem__, l)), b"".join(map(self.pieces.__getitem__, r))
        if len(l) < width or len(r) < width or len(before) + 12 > len(x.encode()) or len(after) + 12 > len(y.encode()):
            return None
        run = x[-len(before) - 3 :] + y[: len(after) + 3]  # at least those bytes and three characters on both sides: 're, 've and 'll end no earlier
        if not any(p.fullmatch(run) for p in RUNS):
            return None
        window = self.core._encode_single_piece(before + after)
        if window[0] == l[0] and window[-1] == r[-1]:
            return [*left[:-width], *window, *right[width:]]
        return None


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the tree that halves a text until its parts have `leaf` characters at most."""
    if len(text) <= max(1, leaf):
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def climb(c: Codec, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Joins the leaves of one text, neighbours first."""
    while len(parts) > 1:
        parts = [(parts[i][0] + parts[i + 1][0], c.join(*parts[i], *parts[i + 1])) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][1] if parts else []


def encode_tree(c: Codec, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """What the distributed plan computes, in one process."""
    out: list[int] = []
    for k, part in enumerate(c.segments(text)):
        out += [c.special[part]] if k % 2 else climb(c, [(p, c.plain(p)) for p in halves(part, leaf)]) if part else []
    return out


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", split_chars: int = SPLIT_CHARS, leaf_chars: int = LEAF_CHARS, packed: bool = False) -> DataFrame:
    """Adds the token ids of the whole text: an array<int>, or with `packed` their little-endian 32-bit form.

    A null text counts as empty and gives no ids; the table's other columns and repeated rows stay as they are.
    A column of the name that ids take is replaced. Texts beyond split_chars are encoded once for all their copies, leaves in parallel, and joined.
    """
    df = df.drop(ids)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    arrow = pa.binary() if packed else pa.list_(pa.int32())
    as_column = lambda rows: pa.array([_packed(r) for r in rows] if packed else [np.asarray(r, np.int32) for r in rows], arrow)
    out = T.StructType([*df.schema.fields, T.StructField(ids, kind)])
    position = df.columns.index(text)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def short(batches):
        c = codec(path)
        for b in slices(batches):
            rows = [c.encode(t or "") for t in b.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, as_column(rows)], [*b.schema.names, ids])

    def leaves(batches):
        c = codec(path)
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = [(key, s, k, p) for s, part in enumerate(c.segments(t)) for k, p in enumerate([part] if s % 2 else halves(part, leaf_chars))]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["key", "segment", "leaf", "part"])

    def encode_leaves(batches):
        c = codec(path)
        for b in slices(batches):
            rows = [[c.special[p]] if s % 2 else c.plain(p) for s, p in zip(b.column("segment").to_pylist(), b.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_packed(r) for r in rows], pa.binary())], [*b.schema.names, "tokens"])

    def join_leaves(key, table):
        c = codec(path)
        parts: dict[int, list] = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["segment"], r["leaf"])):
            parts.setdefault(row["segment"], []).append((row["part"], np.frombuffer(row["tokens"], "<u4").tolist()))
        whole = [i for _, p in sorted(parts.items()) for i in climb(c, p)]
        return pa.table({"key": [table["key"][0].as_py()], "tokens": as_column([whole])})

    key = hidden(df, "text_key")
    brief = df.where(F.length(content) <= split_chars).mapInArrow(short, out)
    long = df.where(F.length(content) > split_chars).withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    texts = long.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    parts = texts.mapInArrow(leaves, "key string, segment int, leaf int, part string").repartition(F.col("key"), F.col("segment"), F.col("leaf"))
    encoded = parts.mapInArrow(encode_leaves, "key string, segment int, leaf int, part string, tokens binary")
    joined = encoded.groupBy("key").applyInArrow(join_leaves, T.StructType([T.StructField("key", T.StringType()), T.StructField("tokens", kind)]))
    joined = joined.select(F.col("key").alias(key), F.col("tokens").alias(ids))
    return brief.unionByName(long.join(joined, key).select(*[F.col(f"`{c}`") for c in df.columns], ids))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", packed: bool = False) -> DataFrame:
    """Replaces ids by the text they stand for; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""
    df = df.drop(text)
    position = df.columns.index(ids)
    out = T.StructType([*[f for f in df.schema.fields if f.name != ids], T.StructField(text, T.StringType())])

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            column = b.column(position).to_pylist() if packed else [None if x is None else x.values.to_numpy(False) for x in b.column(position)]
            texts = [c.decode(np.frombuffer(x or b"", "<u4") if packed else [] if x is None else x) for x in column]
            keep = [i for i in range(b.num_columns) if i != position]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(texts, pa.string())], [*[b.schema.names[i] for i in keep], text])

    return df.mapInArrow(run, out)
