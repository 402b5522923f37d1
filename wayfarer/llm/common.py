"""Tables, folds and hashing that the operators have in common."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Steps, shared_dir

#: Odd multipliers of the polynomial and finalising hashes (fixed values).
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

SECOND = 0xD1342543DE82EF95
LONG_WORD = 256
#: ASCII white space (fixed values).
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

__all__ = ["MULTIPLIER", "POWERS", "Powers", "Steps", "documents", "fold", "hidden", "lanes_of", "mix", "range_hash", "salted", "shared_dir", "slices", "table_of_bytes", "word_spans"]


def hidden(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id="doc_id"):
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def table_of_bytes(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit values, from a seed."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def word_spans(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of anything but ASCII white space, and its document; `ends` are the documents' ends, over which no word goes."""
    inside = ~SPACE[text]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = ends[:-1]
    edges = np.unique(edges[(edges > 0) & (edges < len(text))])
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(ends, starts, "right")


def lanes_of(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of 64 bits that name the words text[start:end]: 8 bytes at a time are stirred into either, each time by a bijection, and the length at first.

    The columns have keys of their own. Words of more than LONG_WORD bytes are few and get xxh3's 128 bits.
    """
    size = ends - starts
    words = np.ndarray((len(text) + 1,), "<u8", text + b"\0" * 8, strides=(1,))
    lanes = [mix(size.astype(np.uint64) * k) for k in (np.uint64(MULTIPLIER), np.uint64(SECOND))]
    some = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[some], size[some]
    while len(some):
        w = words[at].astype(np.uint64)
        w &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        for lane, k in zip(lanes, (np.uint64(MIX_1), np.uint64(MIX_2)), strict=True):
            lane[some] = mix((lane[some] ^ w) * k + np.uint64(MULTIPLIER))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = np.frombuffer(xxhash.xxh3_128_digest(text[starts[k] : ends[k]]), ">u8")
        lanes[0][k], lanes[1][k] = digest
    return lanes[0], lanes[1]


def salted(big: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """big joined to small, which has one row a key at most: a hot key's rows of `big` are dealt by the column `by` to several tasks, each with a copy of the small row.

    The small side grows with the corpus, so it is never broadcast, however small it may be at first.
    """
    salt = hidden(big, "salt")
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [*on, salt], how).drop(salt)


class Powers:
    """multiplier**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, multiplier: int = MULTIPLIER):
        self.n, self.multiplier = 0, multiplier
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 16, 1 << (n - 1).bit_length())
            inverse = pow(self.multiplier, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n - 1, m, np.uint64)]), dtype=np.uint64) for m in (self.multiplier, inverse))
        return self.up[:n], self.down[:n]


POWERS, SECOND_POWERS = Powers(), Powers(SECOND)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end]; equal runs have equal hashes wherever they stand. Starts must lie below len(values).

    Some long runs over two values are known to collide for every odd base: so this names only short runs of values that are names themselves,
    or chooses where things meet that are compared there.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers.get(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def slices(batches, n_bytes: int = 1 << 20):
    """Arrow batches cut into runs of rows of about n_bytes, so that what Python makes of one stays small."""
    for b in batches:
        step = max(1, int(b.num_rows * n_bytes / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
