"""Exact Jaccard join of word n-gram sets, by prefix trees.

1. Each document's set is hashed block by block; keys that only one document has can't be part of a match.
2. With sets in a global order, rarest first, two sets that match share one of the first
   n - ceil(0.75 n) + 1 shingles of each. A document with that many shingles of its own has no partner; of the
   others, equal sets are represented by one, and the shingles in those prefixes tie candidates into groups.
3. In each group the ordered sets form a trie. A set walks it once, so that overlaps with a common beginning are
   counted once, and leaves a subtree as soon as the shingles left on either side can't reach the overlap needed.
   Links that join what is joined already are skipped, so that a task yields at most one link a set, and never
   all its pairs. A group beyond GROUP sets is dealt by size into bands, of which only neighbours can match, and
   each band into parts, which share some pivots. That joins most near copies of one text; what stays outside of
   a group's largest component then, as a rule little, is compared with all the bands around.

Shingles are known by 64 bits, made of their words' 128. Equal sets are told by two sums of 64 bits.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B
from .common import Steps, lanes_of, mix, salted, table_of_bytes, word_spans
from .components import components

WORDS = 5
PERCENT = 75
GROUP = 256
PIVOTS = 8
#: Sets of small groups that one call sees, about.
SETS = 1024
PLACES = table_of_bytes(37)


def shingles(block: B.Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as (document, hash), sorted. Fewer words make one shingle; no word none.

    A to Z count as lower case, and ASCII white space separates words, as for Python's bytes.
    """
    text = block.text.lower()
    starts, ends, doc = word_spans(np.frombuffer(text, np.uint8), block.ends) if text else (np.zeros(0, np.int64),) * 3
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    name = lanes_of(text, starts, ends)
    first = np.searchsorted(doc, np.arange(len(block.ids)))
    size = np.searchsorted(doc, np.arange(len(block.ids)), "right") - first
    value, own = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(min(words, n)):
        m = n - j
        same = doc[:m] == doc[j:]
        part = mix(name[0][j:] + PLACES[j]) * PLACES[64 + j]
        part ^= name[1][j:] * PLACES[192 + j]
        value[:m][same] += mix(part)[same]
        own[:m] += same
    at = np.flatnonzero((own == words) | (np.arange(n) == first[doc]) & (size[doc] < words))
    keys = mix(value[at] + PLACES[128 + own[at]])
    order = np.lexsort((keys, doc[at]))
    d, k = doc[at][order], keys[order]
    keep = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    return d[keep], k[keep]


class Node:
    """A path-compressed trie over ascending token tuples."""

    __slots__ = ("children", "deepest", "ends", "largest", "path", "smallest")

    def __init__(self, sets: list[tuple[tuple[int, ...], int, int]], lo: int, hi: int, depth: int):
        first, last = sets[lo][0], sets[hi - 1][0]
        stop, most = depth, min(len(first), len(last))
        while stop < most and first[stop] == last[stop]:
            stop += 1
        self.path = first[depth:stop]
        self.smallest, self.largest = min(s[1] for s in sets[lo:hi]), max(s[1] for s in sets[lo:hi])
        self.deepest = max(len(s[0]) for s in sets[lo:hi]) - stop  # tokens left below this node at most
        self.ends, self.children = [], []
        while lo < hi and len(sets[lo][0]) == stop:
            self.ends.append(sets[lo][1:])
            lo += 1
        while lo < hi:
            at = lo
            while at < hi and sets[at][0][stop] == sets[lo][0][stop]:
                at += 1
            self.children.append((lo, at))
            lo = at
        self.children = [Node(sets, a, b, stop) for a, b in self.children]


def matches(root: Node, tokens: tuple[int, ...], size: int, percent: int, skip):
    """Walks the trie with one set; yields the ids whose overlap suffices. skip(id) leaves out what is joined already."""
    own = frozenset(tokens)
    stack = [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        if 100 * node.largest < percent * size or 100 * size < percent * node.smallest:
            continue
        overlap += len(own.intersection(node.path))
        left = len(tokens) - bisect_right(tokens, node.path[-1]) if node.path else len(tokens)
        # 100 o >= p (a + b - o) for some b in the subtree
        if (100 + percent) * (overlap + min(left, node.deepest)) < percent * (size + node.smallest):
            continue
        for other, i in node.ends:
            if (100 + percent) * overlap >= percent * (size + other) and not skip(i):
                yield i
        stack += [(c, overlap) for c in node.children]


def forest(rows: list[tuple[int, int, int, tuple[int, ...]]], across: bool, percent: int = PERCENT, tops: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links that join what the matches among (part, id, size, tokens) join; across: only those between two parts. tops: what each id is joined to already."""
    up: dict[int, int] = {r[1]: r[1] for r in rows}
    for i, top in (tops or {}).items():
        up.setdefault(top, top)
        up[i] = top

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    first = min((r[0] for r in rows), default=0)
    stored = sorted((t, n, i) for part, i, n, t in rows if not across or part == first)
    if not stored:
        return []
    root, out = Node(stored, 0, len(stored), 0), []
    for part, i, n, t in rows:
        if across and part == first:
            continue
        for j in matches(root, t, n, percent, lambda j, i=i: find(i) == find(j)):
            up[find(i)] = find(j)
            out.append((i, j))
    return out


def ranked(keys: list[bytes], met: list[bytes]) -> list[tuple[int, ...]]:
    """The sets' shingles as numbers in their global order: by how many blocks have them, then by hash. The same shingle has the same number in all sets."""
    k, m = np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(met), np.uint8)
    order = np.lexsort((k, m))
    new = np.concatenate([[False], (k[order][1:] != k[order][:-1]) | (m[order][1:] != m[order][:-1])])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new)
    ends = np.cumsum([len(x) for x in met]).tolist()
    flat = number.tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def linked(dealt: DataFrame, keys: list[str], across: bool, percent: int) -> DataFrame:
    """Links (a, b) within each group of (label, side, rep, top, n, tokens, met), several groups of a key in one call; across: between the two sides alone. Sets of one `top` are joined already."""

    def run(key, table):
        del key
        sets = ranked(table["tokens"].to_pylist(), table["met"].to_pylist())
        groups: dict[int, list[tuple]] = {}
        for label, top, *row in zip(*(table[c].to_pylist() for c in ("label", "top", "side", "rep", "n")), sets, strict=True):
            groups.setdefault(label, []).append((tuple(row), top))
        found = []
        for rows in groups.values():
            found += forest(sorted(r for r, _ in rows), across, percent, {r[1]: top for r, top in rows})
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.select(*dict.fromkeys([*keys, "label"]), "side", "rep", "top", "n", "tokens", "met").groupBy(*keys).applyInArrow(run, "a long, b long")


def around_pivots(big: DataFrame, group: int, percent: int) -> DataFrame:
    """Links within parts of large groups: a part is some `group` sets of one band, with the band's and the next lower band's pivots, which all parts have in common.

    Near copies of one text are mostly joined by that, so that few pairs are left to compare.
    """
    order = Window.partitionBy("label", "band").orderBy(F.xxhash64("rep"), "rep")
    pivots = big.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS)
    cells = big.groupBy("label", "band").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    own = salted(big, cells, ["label", "band"], "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    also = pivots.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).join(cells, ["label", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["label", "band", "part", "rep", "n", "tokens", "met"]
    every = own.select(*names).union(also.select(*names)).dropDuplicates(["label", "band", "part", "rep"])
    return linked(every.withColumns({"side": F.lit(0), "top": F.col("rep")}), ["label", "band", "part"], False, percent)


def across_components(big: DataFrame, tops: DataFrame, group: int, steps: Steps) -> DataFrame:
    """What is left of large groups: each set outside of its group's largest component against all sets of the bands around, as tasks of two sides.

    A group that is one component by now has nothing left.
    """
    whole = steps.write(big.join(tops.hint("merge"), big["rep"] == tops["node"], "left").select(big["label"], "band", "rep", "n", "tokens", "met", F.coalesce(tops["label"], "rep").alias("top")))
    sizes = whole.groupBy("label", "top").agg(F.count("*").alias("sets"))
    largest = sizes.groupBy("label").agg(F.max_by("top", F.struct("sets", "top")).alias("largest"), F.count("*").alias("tops")).where("tops > 1").drop("tops")
    rest = salted(whole, largest, ["label"], "rep")
    others = rest.where("top <> largest")
    count = lambda df, size, name: df.groupBy("label", "band").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts, chunks = count(others, group, "parts"), count(rest, 4 * group, "chunks")
    near = lambda cells, name: cells.withColumn("other", F.col("band")).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).groupBy("label", "band").agg(F.collect_list(F.struct("other", name)).alias("around"))
    keep = ["rep", "top", "n", "tokens", "met"]
    one = salted(salted(others, parts, ["label", "band"], "rep"), near(chunks, "chunks"), ["label", "band"], "rep").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    one = one.withColumn("to", F.explode("around")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("to.chunks") - 1)))
    two = salted(salted(rest, chunks, ["label", "band"], "rep"), near(parts, "parts"), ["label", "band"], "rep").withColumn("j", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("int"))
    two = two.withColumn("to", F.explode("around")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)))
    left = one.select("label", F.col("band").alias("low"), "i", F.col("to.other").alias("high"), "j", F.lit(0).alias("side"), *keep)
    return left.union(two.select("label", F.col("to.other").alias("low"), "i", F.col("band").alias("high"), "j", F.lit(1).alias("side"), *keep))


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT, group: int = GROUP, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set) and component_id, the smallest id that links reach.

    A null text counts as empty: no set, no link. Each row is a node of its own, whatever its id: rows of null id are linked like others, and
    component_id is the smallest id that isn't null, null only where no row of the component has one.
    """
    steps = Steps(df.sparkSession, "jaccard")
    packed = B.pack(df, doc_id, text, steps, block_bytes)
    total = packed.agg(F.sum("bytes").alias("n")).first().n or 0

    def keys_of(block):
        d, k = shingles(block, words)
        return B.distinct(k, d)

    counts = steps.write(B.shared(packed, keys_of, total // 6))

    def read(batches):
        for row in B.each_row(batches):
            block = B.Block(row)
            d, k = shingles(block, words)
            met = B.counts_of(row)[np.searchsorted(np.unique(k), k)] if len(k) else np.zeros(0, np.uint8)
            size = np.bincount(d, minlength=len(block.ids))
            shared = np.bincount(d[met > 0], minlength=len(block.ids))
            at = np.searchsorted(d, np.arange(len(block.ids)))
            with np.errstate(over="ignore"):
                sums = [np.add.reduceat(np.append(mix(k ^ PLACES[200 + j]), np.uint64(0)), at) * (size > 0) for j in (0, 1)]
            order = np.lexsort((k, met, d))
            order = order[met[order] > 0]
            keys, marks = k[order].astype("<u8").tobytes(), met[order].tobytes()
            ends = np.cumsum(shared).tolist()
            some = (100 * shared >= percent * size) & (size > 0)
            cuts = list(zip([0, *ends], ends, some.tolist(), strict=False))
            number = ((row["block"] >> 32) << 42) + ((row["block"] & 0xFFFFFFFF) << 21) + np.arange(len(size))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(block.ids, mask=block.ids == B.NULL_ID), pa.array(size, pa.int64()), *[pa.array(s.view(np.int64)) for s in sums], pa.array([keys[8 * a : 8 * b] if x else None for a, b, x in cuts], pa.binary()), pa.array([marks[a:b] if x else None for a, b, x in cuts], pa.binary())], ["row", "id", "n", "h1", "h2", "tokens", "met"])

    blocks = packed.repartition(B.partitions(packed, total), "block")
    sets = steps.write(blocks.join(counts.hint("shuffle_hash"), "block", "left").mapInArrow(read, "row long, id long, n long, h1 long, h2 long, tokens binary, met binary"))
    steps.drop(packed, counts)
    some = sets.where("tokens is not null")
    reps = steps.write(some.groupBy("h1", "h2", "n").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"), F.first("tokens").alias("tokens"), F.first("met").alias("met")))

    def prefixes(batches):
        for b in batches:
            for rep, n, t in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                x = np.frombuffer(t, "<i8")
                x = x[: max(0, n - -(-percent * n // 100) + 1 - (n - len(x)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(np.full(len(x), rep), pa.int64())], ["token", "rep"])

    posts = reps.select("rep", "n", "tokens").mapInArrow(prefixes, "token long, rep long")
    least = posts.groupBy("token").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most")
    tied = salted(posts, least, ["token"], "rep").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    groups = steps.write(components(tied, steps))
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    grouped = salted(reps.join(groups.hint("merge"), reps["rep"] == groups["node"]), sizes, ["label"], "rep")
    band = F.when(F.col("size") <= group, 0).otherwise(F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) if percent < 100 else 1.0) + 1)).cast("int")
    grouped = steps.write(grouped.select("label", "size", band.alias("band"), "rep", "n", "tokens", "met"))
    small = grouped.where(F.col("size") <= group)
    tasks = max(1, small.count() // SETS)  # small groups, some in a call
    small = small.withColumns({"task": F.pmod(F.xxhash64("label"), F.lit(tasks)), "side": F.lit(0), "top": F.col("rep")})
    links = linked(small, ["task"], False, percent)
    big = grouped.where(F.col("size") > group)
    if big.limit(1).count():
        links = steps.write(links.union(around_pivots(big, group, percent)))
        tops = steps.write(components(links, steps))
        links = links.union(linked(across_components(big, tops, group, steps), ["label", "low", "i", "high", "j"], True, percent))
    labels = components(links, steps)
    classes = reps.join(labels.hint("merge"), reps["rep"] == labels["node"], "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("top"), "least_id")
    names = classes.groupBy("top").agg(F.min("least_id").alias("component"))
    named = salted(classes.select("h1", "h2", "n", "top"), names, ["top"], "h1").drop("top")
    whole = salted(some.select("row", "id", "n", "h1", "h2"), named, ["h1", "h2", "n"], "row").select("id", "n", "component").union(sets.where("tokens is null").select("id", "n", "id"))
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same in SQL, for small tables: links by shingles in common, components by a recursive walk.
ORACLE = r"""
with recursive ws as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) as s from ws
), n as (select doc_id, count(*) as n from sh group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))
), reach as (
  select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
"""
