"""Exact top-k inner products in three phases with a uniform threshold.

A vector's components are cut into slices, and a score is the sum of its slices' scores. A block of rows and one slice is a node: it holds, for each
query, a list of scores of that slice alone.
1. Each node sends the k best entries of its list. What was sent is summed up by row; the rows that look best are scored in full, and the k-th best of
   these is the query's cutoff: k rows reach it, so no row below it can be among the best.
2. A row all of whose slices stay below cutoff / slices can't reach the cutoff. So a node must send every entry at or above that. As a rule it has done so
   already; only a node whose last entry sent still lies there is asked again, for the queries concerned alone.
3. Rows whose entries are all known and add up to less than the cutoff go; the others are scored in full, and the best k meet in a last ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps

SCALE = 1024
K = 10
SLICES = 2
ROWS, QUERIES = 2048, 1024
#: For the cutoff so many times k rows of each query are scored in full.
LOOK = 4
#: Blocks of queries of up to so many bytes in all are sent to every executor; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20
LONG = 2**63 - 1
#: What a rounded double may be off by, as a share of itself.
SLACK = 2.0**-50


def usable(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v) without rows that lack an id or a vector, and without vectors with a component that is null or isn't finite, even times the scale. Rows of one id are rows like others."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * float(scale)) == float("inf"))))


def cuts_of(width: int, slices: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, slices + 1).astype(int).tolist()
    return list(zip(at, at[1:], strict=False))


def packed(ids: list[int], rows: list[np.ndarray], width: int, slices: int, scale: int) -> tuple[bytes, list[bytes]]:
    """The ids and the scaled values of each slice; shorter vectors end in zeros."""
    values = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        values[k, : len(r)] = np.floor(scale * r)
    return np.array(ids, "<i8").tobytes(), [np.ascontiguousarray(values[:, a:b]).tobytes() for a, b in cuts_of(width, slices)]


def matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data).reshape(n, -1)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of all rows of x with all of y, exact: doubles while every sum stays below 2**53, else Python's integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(x.shape[1], 1) >= 2**53:
        x, y = (np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape) for m in (x, y))
        return x @ y.T if x.shape[1] else np.zeros((len(x), len(y)), object)
    return x @ y.T


def as_doubles(scores) -> np.ndarray:
    """Scores as doubles, rounded where they must be, and cut off where they would be infinite."""
    most = 2**1023
    return np.array([float(max(-most, min(most, int(s)))) for s in scores]) if getattr(scores, "dtype", None) == object else np.asarray(scores, float)


def each(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {c: x[0] for c, x in b.slice(i, 1).to_pydict().items()}


def top_k(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", is_query=None, k: int = K, scale: int = SCALE, slices: int = SLICES, rows: int = ROWS, queries: int = QUERIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products with all rows of another id, ties to the smaller id.

    Components count as floor(scale * x). Queries are the rows for which is_query holds (all, if it is None). Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without an id. Each row counts, those that share an id too; query rows
    that share one have one ranking in common. Vectors of unequal length are compared as if the shorter ended in zeros. Scores beyond
    64 bits end at the largest number.
    """
    steps = Steps(df.sparkSession, "topk")
    vectors = usable(df, vec_id, vector, scale)
    asked = vectors if is_query is None else vectors.where(is_query("id"))
    width, n_rows = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width, n_asked = width or 0, asked.count()
    n_q = max(1, -(-n_asked // queries))

    def pack_rows(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        own: list[np.ndarray] = []

        def block():
            i, parts = packed(ids, own, width, slices, scale)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) | n]), pa.array([i]), pa.array([parts], pa.list_(pa.binary()))], ["block", "v_ids", "v_slices"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                ids.append(i)
                own.append(np.asarray(v.values.to_numpy(zero_copy_only=False), float))
                if len(ids) == rows:
                    yield block()
                    n, ids, own = n + 1, [], []
        if ids:
            yield block()

    def pack_queries(key, table):
        i, parts = packed(table["id"].to_pylist(), [np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in table["v"].combine_chunks()], width, slices, scale)
        return pa.table({"q": key[:1], "q_ids": pa.array([i]), "q_slices": pa.array([parts], pa.list_(pa.binary()))})

    v = steps.write(vectors.mapInArrow(pack_rows, "block long, v_ids binary, v_slices array<binary>"))
    dealt = asked.withColumn("q", F.pmod(F.xxhash64("id", "v"), F.lit(n_q)).cast("int"))
    q = steps.write(dealt.groupBy("q").applyInArrow(pack_queries, "q int, q_ids binary, q_slices array<binary>"))
    near = (lambda x: F.broadcast(x)) if 8 * n_asked * max(width, 1) <= broadcast_bytes else (lambda x: x)
    v_nodes = v.select("block", "v_ids", F.posexplode("v_slices").alias("slice", "v_data"))
    q_nodes = q.select("q", "q_ids", F.posexplode("q_slices").alias("slice", "q_data"))

    def scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, own = np.frombuffer(row["v_ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
        y = matrix(row["q_data"], len(own))
        if row.get("wanted") is not None:
            at = np.array(row["wanted"], int)
            y, own = y[at], own[at]
        return product(matrix(row["v_data"], len(ids)), y), ids, own

    entry = "q int, qpos int, block long, pos int, slice int, score double"

    def entries(row, qpos, pos, score):
        n = len(pos)
        columns = [pa.array(np.full(n, row["q"]), pa.int32()), pa.array(qpos, pa.int32()), pa.array(np.full(n, row["block"]), pa.int64()), pa.array(pos, pa.int32()), pa.array(np.full(n, row["slice"]), pa.int32()), pa.array(as_doubles(score), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["q", "qpos", "block", "pos", "slice", "score"])

    def gather(batches):
        for row in each(batches):
            s, ids, own = scores(row)
            s = as_doubles(s.ravel()).reshape(s.shape)
            s[ids[:, None] == own] = -np.inf
            best = np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k]
            value = np.take_along_axis(s, best, 0)
            pos, qpos = best.T.ravel(), np.repeat(np.arange(len(own)), len(best))
            value = value.T.ravel()
            ok = value > -np.inf
            yield entries(row, qpos[ok], pos[ok], value[ok])

    spread = v_nodes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    sent = steps.write(spread.join(near(q_nodes), ["q", "slice"]).mapInArrow(gather, entry))

    def resolved(candidates: DataFrame) -> DataFrame:
        """(q, qpos, query_id, vec_id, total, score) of the candidates (q, qpos, block, pos), from all their slices."""

        def run(batches):
            for row in each(batches):
                ids, own = np.frombuffer(row["v_ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                x, y = (np.hstack([matrix(d, n) for d in row[c]]) for c, n in (("v_slices", len(ids)), ("q_slices", len(own))))
                pos, qpos = np.array([c["pos"] for c in row["some"]]), np.array([c["qpos"] for c in row["some"]])
                out = []
                for at in range(0, len(pos), 1 << 14):
                    a, b = x[pos[at : at + (1 << 14)]], y[qpos[at : at + (1 << 14)]]
                    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) >= 2**53:
                        out += [sum(int(m) * int(n) for m, n in zip(c, d, strict=True)) for c, d in zip(a.tolist(), b.tolist(), strict=True)]
                    else:
                        out += (a * b).sum(1).astype(np.int64).tolist()
                doubles = as_doubles(np.array(out, object))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), row["q"]), pa.int32()), pa.array(qpos, pa.int32()), pa.array(own[qpos]), pa.array(ids[pos]), pa.array(doubles), pa.array([max(-LONG - 1, min(LONG, t)) for t in out], pa.int64())], ["q", "qpos", "query_id", "vec_id", "total", "score"])

        by_block = candidates.groupBy("block", "q").agg(F.collect_list(F.struct("qpos", "pos")).alias("some"))
        return by_block.join(v, "block").join(near(q), "q").mapInArrow(run, "q int, qpos int, query_id long, vec_id long, total double, score long")

    by_query = Window.partitionBy("q", "qpos")
    known = sent.groupBy("q", "qpos", "block", "pos").agg(F.sum("score").alias("sum"))
    look = known.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("sum"), "block", "pos"))).where(F.col("r") <= LOOK * k)
    first = resolved(look.select("q", "qpos", "block", "pos"))
    cut = first.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("total")))).where(F.col("r") <= k).groupBy("q", "qpos").agg(F.min("total").alias("low"), F.count("*").alias("n"))
    least = steps.write(cut.where(F.col("n") >= k).select("q", "qpos", (F.col("low") - F.abs("low") * SLACK).alias("cutoff")))
    upper = lambda c: c + F.abs(c) * SLACK  # noqa: E731  what a rounded sum may stand for
    reaches = F.col("cutoff").isNull() | (upper(F.col("score")) * slices >= F.col("cutoff"))
    # lists that may go on at or above the threshold: all that was sent reaches it, and the block has more rows than were sent
    lists = sent.groupBy("q", "qpos", "block", "slice").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    open_lists = lists.where(F.col("n") >= k).join(least, ["q", "qpos"], "left").where(reaches)
    asks = steps.write(open_lists.groupBy("block", "slice", "q").agg(F.collect_list(F.struct("qpos", "cutoff")).alias("asks")))

    def collect(batches):
        for row in each(batches):
            row["wanted"] = [a["qpos"] for a in row["asks"]]
            s, ids, own = scores(row)
            s = as_doubles(s.ravel()).reshape(s.shape)
            low = np.array([-np.inf if a["cutoff"] is None else a["cutoff"] for a in row["asks"]])
            pos, col = np.nonzero(((s + np.abs(s) * SLACK) * slices >= low) & (ids[:, None] != own))
            yield entries(row, np.array(row["wanted"])[col], pos, s[pos, col])

    more = asks.join(v_nodes, ["block", "slice"]).join(near(q_nodes), ["q", "slice"]).mapInArrow(collect, entry)
    enough = sent.join(least, ["q", "qpos"], "left").where(reaches).drop("cutoff").union(more.select("q", "qpos", "block", "pos", "slice", "score")).dropDuplicates(["q", "qpos", "block", "pos", "slice"])
    sums = enough.groupBy("q", "qpos", "block", "pos").agg(F.sum("score").alias("sum"), F.sum(F.abs("score")).alias("size"), F.count("*").alias("n"))
    left = sums.join(least, ["q", "qpos"], "left").where(F.col("cutoff").isNull() | (F.col("n") < slices) | (F.col("sum") + F.col("size") * SLACK >= F.col("cutoff")))
    found = resolved(left.select("q", "qpos", "block", "pos"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify rank <= 10
"""
