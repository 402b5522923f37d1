"""Mixing sources to target weights, with DataFrame functions only.

Source s, with the share p(s) of all tokens, gets the weight p(s)**a / sum of p**a. The exponent a is
bisected until the weights' entropy meets its target, or, where that would repeat a source more often than
allowed, until the most repeated source meets the limit. A budget of tokens is then realised in blocks:
a source's documents fall into blocks by a hash of their id, each block is permuted, and takes whole
permutations and a part of one more, up to its share of the source's budget. A block holds a bounded number
of documents on average, so a hot source is spread over many tasks and no total order is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, hidden

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
BUDGET_RATIO = 1.0
BLOCK_DOCS = 2048
SEED = "mix"
#: Blocks whose limits are sent to every executor, at most: some tens of bytes each.
NEAR_ROWS = 200_000
#: Names of the columns that mix() adds, after its prefix.
ADDED = ("tokens", "weight", "copies", "block", "place")
#: The exponent is known to 2**-LEVELS of its bracket; LEVELS_A_JOB of them are tried by one job.
LEVELS = 30
LEVELS_A_JOB = 6
MAX_EXPONENT = 64.0
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shares(df: DataFrame, source: str, tokens: str) -> DataFrame:
    """Documents, tokens and share of tokens of each source; sources without a token have a null share."""
    totals = Steps(df.sparkSession, "mixing").write(df.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("tokens")))
    whole = F.lit(float(totals.agg(F.sum("tokens").alias("n")).first().n or 0))
    return totals.withColumn("all_tokens", whole).withColumn("log_share", F.when(F.col("tokens") > 0, F.ln(F.col("tokens") / whole)))


def profile(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent the weights' entropy and how often the most repeated source is seen for a budget of all tokens."""
    each = sources.where("log_share is not null").select("log_share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.exp(F.col("a") * F.col("log_share"))
    sums = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("log_share")).alias("s"), F.max((F.col("a") - 1) * F.col("log_share")).alias("m"))
    return {r.a: (math.log(r.z) - r.a * r.s / r.z, math.exp(r.m - math.log(r.z))) for r in sums.collect()}


def bisect(sources: DataFrame, lo: float, hi: float, good, low: bool = False) -> float:
    """The upper end (or the lower) of the last bracket; good() holds at hi and not at lo. One job tries several levels."""
    for at in range(0, LEVELS, LEVELS_A_JOB):
        n = 2 ** min(LEVELS_A_JOB, LEVELS - at)
        start, step = lo, (hi - lo) / n
        seen = profile(sources, [start + step * i for i in range(1, n)])
        i, j = 0, n
        while j - i > 1:
            mid = (i + j) // 2
            i, j = (i, mid) if good(*seen[start + step * mid]) else (mid, j)
        lo, hi = start + step * i, start + step * j
    return lo if low else hi


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO) -> float:
    """The exponent at which the weights' entropy is entropy_share of the most there can be, or, where a source
    would then be repeated more than max_repeats times, the one nearest to it at which none is.

    1 where no exponent up to MAX_EXPONENT meets the target (equal shares, one source, no token), or where even
    natural shares break the limit.
    """
    n = sources.where("log_share is not null").count()
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)
    at = profile(sources, [0.0, *[2.0**k for k in range(int(math.log2(MAX_EXPONENT)) + 1)]])
    even = lambda h, _: h <= target
    if even(*at[1.0]):
        a = bisect(sources, 0.0, 1.0, even) if not even(*at[0.0]) else 0.0
    else:
        hi = next((x for x in sorted(at) if x > 1 and even(*at[x])), None)
        if hi is None:
            return 1.0
        a = bisect(sources, hi / 2, hi, even)
    few = lambda _, r: r * budget_ratio <= max_repeats
    if few(*profile(sources, [a])[a]):
        return a
    if not few(*at[1.0]):
        return 1.0
    return bisect(sources, a, 1.0, few) if a < 1 else bisect(sources, 1.0, a, lambda h, r: not few(h, r), low=True)


def counted(df: DataFrame, text: str, source: str, tokens: str, key: str) -> DataFrame:
    """The rows with the words of the whole text, and the source as a key that no null equals."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return df.withColumn(tokens, words).withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))


def digest_of(text: str, doc_id: str, seed: str) -> F.Column:
    """What deals a row to its block and permutes it there: a digest of its id or, without one, of its text, so that rows without an id don't lie in one block."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def rates_of(rows: DataFrame, key: str, tokens: str, weight: str, rate: str, docs: str, entropy_share: float, max_repeats: float, budget_ratio: float) -> DataFrame:
    """(key, weight, rate, docs): each source's weight, how often its documents are taken on average, and their number."""
    sources = shares(rows, key, tokens)
    a = exponent(sources, entropy_share, max_repeats, budget_ratio)
    power = F.exp(F.lit(a) * F.col("log_share"))
    z = sources.agg(F.sum(power).alias("z")).first().z
    w = F.coalesce(power / F.lit(z or 1.0), F.lit(0.0))
    taken = F.coalesce(F.round(w * F.lit(budget_ratio) * F.col("all_tokens") / F.when(F.col("tokens") > 0, F.col("tokens")), 9), F.lit(0.0))
    return sources.select(F.col(key), F.round(w, 12).alias(weight), taken.alias(rate), F.col("docs").alias(docs))


def placed_in_blocks(rows: DataFrame, key: str, tokens: str, perm: str, block: str, rate: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Adds each row's place in its block's permutation, the tokens before it, the block's tokens, and whether the part of a permutation that is left over reaches it."""
    place, before, whole, part = names
    inside = Window.partitionBy(key, block)
    ordered = inside.orderBy(F.reverse(perm), tokens)
    out = rows.withColumn(place, F.row_number().over(ordered).cast("long"))
    out = out.withColumn(before, F.sum(tokens).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn(whole, F.sum(tokens).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rest = F.col(rate) - F.floor(rate)
    reached = 2 * F.coalesce(F.col(before), F.lit(0)) + F.col(tokens) <= 2 * rest * F.col(whole)
    return out.withColumn(part, reached & (rest > 0))


def number(digest) -> F.Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO, block_docs: int = BLOCK_DOCS, seed: str = SEED, prefix: str = "mix_", with_text: bool = True) -> DataFrame:
    """Adds to each row how often the mixture takes it and where.

    mix_tokens: words of the whole text (null: 0); mix_weight: its source's weight (0 if the source has no
    token); mix_copies: how many times the row is taken, 0 included; mix_block and mix_place: its block within
    the source, and its place from 1 in the block's permutation. A null source is a source of its own.
    Repeated rows count each; rows that share an id lie in one block, in order of tokens; a row without an id goes by its text. Columns of these
    names are replaced. Without the text, each text is read and counted once, and only the other columns are written and sorted.
    """
    names = [prefix + n for n in ADDED]
    df = df.drop(*names)
    tokens, weight, copies, block, place = names
    key, perm, before, whole, rate, docs, part = (hidden(df, n) for n in ("mix_key", "mix_perm", "mix_before", "mix_whole", "mix_rate", "mix_docs", "mix_part"))
    rows = counted(df, text, source, tokens, key).withColumn(perm, digest_of(text, doc_id, seed))
    kept = [c for c in df.columns if with_text or c != text]
    if not with_text:
        rows = Steps(df.sparkSession, "mixing").write(rows.drop(text))
    rates = rates_of(rows, key, tokens, weight, rate, docs, entropy_share, max_repeats, budget_ratio)
    placed = rows.join(rates, key)
    placed = placed.withColumn(block, number(F.col(perm)) % F.ceil(F.col(docs) / F.lit(block_docs)))
    placed = placed_in_blocks(placed, key, tokens, perm, block, rate, (place, before, whole, part))
    placed = placed.withColumn(copies, F.floor(rate).cast("long") + F.when(F.col(part), 1).otherwise(0))
    return placed.select(*[F.col(f"`{c}`") for c in kept], *names)


def sample(mixed: DataFrame, prefix: str = "mix_") -> DataFrame:
    """The mixture itself: each row as often as it is taken, without the columns that mix() added."""
    copy = hidden(mixed, "mix_copy")
    taken = mixed.where(F.col(f"{prefix}copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies"))))
    return taken.drop(copy, *[prefix + n for n in ADDED])


def take(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO, block_docs: int = BLOCK_DOCS, seed: str = SEED, near_rows: int = NEAR_ROWS) -> DataFrame:
    """The mixture itself, the rows of sample(mix(df)), without moving a text.

    What decides about a row is how far its block's permutation is taken: the last digest, and tokens, that are. These limits, one a block,
    are joined to the rows where they lie, up to near_rows of them as a broadcast.
    """
    key, perm, tokens, block, rate, docs, weight, copy, limit = (hidden(df, n) for n in ("mix_key", "mix_perm", "mix_tokens", "mix_block", "mix_rate", "mix_docs", "mix_weight", "mix_copy", "mix_limit"))
    steps = Steps(df.sparkSession, "mixing")
    small = df.select(*[F.col(f"`{c}`") for c in {text, source, doc_id}])
    rows = steps.write(counted(small, text, source, tokens, key).select(F.col(key), F.col(tokens), digest_of(text, doc_id, seed).alias(perm)))
    rates = steps.write(rates_of(rows, key, tokens, weight, rate, docs, entropy_share, max_repeats, budget_ratio))
    of_block = lambda r: r.withColumn(block, number(F.col(perm)) % F.ceil(F.col(docs) / F.lit(block_docs)))
    placed = placed_in_blocks(of_block(rows.join(rates, key)), key, tokens, perm, block, rate, ("place", "before", "whole", "part"))
    limits = steps.write(placed.groupBy(key, block).agg(F.max(F.when(F.col("part"), F.struct(F.reverse(perm).alias("p"), F.col(tokens).alias("t")))).alias(limit)))
    steps.drop(rows)
    near = lambda x: F.broadcast(x) if x.count() <= near_rows else x
    keyed = df.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))).withColumn(perm, digest_of(text, doc_id, seed))
    joined = of_block(keyed.join(near(rates), key)).join(near(limits), [key, block])
    own = F.reverse(perm)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    # a text is only counted again where the digest is the last one's own
    within = F.when(own < F.col(f"{limit}.p"), True).when(own == F.col(f"{limit}.p"), words <= F.col(f"{limit}.t")).otherwise(False)
    copies = F.floor(rate).cast("long") + F.when(F.col(limit).isNotNull() & within, 1).otherwise(0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])


#: The same in SQL, with one bisection for each way in which the limit can bind.
ORACLE = rf"""
with recursive docs as (
  select doc_id, source, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as own, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n from documents
), src as (
  select source, count(*) as docs, sum(n)::bigint as t, sum(sum(n)) over ()::double as every from docs group by source
), sh as (
  select *, case when t > 0 then ln(t / every) end as lp from src
), k as (select {ENTROPY_SHARE} * ln(count(lp)) as target, count(lp) as n from sh),
top as (
  select min(a) as hi from (select power(2, e)::double as a from range(0, 7) r(e)) x
  where (select ln(sum(exp(a * lp))) - a * sum(exp(a * lp) * lp) / sum(exp(a * lp)) from sh) <= (select target from k)
), bis as (
  select 0 as i, case when hi = 1 then 0.0 else hi / 2 end::double as lo, hi::double as hi from top
  union all
  select i + 1, case when good then lo else m end, case when good then m else hi end from (
    select i, lo, hi, (lo + hi) / 2 as m,
      (select ln(sum(exp((lo + hi) / 2 * lp))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * lp) * lp) / sum(exp((lo + hi) / 2 * lp)) from sh) <= (select target from k) as good
    from bis where i < {LEVELS} and hi is not null) s
), chosen as (select coalesce((select hi from bis where i = {LEVELS}), 1.0) as a0),
lim as (
  select 0 as i, least(a0, 1.0)::double as lo, greatest(a0, 1.0)::double as hi from chosen
  union all
  select i + 1, case when good = (a0 < 1) then lo else m end, case when good = (a0 < 1) then m else hi end from (
    select i, lo, hi, (lo + hi) / 2 as m, a0,
      (select max(exp(((lo + hi) / 2 - 1) * lp)) / sum(exp((lo + hi) / 2 * lp)) from sh) * {BUDGET_RATIO} <= {MAX_REPEATS} as good
    from lim, chosen where i < {LEVELS}) s
), expo as (
  select case
    when (select max(exp((a0 - 1) * lp)) / sum(exp(a0 * lp)) from sh) * {BUDGET_RATIO} <= {MAX_REPEATS} then a0
    when {BUDGET_RATIO} > {MAX_REPEATS} then 1.0
    when a0 < 1 then (select hi from lim where i = {LEVELS}) else (select lo from lim where i = {LEVELS}) end as a from chosen
), w as (
  select source, docs, t, every, coalesce(exp(a * lp) / (select sum(exp(a * lp)) from sh), 0) as w from sh, expo
), rates as (
  select source, docs, round(w, 12) as weight, coalesce(round(w * {BUDGET_RATIO} * every / nullif(t, 0), 9), 0) as rate from w
), placed as (
  select d.doc_id, d.source, d.n, r.weight, r.rate, md5('{SEED}:' || d.own) as h, r.docs
  from docs d join rates r on d.source is not distinct from r.source
), blocks as (
  select *, ('0x' || h[1:15])::bigint % ceil(docs / {BLOCK_DOCS})::bigint as b from placed
), runs as (
  select *, row_number() over o as place, coalesce(sum(n) over (partition by source, b order by reverse(h), n rows between unbounded preceding and 1 preceding), 0) as before,
    sum(n) over (partition by source, b) as whole
  from blocks window o as (partition by source, b order by reverse(h), n)
)
select doc_id, source, n as mix_tokens, round(weight, 9) as mix_weight,
  (floor(rate) + case when rate > floor(rate) and 2 * before + n <= 2 * (rate - floor(rate)) * whole then 1 else 0 end)::bigint as mix_copies,
  b::bigint as mix_block, place::bigint as mix_place
from runs
"""
