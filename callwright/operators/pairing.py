"""Function pairing of single-call utterances.

X3 half sample: inside each function, the first ``floor(n/2)`` rows by a seeded md5 key go to the
pairing pool.  The last such key of each function is selected by histograms (``select``), so
the table itself is neither sorted nor shuffled, however many rows one function has.

X4 maximum pairing of different functions, closed form (no heap, no driver loop):
order the pool by (group size desc, function, key), N rows, largest group M, h = N // 2.
If M <= h: offset = h and h pairs, else offset = M and N - M pairs; row i pairs with
row i + offset.  No pair shares a function and the count equals the greedy's.  A row's place is
its function's start (prefix sums of the group sizes, one row for each function) plus its rank in
the function (buckets of the md5 key); the pairing itself is one equi self-join on the place.
Pairing needs the ranks anyway, so ``half_sample(.., ranked=True)`` takes the half from them and
keeps them; the pool and the rest are then placed without another pass.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import ensure_end, func_from_cell
from .index import md5_digits, positions, rank_in_group
from .select import first_of_groups

JOINER = " 다음으로 "  # Fixed value: the word joining two utterances of a pair.


def _key(col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def half_sample(df: DataFrame, id_col: str = "index", func_col: str = "function", seed: int = 42, ranked: bool = False) -> DataFrame:
    """X3 (+ P21): ``func_name``, ``in_pool``; rows without a function name are dropped.  ``ranked`` adds ``_r``, the
    rank in the function (from 1), and ``_half``, how many of it are in the pool."""
    named = df.withColumn("func_name", func_from_cell(F.col(func_col))).filter(F.col("func_name") != "").withColumn("_k", _key(id_col, seed))
    if ranked:
        placed = positions(named, ["_k", id_col], "_r", ["func_name"], md5_digits("_k"), group_size="_n")
        placed = placed.withColumn("_half", F.floor(F.col("_n") / 2)).withColumn("_r", F.col("_r") + 1).drop("_n")
        return placed.withColumn("in_pool", F.col("_r") <= F.col("_half"))
    return first_of_groups(named, ["func_name"], "_k", id_col, lambda n: F.floor(n / 2), "in_pool")


def _ranked(df: DataFrame, id_col: str, name: str) -> DataFrame:
    return rank_in_group(df, ["func_name"], ["_k", id_col], name, md5_digits("_k"))


class PoolPlan(NamedTuple):
    """One row per function: pool size ``gsize``, rows before it in the pool (``_start``) and outside of it
    (``_out_start``); the distance between partners, the number of pairs, the rows outside the pool."""

    sizes: DataFrame
    offset: int
    pairs: int
    outside: int


def pool_plan(sampled: DataFrame) -> PoolPlan:
    """The driver sees two numbers for each function name."""
    counted = sampled.groupBy("func_name").agg(F.count_if("in_pool").alias("pool"), F.count_if(~F.col("in_pool")).alias("out"))
    rows = sorted(tuple(r) for r in counted.collect())
    starts, run = {}, 0
    for name, pool, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        starts[name] = run
        run += pool
    out_start, table = 0, []
    for name, pool, out in rows:
        table.append((name, pool, starts[name], out_start))
        out_start += out
    sizes = sampled.sparkSession.createDataFrame(table, "func_name string, gsize bigint, _start bigint, _out_start bigint")
    n, m = run, max((r[1] for r in rows), default=0)
    h = n // 2
    return PoolPlan(sizes, h, h, out_start) if m <= h else PoolPlan(sizes, m, n - m, out_start)


def pair_pool(sampled: DataFrame, id_col: str = "index", seed: int = 42, plan: PoolPlan | None = None):
    """Returns (pairs, leftovers).  pairs: (pair_no, a_*, b_*); leftovers: pool rows left unpaired, with
    ``left_no`` from 0 (they are all of one function, the largest, so their places follow one another).
    ``plan`` is the pool's ``pool_plan`` where the caller has it already."""
    sizes, offset, pairs, _ = plan or pool_plan(sampled)
    pool = sampled.filter("in_pool")
    pool = pool if "_r" in sampled.columns else _ranked(pool, id_col, "_r")
    ordered = pool.join(sizes, "func_name").withColumn("pos", F.col("_start") + F.col("_r") - 1).drop("gsize", "_start", "_out_start", "_r", "_half")
    cols = [c for c in sampled.columns if c not in ("in_pool", "_r", "_half")]
    a = ordered.filter(F.col("pos") < pairs).select(F.col("pos").alias("pair_no"), *[F.col(c).alias("a_" + c) for c in cols])
    b = ordered.filter((F.col("pos") >= offset) & (F.col("pos") < offset + pairs)).select(
        (F.col("pos") - offset).alias("pair_no"), *[F.col(c).alias("b_" + c) for c in cols]
    )
    paired = a.join(b, "pair_no")
    # what no pair takes: places from ``pairs`` to ``offset`` (all of the largest function), or the last of an odd pool
    left = (F.col("pos") >= pairs) & (F.col("pos") < offset) | (F.col("pos") >= offset + pairs)
    first = pairs if offset > pairs else offset + pairs
    leftovers = ordered.filter(left).withColumn("left_no", F.col("pos") - first).drop("pos")
    return paired, leftovers


def merge_pairs(paired: DataFrame, query_col: str = "query", func_col: str = "function", seed: int = 42, strip_inner_end: bool = False) -> DataFrame:
    """Random order from an md5 bit of the pair number; ``q1 다음으로 q2`` and ``f1;f2<end>``; ids P%06d.

    D15: the reference appends ``<end>`` without removing one already inside a part; pass
    ``strip_inner_end=True`` to drop a part's own trailing ``<end>`` first."""
    bit = F.substr(F.md5(F.concat(F.lit(f"{seed}:pair:"), F.col("pair_no").cast("string"))), F.lit(1), F.lit(1)).isin(*"01234567")
    qa, qb = F.col("a_" + query_col), F.col("b_" + query_col)
    fa, fb = F.col("a_" + func_col), F.col("b_" + func_col)
    if strip_inner_end:
        fa, fb = F.regexp_replace(fa, r"<end>\s*$", ""), F.regexp_replace(fb, r"<end>\s*$", "")
    query = F.when(bit, F.concat(qa, F.lit(JOINER), qb)).otherwise(F.concat(qb, F.lit(JOINER), qa))
    function = F.when(bit, F.concat(fa, F.lit(";"), fb, F.lit("<end>"))).otherwise(F.concat(fb, F.lit(";"), fa, F.lit("<end>")))
    return paired.select(
        F.concat(F.lit("P"), F.lpad(F.col("pair_no").cast("string"), 6, "0")).alias("index"), query.alias("query"), function.alias("function"), "pair_no"
    )


def singles(
    sampled: DataFrame, leftovers: DataFrame, n_pairs: int, id_col: str = "index", query_col: str = "query", func_col: str = "function", plan: PoolPlan | None = None
) -> DataFrame:
    """Rows outside the pool then pool leftovers, ``<end>`` ensured, ids continuing after the pairs."""
    plan = plan or pool_plan(sampled)
    outside = sampled.filter(~F.col("in_pool"))
    placed = outside.withColumn("_r", F.col("_r") - F.col("_half")) if "_r" in sampled.columns else _ranked(outside, id_col, "_r")
    first = placed.join(plan.sizes, "func_name").withColumn("_i", F.col("_out_start") + F.col("_r") - 1)
    last = leftovers.withColumn("_i", F.col("left_no") + plan.outside)
    cols = ["_i", query_col, func_col]
    return first.select(*cols).unionByName(last.select(*cols)).select(
        F.concat(F.lit("P"), F.lpad((F.col("_i") + n_pairs).cast("string"), 6, "0")).alias("index"),
        F.col(query_col).alias("query"),
        ensure_end(F.col(func_col)).alias("function"),
    )


def pairing_report(df: DataFrame, func_col: str = "function") -> DataFrame:
    """Number of pairs and singles, from the group sizes alone: half of each group is pooled, the pool
    gives as many pairs as halves or as partners of its largest group, all other rows stay single."""
    sizes = df.select(func_from_cell(F.col(func_col)).alias("func_name")).filter(F.col("func_name") != "").groupBy("func_name").agg(F.count(F.lit(1)).alias("n"))
    half = F.floor(F.col("n") / 2)
    total = sizes.agg(*[F.coalesce(x, F.lit(0)).alias(a) for x, a in ((F.sum("n"), "rows"), (F.sum(half), "pool"), (F.max(half), "largest"))])
    pairs = F.least(F.floor(F.col("pool") / 2), F.col("pool") - F.col("largest"))
    kinds = [F.struct(F.lit(kind).alias("kind"), count.cast("bigint").alias("count")) for kind, count in (("pairs", pairs), ("singles", F.col("rows") - 2 * pairs))]
    return total.select(F.inline(F.array(*kinds)))
