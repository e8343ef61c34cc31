"""Exact, deterministic positions without a global sort, sampling or checkpoint (B2; O1, O2, W3, X2).

A position in a total order is the number of rows before the row's bucket plus the row's place in
the bucket.  Buckets follow from the row alone: ``digits`` of the order key, from coarse to fine, whose
order agrees with the order of the rows.  A task that is computed again therefore gives the same answer.

1. rows are counted by (group, digits): one pre-aggregated table with a row for each bucket;
2. prefix sums over the tree of digits, one window for each level, which never sees more rows than
   one digit has values;
3. rows meet their bucket's offset and are numbered within the bucket.

The input is evaluated twice and nothing runs while the query is built.  The usual digits:

* ``md5_digits``: the first hex digits of an md5 key, even buckets, one level (O2, X2, X3); their number follows
  ``spark.sql.shuffle.partitions``, which is set to suit the data (2 to 5 digits, some 16 buckets a partition);
* ``int_digits``: the number without its lowest 40 and 20 bits, two levels; a bucket spans 2**20
  numbers, so dense row numbers give buckets of a million;
* ``text_digits``: the first 8 and 32 signs.  Values of one group that share 32 signs share a bucket.

The order key must be unique (add the row key as the last column).  Nulls come first, as in an
ascending sort, and a null group is a group.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_digits() -> int:
    """Hex digits that give some 16 buckets for each shuffle partition: 256 to 1,048,576 buckets."""
    partitions = int(SparkSession.active().conf.get("spark.sql.shuffle.partitions", "200"))
    return min(5, max(2, math.ceil(math.log(16 * partitions, 16))))


def md5_digits(key) -> list[Column]:
    return [F.left(_col(key), F.lit(hex_digits()))]


def int_digits(key) -> list[Column]:
    key = _col(key).cast("bigint")
    return [F.shiftright(key, 40), F.shiftright(key, 20)]


def text_digits(key) -> list[Column]:
    return [F.left(_col(key), F.lit(n)) for n in (8, 32)]


def digits_of(df: DataFrame, order_col: str) -> list[Column]:
    """Digits of a column by its type; a column of any other type is one digit by itself."""
    kind = df.schema[order_col].dataType
    if isinstance(kind, T.StringType):
        return text_digits(order_col)
    if isinstance(kind, T.IntegralType):
        return int_digits(order_col)
    return [F.col(order_col)]


def positions(df: DataFrame, order_cols, name: str, group_cols=(), digits: list[Column] | None = None, group_min: dict[str, str] | None = None, group_size: str | None = None) -> DataFrame:
    """Adds ``name``: the 0-based position in the order of ``order_cols`` (ascending) within the group.

    ``digits`` (coarse to fine) must be ordered as the rows are; by default they come from the first order column.
    ``group_min`` names columns whose minimum in the group is added too, taken along with the counts;
    ``group_size`` names a column for the number of rows of the group.
    """
    order_cols, group_cols = list(order_cols), list(group_cols)
    digits = digits or digits_of(df, order_cols[0])
    levels = [f"_digit{i}" for i in range(len(digits))]
    # structs compare equal where their nulls are, so null groups and digits need no care of their own
    group = F.struct(*group_cols) if group_cols else F.struct(F.lit(0).alias("all"))
    rows = df.withColumns({"_group": group, **{n: F.struct(d.alias("d")) for n, d in zip(levels, digits)}})
    least = group_min or {}
    buckets = rows.groupBy("_group", *levels).agg(F.count(F.lit(1)).alias("_rows"), *[F.min(c).alias(n) for n, c in least.items()])
    offsets, above = buckets, buckets
    for depth in range(len(levels), 0, -1):
        parents, last = ["_group", *levels[: depth - 1]], levels[depth - 1]
        before = Window.partitionBy(*parents).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
        counted = above.withColumn(f"_before{depth}", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        if depth == 1:
            whole = Window.partitionBy("_group")
            counted = counted.withColumns({n: F.min(n).over(whole) for n in least} | ({group_size: F.sum("_rows").over(whole)} if group_size else {}))
        else:
            counted = counted.drop(*least)
        offsets = counted.drop("_rows") if depth == len(levels) else offsets.join(counted.drop("_rows"), ["_group", *levels[:depth]])
        above = above.groupBy(*parents).agg(F.sum("_rows").alias("_rows"), *[F.min(n).alias(n) for n in least])
    start = sum((F.col(f"_before{d}") for d in range(2, len(levels) + 1)), F.col("_before1"))
    more = [*least, *([group_size] if group_size else [])]
    offsets = offsets.select("_group", *levels, start.alias("_start"), *more)
    within = Window.partitionBy("_group", *levels).orderBy(*order_cols)
    placed = rows.join(offsets, ["_group", *levels]).withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name, *more)


def global_index(df: DataFrame, order_cols, name: str = "idx", digits: list[Column] | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the order of ``order_cols`` (ascending)."""
    return positions(df, order_cols, name, (), digits)


def rank_in_group(df: DataFrame, group_cols, order_cols, name: str = "rank", digits: list[Column] | None = None, group_min: dict[str, str] | None = None) -> DataFrame:
    """1-based rank inside each group; a hot group is spread over many buckets, never one task."""
    return positions(df, order_cols, name, group_cols, digits, group_min).withColumn(name, F.col(name) + 1)
