"""Distributed selection: the first k rows of a table or of each group, without sorting it.

The k-th key is found by radix histograms.  Rows are counted by a leading digit of the order key, the
running sum tells in which digit the k-th row lies, and only that digit's rows are looked at further.  All
other rows are in or out by comparing a digit; they are neither sorted nor moved.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import hex_digits

#: Rows that one sort may take; larger digits are split by their next digit.
SORT_ROWS = 100_000


def first_of_groups(df: DataFrame, group_cols, key: str, tie: str, wanted, name: str) -> DataFrame:
    """Adds ``name``: whether the row is among the first ``wanted(rows of its group)`` rows of its group in the
    order of (``key``, ``tie``).  ``key`` holds md5 hex digits; (``key``, ``tie``) must be unique in a group.

    Three narrow passes: a histogram of the first hex digits for each group, the k-th key among the rows of the
    one digit that holds it, and a comparison with that key, one row for each group.
    """
    group_cols = list(group_cols)
    group, digit = F.struct(*group_cols), F.left("_key", F.lit(hex_digits()))
    keys = df.select(group.alias("_group"), F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    of_group = Window.partitionBy("_group")
    upto = of_group.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    counted = keys.groupBy("_group", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_rows"))
    counted = counted.withColumns({"_upto": F.sum("_rows").over(upto), "_wanted": wanted(F.sum("_rows").over(of_group))})
    # the digit in which the last wanted row lies, and how many of its rows are wanted
    cut = counted.where("_upto >= _wanted and _upto - _rows < _wanted").select("_group", "_digit", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_need"))
    inside = keys.withColumn("_digit", digit).join(cut, ["_group", "_digit"])
    nth = F.row_number().over(of_group.orderBy("_key", "_tie"))
    last = inside.withColumn("_nth", nth).where("_nth = _need").select("_group", F.struct("_key", "_tie").alias("_last"))
    joined = df.withColumn("_group", group).join(last, "_group", "left")
    upto_last = F.struct(F.col(key).alias("_key"), F.col(tie).alias("_tie")) <= F.col("_last")
    return joined.withColumn(name, F.coalesce(upto_last, F.lit(False))).drop("_group", "_last")


def _digits(df: DataFrame, column: str):
    """The column's digits, coarse to fine; without end for texts."""
    kind, c = df.schema[column].dataType, F.col(column)
    yield c.isNotNull()  # nulls first
    if isinstance(kind, T.StringType):
        at = 1
        while True:
            yield F.substring(c, at, 2)
            at += 2
    elif isinstance(kind, T.IntegralType):
        c = c.cast("bigint")
        yield F.shiftright(c, 48)
        for low in (32, 16, 0):
            yield F.shiftright(c, low).bitwiseAND(F.lit(0xFFFF))
    else:
        yield c


def first_rows(df: DataFrame, order_cols, n: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """The first ``n`` rows in the order of ``order_cols`` (ascending, nulls first).

    Rows are counted by one digit of the key after the other, each time only those that agree with the cut so
    far, until the digit with the n-th row holds few enough rows to sort.  The driver sees one row for each digit.
    """
    order_cols = list(order_cols)
    less, same, need = F.lit(False), F.lit(True), n
    for column in order_cols:
        for digit in _digits(df, column):
            counted = df.where(same).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
            cut = counted.withColumn("upto", upto).where(F.col("upto") >= need).orderBy("digit").first()
            if cut is None:  # fewer rows than wanted: only possible before the first cut
                return df
            here: Column = digit.isNull() if cut.digit is None else digit == F.lit(cut.digit)
            before = F.lit(False) if cut.digit is None else digit.isNull() | (digit < F.lit(cut.digit))
            less, same, need = less | (same & F.coalesce(before, F.lit(False))), same & F.coalesce(here, F.lit(False)), need - (cut.upto - cut.n)
            if cut.n <= max(need, sort_rows) or cut.digit in (None, ""):
                break  # few enough, all of them wanted, or the column has no further digit
        else:
            continue
        if cut.n <= max(need, sort_rows):
            break
    rest = df.where(same)
    rest = rest if cut.n == need else rest.orderBy(*order_cols).limit(need)
    return df.where(less).unionByName(rest)
