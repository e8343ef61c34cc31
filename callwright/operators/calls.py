"""Call tables: one row per call and one row per argument.

Long tables instead of the reference's dynamic ``arg.<k>`` columns, so the schema
is fixed however many argument keys the corpus holds.  Both are narrow
projections + explodes: no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.args import with_args
from ..functions.tags import extract_calls, extract_calls_profile

READERS = {"tags": extract_calls, "profile": extract_calls_profile}


def calls_table(df: DataFrame, text_col: str = "llm_output", keys=("row_id",), reader: str = "tags") -> DataFrame:
    """``(keys..., pos, func, raw_args)``; pos is the 1-based call order inside the text."""
    extract = READERS[reader]
    # inline_outer + null filter: a plain inline makes the optimizer add an inferred
    # size(array) > 0 filter, which evaluates the extraction a second time
    return df.select(*keys, F.inline_outer(extract(F.col(text_col)))).filter(F.col("pos").isNotNull())


def call_args_table(calls: DataFrame, dialect: str = "plain", keys=("row_id",)) -> DataFrame:
    """``(keys..., pos, func, arg_pos, key, raw, vtype, canon, cmp)`` from a calls table."""
    parsed = with_args(calls.select(*keys, "pos", "func", "raw_args"), "raw_args", dialect, "args")
    exploded = parsed.select(*keys, "pos", "func", F.posexplode_outer("args").alias("arg_pos", "a")).filter(F.col("a").isNotNull())
    return exploded.select(
        *keys, "pos", "func", (F.col("arg_pos") + 1).alias("arg_pos"), "a.key", "a.raw", "a.vtype", "a.canon", "a.cmp"
    )


def calls_with_args(df: DataFrame, text_col: str = "llm_output", keys=("row_id",), reader: str = "tags", dialect: str = "plain") -> DataFrame:
    """Calls with their parsed argument array kept nested (one row per call)."""
    return with_args(calls_table(df, text_col, keys, reader), "raw_args", dialect, "args")
