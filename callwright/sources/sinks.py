"""Writers (K1-K10).  All are distributed writes; nothing is collected to the driver.

The reference writes single files; here each output is a folder of part files (the
standard layout on a cluster).  ``partitionBy`` gives one folder per split / function /
outcome, which is how the reference's per-split and per-function files map to Spark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _csv(df: DataFrame, path: str, mode: str) -> None:
    """CSV as Python's ``csv`` writes it: quotes are doubled, blanks at the ends of a cell stay."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**plain).csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """K1: chat rows partitioned by ``split`` as JSON lines (nulls kept); returns the split counts."""
    df.write.mode(mode).option("ignoreNullFields", False).partitionBy("split").json(path)
    return df.groupBy("split").count()


def split_report(df: DataFrame) -> DataFrame:
    """K1: one row with the rows of each split and, where the readers' ``src_kind`` and ``src_file`` are kept,
    the number of JSON and CSV files they came from."""
    counts = [F.count_if(F.col("split") == name).alias(name) for name in ("train", "eval", "test")]
    files = [F.count_distinct(F.when(F.col("src_kind") == kind, F.col("src_file"))).alias(name) for kind, name in ((0, "json_files"), (1, "csv_files"))]
    return df.agg(*counts, *(files if {"src_kind", "src_file"} <= set(df.columns) else []))


def write_converted_csv(converted: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: fixed six columns with header."""
    _csv(converted.select("func", "raw_args", "query", "map_func", "map_enum", "map_args"), path, mode)


def write_message_expected(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: ``{message, expected}`` JSON lines; expected stays JSON text."""
    df.select("message", "expected").write.mode(mode).json(path)


def write_by_extension(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4/K5: CSV for ``.csv``, JSON lines otherwise; nested columns become JSON text in CSV."""
    if path.lower().endswith(".csv"):
        flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields]
        _csv(df.select(*flat), path, mode)
    else:
        df.write.mode(mode).json(path)


def write_by_function(calls_with_source: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: one folder per function, rows ordered by (row, call order) inside each file.

    Range partitioning on (func, row_id, pos) splits a hot function over many tasks and files
    instead of sending it to one task."""
    calls_with_source.repartitionByRange("func", "row_id", "pos").sortWithinPartitions("func", "row_id", "pos").write.mode(mode).partitionBy("func").json(path)


def write_repair_results(statuses: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """K7: results split by outcome (success = already_ok / repaired_success); returns the E9 counts."""
    outcome = F.when(F.col("status").isin("already_ok", "repaired_success"), F.lit("success")).otherwise(F.lit("failure"))
    statuses.withColumn("outcome", outcome).write.mode(mode).partitionBy("outcome").json(path)
    return statuses.groupBy("status").count()


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Spec tables, evaluation rows, value lists and query lists as JSON lines."""
    df.write.mode(mode).json(path)
