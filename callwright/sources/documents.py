"""One JSON document from sorted rows, however many rows one group has.

No group is ever one row: a row becomes one line that holds its own record and the opening, separating and
closing signs that its place asks for.  It opens each level whose first row it is and closes each level
whose last row it is; both follow from its position in the level and the level's size.  The lines are
written in order by many tasks; the part files, one behind the other, are the document.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import json_string
from ..operators.index import int_digits, positions, text_digits


class Level(NamedTuple):
    """Rows with equal ``keys`` stand together between ``opening`` and ``closing``."""

    keys: list[str]
    opening: Column
    closing: str


def document_lines(df: DataFrame, levels: list[Level], order_cols, digits: list[Column], record: Column) -> DataFrame:
    """(line_no, line): the document in lines, one for each row, ordered by the levels' keys and ``order_cols``.

    ``levels``: outermost first, each with the keys of those around it; the first one has none.  ``digits`` of the
    order columns, coarse to fine, deal the rows of one innermost group over tasks.  An empty table has no line.
    """
    keys = levels[-1].keys
    order = [*keys, *order_cols]
    out = df.withColumn("_record", record).withColumns({f"_open{i}": level.opening for i, level in enumerate(levels)})
    for i, level in enumerate(levels):
        inner = [F.col(k) for k in keys if k not in level.keys]
        out = positions(out, order, f"_at{i}", level.keys, [*inner, *digits], group_size=f"_size{i}")
    opens = [F.when(F.col(f"_at{i}") == 0, F.col(f"_open{i}")).otherwise("") for i in range(len(levels))]
    closes = [F.when(F.col(f"_at{i}") == F.col(f"_size{i}") - 1, F.lit(level.closing)).otherwise("") for i, level in enumerate(levels)]
    between = F.when(F.col("_at0") == 0, "").otherwise(",")
    return out.select(F.col("_at0").alias("line_no"), F.concat(between, *opens, "_record", *closes[::-1]).alias("line"))


def write_document(lines: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """The lines as text files whose names are in the document's order; their number is left to Spark or given."""
    ranges = [files, "line_no"] if files else ["line_no"]
    lines.repartitionByRange(*ranges).sortWithinPartitions("line_no").select("line").write.mode(mode).text(path)


def by_function(calls: DataFrame, record: Column, row_col: str = "row_id", pos_col: str = "pos") -> DataFrame:
    """K6: ``{"AA": [record, ...], ...}``, calls of a function in row and call order."""
    levels = [Level([], F.lit("{"), "}"), Level(["func"], F.concat(json_string("func"), F.lit(":[")), "]")]
    return document_lines(calls, levels, [row_col, pos_col], int_digits(row_col), record)


def function_spec_document(spec: DataFrame) -> DataFrame:
    """K8: ``{"functions": [{"name", "description", "args": [{"name", "type", "enum": [...]}]}]}`` of A8's long form."""
    member = lambda name, c: F.concat(F.lit(f'"{name}":'), json_string(c))
    function = F.concat(F.lit("{"), member("name", "func"), F.lit(","), member("description", "description"), F.lit(',"args":['))
    argument = F.concat(F.lit("{"), member("name", "arg_key"), F.lit(","), member("type", "arg_type"), F.lit(',"enum":['))
    levels = [Level([], F.lit('{"functions":['), "]}"), Level(["func"], function, "]}"), Level(["func", "arg_key"], argument, "]}")]
    return document_lines(spec, levels, ["enum_pos"], [F.shiftright("enum_pos", 20)], F.col("enum_value"))


def value_list_document(values: DataFrame) -> DataFrame:
    """``[{"func", "arg_key", "values": [...]}]`` of A7's long form."""
    entry = F.concat(F.lit('{"func":'), json_string("func"), F.lit(',"arg_key":'), json_string("arg_key"), F.lit(',"values":['))
    levels = [Level([], F.lit("["), "]"), Level(["func", "arg_key"], entry, "]}")]
    return document_lines(values, levels, ["value"], text_digits("value"), json_string("value"))
