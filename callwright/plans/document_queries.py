"""Grouped documents as lines (K6, K8, K10); the oracles spell the same lines from SQL windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.args import json_string
from ..sources import documents
from . import catalog as c
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import register

_QUOTED = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


def _q(column: str) -> str:
    return _QUOTED.format(column)


BY_FUNCTION_ORACLE = (
    o.with_(o.TAGGED, o.PCALLS)
    + f""", r AS (SELECT func, row_id, pos, '{{"row_id":' || row_id || ',"call_order":' || pos || ',"raw_args":' || {_q("raw_args")} || ',"query":' || {_q("query")} || '}}' AS rec
  FROM pcalls JOIN tagged USING (row_id)),
p AS (SELECT *, row_number() OVER (ORDER BY func, row_id, pos) - 1 AS line_no, row_number() OVER (PARTITION BY func ORDER BY row_id, pos) AS i,
        count(*) OVER () AS n, count(*) OVER (PARTITION BY func) AS m FROM r)
SELECT line_no, CASE WHEN line_no > 0 THEN ',' ELSE '{{' END || CASE WHEN i = 1 THEN {_q("func")} || ':[' ELSE '' END || rec
  || CASE WHEN i = m THEN ']' ELSE '' END || CASE WHEN line_no = n - 1 THEN '}}' ELSE '' END AS line FROM p"""
)


@register("by_function_document", BY_FUNCTION_ORACLE)
def q_by_function_document(spark, sf_dir):
    """K6: each function's calls with their source row, in one document."""
    calls = c.prof.calls_with_source(c._pcalls(spark, sf_dir), fx.tagged(spark, sf_dir))
    record = F.concat(
        F.lit('{"row_id":'), F.col("row_id").cast("string"), F.lit(',"call_order":'), F.col("pos").cast("string"),
        F.lit(',"raw_args":'), json_string("raw_args"), F.lit(',"query":'), json_string("query"), F.lit("}"),
    )
    return documents.by_function(calls, record)


def _nested(source: str, entry: str, record: str, keys: str, order: str) -> str:
    return f"""p AS (SELECT *, row_number() OVER (ORDER BY {keys}, {order}) - 1 AS line_no, count(*) OVER () AS n,
  row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {keys}) AS m,
  row_number() OVER (PARTITION BY func ORDER BY {keys}, {order}) AS fi, count(*) OVER (PARTITION BY func) AS fm, {entry} AS entry, {record} AS rec FROM {source})"""


VALUES_ORACLE = (
    "WITH v AS (" + c.ORACLES["func_arg_value_list"] + "), "
    + _nested("v", f"""'{{"func":' || {_q("func")} || ',"arg_key":' || {_q("arg_key")} || ',"values":['""", _q("value"), "func, arg_key", "value_pos")
    + """SELECT line_no, CASE WHEN line_no > 0 THEN ',' ELSE '[' END || CASE WHEN i = 1 THEN entry ELSE '' END || rec
  || CASE WHEN i = m THEN ']}' ELSE '' END || CASE WHEN line_no = n - 1 THEN ']' ELSE '' END AS line FROM p"""
)


@register("value_list_document", VALUES_ORACLE)
def q_value_list_document(spark, sf_dir):
    """Value lists nested by (function, key)."""
    return documents.value_list_document(c.q_func_arg_value_list(spark, sf_dir))


SPEC_ORACLE = (
    "WITH v AS (" + c.ORACLES["function_spec_inference"] + "), "
    + _nested("v", f"""'{{"name":' || {_q("arg_key")} || ',"type":' || {_q("arg_type")} || ',"enum":['""", "enum_value", "func, arg_key", "enum_pos")
    + f"""SELECT line_no, CASE WHEN line_no > 0 THEN ',' ELSE '{{"functions":[' END
  || CASE WHEN fi = 1 THEN '{{"name":' || {_q("func")} || ',"description":' || {_q("description")} || ',"args":[' ELSE '' END || CASE WHEN i = 1 THEN entry ELSE '' END || rec
  || CASE WHEN i = m THEN ']}}' ELSE '' END || CASE WHEN fi = fm THEN ']}}' ELSE '' END || CASE WHEN line_no = n - 1 THEN ']}}' ELSE '' END AS line FROM p"""
)


@register("function_spec_document", SPEC_ORACLE)
def q_function_spec_document(spark, sf_dir):
    """K8: the inferred spec as one nested document."""
    return documents.function_spec_document(c.q_function_spec_inference(spark, sf_dir))
