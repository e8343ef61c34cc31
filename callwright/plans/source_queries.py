"""Queries over the file sources (S1, S2, S6, S7, S8): the input is derived from the driver tables, written to the
shared checkpoint folder and read back with the reader.  The write runs while the query is built."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import readers
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import _json_args, register


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/sources/{name}-{uuid.uuid4().hex}"


def _append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


LABELLED_ORACLE = (
    o.with_(o.TAGGED)
    + """SELECT query AS "user", CASE WHEN row_id % 9 <> 0 THEN '{"a":"x, \\"y\\"","id":' || row_id || '}' END AS assistant,
  CASE WHEN row_id % 9 = 0 THEN 'invalid JSON in output column' END AS error
FROM tagged WHERE row_id % 9 <> 1"""
)


@register("source_labelled_csv", LABELLED_ORACLE)
def q_source_labelled_csv(spark, sf_dir):
    """S2 with two header orders in one folder, quotes in cells, empty cells and broken JSON."""
    root = _folder(spark, "labelled")
    text = F.to_json(F.struct(F.col("row_id").alias("id"), F.lit('x, "y"').alias("a")))
    broken = F.when(F.col("row_id") % 9 == 0, F.lit('{"a": ')).when(F.col("row_id") % 9 == 1, F.lit(" ")).otherwise(text)
    t = fx.tagged(spark, sf_dir).select("row_id", F.col("query").alias("input"), broken.alias("output_json"))
    _append_csv(t.filter("row_id % 2 = 0").select("input", "output_json"), f"{root}/csv")
    _append_csv(t.filter("row_id % 2 = 1").select("output_json", "row_id", "input"), f"{root}/csv")
    return readers.read_labelled_csv(spark, root).select("user", "assistant", "error")


ARRAY_ORACLE = (
    o.with_(o.TAGGED)
    + """SELECT CASE WHEN row_id % 5 <> 4 THEN query END AS "user",
  CASE WHEN row_id % 5 IN (0, 1, 4) THEN '{"a":"}, \\"[y","id":' || row_id || '}' END AS assistant,
  CASE row_id % 5 WHEN 2 THEN 'invalid assistant JSON' WHEN 3 THEN 'missing key assistant' WHEN 4 THEN 'user is no text' END AS error
FROM tagged"""
)


@register("source_json_array", ARRAY_ORACLE)
def q_source_json_array(spark, sf_dir):
    """S1 from files that hold one array each: answers as objects and as JSON text, and each kind of bad element."""
    root = _folder(spark, "arrays")
    kind = F.col("row_id") % 5
    answer = F.to_json(F.struct(F.lit('}, "[y').alias("a"), F.col("row_id").alias("id")))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    member = (
        F.when(kind.isin(0, 4), F.concat(F.lit(', "assistant": '), answer))
        .when(kind == 1, F.concat(F.lit(', "assistant": '), text(answer)))
        .when(kind == 2, F.lit(', "assistant": "{\\"a\\": "'))
        .otherwise(F.lit(""))
    )
    user = F.when(kind == 4, F.col("row_id").cast("string")).otherwise(text(F.col("query")))
    element = F.concat(F.lit('{"user": '), user, member, F.lit("}"))
    rows = fx.tagged(spark, sf_dir).select(F.floor(F.col("row_id") / 5000).alias("bucket"), element.alias("element"))
    files = rows.groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("element"), ", "), F.lit("]")).alias("value"))
    files.write.partitionBy("bucket").text(f"{root}/json")
    return readers.read_json_arrays(spark, root, "json/**/*").select("user", "assistant", "error")


MESSAGES_ORACLE = (
    o.with_(o.TAGGED)
    + f"""SELECT query AS message, CASE row_id % 4 WHEN 0 THEN {o.strip('llm_output')} WHEN 1 THEN '{{"a":[1],"id":' || row_id || '}}'
   ELSE '{{"calls":[{{"name":"f"}}]}}' END AS expected FROM tagged WHERE row_id % 4 <> 3
UNION ALL SELECT query AS message, {o.strip('llm_output')} AS expected FROM tagged"""
)


@register("source_messages", MESSAGES_ORACLE)
def q_source_messages(spark, sf_dir):
    """S6 from JSON lines in its three shapes (a quarter of the lines is broken) and from CSV with alias headers."""
    lines, table = _folder(spark, "messages"), _folder(spark, "messages") + ".csv"
    t = fx.tagged(spark, sf_dir)
    entry = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    kind = F.col("row_id") % 4
    line = (
        F.when(kind == 0, F.to_json(F.struct(F.col("query").alias("message"), F.col("llm_output").alias("expected"))))
        .when(
            kind == 1,
            F.to_json(
                F.struct(
                    F.array(entry("system", F.lit("s")), entry("user", F.col("query"))).alias("messages"),
                    F.struct(F.col("row_id").alias("id"), F.array(F.lit(1)).alias("a")).alias("assistant"),
                )
            ),
        )
        .when(kind == 2, F.to_json(F.struct(F.array(entry("other", F.col("query"))).alias("messages"), F.array(F.struct(F.lit("f").alias("name"))).alias("calls"))))
        .otherwise(F.lit('{"message": '))
    )
    t.select(line).write.text(lines)
    _append_csv(t.select(F.col("llm_output").alias("EXPECT"), F.col("query").alias("Query(한글)")), table)
    return readers.read_messages(spark, lines).unionByName(readers.read_messages(spark, table))


RECORDS_ORACLE = (
    o.with_(o.TAGGED, o.CALLS, o.typed_args("cargs", "calls", "row_id, pos", "plain"))
    + f""", flat AS (SELECT t.row_id, t.query, c.pos, c.func, CASE WHEN c.pos IS NOT NULL THEN
    '{{' || coalesce((SELECT string_agg({_json_args('a.key', 'a.canon', 'a.vtype')}, ',' ORDER BY a.arg_pos) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos), '') || '}}' END AS args_json
  FROM tagged t LEFT JOIN calls c USING (row_id))
SELECT query, 1 AS pos, 'BP' AS func, '{{"a":true,"id":' || row_id || '}}' AS args_json FROM tagged WHERE row_id % 3 = 0
UNION ALL SELECT query, pos, func, args_json FROM flat WHERE row_id % 3 = 1
UNION ALL SELECT query, pos, func, args_json FROM flat"""
)


@register("source_records", RECORDS_ORACLE)
def q_source_records(spark, sf_dir):
    """S7 from JSON lines (ready records, tagged rows, rows without a query) and from CSV."""
    lines, table = _folder(spark, "records"), _folder(spark, "records")
    t = fx.tagged(spark, sf_dir)
    ready = F.struct(F.col("query"), F.array(F.struct(F.lit("BP").alias("code"), F.struct(F.col("row_id").alias("id"), F.lit(True).alias("a")).alias("args"))).alias("calls"))
    tagged = F.struct(F.col("query").alias("Query(한글)"), F.col("llm_output").alias("LLM Output"))
    empty = F.struct(F.lit("").alias("message"), F.col("llm_output").alias("expected"))
    kind = F.col("row_id") % 3
    t.select(F.when(kind == 0, F.to_json(ready)).when(kind == 1, F.to_json(tagged)).otherwise(F.to_json(empty))).write.text(lines)
    _append_csv(t.select(F.col("query").alias("MESSAGE"), F.col("llm_output").alias("LLM Output")), table)
    both = readers.read_records(spark, lines, "json").unionByName(readers.read_records(spark, table))
    call = both.select("query", F.explode_outer("calls").alias("c"))
    return call.select("query", "c.pos", "c.func", "c.args_json")


CSV_DIR_ORACLE = (
    o.with_(o.TAGGED)
    + f"""SELECT CAST(row_id AS VARCHAR) AS index, query || ' item' AS query, {o.strip('llm_output')} AS function FROM tagged WHERE row_id % 3 <> 2"""
)


@register("source_csv_dir", CSV_DIR_ORACLE)
def q_source_csv_dir(spark, sf_dir):
    """S8 with two alias headers, line breaks in cells and files that lack a column."""
    path = _folder(spark, "csvdir")
    t = fx.tagged(spark, sf_dir).withColumn("q", F.concat("query", F.lit("\nitem")))
    _append_csv(t.filter("row_id % 3 = 0").select(F.col("row_id").alias("idx"), F.col("q").alias("Utterance"), F.col("llm_output").alias("call")), path)
    _append_csv(t.filter("row_id % 3 = 1").select(F.col("llm_output").alias("functions"), F.col("row_id").alias("ID"), F.col("q").alias("text")), path)
    _append_csv(t.filter("row_id % 3 = 2").select("row_id", "q"), path)
    return readers.read_csv_dir(spark, path).select("index", "query", "function")
