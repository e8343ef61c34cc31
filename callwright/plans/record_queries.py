"""Queries over records, prompts, decoders and template blocks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext, tags
from ..operators import augment as aug
from ..operators import evaluate as ev
from ..operators import rules as rules_op
from ..sources import readers
from . import catalog as c
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import register
from .source_queries import _folder


def _records(spark, sf_dir):
    return readers._tagged_record(fx.tagged(spark, sf_dir).select("row_id", "query", "llm_output")).select("row_id", "query", "calls")


def _flat(records):
    return records.select("row_id", F.explode_outer("calls").alias("c")).select("row_id", "c.pos", "c.func", "c.args_json")


_ARGS = c._json_args("a.key", "a.canon", "a.vtype")
_SORTED_ARGS = f"""'{{{{' || coalesce((SELECT string_agg({_ARGS}, ',' ORDER BY a.key) FROM cargs a WHERE a.row_id = f.row_id AND a.pos = f.pos), '') || '}}}}'""".replace("{{", "{").replace("}}", "}")


@register(
    "records_forward",
    c.FORWARD_ORACLE
    + f"""SELECT t.row_id, f.pos, f.out_func AS func, CASE WHEN f.pos IS NULL THEN NULL WHEN f.matched THEN '{{"enum":' || CAST(to_json(f.map_enum) AS VARCHAR) || '}}' ELSE {_SORTED_ARGS} END AS args_json
FROM tagged t LEFT JOIN fwd f USING (row_id)""",
)
def q_records_forward(spark, sf_dir):
    """K5: records through the rules, records out."""
    return _flat(rules_op.apply_rules_to_records(_records(spark, sf_dir), c._rules(spark), "forward"))


@register(
    "records_reverse",
    c.REVERSE_ORACLE.replace("coalesce(string_agg(k || '=' || value, ', ' ORDER BY k_pos), '') AS txt", "'{' || coalesce(string_agg(" + c._json_args("k", "value", "vtype") + ", ',' ORDER BY k_pos) FILTER (k IS NOT NULL), '') || '}' AS txt")
    .replace("SELECT f.row_id, f.pos, coalesce(rc.code, f.out_func) AS out_func, CASE WHEN rc.code IS NOT NULL THEN w.txt ELSE f.out_args END AS out_args\nFROM fwd f", f"""SELECT t.row_id, f.pos, coalesce(rc.code, f.out_func) AS func, CASE WHEN f.pos IS NULL THEN NULL WHEN rc.code IS NOT NULL THEN w.txt
  WHEN f.matched THEN '{{"enum":' || CAST(to_json(f.map_enum) AS VARCHAR) || '}}' ELSE {_SORTED_ARGS} END AS args_json\nFROM tagged t LEFT JOIN fwd f USING (row_id)"""),
)
def q_records_reverse(spark, sf_dir):
    """K5 there and back: the rewritten records through the reversed rules."""
    rules = c._rules(spark)
    there = rules_op.apply_rules_to_records(_records(spark, sf_dir), rules, "forward")
    return _flat(rules_op.apply_rules_to_records(there, rules, "reverse"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("infer_prompt_render", o.with_(o.TAGGED) + f"SELECT row_id, {_literal(ev.INFER_SYSTEM)} || query || {_literal(ev.INFER_TAIL)} AS prompt FROM tagged")
def q_infer_prompt_render(spark, sf_dir):
    """The inference prompt of every query."""
    return fx.tagged(spark, sf_dir).select("row_id", ev.infer_prompt("query").alias("prompt"))


_DECODE_ORACLE = (
    o.with_(o.TAGGED)
    + """SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'f' || row_id WHEN 1 THEN 'f' || row_id WHEN 2 THEN 'function_AB' WHEN 4 THEN 'function_CD' END AS name,
  CASE row_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'tag' WHEN 4 THEN 'tag' END AS kind,
  CASE row_id % 5 WHEN 0 THEN '{"a":[1],"b":' || row_id || '}' WHEN 1 THEN '{"b":{"c":' || row_id || '}}' WHEN 2 THEN '{"k":' || row_id || ',"on":true}' WHEN 4 THEN '{}' END AS args_json FROM tagged"""
)


@register("decode_call_any", _DECODE_ORACLE)
def q_decode_call_any(spark, sf_dir):
    """JSON objects, one with a brace too many, tagged calls with a flag and a quoted cell, and text that
    is neither."""
    row = F.col("row_id")
    n = row.cast("string")
    text = (
        F.when(row % 5 == 0, F.concat(F.lit('{"functionName": "f'), n, F.lit('", "arguments": {"b": '), n, F.lit(', "a": [1]}}')))
        .when(row % 5 == 1, F.concat(F.lit('{"functionName": "f'), n, F.lit('", "arguments": {"b": {"c": '), n, F.lit("}}}}")))
        .when(row % 5 == 2, F.concat(F.lit("<function_AB>(k="), n, F.lit(", on)<end>")))
        .when(row % 5 == 3, F.concat(F.lit("no call "), n))
        .otherwise(F.lit("< function_CD >;<function_EF>(x=1)"))
    )
    decoded = fx.tagged(spark, sf_dir).select("row_id", tags.decode_with_brace_fix(text).alias("d"))
    return decoded.select("row_id", "d.name", "d.kind", "d.args_json")


@register(
    "quote_cleaning",
    o.with_(o.TAGGED)
    + """SELECT row_id, CASE WHEN row_id % 2 = 0 THEN '<function_AB>(a=""' || row_id || '"")' ELSE 'say "" and "x" "y"' END AS single,
  CASE WHEN row_id % 2 = 0 THEN '<function_AB>(a=' || row_id || ')' ELSE 'say  and x y' END AS bare, row_id % 2 = 0 AS kept FROM tagged""",
)
def q_quote_cleaning(spark, sf_dir):
    """P13, P23 and P20 on cells with doubled quotes: doubled ones would become single when more than half of all
    quotes are such pairs (which no text reaches, as in the reference), all quotes go, and rows that hold a
    placeholder are dropped."""
    row = F.col("row_id")
    cell = F.when(row % 2 == 0, F.concat(F.lit('<function_AB>(a=""'), row.cast("string"), F.lit('"")'))).otherwise(F.lit('say "" and "x" "y"'))
    df = fx.tagged(spark, sf_dir).select("row_id", jsontext.undouble_quotes(cell).alias("single")).withColumn("bare", tags.strip_quotes("single"))
    marked = df.withColumn("mark", F.when(F.col("row_id") % 2 == 0, F.lit("x")).otherwise(F.lit("at <loc>")))
    kept = aug.drop_placeholders(marked, ["single", "mark"]).select("row_id", F.lit(True).alias("kept"))
    return df.join(kept, "row_id", "left").select("row_id", "single", "bare", F.coalesce("kept", F.lit(False)).alias("kept"))


@register(
    "template_blocks",
    """WITH r AS (SELECT r_regionkey + 1 AS block, r_name AS name FROM region), n AS (
  SELECT n_regionkey + 1 AS block, n_name AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS pos FROM nation)
SELECT row_number() OVER (ORDER BY r.block, a.pos, b.pos) AS "index", a.w || ' ' || b.w AS query, r.name AS function, 's' AS slot_type
FROM r JOIN n a USING (block) JOIN n b USING (block)""",
)
def q_template_blocks(spark, sf_dir):
    """Blocks of the named shape, one for each region with its nations as words, expanded and numbered."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    words = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("word"))
    blocks = region.join(words, "r_regionkey").select(
        (F.col("r_regionkey") + 1).alias("block"), F.col("r_name").alias("name"), F.array(F.lit("<s1> <s1>")).alias("datas"),
        F.array(F.struct(F.lit("s1").alias("tag_name"), "word")).alias("tags"),
    )
    formats, tag_rows = aug.blocks_from_named_datas(blocks)
    numbered = aug.number_queries(aug.expand_templates(formats, aug.merge_tags(tag_rows)))
    return numbered.withColumn("slot_type", aug.slot_type(F.lit("<s1>")))


@register("source_jsonl_strict", o.with_(o.TAGGED) + "SELECT row_id AS id, query FROM tagged")
def q_source_jsonl_strict(spark, sf_dir):
    """JSON lines of which none may be broken."""
    path = _folder(spark, "strict")
    fx.tagged(spark, sf_dir).select(F.to_json(F.struct(F.col("row_id").alias("id"), "query"))).write.text(path)
    value = readers.read_jsonl_strict(spark, path)
    return value.select(F.try_variant_get("value", "$.id", "bigint").alias("id"), F.try_variant_get("value", "$.query", "string").alias("query"))
