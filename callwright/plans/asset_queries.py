"""Queries that read back what the sinks wrote (K1-K4, K7, K9) and that take their rules, specs and cases through the
asset loaders (S10-S14).  The writes run while a query is built."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.args import with_args
from ..operators import augment as aug
from ..operators import evaluate as ev
from ..operators import repair as rep
from ..operators import rules as rules_op
from ..sources import assets, readers, sinks
from ..sources.splittable import csv_records
from . import catalog as c
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import register
from .source_queries import _folder


@register("sink_splits", "SELECT split, count(*) AS rows FROM (" + c.SPLIT_ORACLE + ") GROUP BY split")
def q_sink_splits(spark, sf_dir):
    """K1: one folder of JSON lines for each split, counted from the files."""
    path = _folder(spark, "splits")
    sinks.write_splits(c.q_split_exact(spark, sf_dir), path)
    return spark.read.schema("conv_id bigint, turn bigint, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("sink_converted_csv", c.RULE_ORACLE_CONVERTED + "SELECT func, raw_args, query, map_func, map_enum, map_args FROM converted")
def q_sink_converted_csv(spark, sf_dir):
    """K2: the six columns as CSV, read back by name."""
    path = _folder(spark, "converted")
    sinks.write_converted_csv(c._converted(spark, sf_dir), path)
    names = ["func", "raw_args", "query", "map_func", "map_enum", "map_args"]
    place = lambda n: (F.array_position("header", n) - 1).cast("int")
    return csv_records(spark, path).select(*[F.get("cells", place(n)).alias(n) for n in names])


@register("sink_message_expected", c.ORACLES["emit_message_expected"])
def q_sink_message_expected(spark, sf_dir):
    """K3: messages and expected answers as JSON lines, read back by the message source."""
    path = _folder(spark, "expected")
    sinks.write_message_expected(c.q_emit_message_expected(spark, sf_dir), path)
    return readers.read_messages(spark, path)


@register("sink_mapped_rows", c.ORACLES["map_calls_pairs"])
def q_sink_mapped_rows(spark, sf_dir):
    """K4: mapped calls written by extension as JSON lines and read back."""
    path = _folder(spark, "mapped")
    df = c.q_map_calls_pairs(spark, sf_dir)
    sinks.write_by_extension(df, path)
    return spark.read.schema(df.schema).json(path)


@register("sink_repair_results", "SELECT status, CASE WHEN status = 'still_broken' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS rows FROM (" + c.ORACLES["schema_repair"] + ") GROUP BY status")
def q_sink_repair_results(spark, sf_dir):
    """K7: repair results in one folder for each outcome, counted from the files."""
    path = _folder(spark, "repaired")
    sinks.write_repair_results(c.q_schema_repair(spark, sf_dir).select("row_id", "repaired", "status"), path)
    back = spark.read.schema("row_id bigint, repaired string, status string, outcome string").json(path)
    return back.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@register("sink_evaluation_rows", c.EVAL_ROWS_SQL + "SELECT ex_id, source, pred_text, exact, name1, state FROM scored")
def q_sink_evaluation_rows(spark, sf_dir):
    """K9: evaluation rows as JSON lines, read back."""
    path = _folder(spark, "evaluated")
    df = c.q_eval_exact_name_state(spark, sf_dir)
    sinks.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


def _rule_document(spark) -> dict:
    """The fixture's rules in the flat layout of a rule file."""
    typed = {"int": int, "bool": lambda v: v == "True", "str": str}
    rows = sorted(fx.rule_conditions(spark).collect(), key=lambda r: (r["seq"], r["k_pos"] or 0))
    rules = {}
    for r in rows:
        rule = rules.setdefault(r["seq"], {"map_func": r["map_func"], "map_enum": r["map_enum"], "code": r["code"], "when": {}})
        if r["k"] is not None:
            rule["when"][r["k"]] = typed[r["vtype"]](r["value"])
    return {"rules": list(rules.values())}


@register("rules_loaded_convert", c.ORACLES["rule_convert"])
def q_rules_loaded_convert(spark, sf_dir):
    """S10 then J1: the rules come through the loader of rule documents."""
    conditions = assets.conditions_frame(spark, assets.normalise_conversion_rules(_rule_document(spark)))
    return rules_op.convert_calls(c._plain_calls(spark, sf_dir), rules_op.rules_from_conditions(conditions)).drop("args")


@register("template_rules_loaded", c.ORACLES["map_calls_template"])
def q_template_rules_loaded(spark, sf_dir):
    """S11 then J2: the template map comes through its loader."""
    typed = {"int": int, "float": float, "bool": lambda v: v == "True", "none": lambda v: None, "str": str}
    document: dict = {}
    for r in sorted(fx.template_rules(spark).collect(), key=lambda r: r["seq"]):
        when = {w["key"]: "*" if w["expect"] == "*" else typed[w["vtype"]](w["value"]) for w in sorted(r["when"], key=lambda w: w["k_pos"])}
        out = {x["name"]: typed[x["vtype"]](x["template"]) for x in r["out"]}
        document.setdefault(f"function_{r['code']}", []).append({"when": when, "new_name": r["new_name"], "args": out})
    rules = assets.template_rules_frame(spark, assets.template_map_rules({"function_map": document}))
    calls = with_args(c._calls(spark, sf_dir), "raw_args", "quoted", "args")
    return rules_op.map_calls_template(calls, rules).drop("args")


@register(
    "function_spec_loaded",
    """SELECT r_name AS func, CAST(r_regionkey + 1 AS INTEGER) AS func_pos, n_name AS arg, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS arg_order,
  CASE WHEN n_nationkey % 2 = 0 THEN 'integer' ELSE 'string' END AS type, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS INTEGER) AS enum_pos, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS enum_text
FROM region JOIN nation ON n_regionkey = r_regionkey""",
)
def q_function_spec_loaded(spark, sf_dir):
    """A spec with one function for each region and its nations as arguments, through the loader."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    functions: dict = {}
    for r in nation.orderBy("r_regionkey", "n_nationkey").collect():  # 25 rows at any scale factor
        arg = {"name": r["n_name"], "type": "integer", "enum": [r["n_nationkey"]]} if r["n_nationkey"] % 2 == 0 else {"name": r["n_name"]}
        functions.setdefault(r["r_name"], []).append(arg)
    spec = assets.spec_frame(spark, {"functions": [{"name": name, "args": args} for name, args in functions.items()]})
    return spec.select("func", "func_pos", "arg", "arg_order", "type", "enum_pos", "enum_text")


@register("repair_cases_loaded", c.ORACLES["schema_repair"].rsplit("SELECT row_id", 1)[0] + "SELECT status, count(*) AS count FROM (SELECT " + c.ORACLES["schema_repair"].rsplit("SELECT row_id,", 1)[1].split("AS tags,", 1)[1] + ") GROUP BY status")
def q_repair_cases_loaded(spark, sf_dir):
    """Damaged texts as a CSV file of cases, read by the case loader, repaired and counted."""
    path = _folder(spark, "cases") + ".csv"
    fx.damaged(spark, sf_dir).select(F.col("row_id").alias("id"), F.col("raw").alias("text")).write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    repaired = rep.schema_repair(readers.read_repair_cases(spark, path), "raw", fx.REPAIR_ARG_RULES, fx.REPAIR_SIGNATURES)
    return rep.repair_report(repaired)


@register("exact_with_as_written_rows", c.EVAL_ROWS_SQL + "SELECT ex_id, exact, exact AS exact_as_written FROM scored")
def q_exact_with_as_written_rows(spark, sf_dir):
    """On predictions whose numbers are written alike both comparisons agree."""
    return ev.score(fx.predictions(spark, sf_dir), True, as_written=True).select("ex_id", "exact", "exact_as_written")


@register(
    "replacement_rules_loaded",
    """SELECT c_custkey AS id, v.i AS variant_idx, CASE WHEN v.i = 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || '-R' || v.i END AS index_label,
  CASE v.i WHEN 0 THEN 'from <' || n_name || '>' WHEN 1 THEN 'from land ' || n_nationkey ELSE 'from "' || lower(n_name) || '"' END AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES (0), (1), (2)) AS v(i)""",
)
def q_replacement_rules_loaded(spark, sf_dir):
    """One rule for each nation as JSON lines, read by the loader and applied to every customer's text."""
    path = _folder(spark, "replacements")
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    token = F.concat(F.lit("<"), "n_name", F.lit(">"))
    new = F.array(F.concat(F.lit("land "), F.col("n_nationkey").cast("string")), F.concat(F.lit('"'), F.lower("n_name"), F.lit('"')))
    nation.orderBy("n_nationkey").select(F.to_json(F.struct(F.array(token).alias("ori"), new.alias("sr")))).coalesce(1).write.text(path)  # 25 lines
    rules = assets.replacement_rules_of([r["value"] for r in spark.read.text(path).collect()])
    texts = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("from "), token).alias("text"))
    return aug.augment(texts, "id", ["text"], rules).select("id", "variant_idx", "index_label", "text")
