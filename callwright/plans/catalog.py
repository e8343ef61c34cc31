"""Named queries over the driver tables, each with its DuckDB oracle where SQL can say it.

Every query reads whole tables (through the fixtures) and returns a DataFrame
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as prof
from . import fixtures as fx
from . import oracle_sql as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


# ---------------------------------------------------------------- profile (L4)


def _pcalls(spark, sf_dir):
    return prof.profile_calls(fx.tagged(spark, sf_dir))


def _pargs(spark, sf_dir):
    return prof.profile_args(_pcalls(spark, sf_dir))


@register("func_frequency", o.with_(o.TAGGED, o.PCALLS) + "SELECT func, count(*) AS count FROM pcalls GROUP BY func")
def q_func_frequency(spark, sf_dir):
    return prof.func_frequency(_pcalls(spark, sf_dir))


@register("arg_key_frequency", o.with_(o.TAGGED, o.PCALLS, o.PARGS) + "SELECT arg_key, count(*) AS count FROM pmelt GROUP BY arg_key")
def q_arg_key_frequency(spark, sf_dir):
    return prof.arg_key_frequency(_pargs(spark, sf_dir))


@register(
    "arg_type_distribution",
    o.with_(o.TAGGED, o.PCALLS, o.PARGS) + "SELECT arg_key, val_type, count(*) AS count FROM pmelt GROUP BY arg_key, val_type",
)
def q_arg_type_distribution(spark, sf_dir):
    return prof.arg_type_distribution(_pargs(spark, sf_dir))


@register(
    "func_arg_key_frequency",
    o.with_(o.TAGGED, o.PCALLS, o.PARGS) + "SELECT func, arg_key, count(*) AS count FROM pmelt GROUP BY func, arg_key",
)
def q_func_arg_key_frequency(spark, sf_dir):
    return prof.func_arg_key_frequency(_pargs(spark, sf_dir))


@register(
    "func_arg_value_frequency",
    o.with_(o.TAGGED, o.PCALLS, o.PARGS)
    + "SELECT func, arg_key, val_type, val, count(*) AS count FROM pmelt GROUP BY func, arg_key, val_type, val",
)
def q_func_arg_value_frequency(spark, sf_dir):
    return prof.func_arg_value_frequency(_pargs(spark, sf_dir))


VALUE_LIST_SQL = o.with_(o.TAGGED, o.PCALLS, o.PARGS) + """, vl AS (
  SELECT func, arg_key, value, row_number() OVER (PARTITION BY func, arg_key ORDER BY value) AS value_pos
  FROM (SELECT DISTINCT func, arg_key, val AS value FROM pmelt) d)
"""


@register("func_arg_value_list", VALUE_LIST_SQL + "SELECT func, arg_key, value, value_pos FROM vl")
def q_func_arg_value_list(spark, sf_dir):
    return prof.func_arg_value_list(_pargs(spark, sf_dir))


@register(
    "query_list",
    VALUE_LIST_SQL + "SELECT func || '.' || arg_key || '=' || value AS query, func, arg_key, value, value_pos FROM vl",
)
def q_query_list(spark, sf_dir):
    return prof.query_list(prof.func_arg_value_list(_pargs(spark, sf_dir)))


# The argument keys of the tagged fixture, so the pivot needs no discovery job.
FIXTURE_ARG_KEYS = ["enable", "get", "location", "timeframe", "type", "volume"]


@register(
    "func_arg_pivot",
    o.with_(o.TAGGED, o.PCALLS, o.PARGS)
    + "SELECT func, "
    + ", ".join(f"count(*) FILTER (WHERE arg_key = '{k}') AS {k}" for k in FIXTURE_ARG_KEYS)
    + " FROM pmelt GROUP BY func",
)
def q_func_arg_pivot(spark, sf_dir):
    return prof.func_arg_pivot(_pargs(spark, sf_dir), FIXTURE_ARG_KEYS)


@register(
    "func_bigrams",
    o.with_(o.TAGGED, o.PCALLS)
    + """SELECT a.func AS func_a, b.func AS func_b, count(*) AS count
         FROM pcalls a JOIN pcalls b ON a.row_id = b.row_id AND b.pos = a.pos + 1 GROUP BY a.func, b.func""",
)
def q_func_bigrams(spark, sf_dir):
    return prof.func_bigrams_from_text(fx.tagged(spark, sf_dir))


@register(
    "placeholder_locations",
    o.with_(o.TAGGED, o.PCALLS, o.PARGS)
    + "SELECT row_id, pos, func, arg_key, val_type, val FROM pmelt WHERE arg_key = 'location' AND trim(val) IN ('0', '\"\"0\"\"')",
)
def q_placeholder_locations(spark, sf_dir):
    return prof.placeholder_locations(_pargs(spark, sf_dir)).drop("cmp")


@register(
    "empty_arg_calls",
    o.with_(o.TAGGED, o.PCALLS) + "SELECT row_id, pos, func, raw_args FROM pcalls WHERE trim(raw_args) = ''",
)
def q_empty_arg_calls(spark, sf_dir):
    return prof.empty_arg_calls(_pcalls(spark, sf_dir))


@register(
    "calls_with_source",
    o.with_(o.TAGGED, o.PCALLS)
    + "SELECT c.row_id, c.pos, c.func, c.raw_args, t.query, t.llm_output FROM pcalls c JOIN tagged t USING (row_id)",
)
def q_calls_with_source(spark, sf_dir):
    # J6 without a join: the source columns ride along the explode (calls come from these rows)
    src = fx.tagged(spark, sf_dir)
    return prof.profile_calls(src, keys=("row_id", "query", "llm_output")).select("row_id", "pos", "func", "raw_args", "query", "llm_output")


def _spec_oracle() -> str:
    desc_rows = ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(prof.FUNC_DESCRIPTIONS.items())
    )
    return (
        VALUE_LIST_SQL
        + f""", descs AS (SELECT * FROM (VALUES {desc_rows}) AS d(func, description)),
typ AS (
  SELECT func, arg_key,
    CASE WHEN bool_and(lower(trim(value)) IN ('true', 'false')) THEN 'boolean'
         WHEN bool_and(trim(value) IN ('0', '1')) THEN 'boolean'
         WHEN bool_and(regexp_matches(trim(value), '{o.FLOAT_RE}')) THEN 'number' ELSE 'string' END AS arg_type
  FROM vl GROUP BY func, arg_key),
cast_v AS (
  SELECT v.func, v.arg_key, t.arg_type, v.value_pos,
    CASE WHEN t.arg_type = 'boolean' AND lower(trim(value)) IN ('true', 'false') THEN CASE WHEN lower(trim(value)) = 'true' THEN 'true' ELSE 'false' END
         WHEN t.arg_type = 'boolean' THEN CASE WHEN trim(value) = '1' THEN 'true' ELSE 'false' END
         WHEN t.arg_type = 'number' AND regexp_matches(trim(value), '^-?[0-9]+$') THEN CAST(CAST(trim(value) AS BIGINT) AS VARCHAR)
         WHEN t.arg_type = 'number' THEN CAST(CAST(trim(value) AS DOUBLE) AS VARCHAR)
         ELSE CAST(to_json(trim(value)) AS VARCHAR) END AS enum_value,
    CASE WHEN t.arg_type = 'number' THEN CAST(CAST(trim(value) AS DOUBLE) AS VARCHAR) END AS num_key
  FROM vl v JOIN typ t USING (func, arg_key)),
firsts AS (
  SELECT func, arg_key, arg_type, min(value_pos) AS first_pos, arg_min(enum_value, value_pos) AS enum_value
  FROM cast_v GROUP BY func, arg_key, arg_type, CASE WHEN arg_type = 'number' THEN num_key ELSE enum_value END)
SELECT f.func, coalesce(d.description, f.func || ' function') AS description, f.arg_key, f.arg_type,
       row_number() OVER (PARTITION BY f.func, f.arg_key ORDER BY f.first_pos) AS enum_pos, f.enum_value
FROM firsts f LEFT JOIN descs d USING (func)"""
    )


@register("function_spec_inference", _spec_oracle())
def q_function_spec_inference(spark, sf_dir):
    values = prof.func_arg_value_list(_pargs(spark, sf_dir), typed=True)
    return prof.function_spec(values, prof.descriptions_frame(spark))


# ---------------------------------------------------------------- calls (B1)

from ..functions.args import args_json, args_text, with_args  # noqa: E402
from ..functions.tags import first_call  # noqa: E402
from ..operators import calls as calls_op  # noqa: E402
from ..operators import rules as rules_op  # noqa: E402

ARG_COLS = "row_id, pos, func, arg_pos, key, raw, vtype, canon, cmp"


def _calls(spark, sf_dir, keys=("row_id",)):
    return calls_op.calls_table(fx.tagged(spark, sf_dir), "llm_output", keys)


@register("parse_calls", o.with_(o.TAGGED, o.CALLS) + "SELECT row_id, pos, func, raw_args FROM calls")
def q_parse_calls(spark, sf_dir):
    return _calls(spark, sf_dir)


def _args_oracle(dialect):
    return (
        o.with_(o.TAGGED, o.CALLS, o.typed_args("cargs", "calls", "row_id, pos", dialect))
        + f"SELECT a.row_id, a.pos, c.func, a.arg_pos, a.key, CASE WHEN a.raw = a.key AND {'true' if dialect == 'lenient' else 'false'} THEN '' ELSE a.raw END AS raw, a.vtype, a.canon, a.cmp FROM cargs a JOIN calls c USING (row_id, pos)"
    )


@register("parse_args_plain", _args_oracle("plain"))
def q_parse_args_plain(spark, sf_dir):
    return calls_op.call_args_table(_calls(spark, sf_dir), "plain")


@register("parse_args_quoted", _args_oracle("quoted"))
def q_parse_args_quoted(spark, sf_dir):
    return calls_op.call_args_table(_calls(spark, sf_dir), "quoted")


@register("parse_args_lenient", _args_oracle("lenient"))
def q_parse_args_lenient(spark, sf_dir):
    return calls_op.call_args_table(_calls(spark, sf_dir), "lenient")


@register("args_profile_dialect", _args_oracle("profile"))
def q_args_profile_dialect(spark, sf_dir):
    """The quote/paren-aware profile dialect over every tagged call."""
    return calls_op.call_args_table(_calls(spark, sf_dir), "profile")


FC_FULL = r"<\s*function_([A-Za-z0-9]+)\s*>\s*\(([^\n]*?)\)\s*(?:<\s*end\s*>\s*)?$"
FC_LOOSE = r"<\s*function_([A-Za-z0-9]+)\s*>\s*(?:\(([^\n]*?)\))?"
FIRST_CALL_BLOCKS = ",\n".join([
    f"""fc0 AS (SELECT row_id, {o.strip(f"split_part({o.strip('llm_output')}, ';', 1)")} AS t FROM tagged)""",
    f"""fc AS (SELECT row_id, 1 AS pos,
        CASE WHEN regexp_matches(t, '{FC_FULL}') THEN regexp_extract(t, '{FC_FULL}', 1) ELSE regexp_extract(t, '{FC_LOOSE}', 1) END AS fname,
        CASE WHEN regexp_matches(t, '{FC_FULL}') THEN regexp_extract(t, '{FC_FULL}', 2) ELSE regexp_extract(t, '{FC_LOOSE}', 2) END AS raw_args
      FROM fc0 WHERE regexp_matches(t, '{FC_LOOSE}'))""",
    o.typed_args("fargs", "fc", "row_id, pos", "lenient"),
])
FIRST_CALL_SQL = o.with_(o.TAGGED, FIRST_CALL_BLOCKS) + """SELECT f.row_id, 'function_' || f.fname AS name, f.raw_args,
   coalesce((SELECT string_agg(a.key || '=' || a.canon, ', ' ORDER BY a.arg_pos) FROM fargs a WHERE a.row_id = f.row_id), '') AS args_text
FROM fc f"""


@register("first_call", FIRST_CALL_SQL)
def q_first_call(spark, sf_dir):
    t = fx.tagged(spark, sf_dir)
    fc = t.select("row_id", first_call(F.col("llm_output")).alias("fc")).filter(F.col("fc").isNotNull())
    return fc.select("row_id", "fc.name", "fc.raw_args", args_text(F.col("fc.args")).alias("args_text"))


# ---------------------------------------------------------------- rules


def _plain_calls(spark, sf_dir, dialect="plain"):
    c = calls_op.calls_table(fx.tagged(spark, sf_dir), "llm_output", ("row_id", "query"))
    return with_args(c, "raw_args", dialect, "args")


def _rules(spark):
    return rules_op.rules_from_conditions(fx.rule_conditions(spark))


RULE_ORACLE_HEAD = o.with_(
    o.TAGGED, o.CALLS, o.RULES, o.typed_args("cargs", "calls", "row_id, pos", "plain"), o.first_rule("best", "cargs", "'*', '__ANY__'")
)
RULE_ORACLE_CONVERTED = (
    RULE_ORACLE_HEAD
    + """, rr AS (SELECT DISTINCT seq, map_func, map_enum FROM rule_conditions),
margs AS (SELECT b.row_id, b.pos, string_agg(r.k || '=' || a.canon, ', ' ORDER BY r.k_pos) AS map_args
          FROM best b JOIN rule_conditions r ON r.seq = b.seq JOIN cargs a ON a.row_id = b.row_id AND a.pos = b.pos AND a.key = r.k
          GROUP BY b.row_id, b.pos),
converted AS (
  SELECT c.row_id, c.pos, c.func, c.raw_args, t.query, coalesce(rr.map_func, '') AS map_func, coalesce(rr.map_enum, '') AS map_enum,
         coalesce(m.map_args, '') AS map_args
  FROM calls c JOIN tagged t USING (row_id) LEFT JOIN best b USING (row_id, pos) LEFT JOIN rr ON rr.seq = b.seq
  LEFT JOIN margs m USING (row_id, pos))
"""
)


def _converted(spark, sf_dir):
    return rules_op.convert_calls(_plain_calls(spark, sf_dir), _rules(spark))


@register("rule_convert", RULE_ORACLE_CONVERTED + "SELECT * FROM converted")
def q_rule_convert(spark, sf_dir):
    return _converted(spark, sf_dir).drop("args")


@register(
    "rule_convert_report",
    RULE_ORACLE_CONVERTED
    + "SELECT count(*) AS total, count(*) FILTER (WHERE map_func <> '') AS matched, count(*) FILTER (WHERE map_func = '') AS unmatched FROM converted",
)
def q_rule_convert_report(spark, sf_dir):
    return rules_op.conversion_report(_converted(spark, sf_dir))


@register(
    "emit_message_expected",
    RULE_ORACLE_CONVERTED
    + f"""SELECT trim(v.query) AS message,
   '{{"name":' || CAST(to_json(v.map_func) AS VARCHAR) || ',"arguments":{{"code":' || CAST(to_json(v.func) AS VARCHAR)
   || coalesce((SELECT ',' || string_agg(CAST(to_json(a.key) AS VARCHAR) || ':' || {o.json_value('a.vtype', 'a.canon')}, ',' ORDER BY a.arg_pos)
                FROM cargs a WHERE a.row_id = v.row_id AND a.pos = v.pos), '') || '}}}}' AS expected
FROM converted v""",
)
def q_emit_message_expected(spark, sf_dir):
    return rules_op.message_expected(_converted(spark, sf_dir))


TEMPLATE_HEAD = (
    o.with_(
        o.TAGGED,
        o.CALLS,
        o.RULES,
        o.typed_args("cargs", "calls", "row_id, pos", "quoted"),
        o.first_rule("best", "cargs", "'*'"),
        "tout AS (" + fx.TEMPLATE_OUT_SQL + ")",
    )
    + """, filled AS (
  SELECT b.row_id, b.pos, b.seq, t.pos AS opos, t.name, t.vtype,
    CASE WHEN regexp_matches(x.v, '\\{[^{}]*\\}') THEN t.template ELSE replace(replace(x.v, chr(1), '{'), chr(2), '}') END AS val
  FROM best b JOIN calls c USING (row_id, pos) JOIN tout t ON t.seq = b.seq,
  LATERAL (SELECT replace(replace(replace(replace(replace(t.template, '{code}', c.func),
             '{location}', coalesce((SELECT canon FROM cargs a WHERE a.row_id = b.row_id AND a.pos = b.pos AND a.key = 'location'), '{location}')),
             '{volume}', coalesce((SELECT canon FROM cargs a WHERE a.row_id = b.row_id AND a.pos = b.pos AND a.key = 'volume'), '{volume}')),
             '{{', chr(1)), '}}', chr(2)) AS v) x)
"""
)
TEMPLATE_ORACLE = (
    TEMPLATE_HEAD
    + """
SELECT c.row_id, c.pos, c.func, c.raw_args,
  CASE WHEN b.seq IS NOT NULL THEN
    '{"functionName":' || CAST(to_json(coalesce(nullif((SELECT DISTINCT map_func FROM rule_conditions r WHERE r.seq = b.seq), ''), c.func)) AS VARCHAR)
    || ',"arguments":{' || coalesce((SELECT string_agg(CAST(to_json(f.name) AS VARCHAR) || ':' ||
        CASE f.vtype WHEN 'str' THEN CAST(to_json(f.val) AS VARCHAR) WHEN 'bool' THEN lower(f.val) WHEN 'none' THEN 'null' ELSE f.val END, ',' ORDER BY f.opos)
                                     FROM filled f WHERE f.row_id = c.row_id AND f.pos = c.pos), '') || '}}'
  ELSE
    '{"functionName":' || CAST(to_json(c.func) AS VARCHAR) || ',"arguments":{'
    || coalesce((SELECT string_agg(CAST(to_json(a.key) AS VARCHAR) || ':' || """
    + o.json_value("a.vtype", "a.canon")
    + """, ',' ORDER BY a.arg_pos) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos), '') || '}}'
  END AS mapped
FROM calls c LEFT JOIN best b USING (row_id, pos)"""
)


@register("map_calls_template", TEMPLATE_ORACLE)
def q_map_calls_template(spark, sf_dir):
    c = with_args(_calls(spark, sf_dir), "raw_args", "quoted", "args")
    return rules_op.map_calls_template(c, fx.template_rules(spark)).drop("args")


PAIRS_ORACLE = (
    o.with_(o.TAGGED, o.CALLS, o.RULES, o.typed_args("cargs", "calls", "row_id, pos", "quoted"), o.first_rule("best", "cargs", "'*'"))
    + """SELECT c.row_id, c.pos, c.func, c.raw_args,
  CASE WHEN b.seq IS NOT NULL THEN (SELECT DISTINCT '{"name":"' || map_func || '","enum":"' || map_enum || '"}' FROM rule_conditions r WHERE r.seq = b.seq)
  ELSE '{"functionName":' || CAST(to_json(c.func) AS VARCHAR) || ',"arguments":{'
    || coalesce((SELECT string_agg(CAST(to_json(a.key) AS VARCHAR) || ':' || """
    + o.json_value("a.vtype", "a.canon")
    + """, ',' ORDER BY a.arg_pos) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos), '') || '}}' END AS mapped
FROM calls c LEFT JOIN best b USING (row_id, pos)"""
)


@register("map_calls_pairs", PAIRS_ORACLE)
def q_map_calls_pairs(spark, sf_dir):
    c = with_args(_calls(spark, sf_dir), "raw_args", "quoted", "args")
    return rules_op.map_calls_pairs(c, fx.pair_rules(spark)).drop("args")


FORWARD_ORACLE = (
    RULE_ORACLE_HEAD
    + """, fwd AS (
  SELECT c.row_id, c.pos, coalesce(r.map_func, c.func) AS out_func,
    CASE WHEN b.seq IS NOT NULL THEN 'enum=' || r.map_enum
         ELSE coalesce((SELECT string_agg(a.key || '=' || a.canon, ', ' ORDER BY a.arg_pos) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos), '') END AS out_args,
    b.seq IS NOT NULL AS matched, r.map_enum
  FROM calls c LEFT JOIN best b USING (row_id, pos) LEFT JOIN (SELECT DISTINCT seq, map_func, map_enum FROM rule_conditions) r ON r.seq = b.seq)
"""
)


def _forward(spark, sf_dir):
    return rules_op.substitute(_plain_calls(spark, sf_dir), _rules(spark), "forward")


@register("substitute_forward", FORWARD_ORACLE + "SELECT row_id, pos, out_func, out_args FROM fwd")
def q_substitute_forward(spark, sf_dir):
    return _forward(spark, sf_dir).select("row_id", "pos", "out_func", args_text(F.col("out_args")).alias("out_args"))


REVERSE_ORACLE = (
    FORWARD_ORACLE
    + """, rev_rule AS (
  SELECT map_func, map_enum, min(seq) AS seq FROM rule_conditions GROUP BY map_func, map_enum),
rev_when AS (
  SELECT seq, coalesce(string_agg(k || '=' || value, ', ' ORDER BY k_pos), '') AS txt
  FROM rule_conditions GROUP BY seq)
SELECT f.row_id, f.pos, coalesce(rc.code, f.out_func) AS out_func, CASE WHEN rc.code IS NOT NULL THEN w.txt ELSE f.out_args END AS out_args
FROM fwd f
LEFT JOIN rev_rule rr ON f.matched AND rr.map_func = f.out_func AND rr.map_enum = f.map_enum
LEFT JOIN (SELECT DISTINCT seq, code FROM rule_conditions) rc ON rc.seq = rr.seq
LEFT JOIN rev_when w ON w.seq = rr.seq"""
)


@register("substitute_reverse", REVERSE_ORACLE)
def q_substitute_reverse(spark, sf_dir):
    fwd = _forward(spark, sf_dir).select("row_id", "pos", F.col("out_func").alias("func"), F.col("out_args").alias("args"))
    rev = rules_op.substitute(fwd, _rules(spark), "reverse")
    return rev.select("row_id", "pos", "out_func", args_text(F.col("out_args")).alias("out_args"))


def _json_args(name: str, value: str, vtype: str) -> str:
    """Compact JSON members of argument rows (typed text) as one SQL expression."""
    typed = f"CASE {vtype} WHEN 'str' THEN CAST(to_json({value}) AS VARCHAR) WHEN 'bool' THEN lower({value}) WHEN 'none' THEN 'null' ELSE {value} END"
    return f"CAST(to_json({name}) AS VARCHAR) || ':' || {typed}"


V2_ORACLE = (
    RULE_ORACLE_HEAD
    + ", v2out AS (" + fx.V2_OUT_SQL + f"""),
fwd AS (
  SELECT c.row_id, c.pos, b.seq, CASE WHEN b.seq IS NULL THEN c.func ELSE (SELECT DISTINCT map_func FROM rule_conditions r WHERE r.seq = b.seq) END AS fwd_func,
    '{{' || coalesce(CASE WHEN b.seq IS NULL
      THEN (SELECT string_agg({_json_args('a.key', 'a.canon', 'a.vtype')}, ',' ORDER BY a.arg_pos) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos)
      ELSE (SELECT string_agg({_json_args('v.key', 'v.value', 'v.vtype')}, ',' ORDER BY v.pos) FROM v2out v WHERE v.seq = b.seq) END, '') || '}}' AS fwd_args
  FROM calls c LEFT JOIN best b USING (row_id, pos)),
back AS (
  SELECT s.seq, min(t.seq) AS back_seq FROM (SELECT DISTINCT seq, map_func FROM rule_conditions) s JOIN (SELECT DISTINCT seq, map_func FROM rule_conditions) t USING (map_func)
  WHERE NOT EXISTS (SELECT 1 FROM v2out w WHERE w.seq = t.seq AND NOT EXISTS (
    SELECT 1 FROM v2out v WHERE v.seq = s.seq AND v.key = w.key AND (w.value = '*' OR v.cmp = w.cmp)))
  GROUP BY s.seq)
SELECT f.row_id, f.pos, f.fwd_func, f.fwd_args, coalesce((SELECT DISTINCT code FROM rule_conditions r WHERE r.seq = k.back_seq), f.fwd_func) AS back_func,
  CASE WHEN k.back_seq IS NULL THEN f.fwd_args ELSE '{{' || coalesce((SELECT string_agg({_json_args('r.k', 'r.value', 'r.vtype')}, ',' ORDER BY r.k_pos)
    FROM rule_conditions r WHERE r.seq = k.back_seq AND r.k IS NOT NULL), '') || '}}' END AS back_args
FROM fwd f LEFT JOIN back k ON k.seq = f.seq"""
)


@register("substitute_v2", V2_ORACLE)
def q_substitute_v2(spark, sf_dir):
    rules = fx.v2_rules(spark)
    keep = ["row_id", "pos", "fwd_func", "fwd_args"]
    fwd = rules_op.substitute(_plain_calls(spark, sf_dir), rules, "forward").withColumn("fwd_args", rules_op.object_text(F.col("out_args")))
    again = fwd.select("row_id", "pos", F.col("out_func").alias("fwd_func"), "fwd_args", F.col("out_func").alias("func"), F.col("out_args").alias("args"))
    back = rules_op.substitute(again, rules, "reverse")
    return back.select(*keep, F.col("out_func").alias("back_func"), rules_op.object_text(F.col("out_args")).alias("back_args"))


@register(
    "group_by_query",
    o.with_(o.TAGGED, o.CALLS)
    + """SELECT t.query, min(c.row_id) OVER (PARTITION BY t.query) AS query_first,
   row_number() OVER (PARTITION BY t.query ORDER BY c.row_id, c.pos) AS call_seq, c.func, c.raw_args
FROM calls c JOIN tagged t USING (row_id) WHERE t.query <> ''""",
)
def q_group_by_query(spark, sf_dir):
    c = calls_op.calls_table(fx.tagged(spark, sf_dir), "llm_output", ("row_id", "query"))
    return rules_op.group_by_query(c)


# ---------------------------------------------------------------- chat, split

from ..operators import chat as chat_op  # noqa: E402

SYS = chat_op.DEFAULT_SYSTEM_PROMPT


def _chat(spark, sf_dir):
    return chat_op.chat_examples(fx.chat_labelled(spark, sf_dir), "user_text", "assistant", SYS)


@register(
    "json_repair",
    o.with_(o.TAGGED.replace("tagged AS", "unused AS"), o.PREDS, o.REPAIR_INPUT)
    + r"""SELECT ex_id,
  CASE WHEN json_valid(raw_out) THEN 'as_is' WHEN json_valid(fixed) THEN 'repaired' ELSE 'failed' END AS status,
  CASE WHEN json_valid(raw_out) THEN json_extract_string(raw_out, '$.calls[0].name')
       WHEN json_valid(fixed) THEN json_extract_string(fixed, '$.calls[0].name') END AS name
FROM (SELECT ex_id, raw_out,
  regexp_replace(replace(replace(replace(trim(raw_out), chr(92) || '"', '"'), chr(92) || 'n', chr(10)), chr(92) || 't', chr(9)),
                 '([\{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:', '\1"\2":', 'g') AS fixed
  FROM repair_input) r""",
)
def q_json_repair(spark, sf_dir):
    df = chat_op.normalise_assistant(fx.repair_input(spark, sf_dir), "raw_out", repair=True)
    return df.select("ex_id", "status", F.try_variant_get("parsed", "$.calls[0].name", "string").alias("name"))


CHAT_ORACLE = o.with_(o.CHAT, o.CHAT_LABELLED) + f""", chat AS (
  SELECT conv_id, turn, trim(user_text) AS user_content, assistant,
    CAST(to_json([{{'role': 'system', 'content': '{SYS.replace("'", "''")}'}}, {{'role': 'user', 'content': trim(user_text)}}]) AS VARCHAR) AS messages_json
  FROM chat_labelled)
"""


@register("chat_examples", CHAT_ORACLE + "SELECT conv_id, turn, messages_json, assistant FROM chat")
def q_chat_examples(spark, sf_dir):
    return _chat(spark, sf_dir).select("conv_id", "turn", F.to_json("messages").alias("messages_json"), "assistant")


@register(
    "message_expected_normalise",
    CHAT_ORACLE + "SELECT user_content AS message, assistant AS expected FROM chat WHERE user_content <> ''",
)
def q_message_expected_normalise(spark, sf_dir):
    return chat_op.message_expected(_chat(spark, sf_dir))


def _prompt_sql(user: str) -> str:
    head, rest = chat_op.PROMPT_TEMPLATE.split("{sys}")
    mid, tail = rest.split("{user}")
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{lit(head)} || {lit(SYS)} || {lit(mid)} || {user} || {lit(tail.replace('{{', '{'))}"


@register(
    "training_text",
    CHAT_ORACLE
    + f"""SELECT conv_id, turn, {_prompt_sql('user_content')} AS prompt,
  CASE WHEN NOT json_valid(assistant) THEN assistant
       WHEN json_type(assistant) = 'ARRAY' THEN array_to_string(list_transform(json_extract(assistant, '$[*]'), lambda x: CAST(x AS VARCHAR)), '')
       ELSE CAST(json(assistant) AS VARCHAR) END AS target
FROM chat""",
)
def q_training_text(spark, sf_dir):
    return chat_op.training_text(_chat(spark, sf_dir)).select("conv_id", "turn", "prompt", "target")


SPLIT_ORACLE = o.with_(o.CHAT, o.CHAT_LABELLED) + """SELECT conv_id, turn,
  CASE WHEN idx < floor(n * 0.8) THEN 'train' WHEN idx < floor(n * 0.8) + floor(n * 0.1) THEN 'eval' ELSE 'test' END AS split
FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), conv_id, turn) - 1 AS idx,
             count(*) OVER () AS n FROM chat_labelled) x"""


@register("split_exact", SPLIT_ORACLE)
def q_split_exact(spark, sf_dir):
    df = _chat(spark, sf_dir)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return chat_op.split_exact(df, key, "80,10,10", 42, True, ["conv_id", "turn"]).select("conv_id", "turn", "split")


@register(
    "limit_in_order",
    o.with_(o.CHAT, o.CHAT_LABELLED) + "SELECT conv_id, turn, user_text, assistant FROM chat_labelled ORDER BY conv_id, turn LIMIT 100",
)
def q_limit_in_order(spark, sf_dir):
    return chat_op.limit_in_order(fx.chat_labelled(spark, sf_dir), ["conv_id", "turn"], 100)


# ---------------------------------------------------------------- evaluation

from ..functions.jsontext import strict_json  # noqa: E402
from ..functions.normalise import format_valid, normalise_calls  # noqa: E402
from ..operators import evaluate as ev  # noqa: E402


def _p27_sql(x: str) -> str:
    s = f"lower(trim({x}))"
    return (
        f"CASE WHEN regexp_matches({s}, '{ev.NIGHT_RE}') THEN 'enable_night_mode' "
        f"WHEN regexp_matches({s}, '{ev.OFF_RE}') THEN 'power_off' WHEN regexp_matches({s}, '{ev.ON_RE}') THEN 'power_on' END"
    )


@register(
    "keyword_router",
    f"SELECT conv_id, turn, role, {_p27_sql('text')} AS route FROM conversations",
)
def q_keyword_router(spark, sf_dir):
    from ..session import register_tables

    register_tables(spark, sf_dir, ["conversations"])
    conv = spark.table("conversations")
    return conv.select("conv_id", "turn", "role", ev.route_keywords(F.col("text")).alias("route"))


def _p28_sql(x: str) -> str:
    one = lambda n: f"""'{{"calls":[{{"name":"' || {n} || '","arguments":{{}}}}]}}'"""
    full = "(?s)" + ev.REGEX_FULL
    wn = "(?s)" + ev.REGEX_TAIL_WITH_NAME
    nl = "(?s)" + ev.REGEX_TAIL_NAMELESS
    return f"""CASE WHEN regexp_matches({x}, '{full}')
          THEN replace(replace(regexp_extract({x}, '{full}', 0), '"arguments":[]', '"arguments":{{}}'), '"arguments": []', '"arguments": {{}}')
        WHEN regexp_matches({x}, '{wn}') THEN {one(f"regexp_extract({x}, '{wn}', 1)")}
        WHEN regexp_matches({x}, '{nl}') THEN {one(f"regexp_extract({x}, '{nl}', 1)")}
        WHEN regexp_matches({x}, '{ev.REGEX_BARE_NAME}') THEN {one(f"regexp_extract({x}, '{ev.REGEX_BARE_NAME}', 1)")}
        ELSE '' END"""


CUT_SQL = "split_part(coalesce(raw, ''), chr(10) || 'User:', 1)"
EVAL_ROWS_SQL = o.with_(o.PREDS) + f""", ex AS (SELECT ex_id, user_text, gold, raw, {_p28_sql(CUT_SQL)} AS ptxt FROM predictions),
sc AS (
  SELECT ex_id, user_text, gold, ptxt,
    CASE WHEN ptxt <> '' AND json_valid(ptxt) THEN json_extract_string(ptxt, '$.calls[0].name') END AS pname,
    json_extract_string(gold, '$.calls[0].name') AS gname,
    {_p27_sql('user_text')} AS fb
  FROM ex),
sc2 AS (
  SELECT ex_id, gold, gname,
    CASE WHEN pname IS NULL AND allow AND fb IS NOT NULL THEN 'fallback' ELSE 'model' END AS source,
    CASE WHEN pname IS NULL AND allow AND fb IS NOT NULL THEN '{{"calls":[{{"name":"' || fb || '","arguments":{{}}}}]}}' ELSE ptxt END AS pred_text,
    CASE WHEN pname IS NULL AND allow AND fb IS NOT NULL THEN fb ELSE pname END AS pname2, allow
  FROM sc, (SELECT true AS allow) a),
scored AS (
  SELECT ex_id, source, pred_text,
    coalesce(pred_text <> '' AND json_valid(pred_text) AND json_valid(gold)
             AND CAST(json(CASE WHEN json_valid(pred_text) THEN pred_text ELSE '{{}}' END) AS VARCHAR)
                 = CAST(json(CASE WHEN json_valid(gold) THEN gold ELSE '[]' END) AS VARCHAR), false) AS exact,
    coalesce(pname2 IS NOT NULL AND gname IS NOT NULL AND pname2 = gname, false) AS name1,
    (CASE WHEN pname2 = 'power_on' THEN 'on' ELSE 'off' END) = (CASE WHEN gname = 'power_on' THEN 'on' ELSE 'off' END)
      AND coalesce(pname2 = 'enable_night_mode', false) = coalesce(gname = 'enable_night_mode', false) AS state
  FROM sc2)
"""


@register("extract_calls_json", o.with_(o.PREDS) + f"SELECT ex_id, {_p28_sql(CUT_SQL)} AS pred_text FROM predictions")
def q_extract_calls_json(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return p.select("ex_id", ev.extract_calls_json(ev.cut_continuation("raw")).alias("pred_text"))


@register("eval_exact_name_state", EVAL_ROWS_SQL + "SELECT ex_id, source, pred_text, exact, name1, state FROM scored")
def q_eval_exact_name_state(spark, sf_dir):
    return ev.score(fx.predictions(spark, sf_dir), True).select("ex_id", "source", "pred_text", "exact", "name1", "state")


@register(
    "eval_suite_cases",
    EVAL_ROWS_SQL
    + """, m AS (SELECT count(*) AS total, avg(CAST(exact AS DOUBLE)) AS exact, avg(CAST(name1 AS DOUBLE)) AS name1,
                 avg(CAST(state AS DOUBLE)) AS state, count(*) FILTER (WHERE source = 'fallback') AS fb,
                 avg(CAST(source = 'fallback' AS DOUBLE)) AS fb_rate FROM scored)
SELECT c.case_name, m.total, m.exact, m.name1, m.state, m.fb, m.fb_rate
FROM (VALUES ('baseline_fb_on', 'baseline'), ('baseline_nofb', 'baseline'), ('finetuned_fb_on', 'finetuned'), ('finetuned_nofb', 'finetuned')) c(case_name, model)
LEFT JOIN m ON c.model = 'baseline'""",
)
def q_eval_suite_cases(spark, sf_dir):
    preds = fx.predictions(spark, sf_dir).withColumn("model", F.lit("baseline"))
    cases = spark.createDataFrame(fx.EVAL_CASES, "case_name string, model string, allow_fallback boolean")
    return ev.eval_suite(preds, cases)


GRID_ORACLE = (
    o.with_(o.TAGGED)
    + ", prompts AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in fx.GRID_PROMPTS)
    + ") p(prompt_id, prompt)),\n"
    + f"""grid AS (SELECT p.prompt_id, t.row_id AS msg_id, trim(t.llm_output) AS expected, {fx.GRID_RAW_SQL} AS raw
         FROM tagged t CROSS JOIN prompts p WHERE trim(p.prompt) <> '' AND trim(t.query) <> '')
SELECT prompt_id, count(*) AS rows, count(*) FILTER (WHERE expected = {o.p15("replace(trim(raw), '\"', '')")}) AS all_match
FROM grid GROUP BY prompt_id"""
)


def _grid(spark, sf_dir):
    t = fx.tagged(spark, sf_dir)
    messages = t.select(F.col("row_id").alias("msg_id"), F.col("query").alias("message"), F.col("llm_output").alias("expected"), "llm_output")
    prompts = spark.createDataFrame(fx.GRID_PROMPTS, "prompt_id int, prompt string")
    return ev.prompt_grid(prompts, messages).withColumn("raw", F.expr(fx.GRID_RAW_SQL))


@register("text_match_by_prompt", GRID_ORACLE)
def q_text_match_by_prompt(spark, sf_dir):
    return ev.text_match(_grid(spark, sf_dir))


@register(
    "arg_compare_policy",
    RULE_ORACLE_HEAD.replace("WITH ", "WITH ", 1)
    + ", "
    + o.typed_args("largs", "calls", "row_id, pos", "lenient")
    + """, rr AS (SELECT DISTINCT seq, map_func FROM rule_conditions),
named AS (SELECT c.row_id, c.pos, coalesce(rr.map_func, '') AS name FROM calls c LEFT JOIN best b USING (row_id, pos) LEFT JOIN rr ON rr.seq = b.seq),
cmp AS (
  SELECT n.row_id, n.pos, n.name,
    (SELECT count(*) FROM cargs a WHERE a.row_id = n.row_id AND a.pos = n.pos) AS na,
    (SELECT count(*) FROM largs b WHERE b.row_id = n.row_id AND b.pos = n.pos) AS nb,
    (SELECT count(*) FROM cargs a JOIN largs b ON a.row_id = b.row_id AND a.pos = b.pos AND a.key = b.key AND a.canon = b.canon
      WHERE a.row_id = n.row_id AND a.pos = n.pos) AS nm,
    coalesce((SELECT canon FROM cargs a WHERE a.row_id = n.row_id AND a.pos = n.pos AND a.key = 'mode'), 'None') AS a_mode,
    coalesce((SELECT canon FROM largs b WHERE b.row_id = n.row_id AND b.pos = n.pos AND b.key = 'mode'), 'None') AS b_mode,
    coalesce((SELECT canon FROM cargs a WHERE a.row_id = n.row_id AND a.pos = n.pos AND a.key = 'type'), 'None') AS a_type,
    coalesce((SELECT canon FROM largs b WHERE b.row_id = n.row_id AND b.pos = n.pos AND b.key = 'type'), 'None') AS b_type
  FROM named n)
SELECT row_id, pos, name,
  CASE WHEN lower(name) = 'talk' THEN true
       WHEN lower(name) IN ('info_air_quality', 'info_weather', 'info_caution', 'info_organic_compound') THEN a_type = b_type
       WHEN lower(name) IN ('mode_on', 'mode_off') THEN a_mode = b_mode
       ELSE na = nb AND nb = nm END AS args_equal
FROM cmp""",
)
def q_arg_compare_policy(spark, sf_dir):
    conv = rules_op.convert_calls(_plain_calls(spark, sf_dir), _rules(spark))
    both = with_args(conv.withColumnRenamed("args", "a"), "raw_args", "lenient", "b")
    return both.select("row_id", "pos", F.col("map_func").alias("name"), ev.args_equal(F.col("a"), F.col("b"), F.col("map_func")).alias("args_equal"))


@register(
    "expected_any_of",
    TEMPLATE_HEAD
    + f""", cand AS (
  SELECT c.row_id, c.pos,
    CASE WHEN b.seq IS NULL THEN c.func ELSE coalesce(nullif((SELECT DISTINCT map_func FROM rule_conditions r WHERE r.seq = b.seq), ''), c.func) END AS name,
    coalesce(CASE WHEN b.seq IS NULL
      THEN (SELECT string_agg({_json_args('a.key', 'a.canon', 'a.vtype')}, ',' ORDER BY a.key) FROM cargs a WHERE a.row_id = c.row_id AND a.pos = c.pos)
      ELSE (SELECT string_agg({_json_args('f.name', 'f.val', 'f.vtype')}, ',' ORDER BY f.name) FROM filled f WHERE f.row_id = c.row_id AND f.pos = c.pos) END, '') AS args
  FROM calls c LEFT JOIN best b USING (row_id, pos)),
"""
    + FIRST_CALL_BLOCKS
    + f"""
SELECT p.row_id, p.fname AS predicted, coalesce(bool_or(d.name = p.fname), false) AS any_name,
  coalesce(bool_or(d.name = p.fname AND d.args = coalesce((SELECT string_agg({_json_args('a.key', 'a.canon', 'a.vtype')}, ',' ORDER BY a.key) FROM fargs a WHERE a.row_id = p.row_id), '')), false) AS any_match
FROM fc p LEFT JOIN cand d USING (row_id) GROUP BY p.row_id, p.fname""",
)
def q_expected_any_of(spark, sf_dir):
    t = fx.tagged(spark, sf_dir)
    lists = rules_op.map_rows_template(t.select("row_id", "llm_output"), "llm_output", fx.template_rules(spark))
    fc = lists.withColumn("fc", first_call(F.col("llm_output"))).filter(F.col("fc").isNotNull())
    predicted = F.regexp_replace(F.col("fc.name"), "^function_", "")
    fc = fc.select("row_id", predicted.alias("predicted"), F.to_json(F.parse_json(args_json(F.col("fc.args")))).alias("pred_args"), "mapped_json")
    fc = ev.with_expected_candidates(fc, "mapped_json", "candidates")
    name, args = F.col("predicted"), F.col("pred_args")
    return fc.select("row_id", "predicted", ev.any_of(F.col("candidates"), name).alias("any_name"), ev.any_of(F.col("candidates"), name, args).alias("any_match"))


# What each cut leaves: up to four characters are closed again, without the arguments' value nothing parses.
CONTINUATION_ORACLE = (
    o.with_(o.PREDS)
    + """, cut AS (SELECT ex_id, substr(gold, 19, CAST(length(gold) - 18 - ex_id % 6 AS INTEGER)) AS cont, json_extract_string(gold, '$.calls[0].name') AS g FROM predictions)
SELECT ex_id, cont, '{"functionName":"' || g || '","arguments":' || CASE WHEN ex_id % 6 < 5 THEN '{}}' ELSE '' END AS repaired, ex_id % 6 < 5 AS repaired_ok
FROM cut"""
)


@register("json_continuation_repair", CONTINUATION_ORACLE)
def q_json_continuation_repair(spark, sf_dir):
    """Gold texts cut after '{"calls":[{"name":' and truncated at several points, then closed."""
    p = fx.predictions(spark, sf_dir)
    body = F.substr(F.col("gold"), F.lit(len('{"calls":[{"name":') + 1))
    cont = F.substr(body, F.lit(1), F.length(body) - (F.col("ex_id") % 6).cast("int"))
    return ev.with_continuation_repair(p.select("ex_id", cont.alias("cont")), "cont")


# ---------------------------------------------------------------- repair


@register("call_normalise", o.with_(o.TAGGED) + f"SELECT row_id, {o.p15('llm_output')} AS normalised FROM tagged")
def q_call_normalise(spark, sf_dir):
    return fx.tagged(spark, sf_dir).select("row_id", normalise_calls(F.col("llm_output")).alias("normalised"))


def _p16_sql(x: str) -> str:
    txt = o.strip(x)
    head0 = f"regexp_replace(substr({txt}, 1, greatest(length({txt}) - 5, 0)), '\\s+$', '')"
    head1 = f"(CASE WHEN ends_with({head0}, ';') THEN substr({head0}, 1, length({head0}) - 1) ELSE {head0} END)"
    head = o.strip(head1)
    return f"""(ends_with({txt}, '<end>') AND {head} <> ''
   AND list_bool_and(list_transform(string_split({head}, ';'), lambda p: {o.strip('p')} <> '' AND regexp_matches({o.strip('p')}, '(?s)^<(function_[A-Za-z0-9_]+)>\\((.*?)\\)$')))
   AND NOT regexp_matches({head}, '\\)\\s*<function_'))"""


@register("format_validity", o.with_(o.TAGGED) + f"SELECT row_id, {_p16_sql('llm_output')} AS valid FROM tagged")
def q_format_validity(spark, sf_dir):
    return fx.tagged(spark, sf_dir).select("row_id", format_valid(F.col("llm_output")).alias("valid"))


@register(
    "repair_status",
    o.with_(o.TAGGED)
    + f""", rep AS (SELECT llm_output AS raw, {o.p15('llm_output')} AS repaired FROM tagged)
SELECT CASE WHEN {_p16_sql('repaired')} AND trim(repaired) = trim(raw) THEN 'already_ok'
            WHEN {_p16_sql('repaired')} THEN 'repaired_success' ELSE 'still_broken' END AS status, count(*) AS count
FROM rep GROUP BY 1""",
)
def q_repair_status(spark, sf_dir):
    from ..operators import repair as rep

    t = fx.tagged(spark, sf_dir)
    return rep.repair_report(rep.repair_status(t, "llm_output", normalise_calls))


# ---------------------------------------------------------------- augmentation

from ..operators import augment as aug  # noqa: E402
from ..operators import pairing as pair_op  # noqa: E402


def _augment_oracle(keep_original: bool) -> str:
    """Choice-path enumeration: c_k = 0 (rule k not applied) or j (replacement j), only when applicable."""
    blocks = ["r0 AS (SELECT row_id, query AS q0, llm_output AS o0 FROM tagged)"]
    order = []
    for k, (_, ori, sr) in enumerate(sorted(fx.REPLACEMENT_RULES), start=1):
        prev = f"r{k - 1}"
        q, oo = f"q{k - 1}", f"o{k - 1}"
        applicable = " OR ".join(f"(strpos({q}, '{t}') > 0 OR strpos({oo}, '{t}') > 0)" for t in ori)
        sr_list = "[" + ", ".join(f"'{s}'" for s in sr) + "]"

        def rep(col):
            expr = col
            for t in ori:
                expr = f"replace({expr}, '{t}', {sr_list}[c{k}])"
            return expr

        keep = ", ".join([f"c{i}" for i in range(1, k)] + ["row_id"])
        blocks.append(
            f"""{prev}x AS (SELECT {keep}, {q}, {oo}, unnest(CASE WHEN {applicable} THEN range(0, {len(sr) + 1}) ELSE [0] END) AS c{k} FROM {prev})"""
        )
        blocks.append(
            f"""r{k} AS (SELECT {keep}, c{k}, CASE WHEN c{k} = 0 THEN {q} ELSE {rep(q)} END AS q{k},
                       CASE WHEN c{k} = 0 THEN {oo} ELSE {rep(oo)} END AS o{k} FROM {prev}x)"""
        )
        order.append(f"c{k}")
    last = len(fx.REPLACEMENT_RULES)
    ordc = ", ".join(order)
    drop_first = "" if keep_original else f"WHERE NOT ({' AND '.join(f'{c} = 0' for c in order)})"
    return o.with_(o.TAGGED, *blocks) + f""", fin AS (SELECT * FROM r{last} {drop_first}),
dedup AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY row_id, q{last}, o{last} ORDER BY {ordc}) = 1)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY {ordc}) - 1 AS INTEGER) AS variant_idx,
  CASE WHEN row_number() OVER (PARTITION BY row_id ORDER BY {ordc}) = 1 THEN CAST(row_id AS VARCHAR)
       ELSE CAST(row_id AS VARCHAR) || '-R' || CAST(row_number() OVER (PARTITION BY row_id ORDER BY {ordc}) - 1 AS VARCHAR) END AS index_label,
  q{last} AS query, o{last} AS llm_output
FROM dedup"""


def _augmented(spark, sf_dir, keep_original):
    t = fx.tagged(spark, sf_dir)
    v = aug.augment(t, "row_id", ["query", "llm_output"], fx.REPLACEMENT_RULES, keep_original=keep_original)
    return v.select("row_id", "variant_idx", "index_label", "query", "llm_output")


@register("augment_rules", _augment_oracle(True))
def q_augment_rules(spark, sf_dir):
    return _augmented(spark, sf_dir, True)


@register("augment_drop_original", _augment_oracle(False))
def q_augment_drop_original(spark, sf_dir):
    return _augmented(spark, sf_dir, False)


LOC_SQL = r"location\s*=\s*(['\"])?([^'\"\s,);\]}]+)"


@register(
    "delexicalise",
    o.with_(o.TAGGED)
    + f""", v AS (SELECT row_id, query, llm_output,
    CASE WHEN regexp_matches(llm_output, '{LOC_SQL.replace("'", "''")}') THEN regexp_extract(llm_output, '{LOC_SQL.replace("'", "''")}', 2) END AS val FROM tagged),
d AS (SELECT row_id,
    CASE WHEN val IS NOT NULL AND val <> '' AND strpos(query, val) > 0 THEN replace(query, val, '<loc>') ELSE query END AS query,
    CASE WHEN val IS NOT NULL AND val <> '' AND strpos(query, val) > 0 THEN replace(llm_output, val, '<loc>') ELSE llm_output END AS llm_output FROM v)
SELECT row_id, query, llm_output, strpos(query, '<loc>') > 0 OR strpos(llm_output, '<loc>') > 0 AS has_placeholder FROM d""",
)
def q_delexicalise(spark, sf_dir):
    d = aug.delexicalise(fx.tagged(spark, sf_dir), "query", "llm_output", "location", "<loc>")
    flag = F.contains(F.col("query"), F.lit("<loc>")) | F.contains(F.col("llm_output"), F.lit("<loc>"))
    return d.select("row_id", "query", "llm_output", flag.alias("has_placeholder"))


MERGED_TAGS_SQL = o.with_(o.TTAGS) + """, firsts AS (
  SELECT block, slot, value, arg_min(prio, prio * 100000000 + pos) AS prio, arg_min(pos, prio * 100000000 + pos) AS pos FROM ttags GROUP BY block, slot, value),
merged AS (SELECT block, slot, value, row_number() OVER (PARTITION BY block, slot ORDER BY prio, pos, value) AS vpos FROM firsts)
"""


@register("template_tag_merge", MERGED_TAGS_SQL + "SELECT block, slot, value, vpos FROM merged")
def q_template_tag_merge(spark, sf_dir):
    return aug.merge_tags(fx.template_tags(spark, sf_dir))


@register(
    "template_expand",
    MERGED_TAGS_SQL.replace("WITH ", "WITH " + o.TFORMATS + ",\n", 1)
    + """, f AS (SELECT *, regexp_extract_all(fmt, '<[^>]+>') AS slots FROM tformats),
l1 AS (SELECT f.block, f.fname, f.fmt_pos, f.slots, m.value AS v1, m.vpos AS p1 FROM f JOIN merged m ON m.block = f.block AND m.slot = f.slots[1]),
l2 AS (SELECT l1.*, m.value AS v2, m.vpos AS p2 FROM l1 JOIN merged m ON m.block = l1.block AND m.slot = l1.slots[2] WHERE len(slots) >= 2
       UNION ALL SELECT l1.*, NULL AS v2, 0 AS p2 FROM l1 WHERE len(slots) < 2),
l3 AS (SELECT l2.*, m.value AS v3, m.vpos AS p3 FROM l2 JOIN merged m ON m.block = l2.block AND m.slot = l2.slots[3] WHERE len(slots) >= 3
       UNION ALL SELECT l2.*, NULL AS v3, 0 AS p3 FROM l2 WHERE len(slots) < 3),
q AS (SELECT block, fname, fmt_pos, concat_ws(' ', v1, v2, v3) AS query, p1, p2, p3 FROM l3),
kept AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query, fname ORDER BY block, fmt_pos, p1, p2, p3) = 1)
SELECT row_number() OVER (ORDER BY block, fmt_pos, p1, p2, p3) AS "index", query, fname AS function FROM kept""",
)
def q_template_expand(spark, sf_dir):
    merged = aug.merge_tags(fx.template_tags(spark, sf_dir))
    return aug.number_queries(aug.expand_templates(fx.template_formats(spark), merged))


# ---------------------------------------------------------------- pairing

HS_SQL = o.with_(o.TAGGED) + r""", named AS (SELECT row_id, query, llm_output AS function, regexp_extract(llm_output, '<\s*([^>\s]+)\s*>', 1) AS func_name,
                          md5('42:' || CAST(row_id AS VARCHAR)) AS k FROM tagged),
hs AS (SELECT *, row_number() OVER (PARTITION BY func_name ORDER BY k, row_id) AS r, count(*) OVER (PARTITION BY func_name) AS n
       FROM named WHERE func_name <> ''),
pool AS (SELECT * FROM hs WHERE r <= n // 2),
sizes AS (SELECT func_name, count(*) AS gsize FROM pool GROUP BY func_name),
st AS (SELECT sum(gsize) AS n, max(gsize) AS m FROM sizes),
par AS (SELECT CASE WHEN m <= n // 2 THEN n // 2 ELSE m END AS off, CASE WHEN m <= n // 2 THEN n // 2 ELSE n - m END AS np FROM st),
ord AS (SELECT p.*, row_number() OVER (ORDER BY s.gsize DESC, p.func_name, p.k, p.row_id) - 1 AS pos FROM pool p JOIN sizes s USING (func_name))
"""


def _pairing_input(spark, sf_dir):
    t = fx.tagged(spark, sf_dir)
    return t.select("row_id", "query", F.col("llm_output").alias("function"))


@register("half_sample", HS_SQL + "SELECT row_id, func_name, r <= n // 2 AS in_pool FROM hs")
def q_half_sample(spark, sf_dir):
    return pair_op.half_sample(_pairing_input(spark, sf_dir), "row_id").select("row_id", "func_name", "in_pool")


@register(
    "pair_functions",
    HS_SQL
    + """, pr AS (SELECT a.pos AS pair_no, a.query AS qa, b.query AS qb, a.function AS fa, b.function AS fb,
                  substr(md5('42:pair:' || CAST(a.pos AS VARCHAR)), 1, 1) IN ('0','1','2','3','4','5','6','7') AS bit
           FROM ord a JOIN ord b ON b.pos = a.pos + (SELECT off FROM par) WHERE a.pos < (SELECT np FROM par))
SELECT 'P' || lpad(CAST(pair_no AS VARCHAR), 6, '0') AS "index",
  CASE WHEN bit THEN qa || ' 다음으로 ' || qb ELSE qb || ' 다음으로 ' || qa END AS query,
  CASE WHEN bit THEN fa || ';' || fb || '<end>' ELSE fb || ';' || fa || '<end>' END AS function
FROM pr""",
)
def q_pair_functions(spark, sf_dir):
    sampled = pair_op.half_sample(_pairing_input(spark, sf_dir), "row_id", ranked=True)
    paired, _ = pair_op.pair_pool(sampled, "row_id")
    return pair_op.merge_pairs(paired).drop("pair_no")


@register(
    "pair_singles",
    HS_SQL
    + """, lo AS (SELECT 1 AS kind, func_name, k, row_id, query, function FROM ord
             WHERE NOT (pos < (SELECT np FROM par) OR (pos >= (SELECT off FROM par) AND pos < (SELECT off + np FROM par)))),
outside AS (SELECT 0 AS kind, func_name, k, row_id, query, function FROM hs WHERE r > n // 2),
al AS (SELECT * FROM outside UNION ALL SELECT * FROM lo)
SELECT 'P' || lpad(CAST(row_number() OVER (ORDER BY kind, func_name, k, row_id) - 1 + (SELECT np FROM par) AS VARCHAR), 6, '0') AS "index",
  query, CASE WHEN ends_with(trim(function), '<end>') THEN trim(function) ELSE trim(function) || '<end>' END AS function
FROM al""",
)
def q_pair_singles(spark, sf_dir):
    sampled = pair_op.half_sample(_pairing_input(spark, sf_dir), "row_id", ranked=True)
    plan = pair_op.pool_plan(sampled)
    _, left = pair_op.pair_pool(sampled, "row_id", plan=plan)
    return pair_op.singles(sampled, left, plan.pairs, "row_id", plan=plan)


# ---------------------------------------------------------------- prompts

from ..operators import prompts as prompts_op  # noqa: E402

SECTION_ORACLE = (
    "WITH spec AS (" + _spec_oracle() + "),\n"
    + """sp AS (SELECT func, description, arg_key AS arg, enum_pos,
   CASE WHEN arg_type = 'boolean' THEN CASE WHEN enum_value = 'true' THEN 'True' ELSE 'False' END
        WHEN arg_type = 'string' THEN json_extract_string(enum_value, '$') ELSE enum_value END AS enum_text FROM spec),
hints AS (SELECT func, description, arg, string_agg(enum_text, '/' ORDER BY enum_pos) AS hint FROM sp GROUP BY func, description, arg),
blocks AS (SELECT func, '- ' || func || ': ' || description || chr(10) || '  arguments (object):' || chr(10)
   || string_agg('    - ' || arg || ':' || CASE WHEN hint <> '' THEN '  ' || hint ELSE '' END, chr(10) ORDER BY arg) || chr(10)
   || '  example: {"name": "' || func || '", "arguments": {' || string_agg('"' || arg || '": "..."', ', ' ORDER BY arg) || '}}' AS block
 FROM hints GROUP BY func, description)
"""
)


def _blocks(spark, sf_dir):
    return prompts_op.function_blocks(prompts_op.spec_from_inferred(q_function_spec_inference(spark, sf_dir)))


@register("prompt_function_section", SECTION_ORACLE + "SELECT func, block FROM blocks")
def q_prompt_function_section(spark, sf_dir):
    return _blocks(spark, sf_dir)


def _matrix_oracle() -> str:
    header = "\n".join(prompts_op.SECTION_HEADER) + "\n"
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    parts = ", ".join(f"('{k}', {p}, {lit(t)})" for k, p, t in fx.PROMPT_PARTS)
    return (
        SECTION_ORACLE
        + f""", section AS (SELECT {lit(header)} || string_agg(block, chr(10) ORDER BY func) AS section FROM blocks),
parts AS (SELECT * FROM (VALUES {parts}) AS p(kind, pos, text)),
f AS (SELECT pos AS format_pos, text AS format FROM parts WHERE kind = 'format'),
w AS (SELECT pos AS what_pos, text AS what FROM parts WHERE kind = 'what'),
h AS (SELECT pos AS how_pos, text AS how FROM parts WHERE kind = 'how'),
r AS (SELECT pos AS rule_pos, text AS rule FROM parts WHERE kind = 'rule')
SELECT format_pos, what_pos, how_pos, rule_pos,
  concat_ws(chr(10), CASE WHEN what <> '' THEN what END, CASE WHEN how <> '' THEN how END,
            CASE WHEN format <> '' THEN 'FORMAT=' || format END, CASE WHEN rule <> '' THEN rule END, {lit(prompts_op.MATRIX_GUARD)})
  || chr(10) || chr(10) || section AS prompt
FROM f, w, h, r, section"""
    )


@register("prompt_matrix", _matrix_oracle())
def q_prompt_matrix(spark, sf_dir):
    parts = spark.createDataFrame(fx.PROMPT_PARTS, "kind string, pos int, text string")
    section = prompts_op.functions_section(_blocks(spark, sf_dir))
    return prompts_op.prompt_matrix(parts, section)


_VALID_CALL = r"^<function_[A-Za-z0-9_]+>\([^()]*\)$"


def _valid_sql(text: str) -> str:
    """P16 of a text: ends with <end>, every ';' part is a whole call, no two calls run together."""
    head = o.strip(f"regexp_replace(regexp_replace(regexp_replace({o.strip(text)}, '<end>$', ''), '\\s+$', ''), ';$', '')")
    return f"""(ends_with({o.strip(text)}, '<end>') AND {head} <> '' AND NOT regexp_matches({head}, '\\)\\s*<function_')
    AND len(list_filter(string_split({head}, ';'), lambda p: NOT regexp_matches({o.strip('p')}, '{_VALID_CALL}'))) = 0)"""


def _repair_oracle() -> str:
    rules = ", ".join(
        f"('{arg}', {n}, {t}, '{r['type']}')"
        for arg, rs in fx.REPAIR_ARG_RULES.items()
        for n, r in enumerate(rs)
        for t in ([f"'{x}'" for x in r["target"]] or ["NULL"])
    )
    enums = ", ".join(f"('{arg}', {n}, {i}, '{v}')" for arg, rs in fx.REPAIR_ARG_RULES.items() for n, r in enumerate(rs) for i, v in enumerate(r["enum"]))
    members = ", ".join(f"('{fn}', {s}, {i}, '{a}')" for fn, sigs in fx.REPAIR_SIGNATURES.items() for s, sig in enumerate(sigs) for i, a in enumerate(sig))
    signatures = ", ".join(f"('{fn}', {s})" for fn, sigs in fx.REPAIR_SIGNATURES.items() for s in range(len(sigs)))
    return (
        o.with_(
            o.TAGGED,
            "damaged AS (" + fx.DAMAGED_SQL + ")",
            "s1 AS (SELECT *, translate(raw, '＜＞〈〉（）；', '<><>();') AS t1 FROM damaged)",
            "s2 AS (SELECT *, CASE WHEN strpos(t1, '<end>') > 0 THEN split_part(t1, '<end>', 1) ELSE t1 END AS t2 FROM s1)",
            "s3 AS (SELECT *, trim(regexp_replace(t2, '\\s*;\\s*', ';', 'g')) AS t3 FROM s2)",
            "s4 AS (SELECT *, regexp_replace(t3, '<function_([A-Za-z0-9_]+)\\(', '<function_\\1>(', 'g') AS t4 FROM s3)",
            "s5 AS (SELECT *, regexp_replace(regexp_replace(t4, '\\(([^()<>]*);<function_', '(\\1);<function_', 'g'), '\\(([^()<>]*)$', '(\\1)') AS t5 FROM s4)",
            "fixed AS (SELECT row_id, raw, regexp_replace(t5, ';$', '') || '<end>' AS txt, list_filter([CASE WHEN t1 <> raw THEN 'fullwidth' END, CASE WHEN t2 <> t1 THEN 'trim-after-end' END,"
            " CASE WHEN t3 <> t2 THEN 'whitespace' END, CASE WHEN t4 <> t3 THEN 'missing-gt' END, CASE WHEN t5 <> t4 THEN 'closeparen-insert' END], lambda x: x IS NOT NULL) AS tags FROM s5)",
            o.CALLS.replace("calls AS", "rcalls AS", 1).replace("llm_output", "txt").replace("FROM tagged", "FROM fixed"),
            o.typed_args("rargs", "rcalls", "row_id, pos, func", "lenient"),
            f"rules AS (SELECT * FROM (VALUES {rules}) AS r(arg, n, target, type))",
            f"enums AS (SELECT * FROM (VALUES {enums}) AS e(arg, n, i, v))",
            f"members AS (SELECT * FROM (VALUES {members}) AS m(fn, sig, i, arg))",
            f"sigs AS (SELECT * FROM (VALUES {signatures}) AS s(fn, sig))",
            # the first rule of the argument that names the function, or names none
            "ruled AS (SELECT a.row_id, a.pos, 'function_' || a.func AS fn, a.arg_pos, a.key, a.canon, r.n, r.type FROM rargs a JOIN rules r ON r.arg = a.key AND (r.target IS NULL OR r.target = 'function_' || a.func)"
            " QUALIFY row_number() OVER (PARTITION BY a.row_id, a.pos, a.key ORDER BY r.n) = 1)",
            "cast_ AS (SELECT *, CASE type WHEN 'integer' THEN CASE WHEN regexp_matches(canon, '^-?[0-9]+$') THEN CAST(try_cast(canon AS BIGINT) AS VARCHAR) END"
            " WHEN 'boolean' THEN CASE WHEN lower(canon) IN ('true', '1') THEN 'True' WHEN lower(canon) IN ('false', '0') THEN 'False' END ELSE canon END AS val FROM ruled)",
            "kept AS (SELECT c.* FROM cast_ c WHERE val IS NOT NULL AND (NOT EXISTS (SELECT 1 FROM enums e WHERE e.arg = c.key AND e.n = c.n) OR EXISTS (SELECT 1 FROM enums e WHERE e.arg = c.key AND e.n = c.n AND e.v = c.val)))",
            # how many kept keys each signature of the call's function holds; all of them, or the most, wins, the first of equals
            "overlap AS (SELECT c.row_id, c.pos, s.sig, (SELECT count(*) FROM kept k JOIN members m ON m.fn = s.fn AND m.sig = s.sig AND m.arg = k.key WHERE k.row_id = c.row_id AND k.pos = c.pos) AS n"
            " FROM rcalls c JOIN sigs s ON s.fn = 'function_' || c.func)",
            "chosen AS (SELECT row_id, pos, sig FROM overlap QUALIFY row_number() OVER (PARTITION BY row_id, pos ORDER BY n DESC, sig) = 1)",
            "slots AS (SELECT c.row_id, c.pos, m.fn, m.i, m.arg FROM chosen c JOIN rcalls r USING (row_id, pos) JOIN members m ON m.fn = 'function_' || r.func AND m.sig = c.sig"
            " UNION ALL SELECT k.row_id, k.pos, k.fn, k.arg_pos, k.key FROM kept k WHERE NOT EXISTS (SELECT 1 FROM sigs s WHERE s.fn = k.fn))",
            "filled AS (SELECT s.row_id, s.pos, s.i, s.arg || '=' || coalesce(k.val, (SELECT e.v FROM enums e JOIN (SELECT arg, min(n) AS n FROM rules r WHERE r.arg = s.arg AND (r.target IS NULL OR r.target = s.fn) GROUP BY arg) f"
            " ON f.arg = e.arg AND f.n = e.n WHERE e.i = 0)) AS kv FROM slots s LEFT JOIN kept k ON k.row_id = s.row_id AND k.pos = s.pos AND k.key = s.arg)",
            "built AS (SELECT c.row_id, string_agg('<function_' || c.func || '>(' || coalesce((SELECT string_agg(f.kv, ', ' ORDER BY f.i) FROM filled f WHERE f.row_id = c.row_id AND f.pos = c.pos AND f.kv IS NOT NULL), '') || ')', ';' ORDER BY c.pos) || '<end>' AS txt FROM rcalls c GROUP BY c.row_id)",
            f"done AS (SELECT f.row_id, f.raw, {_valid_sql('f.txt')} AND b.txt IS NOT NULL AS rebuilt, CASE WHEN {_valid_sql('f.txt')} AND b.txt IS NOT NULL THEN b.txt ELSE f.txt END AS repaired, f.tags FROM fixed f LEFT JOIN built b USING (row_id))",
        )
        + f"""SELECT row_id, raw, repaired, array_to_string(CASE WHEN rebuilt THEN list_append(tags, 'rebuild-calls') ELSE tags END, ';') AS tags,
  CASE WHEN {_valid_sql('repaired')} AND {o.strip('repaired')} = {o.strip('raw')} THEN 'already_ok' WHEN {_valid_sql('repaired')} THEN 'repaired_success' ELSE 'still_broken' END AS status FROM done"""
    )


@register("schema_repair", _repair_oracle())
def q_schema_repair(spark, sf_dir):
    """P17 over damaged tagged text in six ways (our contract; no reference implementation)."""
    from ..operators import repair as rep

    out = rep.schema_repair(fx.damaged(spark, sf_dir), "raw", fx.REPAIR_ARG_RULES, fx.REPAIR_SIGNATURES)
    return out.select("row_id", "raw", "repaired", F.array_join("tags", ";").alias("tags"), "status")


# ---------------------------------------------------------------- reports


@register(
    "rows_by_function",
    o.with_(o.TAGGED, o.PCALLS)
    + "SELECT row_id, pos, func, raw_args, row_number() OVER (PARTITION BY func ORDER BY row_id, pos) AS func_seq FROM pcalls",
)
def q_rows_by_function(spark, sf_dir):
    return prof.rows_by_function(_pcalls(spark, sf_dir)).select("row_id", "pos", "func", "raw_args", "func_seq")


@register(
    "expansion_report",
    o.with_(o.TAGGED)
    + ", aug AS (" + _augment_oracle(True) + ")\nSELECT (SELECT count(*) FROM tagged) AS rows_in, (SELECT count(*) FROM aug) AS rows_out",
)
def q_expansion_report(spark, sf_dir):
    return aug.expansion_report(fx.tagged(spark, sf_dir), _augmented(spark, sf_dir, True))


@register(
    "pairing_report",
    HS_SQL
    + """, np AS (SELECT np FROM par),
singles AS (SELECT count(*) AS n FROM hs WHERE r > n // 2)
SELECT 'pairs' AS kind, CAST((SELECT np FROM par) AS BIGINT) AS count
UNION ALL SELECT 'singles' AS kind, CAST((SELECT n FROM singles) + (SELECT count(*) FROM ord) - 2 * (SELECT np FROM par) AS BIGINT) AS count""",
)
def q_pairing_report(spark, sf_dir):
    return pair_op.pairing_report(_pairing_input(spark, sf_dir))


# ---------------------------------------------------------------- prompt render (P26) and name buckets

# System text and few-shot block of the evaluation prompt used by the fixture.
EVAL_SYS = "You are a function-calling router. Output ONLY one JSON object."
EVAL_FEWSHOT = 'User: power on\nAssistant: {"calls":[{"name":"power_on","arguments":{}}]}\n'


@register(
    "eval_prompt_render",
    o.with_(o.PREDS)
    + "SELECT ex_id, "
    + "'" + (EVAL_SYS + "\n\n" + EVAL_FEWSHOT + "User: ").replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    + " || user_text || chr(10) || 'Assistant: ' || '" + ev.ANSWER_PREFIX + "' AS prompt FROM predictions",
)
def q_eval_prompt_render(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return p.select("ex_id", ev.eval_prompt(F.col("user_text"), EVAL_SYS, EVAL_FEWSHOT).alias("prompt"))


@register(
    "expected_name_buckets",
    EVAL_ROWS_SQL.replace("SELECT ex_id, source, pred_text,", "SELECT ex_id, source, pred_text, gname, pname2,", 1)
    + """SELECT gname AS expected_name, count(*) AS count,
  count(*) FILTER (WHERE name1 AND pname2 IS NOT NULL) AS "all",
  count(*) FILTER (WHERE name1 AND pname2 IS NULL) AS name_only,
  count(*) FILTER (WHERE NOT name1 AND pname2 IS NOT NULL) AS arg_only
FROM scored GROUP BY gname""",
)
def q_expected_name_buckets(spark, sf_dir):
    scored = ev.score(fx.predictions(spark, sf_dir), True)
    pred_args = F.to_json(F.try_variant_get(strict_json(F.col("pred_text")), "$.calls[0].arguments", "variant"))
    gold_args = F.to_json(F.try_variant_get(strict_json(F.col("gold")), "$.calls[0].arguments", "variant"))
    s = scored.select(
        F.try_variant_get(strict_json(F.col("gold")), "$.calls[0].name", "string").alias("expected_name"),
        F.col("name1").alias("name_match"),
        F.coalesce(pred_args == gold_args, F.lit(False)).alias("args_match"),
    )
    return ev.name_buckets(s)


# ---------------------------------------------------------------- file sources (registered by their module)

from . import asset_queries, branch_queries, document_queries, json_queries, record_queries, source_queries  # noqa: E402, F401
