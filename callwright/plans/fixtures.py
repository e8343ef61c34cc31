"""Fixture SQL over the driver tables.

The driver tables hold no tagged calls, so the inputs of the call operators are
derived from them with SQL whose text runs unchanged on Spark and DuckDB.  Every
fixture reads whole tables: its size grows with the scale factor.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import register_tables

# tagged(row_id, query, llm_output) from events.
TAGGED_SQL = """
SELECT event_id AS row_id,
  concat(event_type, ' item ', CAST(user_id % 20 AS STRING)) AS query,
  concat(
    CASE WHEN event_id % 13 = 0 THEN 'noise ' ELSE '' END,
    CASE WHEN event_id % 11 = 0 THEN '<fuction_' ELSE '<function_' END,
    CASE event_type WHEN 'click' THEN 'BP' WHEN 'error' THEN 'UY' WHEN 'purchase' THEN 'ZV'
                    WHEN 'signup' THEN 'GN' ELSE 'IO' END,
    '>(',
    CASE event_type
      WHEN 'click' THEN concat('enable=', CAST(event_id % 2 AS STRING), ', type=', CAST(event_id % 4 - 1 AS STRING))
      WHEN 'error' THEN ''
      WHEN 'purchase' THEN concat('volume=', CAST(event_id % 7 - 1 AS STRING))
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'get=True' ELSE 'enable=false' END
      ELSE concat('timeframe=', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING),
                  ', location=', CASE WHEN event_id % 3 = 0 THEN '"0"' ELSE concat('city', CAST(user_id % 7 AS STRING)) END) END,
    ')',
    CASE WHEN event_id % 5 = 0 THEN ';<function_MR>()' ELSE '' END,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE '<end>' END) AS llm_output
FROM events
"""

# chat_pairs(conv_id, turn, user_text, assistant) from conversations.
CHAT_PAIRS_SQL = """
SELECT conv_id, turn, text AS user_text, next_text AS assistant FROM (
  SELECT conv_id, turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'
"""

# one row per rule condition; expect is the equality key (n:<number>, s:<text>) or '*';
# k_pos keeps the condition order of the rule as written.
# The conversion rules of the fixture.
RULE_CONDITIONS_SQL = """
SELECT * FROM (VALUES
 (1,'BP','mode_on','AI_Mode','enable',1,'n:0','0','int'),(1,'BP','mode_on','AI_Mode','type',2,'n:-1','-1','int'),
 (2,'BP','mode_off','Outdoor','enable',1,'n:1','1','int'),(2,'BP','mode_off','Outdoor','type',2,'n:0','0','int'),
 (3,'GN','info','Personal_Info','get',1,'n:1','True','bool'),
 (4,'GN','mode_off','Privacy_Mode','enable',1,'n:0','False','bool'),
 (5,'ZV','swap_env','Volume','volume',1,'n:-1','-1','int'),
 (6,'ZV','set_env','Volume','volume',1,'*','*','str'),
 (7,'IO','info','Air_Quality','timeframe',1,'n:0','0','int'),(7,'IO','info','Air_Quality','location',2,'*','*','str'),
 (8,'MR','talk','Default',CAST(NULL AS STRING),CAST(NULL AS INT),CAST(NULL AS STRING),CAST(NULL AS STRING),CAST(NULL AS STRING))
) AS r(seq, code, map_func, map_enum, k, k_pos, expect, value, vtype)
"""

# Output arguments of v2 rules built on F3 (J4): typed values in the rule's order.
# Argument values.
V2_OUT_SQL = """
SELECT * FROM (VALUES
 (1,1,'target','AI_MODE','str','s:AI_MODE'),(1,2,'enable','on','str','s:on'),
 (2,1,'target','OUTDOOR','str','s:OUTDOOR'),(2,2,'level','3','int','n:3'),
 (3,1,'target','PERSONAL','str','s:PERSONAL'),(3,2,'private','True','bool','n:1'),
 (4,1,'target','PERSONAL','str','s:PERSONAL'),(4,2,'private','False','bool','n:0'),
 (5,1,'volume','1.5','float','n:1.5'),
 (6,1,'volume','*','str','s:*'),
 (7,1,'target','AIR','str','s:AIR')
) AS t(seq, pos, key, value, vtype, cmp)
"""

# Output arguments of the template map built on F3 (J2): the rule's new name is map_func.
# Argument templates; {code} and {location} are filled from the call.
TEMPLATE_OUT_SQL = """
SELECT * FROM (VALUES
 (1,1,'mode','AI_Mode','str'),(1,2,'src','{code}','str'),(1,3,'lvl','3','int'),
 (2,1,'mode','Outdoor','str'),(2,2,'src','{code}','str'),(2,3,'on','True','bool'),
 (3,1,'type','Personal_Info','str'),(3,2,'note','{{x}}','str'),
 (4,1,'mode','Privacy_Mode','str'),(4,2,'ratio','1.5','float'),
 (5,1,'target','Volume','str'),(5,2,'step','{volume}','str'),
 (6,1,'target','Volume','str'),(6,2,'level','{{{volume}}}','str'),
 (7,1,'type','Air_Quality','str'),(7,2,'where','{location}','str'),(7,3,'missing','{nowhere}','str'),
 (8,1,'style','Default','str'),(8,2,'extra','None','none')
) AS t(seq, pos, name, template, vtype)
"""

# predictions(ex_id, user_text, gold, raw) from events.
PREDICTIONS_SQL = """
SELECT event_id AS ex_id, event_type AS user_text,
  concat('{"calls":[{"name":"', g, '","arguments":{}}]}') AS gold,
  CASE WHEN event_id % 7 = 0 THEN 'sorry'
       WHEN event_id % 5 = 0 THEN '{"calls":[{"arguments":{},"name":"power_off"}]}'
       WHEN event_id % 3 = 0 THEN concat('ok ', g, '","arguments":[]}]}')
       ELSE concat('{"calls":[{"name":"', g, '","arguments":{}}]}') END AS raw
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'power_on' WHEN 'error' THEN 'power_off'
        ELSE 'enable_night_mode' END AS g FROM events) e
"""

# replacement rules for augmentation of tagged rows (seq, ori, sr).
# The three rules of the fixture; rule 3 maps a word to itself.
REPLACEMENT_RULES = [
    (1, ["click", "view"], ["tap", "look"]),
    (2, ["item"], ["thing", "object"]),
    (3, ["signup"], ["signup", "register"]),
]

# evaluation cases for the four-case suite (E6); only the baseline model has predictions here.
EVAL_CASES = [
    ("baseline_fb_on", "baseline", True),
    ("baseline_nofb", "baseline", False),
    ("finetuned_fb_on", "finetuned", True),
    ("finetuned_nofb", "finetuned", False),
]

# F8: system prompts of the prompt x message grid (J7, E7); the empty one is skipped.
# Prompt texts.
GRID_PROMPTS = [(0, ""), (1, "You route voice commands to calls."), (2, "Answer with tagged calls only."), (3, "Be brief.")]

# Messages of the grid from F1 and the prediction text each prompt produced; prompt 2 wraps
# the output in quotes and prompt 3 misspells the tag, so the normaliser has work to do.
GRID_RAW_SQL = """
CASE prompt_id WHEN 1 THEN llm_output
               WHEN 2 THEN concat('"', llm_output, '"')
               ELSE replace(llm_output, '<function_', '<fuction_') END
"""


# Labelled chat examples from F2; the assistant side is JSON text (object, array, or the raw
# prose for every fifth conversation so the unparsable path is exercised).
CHAT_LABELLED_SQL = """
SELECT conv_id, turn, user_text,
  CASE WHEN conv_id % 5 = 0 THEN assistant
       WHEN turn % 4 = 1 THEN concat('[{"arguments":{"conv":', CAST(conv_id AS STRING),
                                     '},"functionName":"reply"},{"arguments":{},"functionName":"end"}]')
       ELSE concat('{"arguments":{"turn":', CAST(turn AS STRING), '},"functionName":"reply"}') END AS assistant
FROM chat_pairs
"""

# JSON text with the defects the repair step targets (bare keys, escaped quotes) and junk.
REPAIR_INPUT_SQL = """
SELECT ex_id,
  CASE ex_id % 4 WHEN 0 THEN gold
       WHEN 1 THEN replace(replace(replace(gold, '"calls"', 'calls'), '"name"', 'name'), '"arguments"', 'arguments')
       WHEN 2 THEN replace(gold, '"', concat(chr(92), '"'))
       ELSE concat('x', gold) END AS raw_out
FROM predictions
"""


# slot templates.  Two blocks of formats (block 1 repeats a format and has one whose slot <x>
# has no values); tags come from block literals (prio 0) and from the region and customer tables
# shared by every block (prio 1).  Fixed values: the formats and the literal tag words.
TEMPLATE_FORMATS_SQL = """
SELECT * FROM (VALUES
 (1, '<function_BP>(enable=0, type=-1)', 1, '<o><v>'),
 (1, '<function_BP>(enable=0, type=-1)', 2, '<o><a><v>'),
 (1, '<function_BP>(enable=0, type=-1)', 3, '<x><v>'),
 (1, '<function_BP>(enable=0, type=-1)', 4, '<o><v>'),
 (2, '<function_IO>(timeframe=0)', 1, '<v> <o>')
) AS f(block, fname, fmt_pos, fmt)
"""

TEMPLATE_TAGS_SQL = """
SELECT 1 AS block, '<a>' AS slot, v AS value, 0 AS prio, pos FROM (VALUES ('now', 1), ('please', 2)) AS t(v, pos)
UNION ALL SELECT 2 AS block, '<o>' AS slot, 'there' AS value, 0 AS prio, 1 AS pos
UNION ALL SELECT b.block, '<a>' AS slot, t.v AS value, 1 AS prio, t.pos FROM (VALUES ('please', 1), ('kindly', 2)) AS t(v, pos)
  CROSS JOIN (VALUES (1), (2)) AS b(block)
UNION ALL SELECT b.block, '<o>' AS slot, r_name AS value, 1 AS prio, r_regionkey AS pos FROM region CROSS JOIN (VALUES (1), (2)) AS b(block)
UNION ALL SELECT b.block, '<v>' AS slot, c_name AS value, 1 AS prio, c_custkey AS pos FROM customer CROSS JOIN (VALUES (1), (2)) AS b(block)
"""


# prompt parts for the prompt matrix (J8).  Fixed values: part texts; an empty HOW is skipped.
PROMPT_PARTS = [
    ("format", 1, '{"functionName":"...","arguments":{}}'),
    ("what", 1, "Route the voice command to one function."),
    ("what", 2, "Map the request to calls in order."),
    ("how", 1, "Focus on the verb."),
    ("how", 2, ""),
    ("rule", 1, "Never invent function names."),
]


# damaged tagged text for the schema repair (P17) and the repair schemas of the fixture functions.
DAMAGED_SQL = """
SELECT row_id,
  CASE row_id % 6 WHEN 0 THEN replace(replace(llm_output, '<', '＜'), '>', '＞')
                  WHEN 1 THEN replace(llm_output, '>(', '(')
                  WHEN 2 THEN replace(llm_output, ')', '')
                  WHEN 3 THEN concat('  ', replace(llm_output, ';', ' ; '), '  ')
                  WHEN 4 THEN concat(llm_output, ' trailing')
                  ELSE llm_output END AS raw
FROM tagged
"""

# Argument rules (target functions, type, enum) and call signatures of the fixture.
REPAIR_ARG_RULES = {
    "enable": [
        {"target": ["function_BP"], "type": "integer", "enum": [0, 1]},
        {"target": ["function_GN"], "type": "boolean", "enum": [True, False]},
    ],
    "type": [{"target": ["function_BP"], "type": "integer", "enum": [-1, 0, 1, 2]}],
    "get": [{"target": [], "type": "boolean", "enum": [True, False]}],
    "volume": [{"target": ["function_ZV"], "type": "integer", "enum": [-1, 0, 1, 2, 3, 4, 5]}],
    "timeframe": [{"target": ["function_IO"], "type": "integer", "enum": list(range(10))}],
    "location": [{"target": ["function_IO"], "type": "string", "enum": []}],
}
REPAIR_SIGNATURES = {
    "function_BP": [["get"], ["enable", "type"]],
    "function_GN": [["get"], ["enable"]],
    "function_ZV": [["volume"]],
    "function_IO": [["timeframe", "location"]],
    "function_MR": [[]],
    "function_UY": [[]],
}


def _sql(spark: SparkSession, sf_dir: str, sql: str, tables) -> DataFrame:
    register_tables(spark, sf_dir, tables)
    return spark.sql(sql)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TAGGED_SQL, ["events"])


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHAT_PAIRS_SQL, ["conversations"])


def chat_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat_pairs(spark, sf_dir).createOrReplaceTempView("chat_pairs")
    return spark.sql(CHAT_LABELLED_SQL)


def repair_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions(spark, sf_dir).createOrReplaceTempView("predictions")
    return spark.sql(REPAIR_INPUT_SQL)


def template_formats(spark: SparkSession) -> DataFrame:
    return spark.sql(TEMPLATE_FORMATS_SQL)


def template_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TEMPLATE_TAGS_SQL, ["region", "customer"])


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged(spark, sf_dir).createOrReplaceTempView("tagged")
    return spark.sql(DAMAGED_SQL)


def rule_conditions(spark: SparkSession) -> DataFrame:
    return spark.sql(RULE_CONDITIONS_SQL)


def v2_rules(spark: SparkSession) -> DataFrame:
    """The rules of F3 with the output arguments of F3c; rule 8 has none."""
    from pyspark.sql import functions as F

    from ..functions.args import ARGS_TYPE
    from ..operators.rules import rules_from_conditions

    arg = F.struct("pos", F.struct("key", F.col("value").alias("raw"), "vtype", F.col("value").alias("canon"), "cmp").alias("a"))
    out = spark.sql(V2_OUT_SQL).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(arg)), lambda x: x["a"]).cast(ARGS_TYPE).alias("out"))
    conds = rule_conditions(spark).join(out, "seq", "left").withColumn("out", F.coalesce("out", F.array().cast(ARGS_TYPE)))
    return rules_from_conditions(conds)


def template_rules(spark: SparkSession) -> DataFrame:
    """(seq, code, new_name, when, out) built from F3 and F3b."""
    from pyspark.sql import functions as F

    from ..operators.rules import rules_from_conditions

    rules = rules_from_conditions(rule_conditions(spark))
    out = spark.sql(TEMPLATE_OUT_SQL).groupBy("seq").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "template", "vtype"))).alias("out")
    )
    return rules.join(out, "seq", "left").select("seq", "code", F.col("map_func").alias("new_name"), "when", F.coalesce("out", F.array().cast("array<struct<pos:int,name:string,template:string,vtype:string>>")).alias("out"))


def pair_rules(spark: SparkSession) -> DataFrame:
    """(seq, code, args, json) from F3: each rule written as tag text + JSON, then the tag parsed
    back with the tag reader + quoted dialect, first call kept (S11)."""
    from pyspark.sql import functions as F

    from ..functions.args import parse_args
    from ..functions.tags import extract_calls

    val = F.when(F.col("expect") == "*", F.lit("*")).otherwise(F.substr(F.col("expect"), F.lit(3)))
    part = F.when(F.col("k").isNotNull(), F.struct("k_pos", F.concat("k", F.lit("="), val).alias("kv")))
    grouped = rule_conditions(spark).groupBy("seq", "code", "map_func", "map_enum").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    tag = F.concat(F.lit("<function_"), F.col("code"), F.lit(">("), F.array_join(F.transform("parts", lambda x: x["kv"]), ", "), F.lit(")"))
    js = F.concat(F.lit('{"name":"'), F.col("map_func"), F.lit('","enum":"'), F.col("map_enum"), F.lit('"}'))
    first = F.get(extract_calls(tag), 0)
    return (
        grouped.select("seq", first.alias("c"), js.alias("json"))
        .filter(F.col("c").isNotNull())
        .select("seq", F.col("c.func").alias("code"), parse_args(F.col("c.raw_args"), "quoted").alias("args"), "json")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PREDICTIONS_SQL, ["events"])


def replacement_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPLACEMENT_RULES, "seq int, ori array<string>, sr array<string>")
