"""Queries whose input reaches the branches that regular text does not (P7, P12, P15, P19, E7, E9): shapes of argument and call
texts, one for each row of the tagged corpus, with the results that the oracles spell out."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.args import with_args
from ..operators import augment as aug
from ..operators import evaluate as ev
from ..operators.repair import repair_status
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import register

# Argument texts ({n} is the row number) and what the profile dialect makes of them: (key, type, value).
ARGUMENTS = [
    ('a="x, y{n}", b=(1,2), c=None, d=True', [("a", "str", "x, y{n}"), ("b", "str", "(1,2)"), ("c", "none", "None"), ("d", "bool", "True")]),
    ('loc=""{n}"", v=1.5, w=-2', [("loc", "str", "{n}"), ("v", "float", "1.5"), ("w", "int", "-2")]),
    ("k=f(a,b({n})), k2='q,r', noeq, k=2, z={n}", [("k", "int", "2"), ("k2", "str", "'q"), ("z", "int", "{n}")]),
    ('a=b=c{n}, e= , f="un,closed{n}', [("a", "str", "b=c{n}"), ("e", "str", ""), ("f", "str", '"un,closed{n}')]),
    ("x=1), y={n}", [("x", "str", "1), y={n}")]),
]

# Call texts, their normal form and the repair status.
CALLS = [
    ('pre <fuction_A1>  (x = 1, y="2{n}", z=3) <function_B>;<function_C>(c=1)', "<function_A1>(x=1, y=2{n});<function_B>()<end>", "repaired_success"),
    ("<function_Z>(a=1{n}, b=(2,3)", "<function_Z>(a=1{n}, b=(2)<end>", "repaired_success"),
    ("<function_a-b c{n}>(q=1)", "<function_abc{n}>(q=1)<end>", "repaired_success"),
    ("no call {n}", "<end>", "still_broken"),
    ("<function_>(a=1)<function_K{n}>(=5, k==2)", "<function_K{n}>(k==2)<end>", "repaired_success"),
    ("<function_AB>(a={n})<end>", "<function_AB>(a={n})<end>", "already_ok"),
]


def _text(template: str) -> Column:
    parts = [F.lit(p) for p in template.split("{n}")]
    between = [c for p in parts[1:] for c in (F.col("row_id").cast("string"), p)]
    return F.concat(parts[0], *between)


def _sql(template: str) -> str:
    return " || row_id || ".join("'" + p.replace("'", "''") + "'" for p in template.split("{n}"))


def _shape(texts: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        out = F.when(F.col("row_id") % len(texts) == i, _text(t)).otherwise(out)
    return out


@register(
    "parse_args_profile_branches",
    o.with_(o.TAGGED)
    + " UNION ALL ".join(
        f"SELECT row_id, {at} AS arg_pos, '{key}' AS key, '{kind}' AS vtype, {_sql(value)} AS val FROM tagged WHERE row_id % {len(ARGUMENTS)} = {i}"
        for i, (_, args) in enumerate(ARGUMENTS)
        for at, (key, kind, value) in enumerate(args, 1)
    ),
)
def q_parse_args_profile_branches(spark, sf_dir):
    """Commas in quotes and parens, doubled quotes, an unclosed quote, a paren too many, repeated keys."""
    df = fx.tagged(spark, sf_dir).select("row_id", _shape([t for t, _ in ARGUMENTS]).alias("raw_args"))
    args = with_args(df, "raw_args", "profile", "args").select("row_id", F.posexplode("args").alias("at", "a"))
    return args.select("row_id", (F.col("at") + 1).alias("arg_pos"), "a.key", "a.vtype", F.col("a.canon").alias("val"))


def _cases(at: int) -> str:
    return f"CASE row_id % {len(CALLS)} " + " ".join(f"WHEN {i} THEN {_sql(c[at])}" for i, c in enumerate(CALLS)) + " END"


@register("call_normalise_branches", o.with_(o.TAGGED) + f"SELECT row_id, {_cases(1)} AS repaired, {_cases(2)} AS status FROM tagged")
def q_call_normalise_branches(spark, sf_dir):
    """Nested and unclosed parens, odd tags, a third call, text without a call, and a text that is right."""
    df = fx.tagged(spark, sf_dir).select("row_id", _shape([c[0] for c in CALLS]).alias("raw"))
    return repair_status(df, "raw").select("row_id", "repaired", "status")


# Continuations behind '{"functionName":', what they are repaired to and whether that is JSON.
CONTINUATIONS = [
    ('"f{n}","arguments":{"a":1}', '"f{n}","arguments":{"a":1}}', True),
    ('"f{n}", ', '"f{n}"}', True),
    ('"f{n}","arguments":{"a":"x}"}} and more', '"f{n}","arguments":{"a":"x}"}}', True),
    ('"f{n}","arguments":{"a":" \n x"} tail', '"f{n}","arguments":{"a":"x"} tail', False),
    ('"f{n}","arguments":{"a":" \n x"}} tail', '"f{n}","arguments":{"a":"x"}}', True),
    ('"f{n}","arguments":{"a":"x"}}}}', '"f{n}","arguments":{"a":"x"}}', True),
    ('"f{n}","arguments":{"a":"x', '"f{n}","arguments":{"a":"x"}}', True),
    ("junk {n}", "junk {n}", False),
]


@register(
    "json_continuation_branches",
    o.with_(o.TAGGED)
    + f"SELECT row_id, '{{\"functionName\":' || CASE row_id % {len(CONTINUATIONS)} "
    + " ".join(f"WHEN {i} THEN {_sql(c[1])}" for i, c in enumerate(CONTINUATIONS))
    + f" END AS repaired, row_id % {len(CONTINUATIONS)} NOT IN ({', '.join(str(i) for i, c in enumerate(CONTINUATIONS) if not c[2])}) AS repaired_ok FROM tagged",
)
def q_json_continuation_branches(spark, sf_dir):
    """A mended arguments object, a cut at the first two braces, brace runs, an open string, and no JSON at all."""
    df = fx.tagged(spark, sf_dir).select("row_id", _shape([c[0] for c in CONTINUATIONS]).alias("cont"))
    return ev.with_continuation_repair(df, "cont").select("row_id", "repaired", "repaired_ok")


@register(
    "delexicalise_position",
    o.with_(o.TAGGED)
    + """SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'go to <loc> now' ELSE query END AS query,
  CASE WHEN row_id % 2 = 0 THEN '<function_FF>(position=<loc>, location=x)' ELSE '<function_FF>(position=''none' || row_id || ''')' END AS llm_output FROM tagged""",
)
def q_delexicalise_position(spark, sf_dir):
    """P19 with the key position: quoted values, and values that the query does not hold."""
    row, n = F.col("row_id"), F.col("row_id").cast("string")
    even = row % 2 == 0
    df = fx.tagged(spark, sf_dir).select(
        "row_id",
        F.when(even, F.concat(F.lit("go to seat"), n, F.lit(" now"))).otherwise(F.col("query")).alias("query"),
        F.when(even, F.concat(F.lit("<function_FF>(position=seat"), n, F.lit(", location=x)"))).otherwise(F.concat(F.lit("<function_FF>(position='none"), n, F.lit("')"))).alias("llm_output"),
    )
    return aug.delexicalise(df, "query", "llm_output", "position", "<loc>")


@register(
    "text_match_stripped",
    o.with_(o.TAGGED) + "SELECT CAST(row_id % 3 AS INTEGER) AS prompt_id, count(*) AS rows, count(*) FILTER (WHERE row_id % 2 = 0) AS all_match FROM tagged GROUP BY 1",
)
def q_text_match_stripped(spark, sf_dir):
    """E7 with line breaks and other white space around the expected text and the raw output."""
    row, n = F.col("row_id"), F.col("row_id").cast("string")
    call = F.concat(F.lit("<function_AB>(a="), n, F.lit(")<end>"))
    wrong = F.concat(F.lit("<function_AB>(a="), n, F.lit("0)<end>"))
    grid = fx.tagged(spark, sf_dir).select(
        (row % 3).cast("int").alias("prompt_id"),
        F.concat(F.lit("\n\t"), call, F.lit(" \n")).alias("raw"),
        F.concat(F.when(row % 2 == 0, call).otherwise(wrong), F.lit("\r\n　")).alias("expected"),
    )
    return ev.text_match(grid)


@register(
    "prediction_grid_match",
    o.with_(o.TAGGED)
    + "SELECT p.prompt_id, count(*) AS rows, count(*) FILTER (WHERE t.row_id % 3 <> p.prompt_id) AS all_match FROM tagged t CROSS JOIN (VALUES (1), (2)) AS p(prompt_id) GROUP BY p.prompt_id",
)
def q_prediction_grid_match(spark, sf_dir):
    """Outputs kept as a table of their own meet the grid of prompts and messages; a cell without an output is a
    miss, blank prompts take no part."""
    t = fx.tagged(spark, sf_dir).select("row_id", "query")
    call = F.concat(F.lit("<function_AB>(a="), F.col("msg_id").cast("string"), F.lit(")<end>"))
    messages = t.select(F.col("row_id").alias("msg_id"), F.col("query").alias("message")).withColumn("expected", call)
    prompts = spark.createDataFrame([(0, " \n"), (1, "first"), (2, "second")], "prompt_id int, prompt string")
    known = t.select(F.col("row_id").alias("msg_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("prompt_id")).where("msg_id % 3 != prompt_id")
    predictions = known.withColumn("raw", F.concat(F.lit('noise "'), call, F.lit('"')))
    return ev.text_match(ev.attach_predictions(ev.prompt_grid(prompts, messages), predictions))


@register(
    "expansion_cap_report",
    o.with_(o.TAGGED)
    + "SELECT count(*) AS rows, count(*) FILTER (WHERE starts_with(query, 'click') OR starts_with(query, 'view') OR starts_with(query, 'signup')) AS capped_rows FROM tagged",
)
def q_expansion_cap_report(spark, sf_dir):
    """G1 with the reference's cap of the working list (3 here): rows that a second applicable rule takes beyond it."""
    expanded = aug.expand_variants(fx.tagged(spark, sf_dir), ["query", "llm_output"], fx.REPLACEMENT_RULES, max_expansions=3)
    return aug.capped_report(expanded)
