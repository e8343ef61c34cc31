"""Prompt text built from function specs and prompt parts.

A spec is a long table ``(func, description, arg, arg_order, type, enum_pos, enum_value,
minimum, maximum, pattern)``; the functions section is one text block per function
(a grouped ``array_join`` over its arguments) and the prompt matrix is the cross
product of the small part lists, ordered FORMAT, WHAT, HOW, RULE.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header and guard lines of the generated prompts.
SECTION_HEADER = [
    "Output JSON format (fixed):",
    ' [{"functionName":"...", "arguments":{"key_name":"..."}}, {"functionName":"...", "arguments":{"key_name":"..."}} ]',
    " The arguments object must always contain exactly 3 fields.",
    "  # Return JSON only. No extra text.",
    "",
    "Available functions:",
]
MATRIX_GUARD = "Return only the FORMAT as valid JSON. No extra text."
PREAMBLE_HEAD = [
    "Output JSON format (fixed):",
    '  { "functionName": "...", "arguments":{"arg1": "...","arg2": "...","arg3": "..."} }',
    " The arguments object must always contain exactly 3 fields.",
    "  # Return JSON only. No extra text.",
]
PREAMBLE_GUARD = "Return only the JSON. No extra text."


def spec_from_inferred(spec: DataFrame) -> DataFrame:
    """A8 long form -> spec table; enum texts are Python ``str`` of the typed values, args in name order."""
    v = F.col("enum_value")
    text = (
        F.when(F.col("arg_type") == "boolean", F.when(v == "true", F.lit("True")).otherwise(F.lit("False")))
        .when(F.col("arg_type") == "string", F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]"))
        .otherwise(v)
    )
    return spec.select(
        "func", "description", F.col("arg_key").alias("arg"), F.col("arg_type").alias("type"), "enum_pos", text.alias("enum_text")
    ).withColumn("arg_order", F.lit(None).cast("int"))


def function_blocks(spec: DataFrame) -> DataFrame:
    """P32 per function: ``- name: description``, argument hint lines and a compact example.

    Hints are the enum values, then ``min=``, ``max=`` and ``pattern=`` where the spec has them; a row
    without an argument stands for a function without any.  ``func_pos`` (file order) is kept if given.
    """
    limits = [
        F.concat(F.lit(f"{label}="), F.max(name)) for name, label in (("minimum", "min"), ("maximum", "max"), ("pattern", "pattern")) if name in spec.columns
    ]
    pos = ["func_pos"] if "func_pos" in spec.columns else []
    values = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("enum_pos", "enum_text"))), lambda e: e["enum_text"]), "/")
    hints = spec.groupBy(*pos, "func", "description", "arg", "arg_order").agg(F.concat_ws(" ", F.nullif(values, F.lit("")), *limits).alias("hint"))
    line = F.concat(F.lit("    - "), F.col("arg"), F.lit(":"), F.when(F.col("hint") != "", F.concat(F.lit("  "), F.col("hint"))).otherwise(F.lit("")))
    entry = F.struct(F.coalesce(F.col("arg_order"), F.lit(9999)).alias("o"), F.col("arg").alias("a"), line.alias("l"))
    per_func = hints.groupBy(*pos, "func", "description").agg(F.sort_array(F.collect_list(F.when(F.col("arg").isNotNull(), entry))).alias("args"))
    head = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit("- "), F.col("func"), F.lit(": "), F.col("description"))).otherwise(
        F.concat(F.lit("- "), F.col("func"), F.lit(":"))
    )
    arg_lines = F.array_join(F.transform("args", lambda a: a["l"]), "\n")
    example_args = F.array_join(F.transform("args", lambda a: F.concat(F.lit('"'), a["a"], F.lit('": "..."'))), ", ")
    example = F.concat(F.lit('  example: {"name": "'), F.col("func"), F.lit('", "arguments": {'), example_args, F.lit("}}"))
    body = F.when(
        F.size("args") > 0, F.concat_ws("\n", head, F.lit("  arguments (object):"), arg_lines, example)
    ).otherwise(F.concat_ws("\n", head, F.lit("  (no parameters)"), example))
    return per_func.select(*pos, "func", body.alias("block"))


def functions_section(blocks: DataFrame) -> DataFrame:
    """The whole section as one row (one block per function: a small, bounded set), in file order if known."""
    order = ["func_pos"] if "func_pos" in blocks.columns else []
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "func", "block"))), lambda b: b["block"]), "\n")
    return blocks.agg(F.concat(F.lit("\n".join(SECTION_HEADER) + "\n"), joined).alias("section"))


def preamble(what, how) -> F.Column:
    """P33 (template variant): fixed format block, WHAT=, HOW=, guard; empty parts skipped."""
    parts = [F.lit(x) for x in PREAMBLE_HEAD]
    parts += [F.when(what != "", F.concat(F.lit("WHAT="), what)), F.when(how != "", F.concat(F.lit("HOW="), how)), F.lit(PREAMBLE_GUARD)]
    return F.concat_ws("\n", *parts)


def prompt_matrix(parts: DataFrame, section: DataFrame) -> DataFrame:
    """Every FORMAT x WHAT x HOW x RULE combination (parts: kind, pos, text), preamble + section."""
    def kind(k):
        return parts.filter(F.col("kind") == k).select(F.col("pos").alias(f"{k}_pos"), F.col("text").alias(k))

    # the product is the feature and as large as all factors together, so no factor of a product that can be
    # made is too large to send; the section is one row
    grid = kind("format")
    for factor in (kind("what"), kind("how"), kind("rule"), section):
        grid = grid.crossJoin(F.broadcast(factor))
    text = F.concat_ws(
        "\n",
        F.when(F.col("what") != "", F.col("what")),
        F.when(F.col("how") != "", F.col("how")),
        F.when(F.col("format") != "", F.concat(F.lit("FORMAT="), F.col("format"))),
        F.when(F.col("rule") != "", F.col("rule")),
        F.lit(MATRIX_GUARD),
    )
    full = F.when(F.col("section") != "", F.concat(text, F.lit("\n\n"), F.col("section"))).otherwise(text)
    return grid.select("format_pos", "what_pos", "how_pos", "rule_pos", full.alias("prompt"))
