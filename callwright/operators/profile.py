"""Corpus profile (L4): every metric is one aggregate over the long call tables.

A1-A9, W1, O8, J6, G7, P29.  Calls are read with the profile grammar (P6) and
arguments with the profile dialect (P7); ``None`` values are left out of the
argument metrics as in the reference.  Aggregates are partial/final (map-side
combine), so a hot function or key is pre-aggregated before any shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import FLOAT_RE, float_text
from .calls import call_args_table, calls_table
from .index import rank_in_group

# Function descriptions used by spec inference (A8); other names get "<func> function".
FUNC_DESCRIPTIONS = {
    "CE": "Provides reports or results about the air purification process (status, duration, or outcome).",
    "BP": "Controls basic power or operational modes (enable/disable, type switching).",
    "BS": "Toggles simple enable/disable state of a subsystem.",
    "CS": "Selects content or category types among limited options.",
    "DW": "Switches display or device modes with four type options.",
    "EF": "Triggers a predefined action event.",
    "EN": "Selects environment or entity type across multiple levels (1–7).",
    "EW": "Retrieves or sets environmental type values (negative, neutral, positive).",
    "FF": "Specifies a detailed physical position or location name (rooms, facilities, seats).",
    "GN": "Controls or queries generic enable/disable state.",
    "GQ": "Queries or sets gender-related attributes (male, female, unknown).",
    "HG": "Queries or sets theme-related options (basic themes).",
    "HI": "Chooses a binary type (two-level classification).",
    "HS": "Selects a three-level classification (negative, neutral, positive).",
    "HW": "Sets type or mode with six available options.",
    "ID": "Retrieves identification state.",
    "IH": "Gets or scans input/hardware status.",
    "IO": "Specifies a geographic location and timeframe for queries (e.g., weather, air quality).",
    "JS": "Selects a numeric type (1–10 levels).",
    "KP": "Chooses type with two possible levels.",
    "MO": "Queries or specifies mobility/travel locations with timeframe.",
    "MV": "Toggles get/mute state for media or audio.",
    "NK": "Controls or queries speed levels (from -1 to 4).",
    "NN": "Toggles enable/disable state for a neural or network feature.",
    "PC": "Selects a type among multiple categorical values.",
    "QD": "Queries or classifies using discrete type values.",
    "QT": "Toggles or queries enable state for quick/test features.",
    "SB": "Selects among five type levels (scenario or setting).",
    "SC": "Toggles enable/disable state for a control feature.",
    "SV": "Sets type among five categories (service or state).",
    "WN": "Adjusts brightness or queries its state.",
    "YA": "Controls movement along defined steps (0–2).",
    "ZV": "Adjusts or queries volume levels.",
    "ZX": "Enables/disables a feature toggle.",
}


def profile_calls(df: DataFrame, text_col: str = "llm_output", keys=("row_id",)) -> DataFrame:
    """``(keys, pos, func, raw_args)`` with the profile grammar."""
    return calls_table(df, text_col, keys, reader="profile")


def profile_args(calls: DataFrame, keys=("row_id",)) -> DataFrame:
    """Melted argument table without ``None`` values: ``(keys, pos, func, arg_key, val_type, val, cmp)``."""
    return (
        call_args_table(calls, "profile", keys)
        .filter(F.col("vtype") != "none")
        .select(*keys, "pos", "func", F.col("key").alias("arg_key"), F.col("vtype").alias("val_type"), F.col("canon").alias("val"), "cmp")
    )


def func_frequency(calls: DataFrame) -> DataFrame:
    """Calls per function, descending."""
    return calls.groupBy("func").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "func")


def arg_key_frequency(args: DataFrame) -> DataFrame:
    """A2."""
    return args.groupBy("arg_key").agg(F.count(F.lit(1)).alias("count"))


def arg_type_distribution(args: DataFrame) -> DataFrame:
    """A3: key x Python type name."""
    return args.groupBy("arg_key", "val_type").agg(F.count(F.lit(1)).alias("count"))


def func_arg_key_frequency(args: DataFrame) -> DataFrame:
    """A4: ordered by (func, count desc, key)."""
    return args.groupBy("func", "arg_key").agg(F.count(F.lit(1)).alias("count")).orderBy("func", F.desc("count"), "arg_key")


def func_arg_value_frequency(args: DataFrame) -> DataFrame:
    """A5: values grouped by (type, text) so True and 1 stay apart."""
    return (
        args.groupBy("func", "arg_key", "val_type", "val")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("func", "arg_key", F.desc("count"))
    )


def func_arg_value_list(args: DataFrame, typed: bool = False) -> DataFrame:
    """A7 long form: distinct value texts per (func, key) with their sorted position.

    Distinct values are found by a partial aggregate; the position comes from the
    bucketed rank, so a key with very many values never sits in one task.  ``typed`` adds the
    ``arg_type`` of each key (P29), taken along with the rank's counts.
    """
    distinct = args.select("func", "arg_key", F.col("val").alias("value")).distinct()
    if not typed:
        return rank_in_group(distinct, ["func", "arg_key"], ["value"], "value_pos")
    kinds = value_kinds(F.col("value"))
    flagged = distinct.withColumns({f"_{k}": c.cast("int") for k, c in kinds.items()})
    ranked = rank_in_group(flagged, ["func", "arg_key"], ["value"], "value_pos", group_min={f"_all_{k}": f"_{k}" for k in kinds})
    return ranked.select("func", "arg_key", "value", "value_pos", type_of({k: F.col(f"_all_{k}") == 1 for k in kinds}).alias("arg_type"))


def query_list(value_list: DataFrame) -> DataFrame:
    """One ``func.key=value`` query per listed value."""
    return value_list.select(
        F.concat("func", F.lit("."), "arg_key", F.lit("="), "value").alias("query"), "func", "arg_key", "value", "value_pos"
    )


def func_arg_pivot(args: DataFrame, keys=None) -> DataFrame:
    """Function x key usage counts, zero filled.  Pass ``keys`` to skip the key-discovery job."""
    if keys is None:
        keys = sorted(r[0] for r in args.select("arg_key").distinct().collect())
    return args.groupBy("func").pivot("arg_key", list(keys)).agg(F.count(F.lit(1))).fillna(0)


def value_kinds(value: Column) -> dict[str, Column]:
    """What a value text may stand for."""
    v = F.trim(value)
    return {"word": F.lower(v).isin("true", "false"), "bit": v.isin("0", "1"), "number": v.rlike(FLOAT_RE)}


def type_of(every: dict[str, Column]) -> Column:
    """The type of a key whose values are all of these kinds."""
    return F.when(every["word"] | every["bit"], F.lit("boolean")).when(every["number"], F.lit("number")).otherwise(F.lit("string"))


def infer_value_types(value_list: DataFrame) -> DataFrame:
    """Type of each (func, key) from its distinct value texts: boolean, number or string."""
    every = {k: F.bool_and(c) for k, c in value_kinds(F.col("value")).items()}
    return value_list.groupBy("func", "arg_key").agg(type_of(every).alias("arg_type"))


def function_spec(value_list: DataFrame, descriptions: DataFrame) -> DataFrame:
    """A8 long form: ``(func, description, arg_key, arg_type, enum_pos, enum_value)``.

    ``value_list`` is A7's, best with its types.  enum_value is the JSON scalar of the cast value; equal values after the cast
    (1 and 1.0) keep their first occurrence in sorted text order.
    """
    # without types: one row per key, which Spark broadcasts by its measured size, else AQE splits a key with most values
    typed = value_list if "arg_type" in value_list.columns else value_list.join(infer_value_types(value_list), ["func", "arg_key"])
    v = F.trim(F.col("value"))
    is_int = v.rlike(r"^-?[0-9]+$")
    num = v.try_cast("double")
    enum_value = (
        F.when((F.col("arg_type") == "boolean") & F.lower(v).isin("true", "false"), F.when(F.lower(v) == "true", F.lit("true")).otherwise(F.lit("false")))
        .when(F.col("arg_type") == "boolean", F.when(v == "1", F.lit("true")).otherwise(F.lit("false")))
        .when((F.col("arg_type") == "number") & is_int, v.try_cast("bigint").cast("string"))
        .when(F.col("arg_type") == "number", float_text(num))
        .otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    )
    eq_key = F.when(F.col("arg_type") == "number", num.cast("string")).otherwise(enum_value)
    firsts = (
        typed.withColumn("enum_value", enum_value)
        .withColumn("_eq", eq_key)
        .groupBy("func", "arg_key", "arg_type", "_eq")
        .agg(F.min_by("enum_value", "value_pos").alias("enum_value"), F.min("value_pos").alias("_first"))
    )
    ranked = rank_in_group(firsts, ["func", "arg_key"], ["_first"], "enum_pos", [F.shiftright("_first", 20)]).drop("_eq", "_first")
    desc = F.coalesce(F.col("description"), F.concat("func", F.lit(" function")))
    return ranked.join(descriptions, "func", "left").select(
        "func", desc.alias("description"), "arg_key", "arg_type", "enum_pos", "enum_value"
    )


def descriptions_frame(spark) -> DataFrame:
    return spark.createDataFrame(sorted(FUNC_DESCRIPTIONS.items()), "func string, description string")


def func_bigrams_from_text(df: DataFrame, text_col: str = "llm_output") -> DataFrame:
    """W1 without any shuffle before the count: pairs come from each text's own call array."""
    from ..functions.tags import extract_calls_profile

    cs = extract_calls_profile(F.col(text_col))
    n = F.size(cs)
    pairs = F.zip_with(F.slice(cs, 1, F.greatest(n - 1, F.lit(1))), F.slice(cs, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a["func"].alias("func_a"), b["func"].alias("func_b")))
    return (
        df.select(F.explode_outer(F.when(n >= 2, pairs)).alias("p"))
        .filter(F.col("p").isNotNull())
        .groupBy("p.func_a", "p.func_b")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def placeholder_locations(args: DataFrame, keys=("row_id",)) -> DataFrame:
    """``location`` values that are the placeholder 0 (``0`` or ``""0""``)."""
    return args.filter((F.col("arg_key") == "location") & F.trim(F.col("val")).isin("0", '""0""'))


def empty_arg_calls(calls: DataFrame) -> DataFrame:
    """Calls whose argument text is empty."""
    return calls.filter(F.trim(F.col("raw_args")) == "")


def calls_with_source(calls: DataFrame, source: DataFrame, keys=("row_id",)) -> DataFrame:
    """Every call joined back to its source row (equi join on the row key)."""
    return calls.join(source, list(keys))


def rows_by_function(calls_with_src: DataFrame, keys=("row_id",)) -> DataFrame:
    """A11 flat form: every call row with its position inside its function, ordered by (row, call)."""
    return rank_in_group(calls_with_src, ["func"], [*keys, "pos"], "func_seq")


def calls_with_original(df: DataFrame, text_col: str = "llm_output", keys=("row_id",)) -> DataFrame:
    """K6 full call records: each call with its parsed arguments and the whole source row embedded
    as ``original`` (carried through the explode, so no join back to the source)."""
    from ..functions.args import with_args

    src = df.withColumn("original", F.struct(*[F.col(c) for c in df.columns]))
    calls = calls_table(src, text_col, (*keys, "original"), reader="profile")
    return with_args(calls, "raw_args", "profile", "args").select(*keys, "func", F.col("pos").alias("call_order"), "raw_args", "args", "original")
