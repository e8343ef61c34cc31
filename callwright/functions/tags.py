"""Tagged-call text ``<function_XX>(k=v, ...);...<end>`` to call arrays.

All builders return Columns; nothing leaves the JVM.  A call array is
``ARRAY<STRUCT<pos INT, func STRING, raw_args STRING>>`` in text order (pos from 1).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .args import parse_args, pystrip
from .jsontext import strict_json

# Tag grammars of the four call readers.
TAG_RE = r"(?s)<function_([A-Za-z0-9_]+)>\((.*?)\)"  # P5, dot matches newlines
PROFILE_TAG_RE = r"<function_([A-Z]{2})>\(([^\n]*?)\)"  # P6, first match per ';' piece
FIRST_CALL_FULL_RE = r"<\s*function_([A-Za-z0-9]+)\s*>\s*\(([^\n]*?)\)\s*(?:<\s*end\s*>\s*)?$"  # P9
FIRST_CALL_LOOSE_RE = r"<\s*function_([A-Za-z0-9]+)\s*>\s*(?:\(([^\n]*?)\))?"  # P9 fallback
FUNC_CELL_RE = r"<\s*([^>\s]+)\s*>"  # P21


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_calls(text) -> Column:
    """P5: every ``<function_X>(args)`` in order after removing ``<end>``; args stop at the first ')'."""
    s = F.replace(_col(text), F.lit("<end>"), F.lit(""))
    names = F.regexp_extract_all(s, F.lit(TAG_RE), 1)
    raws = F.regexp_extract_all(s, F.lit(TAG_RE), 2)
    calls = F.transform(
        names,
        lambda n, i: F.struct((i + 1).alias("pos"), n.alias("func"), F.try_element_at(raws, i + 1).alias("raw_args")),
    )
    return F.coalesce(calls, F.array().cast("array<struct<pos:int,func:string,raw_args:string>>"))


def extract_calls_profile(text) -> Column:
    """Split on ';', keep non-empty stripped pieces, first two-capital tag per piece."""
    pieces = F.filter(F.transform(F.split(_col(text), ";"), pystrip), lambda p: p != "")
    hits = F.filter(pieces, lambda p: p.rlike(PROFILE_TAG_RE))
    calls = F.transform(
        hits,
        lambda p, i: F.struct(
            (i + 1).alias("pos"),
            F.regexp_extract(p, PROFILE_TAG_RE, 1).alias("func"),
            F.regexp_extract(p, PROFILE_TAG_RE, 2).alias("raw_args"),
        ),
    )
    return F.coalesce(calls, F.array().cast("array<struct<pos:int,func:string,raw_args:string>>"))


def first_call(text) -> Column:
    """First call only (text before the first ';'); returns STRUCT<name, raw_args, args> or null.

    The name carries the ``function_`` prefix; args use the lenient dialect.
    """
    t = F.substring_index(pystrip(_col(text)), ";", 1)
    t = pystrip(t)
    full = t.rlike(FIRST_CALL_FULL_RE)
    loose = t.rlike(FIRST_CALL_LOOSE_RE)
    name = F.when(full, F.regexp_extract(t, FIRST_CALL_FULL_RE, 1)).when(loose, F.regexp_extract(t, FIRST_CALL_LOOSE_RE, 1))
    raw = F.when(full, F.regexp_extract(t, FIRST_CALL_FULL_RE, 2)).when(loose, F.regexp_extract(t, FIRST_CALL_LOOSE_RE, 2))
    return F.when(
        (F.coalesce(_col(text), F.lit("")) != "") & name.isNotNull(),
        F.struct(F.concat(F.lit("function_"), name).alias("name"), raw.alias("raw_args"), parse_args(raw, "lenient").alias("args")),
    )


def decode_call_any(text) -> Column:
    """P10: a JSON object holding ``functionName`` wins, else the first tagged call.

    Returns STRUCT<name, kind, args_json> where kind is 'json' or 'tag' and args_json is
    compact, key-sorted JSON text of the arguments (``{}`` when absent or not an object).
    """
    t = _col(text)
    v = strict_json(t)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    has_name = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").getItem("functionName").isNotNull(), F.lit(False))
    json_name = F.try_variant_get(v, "$.functionName", "string")
    json_args = F.try_variant_get(v, "$.arguments", "variant")
    json_args_text = F.when(F.schema_of_variant(json_args).startswith("OBJECT"), F.to_json(json_args)).otherwise(F.lit("{}"))
    fc = first_call(t)
    from .args import args_json

    tag_args = F.to_json(F.parse_json(args_json(fc["args"])))
    use_json = is_obj & has_name
    return F.when(
        F.coalesce(t, F.lit("")) != "",
        F.when(use_json, F.struct(json_name.alias("name"), F.lit("json").alias("kind"), json_args_text.alias("args_json"))).when(
            fc.isNotNull(), F.struct(fc["name"].alias("name"), F.lit("tag").alias("kind"), tag_args.alias("args_json"))
        ),
    )


def decode_with_brace_fix(text) -> Column:
    """Decode; only when that fails and the text holds '}}}', retry with '}}}' -> '}}'."""
    t = _col(text)
    first = decode_call_any(t)
    retry = F.when(t.contains("}}}"), decode_call_any(F.replace(t, F.lit("}}}"), F.lit("}}"))))
    return F.coalesce(F.when(first["name"].isNotNull(), first), F.when(retry["name"].isNotNull(), retry))


def func_from_cell(cell) -> Column:
    """Text inside the first ``<...>`` of a cell ('' when none)."""
    return F.coalesce(F.regexp_extract(_col(cell), FUNC_CELL_RE, 1), F.lit(""))


def ensure_end(text) -> Column:
    """Trimmed text with a guaranteed ``<end>`` suffix."""
    s = pystrip(F.coalesce(_col(text), F.lit("")))
    return F.when(s.endswith("<end>"), s).otherwise(F.concat(s, F.lit("<end>")))


def strip_quotes(text) -> Column:
    """Drop every double quote."""
    return F.replace(_col(text), F.lit('"'), F.lit(""))


def with_decoded_call(df, text_col: str, out: str = "decoded"):
    """P10 as staged columns (each heavy piece computed once per row): ``out`` =
    STRUCT<name, kind, args_json> like ``decode_call_any``."""
    from .args import args_json

    t = F.col(text_col)
    staged = df.withColumn("_dv", strict_json(t)).withColumn("_dfc", first_call(t))
    is_obj = F.schema_of_variant(F.col("_dv")).startswith("OBJECT")
    has_name = F.coalesce(F.try_variant_get(F.col("_dv"), "$", "map<string,variant>").getItem("functionName").isNotNull(), F.lit(False))
    json_args = F.try_variant_get(F.col("_dv"), "$.arguments", "variant")
    json_part = F.struct(
        F.try_variant_get(F.col("_dv"), "$.functionName", "string").alias("name"),
        F.lit("json").alias("kind"),
        F.when(F.schema_of_variant(json_args).startswith("OBJECT"), F.to_json(json_args)).otherwise(F.lit("{}")).alias("args_json"),
    )
    tag_part = F.struct(F.col("_dfc.name").alias("name"), F.lit("tag").alias("kind"), F.to_json(F.parse_json(args_json(F.col("_dfc.args")))).alias("args_json"))
    decoded = F.when(F.coalesce(t, F.lit("")) != "", F.when(is_obj & has_name, json_part).when(F.col("_dfc").isNotNull(), tag_part))
    return staged.withColumn(out, decoded).drop("_dv", "_dfc")
