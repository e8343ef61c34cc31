"""Corpus readers (S1-S9, S14) built on Spark's file sources.

Every reader keeps an order key ``(kind, path, pos)`` (JSON before CSV, then file, then
position in the file) so limits and splits can follow source order exactly.  JSON arrays and CSV files are
split over many tasks (``splittable``); nothing is read while a reader is built.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.args import pystrip
from ..functions.jsontext import json_with_repair, strict_json
from ..functions.tags import extract_calls
from .splittable import csv_records, json_elements

GLOB_PARTS = {"**/": "(.*/)?", "*": "[^/]*", "?": "[^/]"}


def _glob_regex(pattern: str) -> str:
    return "^.*/" + "".join(GLOB_PARTS.get(part, re.escape(part)) for part in re.split(r"(\*\*/|\*|\?)", pattern)) + "$"


def _glob_filter(df: DataFrame, patterns: str | None) -> DataFrame:
    """S3: comma-separated globs matched against the full path (pathGlobFilter sees names only)."""
    globs = [p.strip() for p in (patterns or "").split(",") if p.strip()]
    if not globs:
        return df
    return df.filter(F.col("src_file").rlike("|".join(f"(?:{_glob_regex(p)})" for p in globs)))


def _name_glob(patterns: str | None, default: str) -> str:
    """File-name part of the patterns for ``pathGlobFilter`` (the full path is matched afterwards)."""
    names = sorted({p.strip().split("/")[-1] for p in (patterns or "").split(",") if p.strip()}) or [default]
    return names[0] if len(names) == 1 else "{" + ",".join(names) + "}"


def _member(value: Column, key: str) -> Column:
    return F.try_variant_get(value, "$['" + key.replace("'", "\\'") + "']", "variant")


def read_json_arrays(spark: SparkSession, root: str, pattern: str = "json/*.json", user_key: str = "user", assistant_key: str = "assistant") -> DataFrame:
    """JSON files holding an array of objects; ``user`` must be text, ``assistant`` an object or
    JSON text.  Adds ``error`` (null when the row is valid) instead of raising; see ``require_valid``.

    Strict: another top level, text between elements, an element that is no object or a missing end gives a
    row with an error.  A large file is many tasks' work."""
    raw = json_elements(spark, root, _name_glob(pattern, "*.json")).withColumn("src_kind", F.lit(0))
    df = _glob_filter(raw, pattern).withColumn("_v", strict_json(F.col("element")))
    df = df.withColumns({"_user": _member(F.col("_v"), user_key), "_answer": _member(F.col("_v"), assistant_key)})
    user, answer = F.col("_user"), F.col("_answer")
    kind = F.schema_of_variant(answer)
    parsed = F.when(kind.startswith("OBJECT"), answer).when(kind == "STRING", strict_json(F.try_variant_get(answer, "$", "string")))
    err = (
        F.when(F.col("_v").isNull(), F.lit("not a JSON array of objects"))
        .when(user.isNull(), F.lit(f"missing key {user_key}"))
        .when(answer.isNull(), F.lit(f"missing key {assistant_key}"))
        .when(F.schema_of_variant(user) != "STRING", F.lit(f"{user_key} is no text"))
        .when(~kind.startswith("OBJECT") & (kind != "STRING"), F.lit(f"{assistant_key} is neither an object nor text"))
        .when(parsed.isNull(), F.lit("invalid assistant JSON"))
    )
    text = F.when(F.schema_of_variant(user) == "STRING", pystrip(F.try_variant_get(user, "$", "string")))
    return df.select("src_kind", "src_file", "src_pos", text.alias("user"), F.to_json(parsed).alias("assistant"), err.alias("error"))


def _named(name: str) -> Column:
    """Place of a column of a CSV record in its file's header, null without it."""
    return F.nullif(F.array_position("header", name), F.lit(0)) - 1


def _picked(candidates) -> Column:
    """Place of the column that a list of candidates means, whatever its case; null without one."""
    back = F.reverse(F.transform("header", lambda n: F.lower(F.trim(n))))
    return F.coalesce(*[F.size("header") - F.nullif(F.array_position(back, c), F.lit(0)) for c in candidates])


def _cell(place: Column) -> Column:
    """Stripped text of the cell at a place, empty without it."""
    return pystrip(F.coalesce(F.get("cells", place.cast("int")), F.lit("")))


def read_labelled_csv(spark: SparkSession, root: str, pattern: str = "csv/*.csv", input_col: str = "input", output_col: str = "output_json", repair: bool = False) -> DataFrame:
    """CSV with header; both cells trimmed; rows with either empty are skipped; bad JSON is an
    error unless repair (P2) fixes it.  A file without the two columns fails the job with what it has."""
    df = _glob_filter(csv_records(spark, root, _name_glob(pattern, "*.csv"), recursive=True), pattern)
    missing = _named(input_col).isNull() | _named(output_col).isNull()
    failure = F.raise_error(F.concat(F.lit(f"CSV must contain columns {input_col!r}, {output_col!r}; found "), F.array_join("header", ", ")))
    place = lambda name: F.when(missing, failure.cast("bigint")).otherwise(_named(name))
    cut = df.select(F.lit(1).alias("src_kind"), "src_file", "src_pos", _cell(place(input_col)).alias("_u"), _cell(place(output_col)).alias("_o"))
    df = cut.filter((F.col("_u") != "") & (F.col("_o") != "")).withColumn("_p", json_with_repair(F.col("_o"), repair))
    error = F.when(F.col("_p").isNull(), F.lit("invalid JSON in output column"))
    return df.select("src_kind", "src_file", "src_pos", F.col("_u").alias("user"), F.to_json("_p").alias("assistant"), error.alias("error"))


def read_labelled(spark: SparkSession, root: str, json_pattern: str = "json/*.json", csv_pattern: str = "csv/*.csv", repair: bool = False) -> DataFrame:
    """S1 + S2 + S3 + O3: JSON rows then CSV rows, ordered by (kind, file, position)."""
    parts = []
    try:
        parts.append(read_json_arrays(spark, root, json_pattern))
    except Exception as e:  # no JSON files at all
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    try:
        parts.append(read_labelled_csv(spark, root, csv_pattern, repair=repair))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if not parts:
        raise FileNotFoundError(f"no input files under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_valid(df: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first row with an error (the reference raises)."""
    # a filter, so that the check stays in the plan whatever columns are read
    failure = F.raise_error(F.concat(F.lit("invalid row: "), F.col("error"))).cast("boolean")
    return df.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(failure))


def read_jsonl_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Blank and malformed lines are dropped; ``value`` is the parsed VARIANT of each line."""
    lines = spark.read.text(path)
    return lines.select(strict_json(F.col("value")).alias("value")).filter(F.col("value").isNotNull())


def read_jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """Any line that is not one JSON value (blank included) fails the read."""
    lines = spark.read.text(path)
    v = strict_json(F.col("value"))
    return lines.select(F.when(v.isNull(), F.raise_error(F.concat(F.lit("bad JSONL line: "), F.col("value")))).otherwise(v).alias("value"))


# Header and key names of messages, expected answers, queries and tagged outputs.
MESSAGE_NAMES = ("message", "query", "query(한글)")
EXPECTED_NAMES = ("expected", "llm output", "assistant", "expect")
QUERY_NAMES = ("query(한글)", "query", "message")
OUTPUT_NAMES = ("llm output", "llm_output", "output", "expected")
CSV_DIR_ALIASES = {"index": ("idx", "id"), "query": ("q", "utterance", "text"), "function": ("func", "functions", "call")}


def _json_text(value: Column) -> Column:
    """Text of a VARIANT scalar, stripped; null if missing or JSON null."""
    return pystrip(F.try_variant_get(value, "$", "string"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``(message, expected)`` of a CSV file or folder (``.csv``) or of JSON lines; both stripped.

    JSON lines: ``message`` if it is text, else the content of the first user entry of ``messages``, else of
    its first entry; ``expected``, else ``assistant``, else ``{"calls": ..}``, objects and lists as compact JSON.
    Rows without a message and malformed lines are dropped.
    """
    if path.lower().endswith(".csv"):
        rows = csv_records(spark, path)
        return rows.select(_cell(_picked(MESSAGE_NAMES)).alias("message"), _cell(_picked(EXPECTED_NAMES)).alias("expected")).filter(F.col("message") != "")
    get = lambda key, kind="variant": F.try_variant_get(F.col("value"), f"$.{key}", kind)
    known = lambda v: F.when(~F.is_variant_null(v), v)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    content = lambda m: text(F.try_variant_get(m, "$.content", "variant"))
    user = F.filter("_messages", lambda m: (F.try_variant_get(m, "$.role", "string") == "user") & content(m).isNotNull())
    df = read_jsonl_tolerant(spark, path).withColumn("_messages", get("messages", "array<variant>"))
    message = F.coalesce(text(get("message")), content(F.get(user, 0)), content(F.get(F.col("_messages"), 0)))
    calls = F.when(get("calls").isNotNull(), F.concat(F.lit('{"calls":'), F.to_json(get("calls")), F.lit("}")))
    answer = F.coalesce(known(get("expected")), known(get("assistant")))
    kind = F.schema_of_variant(answer)
    expected = (
        F.when(answer.isNull() & get("assistant").isNull(), calls)
        .when(kind == "STRING", _json_text(answer))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(answer))
    )
    return df.select(pystrip(message).alias("message"), F.coalesce(expected, F.lit("")).alias("expected"), (message != "").alias("_kept")).filter("_kept").drop("_kept")


def _tagged_record(df: DataFrame) -> DataFrame:
    """(query, llm_output) to records: the calls of the tagged text with their arguments as JSON."""
    from ..functions.args import args_json, parse_args

    call = lambda c: F.struct(c["pos"].alias("pos"), c["func"].alias("func"), c["raw_args"].alias("raw_args"), args_json(parse_args(c["raw_args"], "plain")).alias("args_json"))
    return df.filter(F.col("query") != "").withColumn("calls", F.transform(extract_calls(F.col("llm_output")), call))


def read_records(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``(query, llm_output, calls)`` of CSV, JSON lines (``json``) or JSON files holding one object or an
    array (``json_array``); ``calls`` = ARRAY<STRUCT<pos, func, raw_args, args_json>>.

    Objects that have ``query`` and ``calls`` already pass through (``code`` stands for ``func``; entries that
    are no objects go; no output text and no raw arguments); other rows without a query are dropped.
    """
    if fmt == "csv":
        rows = csv_records(spark, path)
        return _tagged_record(rows.select(_cell(_picked(QUERY_NAMES)).alias("query"), _cell(_picked(OUTPUT_NAMES)).alias("llm_output")))
    if fmt not in ("json", "json_array"):
        raise ValueError("fmt must be 'csv', 'json' or 'json_array'")
    keys = ["Query(한글)", "query", "message", "LLM Output", "expected", "calls"]
    if fmt == "json_array":  # split over tasks; elements that are no objects of their own go
        value = strict_json(F.col("element"))
        objects = json_elements(spark, path, "*", objects=True).withColumn("_v", value).where("_v is not null")
        raw = objects.select(*[_member(F.col("_v"), k).alias(k) for k in keys])
    else:
        raw = spark.read.schema(", ".join(f"`{k}` variant" for k in keys)).option("mode", "DROPMALFORMED").json(path)
    ready = F.col("query").isNotNull() & F.col("calls").isNotNull()
    first = lambda *names: F.coalesce(*[F.nullif(_json_text(F.col(f"`{n}`")), F.lit("")) for n in names], F.lit(""))
    tagged = _tagged_record(raw.filter(~ready).select(first(*keys[:3]).alias("query"), first(*keys[3:5]).alias("llm_output")))

    def call(c, i):
        part = lambda key, kind: F.try_variant_get(c, f"$.{key}", kind)
        name = F.coalesce(F.nullif(part("func", "string"), F.lit("")), part("code", "string"), F.lit(""))
        return F.struct((i + 1).alias("pos"), name.alias("func"), F.lit(None).cast("string").alias("raw_args"), F.coalesce(F.to_json(part("args", "variant")), F.lit("{}")).alias("args_json"))

    objects = F.filter(F.try_variant_get(F.col("calls"), "$", "array<variant>"), lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    calls = F.coalesce(F.transform(objects, call), F.array().cast(tagged.schema["calls"].dataType))
    records = raw.filter(ready).select(F.coalesce(_json_text(F.col("query")), F.lit("")).alias("query"), F.lit("").alias("llm_output"), calls.alias("calls"))
    return records.unionByName(tagged)


def read_csv_dir(spark: SparkSession, directory: str) -> DataFrame:
    """Every ``*.csv`` of a folder; alias headers (idx/id, q/utterance/text, func/functions/call);
    lines with too many cells dropped; newlines become spaces; files missing a column are skipped; file name kept."""
    rows = csv_records(spark, directory)
    plain = F.forall(F.array(*map(F.lit, CSV_DIR_ALIASES)), lambda c: F.array_contains("header", c))
    places = {c: F.when(plain, _named(c)).otherwise(_picked((c, *aliases))) for c, aliases in CSV_DIR_ALIASES.items()}
    complete = rows.withColumns({f"_{c}": p for c, p in places.items()}).filter(" and ".join(f"_{c} is not null" for c in places))
    clean = [pystrip(F.regexp_replace(_cell(F.col(f"_{c}")), "\r\n|\n", " ")).alias(c) for c in places]
    return complete.select(*clean, F.element_at(F.split("src_file", "/"), -1).alias("src_path"))


def read_prompt_parts(spark: SparkSession, path: str) -> DataFrame:
    """``{"datas": [text | object]}`` -> (pos, text); objects become compact JSON text in their
    own key order.  A prompt-part list is a small hand-written asset, so it is read on the driver."""
    import json
    from pathlib import Path

    p = Path(path)
    if not p.exists():
        return spark.createDataFrame([], "pos int, text string")
    raw = p.read_text(encoding="utf-8")
    try:
        obj = json.loads(raw)
    except ValueError:
        import yaml

        obj = yaml.safe_load(raw)
    items = (obj or {}).get("datas", [])
    rows = [(i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))) for i, x in enumerate(items, start=1)]
    return spark.createDataFrame(rows, "pos int, text string")


def read_repair_cases(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSONL cases; the case text is ``raw`` else ``text``; other extensions are rejected."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.lower().endswith(".jsonl"):
        df = spark.read.json(path)
    else:
        raise ValueError("repair cases must be .csv or .jsonl")
    cols = [F.col(c) for c in ("raw", "text") if c in df.columns]
    return df.withColumn("raw", F.coalesce(*cols, F.lit("")) if cols else F.lit(""))


def read_pair_rules(spark: SparkSession, path: str) -> DataFrame:
    """S11 pair rules: JSON lines ``{"tag": "<function_X>(..)", "json": {...}}``; bad lines are skipped,
    the first call of the tag is kept, its arguments use the quoted dialect; ``seq`` is file order."""
    from ..functions.args import parse_args

    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    v = strict_json(F.col("value"))
    tag = F.try_variant_get(v, "$.tag", "string")
    js = F.try_variant_get(v, "$.json", "variant")
    is_obj = F.schema_of_variant(js).startswith("OBJECT")
    first = F.get(extract_calls(tag), 0)
    good = lines.select("seq", first.alias("c"), F.when(is_obj, F.to_json(js)).alias("json")).filter(F.col("c").isNotNull() & F.col("json").isNotNull())
    return good.select("seq", F.col("c.func").alias("code"), parse_args(F.col("c.raw_args"), "quoted").alias("args"), "json")
