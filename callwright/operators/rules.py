"""Rule matching and call rewriting (J1-J5, P30, A10, A12, K3; L2, L3).

Rules are small assets.  They are grouped to one ordered array per function code
and joined to the calls by code; the join broadcasts the rule side only after its
rows and bytes are checked (``bounded_broadcast``), otherwise it is a plain shuffle join.
Inside a call row the first matching rule is ``get(filter(rules, r -> ...), 0)``:
first match in file order, every condition key present and equal (D1 equality key)
or a wildcard.  No call is shuffled for a broadcast match.

Where one code has more than ``MAX_RULES_IN_ROW`` rules that walk is too long, and ``match_by_index`` takes
its place: every rule is filed under its rarest condition, a call looks up its own arguments only, and
equal calls look once.  Both give the same rule.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .broadcast import fits, fits_broadcast, measure
from ..functions.args import ARG_TYPE, ARGS_TYPE, args_json, float_text, json_string, number_cmp, pystrip
from ..functions.normalise import let
from ..session import checkpoint_dir

WILDCARDS_CONVERT = ("*", "__ANY__")  # conversion rules (J1, J4, J5)
WILDCARDS_TEMPLATE = ("*",)  # template map and pair rules (J2, J3)
MAX_BROADCAST_RULES = 200_000
MAX_RULES_IN_ROW = 2_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Broadcast hint only when row count and bytes are proven small; otherwise leave the join to Spark.  For
    assets (rules, cases, prompts): the measure is one aggregate, nothing is kept."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def rules_from_conditions(conds: DataFrame) -> DataFrame:
    """``(seq, code, map_func, map_enum, k, k_pos, expect, value, vtype[, out])`` rows to one row per rule with
    its ordered ``when`` array; a rule without conditions has an empty array.  ``expect`` is the equality
    key, ``value`` and ``vtype`` are what the rule says; ``out`` (argument array) is carried along."""
    cond = F.when(F.col("k").isNotNull(), F.struct("k_pos", F.col("k").alias("key"), "expect", "value", "vtype"))
    extra = ["out"] if "out" in conds.columns else []
    return conds.groupBy("seq", "code", "map_func", "map_enum", *extra).agg(F.sort_array(F.collect_list(cond)).alias("when"))


def rules_by_code(rules: DataFrame, extra=()) -> DataFrame:
    """One row per code holding its rules ordered by ``seq`` (file order)."""
    fields = ["seq", "map_func", "map_enum", "when", *extra]
    return rules.groupBy("code").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rules"))


def condition_holds(args: Column, w: Column, wildcards, strict_types: bool = False) -> Column:
    """Key present and (wildcard or equal).  Default equality is Python's ``==`` across numbers (D1:
    True == 1 == 1.0); with ``strict_types`` the type must match too (expectations written by
    ``assets.expect_key(v, strict=True)`` as ``<type>:<text>``)."""
    def value(a):
        return F.concat(a["vtype"], F.lit(":"), a["canon"]) if strict_types else a["cmp"]

    return F.exists(args, lambda a: (a["key"] == w["key"]) & (w["expect"].isin(*wildcards) | (value(a) == w["expect"])))


def first_match(args: Column, rules: Column, wildcards=WILDCARDS_CONVERT, when_field: str = "when", strict_types: bool = False) -> Column:
    """First rule (array order) whose every condition holds; null when none or no rules."""
    return F.get(F.filter(rules, lambda r: F.forall(r[when_field], lambda w: condition_holds(args, w, wildcards, strict_types))), 0)


def arg_canon(args: Column, key: Column) -> Column:
    return F.get(F.filter(args, lambda a: a["key"] == key), 0)["canon"]


def match_calls(calls: DataFrame, rules: DataFrame, wildcards=WILDCARDS_CONVERT, extra=(), strict_types: bool = False) -> DataFrame:
    """Calls (with ``func`` and ``args``) + the first matching rule struct as ``rule`` (left outer)."""
    by_code = rules_by_code(rules, extra)
    measured = measure(by_code, F.max(F.size("rules")).alias("most"))
    if (measured["most"] or 0) > MAX_RULES_IN_ROW:
        return match_by_index(calls, rules, wildcards, extra, strict_types)
    if fits(measured, MAX_BROADCAST_RULES):
        by_code = F.broadcast(by_code)
    joined = calls.join(by_code, calls["func"] == by_code["code"], "left").drop("code")
    rule = first_match(F.col("args"), F.coalesce(F.col("rules"), F.array()), wildcards, strict_types=strict_types)
    return joined.withColumn("rule", rule).drop("rules")


def match_by_index(calls: DataFrame, rules: DataFrame, wildcards=WILDCARDS_CONVERT, extra=(), strict_types: bool = False) -> DataFrame:
    """``match_calls`` by an index of the rules.

    A rule is filed under the one of its conditions that the fewest rules of its code share, as (code, key,
    expected value); a rule of wildcards alone under (code, key), one without conditions under its code.
    Each different (func, args) looks up its code, its keys and its (key, value) pairs, the found rules are
    checked in full, and the first by ``seq`` counts.  Calls meet their rule by (func, args).
    """
    fields = ["seq", "map_func", "map_enum", "when", *extra]
    rule_type = rules.select(F.struct(*fields)).schema[0].dataType
    wild = F.col("w.expect").isin(*wildcards)
    none = F.lit(None).cast("string")
    # a wildcard names its key only; a null stands for "any", as no key or value is null in a lookup
    terms = rules.select("code", F.struct(*fields).alias("rule"), F.posexplode_outer("when").alias("i", "w"))
    terms = terms.select("code", "rule", "i", F.col("w.key").alias("key"), F.when(~wild, F.col("w.expect")).alias("expect"))
    shared = terms.groupBy("code", "key", "expect").agg(F.countDistinct("rule.seq").alias("shared"))
    same = lambda a, b: (a["code"] == b["code"]) & a["key"].eqNullSafe(b["key"]) & a["expect"].eqNullSafe(b["expect"])
    weighed = terms.alias("t").join(shared.alias("s"), same({c: F.col(f"t.{c}") for c in ("code", "key", "expect")}, {c: F.col(f"s.{c}") for c in ("code", "key", "expect")})).select("t.*", "s.shared")
    place = F.struct("shared", F.coalesce("i", F.lit(-1)).alias("i"), "key", "expect")
    filed = weighed.groupBy("code", F.col("rule.seq").alias("seq")).agg(F.min(place).alias("p"), F.first("rule").alias("rule"))
    index = filed.select(F.col("code").alias("r_code"), F.col("p.key").alias("r_key"), F.col("p.expect").alias("r_expect"), "rule")

    def value(a):
        return F.concat(a["vtype"], F.lit(":"), a["canon"]) if strict_types else a["cmp"]

    probe = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    probes = F.concat(F.array(probe(none, none)), F.transform("args", lambda a: probe(a["key"], none)), F.transform("args", lambda a: probe(a["key"], value(a))))
    distinct = calls.select("func", "args").distinct()
    asked = distinct.select("func", "args", F.explode(F.array_distinct(probes)).alias("q"))
    on = (F.col("func") == F.col("r_code")) & F.col("q.k").eqNullSafe(F.col("r_key")) & F.col("q.v").eqNullSafe(F.col("r_expect"))
    found = asked.join(index, on)
    holds = F.forall(F.col("rule.when"), lambda w: condition_holds(F.col("args"), w, wildcards, strict_types))
    best = found.where(holds).groupBy("func", "args").agg(F.min_by("rule", F.col("rule.seq")).alias("rule"))
    best = best.select(F.col("func").alias("_func"), F.col("args").alias("_args"), F.col("rule").cast(rule_type).alias("rule"))
    return calls.join(best, (F.col("func") == F.col("_func")) & F.col("args").eqNullSafe(F.col("_args")), "left").drop("_func", "_args")


def convert_calls(calls: DataFrame, rules: DataFrame, strict_types: bool = False) -> DataFrame:
    """map_func / map_enum / map_args ('' when unmatched); map_args lists the rule's keys."""
    m = match_calls(calls, rules, WILDCARDS_CONVERT, strict_types=strict_types)
    when_sorted = F.col("rule.when")
    map_args = F.array_join(
        F.transform(when_sorted, lambda w: F.concat(w["key"], F.lit("="), arg_canon(F.col("args"), w["key"]))), ", "
    )
    return m.select(
        *[c for c in m.columns if c != "rule"],
        F.coalesce(F.col("rule.map_func"), F.lit("")).alias("map_func"),
        F.coalesce(F.col("rule.map_enum"), F.lit("")).alias("map_enum"),
        F.coalesce(map_args, F.lit("")).alias("map_args"),
    )


def conversion_report(converted: DataFrame) -> DataFrame:
    """Total / matched / unmatched in one aggregate."""
    return converted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("map_func") != "").alias("matched"),
        F.count_if(F.col("map_func") == "").alias("unmatched"),
    )


#: Compact JSON object of an argument array, keys in argument order.
object_text = args_json


def dict_update(base: Column, more: Column) -> Column:
    """Python ``dict.update``: keys of ``more`` overwrite in place, new keys append."""
    return F.aggregate(
        more,
        base,
        lambda acc, x: F.when(
            F.exists(acc, lambda y: y["key"] == x["key"]), F.transform(acc, lambda y: F.when(y["key"] == x["key"], x).otherwise(y))
        ).otherwise(F.concat(acc, F.array(x))),
    )


def str_arg(key: str | Column, value: Column) -> Column:
    k = F.lit(key) if isinstance(key, str) else key
    return F.struct(k.alias("key"), value.alias("raw"), F.lit("str").alias("vtype"), value.alias("canon"), F.concat(F.lit("s:"), value).alias("cmp")).cast(ARG_TYPE)


def message_expected(converted: DataFrame, message_col: str = "query", source: str = "raw_args") -> DataFrame:
    """K3: ``{"name": map_func, "arguments": {"code": func, **args}}`` as compact JSON text.

    D10: the reference reads the raw arguments (``source="raw_args"``, the default) although its
    documentation names the mapped ones; ``source="map_args"`` uses the rule's keys instead."""
    from ..functions.args import parse_args

    if source not in ("raw_args", "map_args"):
        raise ValueError("source must be 'raw_args' or 'map_args'")
    args = F.col("args") if source == "raw_args" else parse_args(F.col("map_args"), "plain")
    arguments = dict_update(F.array(str_arg("code", F.col("func"))).cast(ARGS_TYPE), args)
    expected = F.concat(F.lit('{"name":'), json_string(F.col("map_func")), F.lit(',"arguments":'), object_text(arguments), F.lit("}"))
    return converted.select(pystrip(message_col).alias("message"), expected.alias("expected"))


# ------------------------------------------------------------------ templates (J2) / pairs


# The parts of a format template: escaped braces, fields, lone braces, text.
TEMPLATE_PART_RE = r"\{\{|\}\}|\{[^{}]*\}|[{}]|[^{}]+"


def template_values(args: Column, code: Column) -> Column:
    """What the fields of a template stand for: {code, **args}; an argument named ``code`` wins."""
    return dict_update(F.array(str_arg("code", code)).cast(ARGS_TYPE), args)


def fill_template(template: Column, values: Column) -> Column:
    """``str.format`` with ``template_values`` in one pass over the template.

    Doubled braces are literal ones.  A lone brace or a field that names no argument (conversions, format
    specs and positions included) keeps the whole template as it is.
    """
    value = lambda field: F.get(F.filter(values, lambda a: F.concat(F.lit("{"), a["key"], F.lit("}")) == field), 0)["canon"]
    filled = F.transform(
        F.regexp_extract_all(template, F.lit(TEMPLATE_PART_RE), F.lit(0)),
        lambda p: F.when(p == "{{", F.lit("{")).when(p == "}}", F.lit("}")).when(p.isin("{", "}"), F.lit(None)).when(p.startswith("{"), value(p)).otherwise(p),
    )
    whole = let(filled, lambda f: F.when(F.exists(f, lambda p: p.isNull()), template).otherwise(F.array_join(f, "")))
    return F.when(F.contains(template, F.lit("{")) | F.contains(template, F.lit("}")), whole).otherwise(template)


def _template_args(out: Column, values: Column) -> Column:
    """Output arguments of a template rule: text is filled, any other value keeps its type.  Two steps, so that a
    text is filled once."""
    filled = F.transform(out, lambda x: F.struct(x["name"].alias("key"), x["vtype"].alias("vtype"), F.when(x["vtype"] == "str", fill_template(x["template"], values)).otherwise(x["template"]).alias("v")))
    return F.transform(filled, lambda x: F.struct(x["key"].alias("key"), x["v"].alias("raw"), x["vtype"].alias("vtype"), x["v"].alias("canon"), F.lit(None).cast("string").alias("cmp"))).cast(ARGS_TYPE)


def _template_mapped(func: Column, args: Column, rule: Column, values: Column) -> Column:
    """J2 output text of one call given its matched template rule (null rule = identity)."""
    name = F.when(rule.isNotNull(), F.coalesce(F.nullif(rule["map_func"], F.lit("")), func)).otherwise(func)
    arguments = object_text(F.when(rule.isNotNull(), _template_args(rule["out"], values)).otherwise(args))
    return F.concat(F.lit('{"functionName":'), json_string(name), F.lit(',"arguments":'), arguments, F.lit("}"))


def _template_rules(template_rules: DataFrame) -> DataFrame:
    return template_rules.select("seq", "code", F.col("new_name").alias("map_func"), F.lit("").alias("map_enum"), "when", "out")


def map_calls_template(calls: DataFrame, template_rules: DataFrame) -> DataFrame:
    """First template rule by code (wildcard '*') -> ``{"functionName", "arguments"}``; identity fallback.

    ``template_rules``: (seq, code, new_name, when ARRAY<STRUCT<k_pos,key,expect>>, out ARRAY<STRUCT<pos,name,template,vtype>>).
    """
    m = match_calls(calls, _template_rules(template_rules), WILDCARDS_TEMPLATE, extra=("out",))
    m = m.withColumn("_values", F.when(F.col("rule").isNotNull(), template_values(F.col("args"), F.col("func"))))
    return m.withColumn("mapped", _template_mapped(F.col("func"), F.col("args"), F.col("rule"), F.col("_values"))).drop("rule", "_values")


def rules_map(rules: DataFrame, extra=()) -> DataFrame:
    """All rules as one row ``map<code, array<rule>>`` (a small asset), for in-row matching."""
    by_code = rules_by_code(rules, extra)
    return by_code.agg(F.map_from_entries(F.collect_list(F.struct("code", "rules"))).alias("rules_by_code"))


def map_rows_template(df: DataFrame, text_col: str, template_rules: DataFrame, dialect: str = "quoted") -> DataFrame:
    """J2 per text row: ``mapped_json`` = JSON array of the mapped calls, computed inside the row.

    The rule map is one broadcast row (size-checked), so rows are neither exploded nor regrouped:
    no shuffle at all, whatever the number of calls per row."""
    from ..functions.args import parse_args
    from ..functions.tags import extract_calls

    if not fits_broadcast(template_rules, MAX_BROADCAST_RULES):
        # too many rules for one broadcast row: match per call through the (shuffle) join path
        from ..functions.args import with_args
        from .calls import calls_table

        checkpoint_dir(df.sparkSession)
        # row ids are written once: computed again they could differ
        keyed = df.withColumn("_rid", F.monotonically_increasing_id()).checkpoint()
        calls = with_args(calls_table(keyed, text_col, ("_rid",)), "raw_args", dialect, "args")
        mapped = map_calls_template(calls, template_rules)
        return per_row_json_list(mapped, keyed, ("_rid",)).drop("_rid")
    rm = F.broadcast(rules_map(_template_rules(template_rules), ("out",)))  # one row, size bounded by the check above
    joined = df.crossJoin(rm)

    # staged transforms: each stage reads the previous one's fields, so the argument parse and
    # the rule match run once per call (lambdas get no common-subexpression elimination)
    parsed = F.transform(extract_calls(F.col(text_col)), lambda c: F.struct(c["func"].alias("func"), parse_args(c["raw_args"], dialect).alias("args")))
    matched = F.transform(
        parsed,
        lambda c: F.struct(
            c["func"].alias("func"),
            c["args"].alias("args"),
            first_match(c["args"], F.coalesce(F.try_element_at(F.col("rules_by_code"), c["func"]), F.array()), WILDCARDS_TEMPLATE).alias("rule"),
        ),
    )
    valued = F.transform(matched, lambda c: F.struct(c["func"].alias("func"), c["args"].alias("args"), c["rule"].alias("rule"), template_values(c["args"], c["func"]).alias("values")))
    mapped = F.transform(valued, lambda c: _template_mapped(c["func"], c["args"], c["rule"], c["values"]))
    return joined.withColumn("mapped_json", F.concat(F.lit("["), F.array_join(mapped, ","), F.lit("]"))).drop("rules_by_code")


def map_calls_pairs(calls: DataFrame, pair_rules: DataFrame) -> DataFrame:
    """First pair rule of the call's function whose tag args are a subset (wildcard '*'); identity fallback.

    ``pair_rules``: (seq, code, args ARRAY<arg>, json STRING); conditions come from the tag's own arguments.
    """
    rules = pair_rules.select(
        "seq",
        "code",
        F.lit("").alias("map_func"),
        F.lit("").alias("map_enum"),
        F.transform("args", lambda a, i: F.struct((i + 1).alias("k_pos"), a["key"].alias("key"), F.when(a["canon"] == "*", F.lit("*")).otherwise(a["cmp"]).alias("expect"))).alias("when"),
        "json",
    )
    m = match_calls(calls, rules, WILDCARDS_TEMPLATE, extra=("json",))
    identity = F.concat(F.lit('{"functionName":'), json_string(F.col("func")), F.lit(',"arguments":'), object_text(F.col("args")), F.lit("}"))
    return m.withColumn("mapped", F.coalesce(F.col("rule.json"), identity)).drop("rule")


def per_row_json_list(mapped: DataFrame, source: DataFrame, keys=("row_id",)) -> DataFrame:
    """L3 output: the mapped calls of each source row as one JSON array text ('[]' when none)."""
    lists = mapped.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "mapped"))).alias("ms"))
    return source.join(lists, list(keys), "left").withColumn(
        "mapped_json", F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("ms", lambda m: m["mapped"]), ","), F.lit("")), F.lit("]"))
    ).drop("ms")


# ------------------------------------------------------------------ substitution


def _directed(rules: DataFrame, direction: str):
    """(rules as matched in this direction, their extra column, (func, args, rule) -> (func, args))."""
    if direction not in ("forward", "reverse"):
        raise ValueError("direction must be 'forward' or 'reverse'")
    if "out" not in rules.columns:
        rules = rules.withColumn("out", F.array(str_arg("enum", F.col("map_enum"))).cast(ARGS_TYPE))
    if direction == "forward":
        return rules, "out", lambda func, args, rule: (F.coalesce(rule["map_func"], func), F.when(rule.isNotNull(), rule["out"]).otherwise(args))
    wild = lambda a: (a["vtype"] == "str") & a["canon"].isin(*WILDCARDS_CONVERT)
    rev = rules.select(
        "seq",
        F.col("map_func").alias("code"),
        F.col("code").alias("map_func"),
        F.lit("").alias("map_enum"),
        F.transform("out", lambda a, i: F.struct((i + 1).alias("k_pos"), a["key"].alias("key"), F.when(wild(a), a["canon"]).otherwise(a["cmp"]).alias("expect"))).alias("when"),
        F.col("when").alias("back"),
    )

    def written_back(w):
        cmp = F.when(w["expect"].isin(*WILDCARDS_CONVERT), F.concat(F.lit("s:"), w["value"])).otherwise(w["expect"])
        return F.struct(w["key"].alias("key"), w["value"].alias("raw"), w["vtype"].alias("vtype"), w["value"].alias("canon"), cmp.alias("cmp"))

    def build(func, args, rule):
        back = F.transform(rule["back"], written_back)
        return F.coalesce(rule["map_func"], func), F.when(rule.isNotNull(), back.cast(ARGS_TYPE)).otherwise(args)

    return rev, "back", build


def substitute(calls: DataFrame, rules: DataFrame, direction: str = "forward") -> DataFrame:
    """J4 / J5 on calls with ``func`` / ``args``.

    forward: raw code + ``when`` subset -> (map_func, the rule's ``out`` arguments, {enum: map_enum} without any)
    reverse: (map_func, args containing these) -> (code, when), values with the types of the rule and
    wildcards written back as literal '*'.  Unmatched calls pass through unchanged.
    """
    table, extra, build = _directed(rules, direction)
    m = match_calls(calls, table, WILDCARDS_CONVERT, extra=(extra,))
    out_func, out_args = build(F.col("func"), F.col("args"), F.col("rule"))
    return m.withColumn("out_func", out_func).withColumn("out_args", out_args).drop("rule")


def args_of_object(text) -> Column:
    """Typed argument array of a JSON object's text; lists and objects stay JSON text (``json``)."""
    members = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))

    def arg(m):
        v, kind = m["value"], F.schema_of_variant(m["value"])
        plain = F.try_variant_get(v, "$", "string")
        vtype = (
            F.when(kind == "STRING", F.lit("str"))
            .when(kind == "BOOLEAN", F.lit("bool"))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit("float"))
            .when(kind == "VOID", F.lit("none"))
            .otherwise(F.lit("json"))
        )
        number = F.try_variant_get(v, "$", "double")
        canon = (
            F.when(vtype == "bool", F.initcap(plain)).when(vtype == "float", float_text(number)).when(vtype == "none", F.lit("None")).when(vtype == "json", F.to_json(v)).otherwise(plain)
        )
        cmp = (
            F.when(vtype == "bool", F.when(plain == "true", F.lit("n:1")).otherwise(F.lit("n:0")))
            .when(vtype == "int", F.concat(F.lit("n:"), plain))
            .when(vtype == "float", number_cmp(number))
            .when(vtype == "none", F.lit("z:None"))
            .otherwise(F.concat(F.lit("s:"), canon))
        )
        return F.struct(m["key"].alias("key"), canon.alias("raw"), vtype.alias("vtype"), canon.alias("canon"), cmp.alias("cmp"))

    return F.coalesce(F.transform(members, arg), F.array()).cast(ARGS_TYPE)


def apply_rules_to_records(records: DataFrame, rules: DataFrame, direction: str = "forward") -> DataFrame:
    """K5: records in, records out; every call of ``calls`` (ARRAY<STRUCT<pos, func, raw_args, args_json>>, as the
    record reader gives them) rewritten by J4 or J5; ``raw_args`` of a rewritten record are null.

    Calls are matched as a table of their different (func, arguments), whose rewritten form then stands
    in each record that holds it: the records themselves are neither exploded nor regrouped when the rules fit
    a broadcast, and each different call is matched once when they do not.
    """
    table, extra, build = _directed(rules, direction)
    columns = [c for c in records.columns if c != "calls"]

    def rewritten(func, args, rule):
        out_func, out_args = build(func, args, rule)
        return out_func.alias("func"), object_text(out_args).alias("args_json")

    if fits_broadcast(table, MAX_RULES_IN_ROW):
        staged = records.crossJoin(F.broadcast(rules_map(table, (extra,))))  # one row, size bounded by the check above
        read = F.transform("calls", lambda c: F.struct(c["pos"].alias("pos"), c["func"].alias("func"), args_of_object(c["args_json"]).alias("args")))
        of_code = lambda func: F.coalesce(F.try_element_at(F.col("rules_by_code"), func), F.array())
        matched = F.transform(read, lambda c: F.struct(c["pos"].alias("pos"), c["func"].alias("func"), c["args"].alias("args"), first_match(c["args"], of_code(c["func"])).alias("rule")))
        made = F.transform(matched, lambda c: F.struct(c["pos"].alias("pos"), *rewritten(c["func"], c["args"], c["rule"])))
    else:
        asked = records.select(F.explode("calls").alias("c")).select(F.col("c.func").alias("func"), F.col("c.args_json").alias("given")).distinct()
        answers = match_calls(asked.withColumn("args", args_of_object(F.col("given"))), table, WILDCARDS_CONVERT, extra=(extra,))
        answers = answers.select(F.struct("func", F.col("given").alias("args_json")).alias("k"), F.struct(*rewritten(F.col("func"), F.col("args"), F.col("rule"))).alias("v"))
        # each different list of calls is put together once
        lists = records.select("calls").distinct()
        called = lists.select("calls", F.explode("calls").alias("c")).select("calls", F.col("c.pos").alias("pos"), F.struct(F.col("c.func").alias("func"), F.col("c.args_json").alias("args_json")).alias("k"))
        joined = called.join(answers, "k").groupBy("calls").agg(F.sort_array(F.collect_list(F.struct("pos", "v.func", "v.args_json"))).alias("_made"))
        staged = records.join(joined, "calls", "left")
        made = F.coalesce(F.col("_made"), F.array())
    kept = lambda c: F.struct(c["pos"].alias("pos"), c["func"].alias("func"), F.lit(None).cast("string").alias("raw_args"), c["args_json"].alias("args_json"))
    return staged.withColumn("_out", made).select(*columns, F.transform("_out", kept).alias("calls"))


def group_by_query(calls: DataFrame, keys=("row_id",)) -> DataFrame:
    """A10 long form: calls of all records sharing a query, in record then call order.

    Flat rows ``(query, query_first, call_seq, func, raw_args)`` instead of one nested record per
    query, so a query shared by a third of the corpus is ranked across buckets, not in one task.
    """
    from .index import rank_in_group

    c = calls.filter(F.col("query") != "")
    ranked = rank_in_group(c, ["query"], [*keys, "pos"], "call_seq", group_min={"query_first": keys[0]})
    return ranked.select("query", "query_first", "call_seq", "func", "raw_args")
