"""DuckDB SQL building blocks for the oracle of each named query.

Each block is a CTE over the fixture SQL (same text the Spark side runs), so a
query's oracle is ``WITH <blocks> SELECT ...``.  The blocks restate the operator
semantics in plain SQL, independently of the Spark column code.
"""
from __future__ import annotations

from .fixtures import CHAT_LABELLED_SQL, CHAT_PAIRS_SQL, PREDICTIONS_SQL, REPAIR_INPUT_SQL, RULE_CONDITIONS_SQL, TAGGED_SQL, TEMPLATE_FORMATS_SQL, TEMPLATE_TAGS_SQL

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

TAGGED = f"tagged AS ({TAGGED_SQL})"
CHAT = f"chat_pairs AS ({CHAT_PAIRS_SQL})"
RULES = f"rule_conditions AS ({RULE_CONDITIONS_SQL})"
PREDS = f"predictions AS ({PREDICTIONS_SQL})"
CHAT_LABELLED = f"chat_labelled AS ({CHAT_LABELLED_SQL})"
REPAIR_INPUT = f"repair_input AS ({REPAIR_INPUT_SQL})"
TFORMATS = f"tformats AS ({TEMPLATE_FORMATS_SQL})"
TTAGS = f"ttags AS ({TEMPLATE_TAGS_SQL})"

# P6 profile calls
P6 = r"<function_([A-Z]{2})>\(([^\n]*?)\)"
PCALLS = f"""pcalls AS (
  SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY ord) AS INTEGER) AS pos,
         regexp_extract(piece, '{P6}', 1) AS func, regexp_extract(piece, '{P6}', 2) AS raw_args
  FROM (SELECT row_id, {strip('piece0')} AS piece, ord FROM
          (SELECT row_id, unnest(string_split(llm_output, ';')) AS piece0,
                  unnest(generate_series(1, len(string_split(llm_output, ';')))) AS ord FROM tagged) y) x
  WHERE piece <> '' AND regexp_matches(piece, '{P6}'))"""

# P7 profile dialect over the plain comma split (the fixture has no parens / quoted commas)
PARGS = f"""pargs_raw AS (
  SELECT row_id, pos, func, ord, {strip("split_part(tok, '=', 1)")} AS arg_key,
         {strip("substr(tok, strpos(tok, '=') + 1)")} AS raw
  FROM (SELECT row_id, pos, func, {strip('tok0')} AS tok, ord FROM
          (SELECT row_id, pos, func, unnest(string_split(raw_args, ',')) AS tok0,
                  unnest(generate_series(1, len(string_split(raw_args, ',')))) AS ord FROM pcalls) y) t
  WHERE strpos(tok, '=') > 0
  QUALIFY row_number() OVER (PARTITION BY row_id, pos, arg_key ORDER BY ord DESC) = 1),
pargs AS (
  SELECT row_id, pos, func, arg_key, raw,
    CASE WHEN raw = 'None' THEN 'none' WHEN raw IN ('True', 'False') THEN 'bool'
         WHEN strpos(raw, '.') > 0 AND regexp_matches(raw, '{FLOAT_RE}') THEN 'float'
         WHEN strpos(raw, '.') = 0 AND regexp_matches(raw, '{INT_RE}') AND try_cast(raw AS BIGINT) IS NOT NULL THEN 'int'
         ELSE 'str' END AS val_type
  FROM pargs_raw),
pmelt AS (
  SELECT row_id, pos, func, arg_key, val_type,
    CASE val_type WHEN 'int' THEN CAST(CAST(raw AS BIGINT) AS VARCHAR)
                  WHEN 'float' THEN CAST(CAST(raw AS DOUBLE) AS VARCHAR)
                  WHEN 'str' THEN CASE WHEN length(raw) >= 2 AND ((starts_with(raw, '"') AND ends_with(raw, '"'))
                                         OR (starts_with(raw, '''') AND ends_with(raw, ''''))) THEN substr(raw, 2, length(raw) - 2) ELSE raw END
                  ELSE raw END AS val
  FROM pargs WHERE val_type <> 'none')"""

# P5 tagged calls (dot-all, stops at the first ')')
P5 = r"<function_([A-Za-z0-9_]+)>\((.*?)\)"
CALLS = f"""calls AS (
  SELECT row_id, CAST(i AS INTEGER) AS pos, f[i] AS func, a[i] AS raw_args FROM (
    SELECT row_id, f, a, unnest(generate_series(1, len(f))) AS i FROM (
      SELECT row_id, regexp_extract_all(replace(llm_output, '<end>', ''), '{P5}', 1, 's') AS f,
             regexp_extract_all(replace(llm_output, '<end>', ''), '{P5}', 2, 's') AS a FROM tagged) z) w)"""


def kv_split(src: str, name: str, text_col: str, keys: str, require_eq: bool = True) -> str:
    """Plain comma split of ``text_col`` into (keys, ord, arg_key, raw) with last-wins per key."""
    where = "WHERE tok <> '' AND strpos(tok, '=') > 0" if require_eq else "WHERE tok <> ''"
    return f"""{name} AS (
  SELECT {keys}, ord, {strip("split_part(tok, '=', 1)")} AS arg_key,
         {strip("substr(tok, strpos(tok, '=') + 1)")} AS raw,
         min(ord) OVER (PARTITION BY {keys}, {strip("split_part(tok, '=', 1)")}) AS first_ord
  FROM (SELECT {keys}, {strip('tok0')} AS tok, ord FROM
          (SELECT {keys}, unnest(string_split({strip(text_col)}, ',')) AS tok0,
                  unnest(generate_series(1, len(string_split({strip(text_col)}, ',')))) AS ord FROM {src}) y) t
  {where}
  QUALIFY row_number() OVER (PARTITION BY {keys}, {strip("split_part(tok, '=', 1)")} ORDER BY ord DESC) = 1)"""


def plain_typed(raw: str = "raw") -> str:
    """vtype / canon / cmp of the plain dialect as SQL expressions (fixture range of numbers)."""
    vtype = f"""CASE WHEN lower({raw}) IN ('true', 'false') THEN 'bool'
         WHEN regexp_matches({raw}, '{INT_RE}') AND try_cast({raw} AS BIGINT) IS NOT NULL THEN 'int'
         WHEN regexp_matches({raw}, '{FLOAT_RE}') THEN 'float' ELSE 'str' END"""
    canon = f"""CASE WHEN lower({raw}) = 'true' THEN 'True' WHEN lower({raw}) = 'false' THEN 'False'
         WHEN regexp_matches({raw}, '{INT_RE}') AND try_cast({raw} AS BIGINT) IS NOT NULL THEN CAST(CAST({raw} AS BIGINT) AS VARCHAR)
         WHEN regexp_matches({raw}, '{FLOAT_RE}') THEN CAST(CAST({raw} AS DOUBLE) AS VARCHAR) ELSE {raw} END"""
    cmp = f"""CASE WHEN lower({raw}) = 'true' THEN 'n:1' WHEN lower({raw}) = 'false' THEN 'n:0'
         WHEN regexp_matches({raw}, '{INT_RE}') AND try_cast({raw} AS BIGINT) IS NOT NULL THEN 'n:' || CAST(CAST({raw} AS BIGINT) AS VARCHAR)
         WHEN regexp_matches({raw}, '{FLOAT_RE}') AND CAST({raw} AS DOUBLE) = floor(CAST({raw} AS DOUBLE)) THEN 'n:' || CAST(CAST(CAST({raw} AS DOUBLE) AS BIGINT) AS VARCHAR)
         WHEN regexp_matches({raw}, '{FLOAT_RE}') THEN 'n:' || CAST(CAST({raw} AS DOUBLE) AS VARCHAR)
         ELSE 's:' || {raw} END"""
    return vtype, canon, cmp


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


def quoted_typed(raw: str = "raw") -> tuple[str, str, str]:
    q = f"((starts_with({raw}, '\"') AND ends_with({raw}, '\"')) OR (starts_with({raw}, '''') AND ends_with({raw}, '''')))"
    mid = f"substr({raw}, 2, greatest(length({raw}) - 2, 0))"
    pv, pc, pm = plain_typed(raw)
    vtype = f"CASE WHEN {q} THEN 'str' WHEN NOT regexp_matches({raw}, '^[0-9+\\-.]*$') AND regexp_matches({raw}, '[^\\x00-\\x7f]') THEN 'str' ELSE {pv} END"
    canon = f"CASE WHEN {q} THEN {mid} WHEN NOT regexp_matches({raw}, '^[0-9+\\-.]*$') AND regexp_matches({raw}, '[^\\x00-\\x7f]') THEN {raw} ELSE {pc} END"
    cmp = f"CASE WHEN {q} THEN 's:' || {mid} WHEN NOT regexp_matches({raw}, '^[0-9+\\-.]*$') AND regexp_matches({raw}, '[^\\x00-\\x7f]') THEN 's:' || {raw} ELSE {pm} END"
    return vtype, canon, cmp


def lenient_typed(raw: str = "raw") -> tuple[str, str, str]:
    q = f"((starts_with({raw}, '\"') AND ends_with({raw}, '\"')) OR (starts_with({raw}, '''') AND ends_with({raw}, '''')))"
    unq = f"(CASE WHEN {q} THEN substr({raw}, 2, greatest(length({raw}) - 2, 0)) ELSE {raw} END)"
    vtype = f"""CASE WHEN length({raw}) = 0 THEN 'str' WHEN lower({unq}) IN ('true', 'false') THEN 'bool'
        WHEN regexp_matches({unq}, '^-?[0-9]+$') AND try_cast({unq} AS BIGINT) IS NOT NULL THEN 'int'
        WHEN regexp_matches({unq}, '{FLOAT_RE}') THEN 'float' ELSE 'str' END"""
    canon = f"""CASE WHEN length({raw}) = 0 THEN '' WHEN lower({unq}) = 'true' THEN 'True' WHEN lower({unq}) = 'false' THEN 'False'
        WHEN regexp_matches({unq}, '^-?[0-9]+$') AND try_cast({unq} AS BIGINT) IS NOT NULL THEN CAST(CAST({unq} AS BIGINT) AS VARCHAR)
        WHEN regexp_matches({unq}, '{FLOAT_RE}') THEN CAST(CAST({unq} AS DOUBLE) AS VARCHAR) ELSE {unq} END"""
    cmp = f"""CASE WHEN length({raw}) = 0 THEN 's:' WHEN lower({unq}) = 'true' THEN 'n:1' WHEN lower({unq}) = 'false' THEN 'n:0'
        WHEN regexp_matches({unq}, '^-?[0-9]+$') AND try_cast({unq} AS BIGINT) IS NOT NULL THEN 'n:' || CAST(CAST({unq} AS BIGINT) AS VARCHAR)
        ELSE 's:' || {unq} END"""
    return vtype, canon, cmp


def profile_typed(raw: str = "raw") -> tuple[str, str, str]:
    """Case-sensitive True / False / None, numbers as written, one pair of outer quotes dropped."""
    q = f"(length({raw}) >= 2 AND ((starts_with({raw}, '\"') AND ends_with({raw}, '\"')) OR (starts_with({raw}, '''') AND ends_with({raw}, ''''))))"
    vtype = f"""CASE WHEN {raw} = 'None' THEN 'none' WHEN {raw} IN ('True', 'False') THEN 'bool'
        WHEN strpos({raw}, '.') > 0 AND regexp_matches({raw}, '{FLOAT_RE}') THEN 'float'
        WHEN strpos({raw}, '.') = 0 AND regexp_matches({raw}, '{INT_RE}') AND try_cast({raw} AS BIGINT) IS NOT NULL THEN 'int' ELSE 'str' END"""
    canon = f"""CASE {vtype} WHEN 'int' THEN CAST(CAST({raw} AS BIGINT) AS VARCHAR) WHEN 'float' THEN CAST(CAST({raw} AS DOUBLE) AS VARCHAR)
        WHEN 'str' THEN CASE WHEN {q} THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END ELSE {raw} END"""
    cmp = f"""CASE {vtype} WHEN 'bool' THEN CASE {raw} WHEN 'True' THEN 'n:1' ELSE 'n:0' END WHEN 'int' THEN 'n:' || {canon}
        WHEN 'float' THEN 'n:' || {canon} ELSE 's:' || {canon} END"""
    return vtype, canon, cmp


def typed_args(name: str, src: str, keys: str, dialect: str) -> str:
    """(keys, arg_pos, key, raw, vtype, canon, cmp) for the rows of ``src`` with column raw_args."""
    split_name = f"{name}_kv"
    typer = {"plain": plain_typed, "quoted": quoted_typed, "lenient": lenient_typed, "profile": profile_typed}[dialect]
    v, c, m = typer("raw")
    return (
        kv_split(src, split_name, "raw_args", keys, require_eq=(dialect != "lenient"))
        + f""",
{name} AS (
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY first_ord) AS INTEGER) AS arg_pos,
         arg_key AS key, raw, {v} AS vtype, {c} AS canon, {m} AS cmp, first_ord
  FROM {split_name})"""
    )


def json_value(vtype: str = "vtype", canon: str = "canon") -> str:
    return f"CASE WHEN {vtype} = 'bool' THEN lower({canon}) WHEN {vtype} IN ('int', 'float') THEN {canon} WHEN {vtype} = 'none' THEN 'null' ELSE CAST(to_json({canon}) AS VARCHAR) END"


def first_rule(name: str, args: str, wild: str) -> str:
    """Per call (row_id, pos): the first rule (min seq) of its code whose conditions all hold."""
    return f"""{name}_cand AS (
  SELECT c.row_id, c.pos, r.seq, count(r.k) AS need, count(a.key) AS have
  FROM calls c JOIN rule_conditions r ON r.code = c.func
  LEFT JOIN {args} a ON a.row_id = c.row_id AND a.pos = c.pos AND a.key = r.k AND (r.expect IN ({wild}) OR a.cmp = r.expect)
  GROUP BY c.row_id, c.pos, r.seq),
{name} AS (SELECT row_id, pos, min(seq) AS seq FROM {name}_cand WHERE need = have GROUP BY row_id, pos)"""


P15_CALL = r"<fu(?:n)?ction_([A-Za-z0-9_]+)>\s*(?:\(([^()]*)\))?"


def p15(expr: str) -> str:
    """Normaliser for regular text (flat parens, plain tag names) as one SQL expression."""
    s = f"replace({expr}, '\"', '')"
    names = f"list_slice(regexp_extract_all({s}, '{P15_CALL}', 1), 1, 2)"
    argss = f"regexp_extract_all({s}, '{P15_CALL}', 2)"
    piece = strip("p")
    key = strip("split_part(p, '=', 1)")
    val = strip("substr(p, strpos(p, '=') + 1)")
    arg_i = strip(f"coalesce({argss}[i], '')")
    kv = (
        f"array_to_string(list_transform(list_slice(list_filter(list_transform(string_split({arg_i}, ','), lambda p: {piece}), "
        f"lambda p: strpos(p, '=') > 0 AND {key} <> ''), 1, 2), "
        f"lambda p: {key} || '=' || {val}), ', ')"
    )
    body = f"array_to_string(list_transform(range(1, len({names}) + 1), lambda i: '<function_' || {names}[i] || '>(' || {kv} || ')'), ';')"
    return f"({body} || '<end>')"
