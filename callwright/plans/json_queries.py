"""Queries over JSON text that is kept as it was written (P1, P25, E1; D4, D5): documents in six shapes, one for
each row of the tagged corpus, whose written-anew forms the oracles spell out."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import json_dumps, strict_json
from ..operators import chat as chat_op
from ..operators import evaluate as eval_op
from . import fixtures as fx
from . import oracle_sql as o
from .catalog import register

# Text, source order, sorted keys, flat form of each shape ({n} is the row number).
SHAPES = [
    ('{{"b": 1.0, "a": [1, 1.0, "x"],\n "id": {n}}}', '{{"b":1.0,"a":[1,1.0,"x"],"id":{n}}}', '{{"a":[1,1.0,"x"],"b":1.0,"id":{n}}}', None),
    ('{{"b":1,"a":2,"b":1.50,"id":{n}}}', '{{"b":1.5,"a":2,"id":{n}}}', '{{"a":2,"b":1.5,"id":{n}}}', None),
    (' {{"z": {{"y": 1, "x": {{"k": "\\u00e9\\/"}}}}, "id": {n}}} ', '{{"z":{{"y":1,"x":{{"k":"é/"}}}},"id":{n}}}', '{{"id":{n},"z":{{"x":{{"k":"é/"}},"y":1}}}}', None),
    ('[-0, 1e2, {{"n": {n}, "a": []}}]', '[0,100.0,{{"n":{n},"a":[]}}]', '[0,100.0,{{"a":[],"n":{n}}}]', '0100.0{{"n":{n},"a":[]}}'),
    ('{{"a": 1, "id": {n},}}', None, None, '{{"a": 1, "id": {n},}}'),
    ('{{"q": "one\\ntwo \\"q\\" \\\\", "id": {n}}}', '{{"q":"one\\ntwo \\"q\\" \\\\","id":{n}}}', '{{"id":{n},"q":"one\\ntwo \\"q\\" \\\\"}}', None),
]


def _sql(template: str | None) -> str:
    if template is None:
        return "NULL"
    head, tail = (part.format().replace("'", "''").replace("\n", "' || chr(10) || '") for part in template.split("{n}"))
    return f"'{head}' || row_id || '{tail}'"


def _cases(at: int) -> str:
    return "CASE row_id % 6 " + " ".join(f"WHEN {i} THEN {_sql(s[at] if at < 3 or s[at] else s[1])}" for i, s in enumerate(SHAPES)) + " END"


def _documents(spark, sf_dir):
    row, text = F.col("row_id"), F.lit(None).cast("string")
    for i, (template, *_) in enumerate(SHAPES):
        head, tail = (part.format() for part in template.split("{n}"))
        text = F.when(row % 6 == i, F.concat(F.lit(head), row.cast("string"), F.lit(tail))).otherwise(text)
    return fx.tagged(spark, sf_dir).select("row_id", text.alias("doc"))


@register(
    "json_as_written",
    o.with_(o.TAGGED) + f"SELECT row_id, {_cases(1)} AS written, {_cases(2)} AS sorted, {_cases(3)} AS target FROM tagged",
)
def q_json_as_written(spark, sf_dir):
    """P1 and P25 with the source's key order, numbers and repeated keys."""
    docs = _documents(spark, sf_dir)
    return docs.select("row_id", json_dumps("doc").alias("written"), json_dumps("doc", sort_keys=True).alias("sorted"), chat_op.training_target(F.col("doc"), as_written=True).alias("target"))


@register(
    "eval_exact_as_written",
    o.with_(o.TAGGED)
    + """SELECT row_id, row_id % 6 IN (0, 5) AS exact, row_id % 6 IN (0, 3) AS exact_as_written FROM tagged""",
)
def q_eval_exact_as_written(spark, sf_dir):
    """E1 two ways: equal apart from key order (0), a repeated key (1, 3: a value that the last one overrides), other
    values (2), no JSON (4), 1 against 1.0 (5)."""
    pairs = [
        ('{{"a": 1, "b": [1.0], "id": {n}}}', '{{"b":[1.0],"id":{n},"a":1}}'),
        ('{{"a": 1, "a": 2, "id": {n}}}', '{{"a":1,"id":{n}}}'),
        ('{{"a": 1, "id": {n}}}', '{{"a":"1","id":{n}}}'),
        ('{{"a": 1, "a": 2, "id": {n}}}', '{{"a":2,"id":{n}}}'),
        ('{{"a": 1, "id": {n}', '{{"a":1,"id":{n}'),
        ('{{"a": 1, "id": {n}}}', '{{"a":1.0,"id":{n}}}'),
    ]
    row = F.col("row_id")
    sides = []
    for side in (0, 1):
        text = F.lit(None).cast("string")
        for i, pair in enumerate(pairs):
            # a document cut short has no closing brace to format
            head, tail = pair[side].replace("{{", "{").replace("}}", "}").split("{n}")
            text = F.when(row % 6 == i, F.concat(F.lit(head), row.cast("string"), F.lit(tail))).otherwise(text)
        sides.append(text)
    df = fx.tagged(spark, sf_dir).select("row_id", sides[0].alias("pred_text"), sides[1].alias("gold"))
    exact = F.coalesce(F.to_json(strict_json("pred_text")) == F.to_json(strict_json("gold")), F.lit(False))
    return df.select("row_id", exact.alias("exact"), eval_op.exact_as_written("pred_text", "gold").alias("exact_as_written"))
