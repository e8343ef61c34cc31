"""Call repair and its report.

``repair_status`` labels each row already_ok / repaired_success / still_broken from the
format check before and after a repair function (the normaliser by default, or the
schema repair below).  The report is one grouped count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import format_valid, normalise_calls


def repair_status(df: DataFrame, raw_col: str, repair=normalise_calls) -> DataFrame:
    """``repaired`` and ``status`` per row."""
    repaired = df.withColumn("repaired", repair(F.col(raw_col)))
    ok = format_valid(F.col("repaired"))
    same = pystrip("repaired") == pystrip(raw_col)
    status = F.when(ok & same, F.lit("already_ok")).when(ok, F.lit("repaired_success")).otherwise(F.lit("still_broken"))
    return repaired.withColumn("status", status)


def repair_report(statuses: DataFrame) -> DataFrame:
    """E9 counts per status."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------ P17 schema-driven repair (our contract)

from ..functions.args import parse_args, pystrip  # noqa: E402
from ..functions.tags import extract_calls  # noqa: E402

# Bracket look-alikes mapped to ASCII (full-width and CJK angle brackets only).
LOOKALIKES = {"＜": "<", "＞": ">", "〈": "<", "〉": ">", "（": "(", "）": ")", "；": ";"}


def with_repaired_text(df: DataFrame, text_col: str, out: str = "_rep") -> DataFrame:
    """Tag-list repair as staged columns: look-alike brackets, text after the first <end>, blanks around
    ';' and at the ends, a missing '>' after the tag name, a missing ')' before the next call or the end,
    and a final <end>.  ``out`` = STRUCT<text, tags ARRAY<STRING>>.  Calls run together without ';',
    text without '<' before the tag and square brackets are left broken on purpose (their labels say so).

    Each step is its own column so no step is evaluated more than once per row."""
    src, dst = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
    s = df.withColumn("_s0", F.coalesce(F.col(text_col), F.lit("")))
    s = s.withColumn("_s1", F.translate(F.col("_s0"), src, dst))
    s = s.withColumn("_s2", F.when(F.contains(F.col("_s1"), F.lit("<end>")), F.substring_index(F.col("_s1"), "<end>", 1)).otherwise(F.col("_s1")))
    s = s.withColumn("_s3", F.trim(F.regexp_replace(F.col("_s2"), r"\s*;\s*", ";")))
    s = s.withColumn("_s4", F.regexp_replace(F.col("_s3"), r"<function_([A-Za-z0-9_]+)\(", "<function_$1>("))
    s = s.withColumn("_s5", F.regexp_replace(F.regexp_replace(F.col("_s4"), r"\(([^()<>]*);<function_", "($1);<function_"), r"\(([^()<>]*)$", "($1)"))
    text = F.concat(F.regexp_replace(F.col("_s5"), r";$", ""), F.lit("<end>"))
    tags = F.array_compact(
        F.array(
            F.when(F.col("_s1") != F.col("_s0"), F.lit("fullwidth")),
            F.when(F.col("_s2") != F.col("_s1"), F.lit("trim-after-end")),
            F.when(F.col("_s3") != F.col("_s2"), F.lit("whitespace")),
            F.when(F.col("_s4") != F.col("_s3"), F.lit("missing-gt")),
            F.when(F.col("_s5") != F.col("_s4"), F.lit("closeparen-insert")),
        )
    )
    return s.withColumn(out, F.struct(text.alias("text"), tags.alias("tags"))).drop("_s0", "_s1", "_s2", "_s3", "_s4", "_s5")


def _rules_map(arg_rules: dict) -> F.Column:
    """arg -> [(targets, type, enum texts)] as a map literal (a small asset)."""
    entries = []
    for arg, rules in sorted(arg_rules.items()):
        arr = F.array(
            *[
                F.struct(
                    F.array(*[F.lit(str(t)) for t in (r.get("target") or [])]).cast("array<string>").alias("target"),
                    F.lit(str(r.get("type", "string"))).alias("type"),
                    F.array(*[F.lit(str(v)) for v in (r.get("enum") or [])]).cast("array<string>").alias("enum"),
                )
                for r in rules
            ]
        )
        entries += [F.lit(arg), arr]
    return F.create_map(*entries)


def _sig_map(signatures: dict) -> F.Column:
    entries = []
    for func, sigs in sorted(signatures.items()):
        entries += [F.lit(func), F.array(*[F.array(*[F.lit(a) for a in s]).cast("array<string>") for s in sigs]).cast("array<array<string>>")]
    return F.create_map(*entries)


def _cast(canon: F.Column, typ: F.Column) -> F.Column:
    low = F.lower(canon)
    return (
        F.when(typ == "integer", F.when(canon.rlike(r"^-?[0-9]+$"), canon.try_cast("bigint").cast("string")))
        .when(typ == "boolean", F.when(low.isin("true", "1"), F.lit("True")).when(low.isin("false", "0"), F.lit("False")))
        .when(typ.isin("float", "number"), canon.try_cast("double").cast("string"))
        .otherwise(canon)
    )


def schema_repair(df: DataFrame, text_col: str, arg_rules: dict, signatures: dict) -> DataFrame:
    """Text repair, then per call: cast arguments by the rule for (arg, function), drop unknown
    and invalid ones, pick the first signature holding every kept key (else the largest overlap),
    drop extra keys and fill missing signature keys with the first enum value.  All inside the row:
    the schemas are map literals, so there is no join and no shuffle."""
    # the schemas ride along as one broadcast row (asset-sized), so each row looks them up instead
    # of rebuilding the map expressions per call
    maps = df.sparkSession.range(1).select(_rules_map(arg_rules).alias("_rmap"), _sig_map(signatures).alias("_smap"))
    rmap, smap = F.col("_rmap"), F.col("_smap")
    staged = with_repaired_text(df.crossJoin(F.broadcast(maps)), text_col, "_rep")
    staged = staged.withColumn("_calls", extract_calls(F.col("_rep.text")))

    # staged transforms: every stage reads fields of the previous stage, so the argument parse,
    # the rule lookup and the signature choice run once per call (lambdas get no common-
    # subexpression elimination)
    def rule_for(key, fn):
        return F.get(F.filter(F.coalesce(F.try_element_at(rmap, key), F.array()), lambda r: (F.size(r["target"]) == 0) | F.array_contains(r["target"], fn)), 0)

    s1 = F.transform(
        F.col("_calls"),
        lambda c: F.struct(F.concat(F.lit("function_"), c["func"]).alias("fn"), parse_args(c["raw_args"], "lenient").alias("args")),
    )
    s2 = F.transform(
        s1,
        lambda c: F.struct(
            c["fn"].alias("fn"),
            F.transform(c["args"], lambda a: F.struct(a["key"].alias("key"), rule_for(a["key"], c["fn"]).alias("rule"), a["canon"].alias("canon"))).alias("checked"),
        ),
    )
    s3 = F.transform(
        s2,
        lambda c: F.struct(
            c["fn"].alias("fn"),
            F.filter(
                F.transform(c["checked"], lambda x: F.struct(x["key"].alias("key"), x["rule"].alias("rule"), _cast(x["canon"], x["rule"]["type"]).alias("val"))),
                lambda x: x["rule"].isNotNull() & x["val"].isNotNull() & ((F.size(x["rule"]["enum"]) == 0) | F.array_contains(x["rule"]["enum"], x["val"])),
            ).alias("kept"),
        ),
    )
    s4 = F.transform(
        s3,
        lambda c: F.struct(
            c["fn"].alias("fn"),
            c["kept"].alias("kept"),
            F.transform(c["kept"], lambda x: x["key"]).alias("keys"),
            F.coalesce(F.try_element_at(smap, c["fn"]), F.array().cast("array<array<string>>")).alias("sigs"),
        ),
    )

    def choose(c):
        keys, sigs = c["keys"], c["sigs"]
        full = F.get(F.filter(sigs, lambda s: F.forall(keys, lambda k: F.array_contains(s, k))), 0)
        best = F.aggregate(
            sigs,
            F.struct(F.lit(-1).alias("n"), F.array().cast("array<string>").alias("s")),
            lambda acc, s: F.when(F.size(F.array_intersect(s, keys)) > acc["n"], F.struct(F.size(F.array_intersect(s, keys)).alias("n"), s.alias("s"))).otherwise(acc),
        )["s"]
        chosen = F.when(F.size(sigs) == 0, keys).otherwise(F.coalesce(full, best))
        return F.struct(c["fn"].alias("fn"), c["kept"].alias("kept"), chosen.alias("chosen"))

    s5 = F.transform(s4, choose)

    def render(c):
        fn, kept = c["fn"], c["kept"]
        final = F.transform(
            c["chosen"],
            lambda k: F.coalesce(
                F.get(F.transform(F.filter(kept, lambda x: x["key"] == k), lambda x: F.concat(k, F.lit("="), x["val"])), 0),
                F.concat(k, F.lit("="), F.get(rule_for(k, fn)["enum"], 0)),
            ),
        )
        return F.concat(F.lit("<"), fn, F.lit(">("), F.array_join(F.filter(final, lambda t: t.isNotNull()), ", "), F.lit(")"))

    rebuilt = F.concat(F.array_join(F.transform(s5, render), ";"), F.lit("<end>"))
    # arguments are only rebuilt once the text stage gives a well-formed call list: rebuilding a
    # broken list would silently drop or join calls the labels expect to stay broken
    rebuild = format_valid(F.col("_rep.text")) & (F.size("_calls") > 0)
    staged = staged.withColumn("_rebuild", rebuild)
    out = staged.withColumn("repaired", F.when(F.col("_rebuild"), rebuilt).otherwise(F.col("_rep.text")))
    out = out.withColumn("tags", F.when(F.col("_rebuild"), F.array_union(F.col("_rep.tags"), F.array(F.lit("rebuild-calls")))).otherwise(F.col("_rep.tags")))
    ok = format_valid(F.col("repaired"))
    same = pystrip("repaired") == pystrip(text_col)
    status = F.when(ok & same, F.lit("already_ok")).when(ok, F.lit("repaired_success")).otherwise(F.lit("still_broken"))
    return out.withColumn("status", status).drop("_rep", "_calls", "_rebuild", "_rmap", "_smap")
