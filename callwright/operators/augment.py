"""Augmentation and template expansion.

Rule-composed augmentation is a fold over the (small, driver-side) rule list inside
each row: ``aggregate(rules, [v], (acc, r) -> flatten(transform(acc, v -> [v] ++ variants(v, r))))``.
The fan-out of a row is the product of (1 + |sr|) over its applicable rules: ``max_expansions``
caps the working list after every rule exactly as the reference does (off by default).
``augment`` folds as many rules inside a row as a bound on that product allows, so a short rule
list needs no shuffle; a longer one is exploded between groups of rules, then cleared of repeats
and numbered by key, and no row ever holds the whole product.

Template expansion counts the product of each format's slot values and deals ranges of product numbers
over the tasks.  A number is unranked in mixed radix to its slots' value positions, and its place in the
whole expansion follows by arithmetic.  A range fetches just the blocks of values that its numbers use.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import global_index, rank_in_group

# Delexicalisation patterns (value after location= / position=) and placeholders.
LOC_RE = r"location\s*=\s*(['\"])?([^'\"\s,);\]}]+)"
POS_RE = r"position\s*=\s*(['\"])?([^'\"\s,);\]}]+)"


def _rules_literal(rules) -> Column:
    """Rule list (seq, ori, sr) as an array literal; rules are a small asset read on the driver.  ``later``: a rule
    before it may write one of its tokens, so a text without the tokens does not rule it out."""
    ordered = sorted(rules)
    return F.array(
        *[
            F.struct(
                F.array(*[F.lit(o) for o in ori if o]).cast("array<string>").alias("ori"),
                F.array(*[F.lit(s) for s in sr]).cast("array<string>").alias("sr"),
                F.lit(any(_may_write(new, token) for _, _, earlier in ordered[:i] for new in earlier for token in ori if token)).alias("later"),
            )
            for i, (_, ori, sr) in enumerate(ordered)
        ]
    )


def _may_write(new: str, token: str) -> bool:
    """Whether a text may come to hold ``token`` by having ``new`` put into it: the token then lies over some of the
    new signs, so one holds the other or an end of one is the start of the other."""
    ends = any(new.endswith(token[:n]) or new.startswith(token[-n:]) for n in range(1, min(len(new), len(token)) + 1))
    return not new or new in token or token in new or ends


def apply_rule(text: Column, ori: Column, rep: Column) -> Column:
    """Replace every token of ``ori`` (in list order, cascading) by ``rep``."""
    return F.aggregate(ori, text, lambda t, o: F.replace(t, o, rep))


def expand_variants(df: DataFrame, target_cols, rules, keep_original: bool = True, max_expansions: int | None = None, distinct: bool = True) -> DataFrame:
    """``variants`` = ARRAY<STRUCT<target cols>> per row, first-occurrence order, de-duplicated
    unless ``distinct`` is off."""
    targets = list(target_cols)
    # one look at the row's own texts leaves the few rules that can matter; only they are folded over the variants
    texts = F.array(*[F.col(c).cast("string") for c in targets])
    r = F.filter(_rules_literal(rules), lambda rule: rule["later"] | F.exists(rule["ori"], lambda tok: F.exists(texts, lambda s: F.contains(s, tok))))
    start = F.array(F.struct(*[F.col(c).cast("string").alias(c) for c in targets]))
    empty_type = "array<struct<" + ",".join(f"{c}:string" for c in targets) + ">>"

    def step(acc, rule):
        def grow(v):
            applicable = F.exists(rule["ori"], lambda tok: F.exists(F.array(*[v[c] for c in targets]), lambda s: F.contains(s, tok)))
            new = F.transform(rule["sr"], lambda rep: F.struct(*[apply_rule(v[c], rule["ori"], rep).alias(c) for c in targets]))
            return F.concat(F.array(v), F.when(applicable, new).otherwise(F.array().cast(empty_type)))

        nxt = F.flatten(F.transform(acc["vs"], grow))
        if not max_expansions:
            return F.struct(nxt.alias("vs"), acc["capped"].alias("capped"))
        return F.struct(F.slice(nxt, 1, max_expansions).alias("vs"), (acc["capped"] | (F.size(nxt) > max_expansions)).alias("capped"))

    state = F.aggregate(r, F.struct(start.alias("vs"), F.lit(False).alias("capped")), step)
    staged = df.withColumn("_state", state)
    working = F.col("_state.vs")
    kept = working if keep_original else F.slice(working, 2, F.greatest(F.size(working) - 1, F.lit(0)))
    # ``capped`` marks rows whose working list was cut by max_expansions after some rule
    return staged.withColumn("variants", F.array_distinct(kept) if distinct else kept).withColumn("capped", F.col("_state.capped")).drop("_state")


def capped_report(expanded: DataFrame) -> DataFrame:
    """How many rows hit the expansion cap."""
    return expanded.agg(F.count(F.lit(1)).alias("rows"), F.count_if("capped").alias("capped_rows"))


def explode_variants(df: DataFrame, id_col: str, use_suffix: bool = True) -> DataFrame:
    """One row per variant; variant 0 keeps the id, variant i>0 becomes ``<id>-R<i>``."""
    # posexplode_outer + null filter: avoids the inferred size(variants) > 0 filter that would run the fold twice
    ex = df.select("*", F.posexplode_outer("variants").alias("variant_idx", "_v")).filter(F.col("_v").isNotNull()).drop("variants")
    fields = [f.name for f in df.schema["variants"].dataType.elementType.fields]
    return ex.select(*[c for c in ex.columns if c not in fields + ["_v"]], *[F.col("_v")[c].alias(c) for c in fields]).withColumn("index_label", _label(id_col, use_suffix))


def _label(id_col: str, use_suffix: bool) -> Column:
    label = F.col(id_col).cast("string")
    if not use_suffix:
        return label
    return F.when(F.col("variant_idx") == 0, label).otherwise(F.concat(label, F.lit("-R"), F.col("variant_idx").cast("string")))


MAX_IN_ROW = 4096


def rule_groups(rules, max_in_row: int = MAX_IN_ROW) -> list[list]:
    """Consecutive rules whose product of (1 + |sr|) stays within the bound (at least one rule each)."""
    groups, product = [], max_in_row + 1
    for rule in sorted(rules):
        fan_out = 1 + len(rule[2])
        if product * fan_out > max_in_row:
            groups.append([])
            product = 1
        groups[-1].append(rule)
        product *= fan_out
    return groups or [[]]


def augment(df: DataFrame, id_col: str, target_cols, rules, keep_original: bool = True, use_suffix: bool = True, max_in_row: int = MAX_IN_ROW) -> DataFrame:
    """G1 + P31 without a cap: one row per different variant, numbered in the order of the rule choices.

    ``id_col`` must tell the rows of ``df`` apart.  Between groups of rules the variants are exploded
    with the path of their positions, which orders them as the choices do."""
    groups, targets = rule_groups(rules, max_in_row), list(target_cols)
    if len(groups) == 1:
        return explode_variants(expand_variants(df, targets, groups[0], keep_original), id_col, use_suffix).drop("capped")
    rest = [c for c in df.columns if c not in targets]
    cur = df.withColumn("_path", F.array().cast("array<int>"))
    for group in groups:
        # a rule may give back the original text: while only the untouched original is to go, such variants keep their own path
        cur = explode_variants(expand_variants(cur, targets, group, distinct=keep_original), id_col, False).withColumn("_path", F.concat("_path", F.array("variant_idx")))
        cur = cur.select(*rest, *targets, "_path")
    if not keep_original:
        cur = cur.filter(F.exists("_path", lambda p: p > 0))
    firsts = cur.groupBy(id_col, *targets).agg(F.min("_path").alias("_path"))
    # rows of one source row that agree in all but the last choice share a bucket
    ranked = rank_in_group(firsts, [id_col], ["_path"], "_rank", [F.get("_path", F.lit(i)) for i in range(len(groups) - 1)]).withColumn("variant_idx", (F.col("_rank") - 1).cast("int")).drop("_rank", "_path")
    back = ranked.join(df.select(*rest), id_col)
    return back.select(*rest, *targets, "variant_idx", _label(id_col, use_suffix).alias("index_label"))


def expansion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows out."""
    return before.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(after.agg(F.count(F.lit(1)).alias("rows_out")))


def delexicalise(df: DataFrame, query_col: str, output_col: str, key: str = "location", placeholder: str = "<loc>") -> DataFrame:
    """The value after ``key=`` in the output, when it also occurs in the query, becomes the
    placeholder in both columns."""
    pat = LOC_RE if key == "location" else POS_RE if key == "position" else rf"{key}\s*=\s*(['\"])?([^'\"\s,);\]}}]+)"
    val = F.when(F.col(output_col).rlike(pat), F.regexp_extract(F.col(output_col), pat, 2))
    staged = df.withColumn("_val", val)
    hit = F.col("_val").isNotNull() & (F.col("_val") != "") & F.contains(F.col(query_col), F.coalesce(F.col("_val"), F.lit("")))
    staged = staged.withColumn("_hit", hit)
    return (
        staged.withColumn(query_col, F.when(F.col("_hit"), F.replace(F.col(query_col), F.col("_val"), F.lit(placeholder))).otherwise(F.col(query_col)))
        .withColumn(output_col, F.when(F.col("_hit"), F.replace(F.col(output_col), F.col("_val"), F.lit(placeholder))).otherwise(F.col(output_col)))
        .drop("_val", "_hit")
    )


def drop_placeholders(df: DataFrame, cols, placeholder: str = "<loc>") -> DataFrame:
    """P20: rows whose target columns hold the placeholder are removed."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.contains(F.col(c), F.lit(placeholder)), F.lit(False))
    return df.filter(~cond)


# ------------------------------------------------------------------ slot templates


def merge_tags(tags: DataFrame) -> DataFrame:
    """``(block, slot, value, prio, pos)`` -> values per (block, slot) in priority order, first kept,
    ranked by the bucketed rank (``vpos`` from 1)."""
    firsts = tags.groupBy("block", "slot", "value").agg(F.min(F.struct("prio", "pos")).alias("_o"))
    flat = firsts.select("block", "slot", "value", F.col("_o.prio").alias("prio"), F.col("_o.pos").alias("pos"))
    digits = [F.struct("prio", F.shiftright(F.col("pos").cast("bigint"), 20))]
    return rank_in_group(flat, ["block", "slot"], ["prio", "pos", "value"], "vpos", digits).select("block", "slot", "value", "vpos")


#: Product numbers of one range, and slot values of one block (SQL literals of the plan's arithmetic).
RANGE_PRODUCTS = 1 << 13
BLOCK_VALUES = 1 << 12


def expand_templates(formats: DataFrame, merged_tags: DataFrame, range_products: int = RANGE_PRODUCTS, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Every format ``(block, fname, fmt_pos, fmt)`` filled with the cartesian product of its slot
    values, joined by one space; formats with a slot lacking values produce nothing.

    Returns ``(block, fname, fmt_pos, query, order, seq)``: ``order`` is the value positions, ``seq`` the
    place in the order of (block, format, values).  ``(block, fmt_pos)`` tells the formats apart.

    * ``radix``: number of values of each slot; ``weight``: product of the radices behind it;
    * a range of at most ``range_products`` numbers uses for each slot the values from its first quotient to its
      last one, so about two values for each number, fetched in blocks of ``block_values``.
    """
    f = formats.select("block", "fname", "fmt_pos", F.regexp_extract_all(F.col("fmt"), F.lit(r"<[^>]+>"), 0).alias("slots"))
    key = ["block", "fname", "fmt_pos"]
    counted = merged_tags.groupBy("block", "slot").agg(F.count(F.lit(1)).alias("radix"))
    slots = f.select(*key, F.posexplode("slots").alias("i", "slot")).join(counted, ["block", "slot"], "left")
    per_format = slots.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "slot", F.coalesce("radix", F.lit(0)).alias("radix")))).alias("s"))
    behind = F.expr("transform(s, x -> aggregate(slice(s, x.i + 2, size(s)), 1L, (p, y) -> p * y.radix))")
    sized = per_format.withColumn("w", behind).withColumn("products", F.expr("get(w, 0) * get(s, 0).radix")).where("products > 0")
    before = Window.partitionBy(F.lit(0)).orderBy("block", "fmt_pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("start", F.coalesce(F.sum("products").over(before), F.lit(0)))
    ranges = sized.withColumn("lo", F.explode(F.expr(f"sequence(0L, products - 1, {range_products}L)"))).withColumn("hi", F.least(F.col("lo") + range_products, "products") - 1)

    # the blocks of values that a range needs of each slot: from its first to its last quotient, around the radix
    used = ranges.select(*key, "lo", "hi", F.inline(F.arrays_zip(F.col("s"), F.col("w")))).select(*key, "lo", "hi", "s.i", "s.slot", "s.radix", "w")
    used = used.withColumns({"q0": F.expr("lo div w"), "q1": F.expr("hi div w")}).withColumns({"a": F.expr("q0 % radix"), "b": F.expr("q1 % radix")})
    part = F.expr(
        f"case when q1 - q0 + 1 >= radix then sequence(0L, (radix - 1) div {block_values}) when a <= b then sequence(a div {block_values}, b div {block_values})"
        f" else array_union(sequence(0L, b div {block_values}), sequence(a div {block_values}, (radix - 1) div {block_values})) end"
    )
    wanted = used.select(*key, "lo", "i", "slot", F.explode(part).alias("part"))
    number = F.col("vpos").cast("bigint") - 1
    values = merged_tags.groupBy("block", "slot", F.floor(number / block_values).alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("vpos", "value"))), lambda x: x["value"]).alias("values")
    )
    entry = F.struct(F.struct(F.col("i"), F.col("part")).alias("k"), F.col("values").alias("v"))
    held = wanted.join(values, ["block", "slot", "part"]).groupBy(*key, "lo").agg(F.map_from_entries(F.collect_list(entry)).alias("held"))

    # the texts of a range are made inside its row, so the values are not copied to each product
    places = "transform(sequence(lo, hi), k -> transform(s, (x, j) -> (k div get(w, j)) % x.radix))"
    text = f"array_join(transform(at, (p, j) -> get(element_at(held, named_struct('i', j, 'part', p div {block_values})), cast(p % {block_values} as int))), ' ')"
    made = F.expr(f"transform({places}, (at, n) -> named_struct('query', {text}, 'order', transform(at, p -> cast(p + 1 as int)), 'seq', start + lo + n))")
    dealt = ranges.join(held, [*key, "lo"]).repartition(*key, "lo")
    return dealt.withColumn("made", made).select(*key, F.inline("made"))


def number_queries(expanded: DataFrame) -> DataFrame:
    """O4 + W3: drop repeated (query, fname) keeping the first in (block, format, values) order, then
    number the rest 1..n in that order.  ``seq`` is that order already, so only the gaps are counted."""
    firsts = expanded.groupBy("query", "fname").agg(F.min("seq").alias("_seq"))
    indexed = global_index(firsts, ["_seq"], "_i", [F.shiftright("_seq", 20)])
    return indexed.select((F.col("_i") + 1).alias("index"), "query", F.col("fname").alias("function"))


def slot_type(slot) -> Column:
    """The slot's type letter (``<s1>`` -> s, ``s_g_bp_1`` -> s); same-type grouping does not change
    the text because only one space is ever used between slots."""
    s = F.col(slot) if isinstance(slot, str) else slot
    a = F.regexp_extract(s, r"^<([a-zA-Z]+)", 1)
    b = F.regexp_extract(s, r"^([a-zA-Z])_", 1)
    return F.lower(F.when(a != "", F.substr(a, F.lit(1), F.lit(1))).when(b != "", b).otherwise(F.lit("")))


def blocks_from_named_datas(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The alternative template shape ``{name, datas: ["<a> <b>"], tags: [{tag_name, word: [..]}]}``
    -> (formats, tags) in the shape ``expand_templates`` / ``merge_tags`` take.  A column ``block`` gives the
    order of the blocks; without one they are told apart by a hash of their content, which is the same in
    both results however often the source is read (two equal blocks are one)."""
    blocks = df if "block" in df.columns else df.withColumn("block", F.xxhash64("name", F.to_json("datas"), F.to_json("tags")))
    formats = blocks.select("block", F.col("name").alias("fname"), F.posexplode("datas").alias("fmt_pos", "fmt")).withColumn("fmt_pos", F.col("fmt_pos") + 1)
    tags = (
        blocks.select("block", F.explode("tags").alias("t"))
        .select("block", F.concat(F.lit("<"), F.col("t.tag_name"), F.lit(">")).alias("slot"), F.posexplode("t.word").alias("pos", "value"))
        .withColumn("prio", F.lit(0))
    )
    return formats, tags
