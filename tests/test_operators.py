"""Operator properties: exact indexes, split counts, pairing, augmentation, readers, streaming."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from callwright.operators import augment as aug
from callwright.operators import chat as chat_op
from callwright.operators import pairing as pair_op
from callwright.operators.index import global_index, md5_digits, positions, rank_in_group, text_digits
from callwright.operators.select import first_of_groups, first_rows
from callwright.plans import fixtures as fx

from .conftest import SF_MID, SF_SMALL


def test_global_index_is_exact_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(7)
    a = global_index(df, ["k", "id"], "i", md5_digits("k")).select("id", "i")
    b = global_index(df.repartition(3), ["k", "id"], "i", text_digits("k")).select("id", "i")
    c = global_index(df, ["k", "id"], "i").select("id", "i")
    rows_a = sorted(a.collect())
    assert [r["i"] for r in sorted(rows_a, key=lambda r: r["i"])] == list(range(5000))
    assert rows_a == sorted(b.collect()) == sorted(c.collect())
    expected = {r["id"]: i for i, r in enumerate(df.orderBy("k", "id").collect())}
    assert all(expected[r["id"]] == r["i"] for r in rows_a)


def test_rank_in_group_handles_a_hot_group(spark):
    df = spark.range(0, 3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")))
    r = rank_in_group(df, ["g"], ["id"], "r")
    hot = [row["r"] for row in r.filter("g = 'hot'").orderBy("id").collect()]
    assert hot == list(range(1, 1001))


def test_positions_with_nulls_signs_and_sparse_keys(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate((g, v) for g in ("a", None, "hot") for v in (None, -5, -(2**50), 2**62, 0, 7, 2**20, 2**40 + 3))]
    rows += [("hot", 2**33 * k, 1000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v bigint, id int").repartition(4)
    got = {r.id: r.p for r in positions(df, ["v", "id"], "p", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(of)}
    assert got == want
    least = rank_in_group(df, ["g"], ["id"], "r", group_min={"first_v": "v"}).select("g", "first_v").distinct().collect()
    assert {(r.g, r.first_v) for r in least} == {(g, -(2**50)) for g in ("a", None, "hot")}
    assert positions(df.where("false"), ["v", "id"], "p", ["g"]).count() == 0


def test_building_a_position_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run here")
    try:
        df = spark.range(0, 1000).withColumn("k", F.md5(F.col("id").cast("string")))
        out = chat_op.split_exact(rank_in_group(df, ["k"], ["id"], "r"), F.col("k"), order_cols=["id"])
        half = pair_op.half_sample(df.selectExpr("id index", "'<function_AB>()' function"))
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 1000 and half.where("in_pool").count() == 500


def test_selection_equals_a_sort(spark):
    df = spark.range(0, 6000).selectExpr("id", "md5(cast(id as string)) k", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('g', id % 40) end g", "cast(id * 7919 % 6007 as bigint) - 3000 v", "concat('shared/prefix/', id % 50) t").repartition(5)
    got = {(r.id, r.chosen) for r in first_of_groups(df, ["g"], "k", "id", lambda n: F.floor(n / 2), "chosen").collect()}
    df.createOrReplaceTempView("selection_input")
    want = spark.sql("select id, row_number() over (partition by g order by k, id) <= floor(count(*) over (partition by g) / 2) c from selection_input").collect()
    assert got == {(r.id, r.c) for r in want}
    for order in (["v"], ["t", "v"], ["t", "k"], ["g", "id"]):
        ordered = [r.id for r in df.orderBy(*order).select("id").collect()]
        for n in (1, 37, 2500, 5999, 6000, 7000):
            assert sorted(r.id for r in first_rows(df, order, n, sort_rows=20).collect()) == sorted(ordered[:n]), (order, n)
    same = spark.range(0, 50).selectExpr("'x' t", "cast(null as bigint) v")
    assert first_rows(same, ["t", "v"], 20, sort_rows=1).count() == 20 and first_rows(same.where("false"), ["t"], 5, 1).count() == 0


def test_split_exact_counts(spark):
    assert chat_op.parse_split("80,10,10") == [0.8, 0.1, 0.1]
    assert chat_op.cut_points(60, chat_op.parse_split("80,10,10")) == (48, 54)
    df = spark.range(0, 233).withColumn("key", F.col("id").cast("string"))
    out = chat_op.split_exact(df, F.col("key"), "80,10,10", 42, True, ["id"])
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 186, "eval": 23, "test": 24}
    two = chat_op.split_exact(df, F.col("key"), "0.9,0.1", 7, False, ["id"])
    assert {r["split"]: r["count"] for r in two.groupBy("split").count().collect()} == {"train": 209, "eval": 24}


@pytest.mark.parametrize("ranked", [False, True])
def test_pairing_properties(spark, ranked):
    t = fx.tagged(spark, SF_MID).select("row_id", "query", F.col("llm_output").alias("function"))
    sampled = pair_op.half_sample(t, "row_id", ranked=ranked)
    paired, left = pair_op.pair_pool(sampled, "row_id")
    pool = sampled.filter("in_pool")
    sizes = [r["count"] for r in pool.groupBy("func_name").count().collect()]
    n, m = sum(sizes), max(sizes)
    assert paired.count() == min(n // 2, n - m)
    assert paired.filter(F.col("a_func_name") == F.col("b_func_name")).count() == 0
    assert paired.count() * 2 + left.count() == n
    singles = pair_op.singles(sampled, left, paired.count(), "row_id")
    assert singles.count() + 2 * paired.count() == t.filter(F.col("function").rlike("<\\s*[^>\\s]+\\s*>")).count()
    assert singles.filter(~F.col("function").endswith("<end>")).count() == 0


def test_augmentation_cap_and_drop_original(spark):
    rules = [(1, ["a"], ["b", "c"]), (2, ["x"], ["y", "z"])]
    df = spark.createDataFrame([(1, "a x", "a")], "id int, q string, o string")
    full = aug.expand_variants(df, ["q", "o"], rules).first()["variants"]
    assert [v["q"] for v in full] == ["a x", "a y", "a z", "b x", "b y", "b z", "c x", "c y", "c z"]
    capped_row = aug.expand_variants(df, ["q", "o"], rules, max_expansions=4).first()
    assert len(capped_row["variants"]) <= 4 and capped_row["capped"] is True
    assert aug.expand_variants(df, ["q", "o"], rules).first()["capped"] is False
    dropped = aug.expand_variants(df, ["q", "o"], rules, keep_original=False).first()["variants"]
    assert [v["q"] for v in dropped] == [v["q"] for v in full][1:]


def test_augmentation_of_long_rule_lists(spark):
    rules = [(k, [w], [w, w.upper(), f"{w}{w}"]) for k, w in enumerate("abcde", start=1)]
    df = spark.createDataFrame([(1, "a b c", "a"), (2, "d", ""), (3, "", "x"), (4, None, "e")], "id int, q string, o string")
    for keep in (True, False):
        row = lambda r: (r["id"], r["variant_idx"], r["index_label"], r["q"], r["o"])
        in_row = sorted(map(row, aug.augment(df, "id", ["q", "o"], rules, keep).collect()), key=str)
        staged = sorted(map(row, aug.augment(df, "id", ["q", "o"], rules, keep, max_in_row=8).collect()), key=str)
        assert in_row == staged and len(in_row) > 30
    long = [(k, [f"w{k}"], [f"x{k}"]) for k in range(200)]
    assert len(aug.rule_groups(long)) == 17 and sum(aug.rule_groups(long), []) == long
    assert [r["q"] for r in aug.augment(spark.createDataFrame([(1, "w3 w150")], "id int, q string"), "id", ["q"], long).orderBy("variant_idx").collect()] == [
        "w3 w150", "w3 x150", "x3 w150", "x3 x150"
    ]


def test_pairing_report_counts_the_pairs(spark):
    for sizes in ([7, 2, 1], [4, 4, 4], [1], [9]):
        rows = [(i, "q", f"<function_{chr(65 + g)}>()") for g, n in enumerate(sizes) for i in range(100 * g, 100 * g + n)]
        df = spark.createDataFrame(rows, "index int, query string, function string")
        paired, _ = pair_op.pair_pool(pair_op.half_sample(df))
        assert {r["kind"]: r["count"] for r in pair_op.pairing_report(df).collect()} == {"pairs": paired.count(), "singles": len(rows) - 2 * paired.count()}


def test_labelled_readers_round_trip(spark):
    chat = fx.chat_labelled(spark, SF_SMALL).filter(F.col("conv_id") % 5 != 0).orderBy("conv_id", "turn").collect()
    root = tempfile.mkdtemp(prefix="cw-read-")
    os.makedirs(f"{root}/json")
    os.makedirs(f"{root}/csv")
    half = len(chat) // 2
    with open(f"{root}/json/a.json", "w", encoding="utf-8") as f:
        json.dump([{"user": r["user_text"], "assistant": r["assistant"]} for r in chat[:half]], f, ensure_ascii=False)
    import csv

    with open(f"{root}/csv/b.csv", "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(["input", "output_json"])
        for r in chat[half:]:
            w.writerow([r["user_text"], r["assistant"]])
        w.writerow(["", "{}"])
    from callwright.sources.readers import read_labelled

    df = read_labelled(spark, root).orderBy("src_kind", "src_file", "src_pos")
    rows = df.collect()
    assert len(rows) == len(chat)
    assert all(r["error"] is None for r in rows)
    assert [r["user"] for r in rows] == [r["user_text"].strip() for r in chat]


def test_streaming_matches_batch(spark):
    from callwright.operators import rules as rules_op
    from callwright.streaming.stateless import convert_stream, read_tagged_stream, start_file_sink

    src = tempfile.mkdtemp(prefix="cw-stream-src-")
    out = tempfile.mkdtemp(prefix="cw-stream-out-")
    tagged = fx.tagged(spark, SF_SMALL)
    tagged.write.mode("overwrite").json(f"{src}/in")
    rules = rules_op.rules_from_conditions(fx.rule_conditions(spark))
    q = start_file_sink(convert_stream(read_tagged_stream(spark, f"{src}/in"), rules), f"{out}/res", "convert_test")
    q.awaitTermination(120)
    streamed = spark.read.parquet(f"{out}/res")
    from callwright.plans.catalog import q_rule_convert

    batch = q_rule_convert(spark, SF_SMALL)
    cols = ["row_id", "pos", "func", "map_func", "map_enum", "map_args"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_calls_with_original_row(spark):
    from callwright.operators.profile import calls_with_original

    t = fx.tagged(spark, SF_SMALL)
    out = calls_with_original(t)
    row = out.filter(F.col("func") == "IO").first()
    assert row["original"]["row_id"] == row["row_id"] and "<function_IO>" in row["original"]["llm_output"]
    assert out.count() == t.selectExpr("size(filter(split(llm_output, ';'), p -> p rlike '<function_[A-Z]{2}>\\\\(')) AS n").agg(F.sum("n")).first()[0]


def test_streaming_checks_with_python_path(spark):
    from callwright.functions.normalise import format_valid, normalise_calls
    from callwright.streaming.stateless import check_stream, read_tagged_stream, start_file_sink

    src = tempfile.mkdtemp(prefix="cw-stream2-src-")
    out = tempfile.mkdtemp(prefix="cw-stream2-out-")
    rows = [(1, "q", "<function_A>(x=f(1), y=2)"), (2, "q", "<fuction_B>(k=v)<end>"), (3, "q", "none")]
    spark.createDataFrame(rows, "row_id bigint, query string, llm_output string").write.mode("overwrite").json(f"{src}/in")
    q = start_file_sink(check_stream(read_tagged_stream(spark, f"{src}/in")), f"{out}/res", "check_test")
    q.awaitTermination(120)
    got = {r["row_id"]: (r["normalised"], r["valid"]) for r in spark.read.parquet(f"{out}/res").collect()}
    assert got == {1: ("<function_A>(x=f(1), y=2)<end>", False), 2: ("<function_B>(k=v)<end>", False), 3: ("<end>", False)}


def test_repair_results_sink(spark):
    from callwright.operators.repair import repair_status
    from callwright.sources.sinks import write_repair_results

    d = tempfile.mkdtemp(prefix="cw-rep-")
    st = repair_status(fx.tagged(spark, SF_SMALL), "llm_output")
    counts = {r["status"]: r["count"] for r in write_repair_results(st, f"{d}/out").collect()}
    back = spark.read.json(f"{d}/out")
    assert back.count() == sum(counts.values())
    assert {r["outcome"] for r in back.select("outcome").distinct().collect()} <= {"success", "failure"}


def test_index_does_not_depend_on_the_cache(spark):
    df = spark.range(0, 60_000).selectExpr("id", "md5(cast(id as string)) k").persist()
    out = global_index(df, ["k", "id"], "i")
    assert df.is_cached
    spark.catalog.clearCache()
    assert out.selectExpr("count(distinct i)", "min(i)", "max(i)").first()[:] == (60_000, 0, 59_999)
    df.unpersist()


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    from callwright.operators.broadcast import fits_broadcast

    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "`a.b` int, t string")
    assert fits_broadcast(df, 2) and not fits_broadcast(df, 1) and not fits_broadcast(df, 2, 500)
    assert fits_broadcast(df.filter("t = 'none'"), 0)


def test_template_products_equal_a_loop(spark):
    from itertools import product

    formats = [(1, "A", 1, "<x> <y>"), (1, "B", 2, "<y>"), (2, "A", 1, "<x> <z> <x>"), (2, "C", 2, "<none> <x>"), (3, "D", 1, "no slot")]
    values = {(1, "<x>"): 5, (1, "<y>"): 23, (2, "<x>"): 7, (2, "<z>"): 1}
    tags = [(b, s, f"{s}{v % 6}", v + 1) for (b, s), n in values.items() for v in range(n)]
    f = spark.createDataFrame(formats, "block int, fname string, fmt_pos int, fmt string")
    t = spark.createDataFrame(tags, "block int, slot string, value string, vpos bigint").repartition(3)
    want, seen, numbered = [], set(), []
    for block, fname, pos, fmt in formats:
        slots = [w for w in fmt.split() if w.startswith("<")]
        lists = [[(v, p) for b, s, v, p in tags if (b, s) == (block, slot)] for slot in slots]
        for choice in product(*lists) if slots and all(lists) else []:
            want.append((block, fname, pos, " ".join(v for v, _ in choice), [p for _, p in choice], len(want)))
    for _, fname, _, query, _, _ in want:
        if (query, fname) not in seen:
            seen.add((query, fname))
            numbered.append((len(numbered) + 1, query, fname))
    for ranges, blocks in ((1 << 13, 1 << 12), (4, 3), (10, 2), (1, 1)):
        out = aug.expand_templates(f, t, ranges, blocks)
        assert sorted(tuple(r) for r in out.collect()) == sorted(want), (ranges, blocks)
    assert sorted(tuple(r) for r in aug.number_queries(out).collect()) == numbered


def test_many_rules_give_the_variants_of_a_plain_loop(spark):
    import random

    r = random.Random(12)
    syllables = ["가", "나", "다", "ab", "b", "c", " ", "켜", "꺼줘"]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    rules = [(i, [word(r.randint(2, 4)) for _ in range(r.randint(1, 3))], [word(r.randint(1, 3)) for _ in range(r.randint(1, 2))]) for i in range(117)]
    rules[5] = (5, ["zz"], ["", "q"])
    rows = [(i, word(r.randint(1, 9)), "zz" if i % 10 == 0 else word(2)) for i in range(60)]

    def variants(texts):
        work = [texts]
        for _, ori, sr in rules:
            grown = []
            for v in work:
                grown.append(v)
                if any(o in t for o in ori for t in v):
                    for new in sr:
                        made = []
                        for t in v:
                            for o in ori:
                                t = t.replace(o, new)
                            made.append(t)
                        grown.append(tuple(made))
            work = grown[:200]
        return list(dict.fromkeys(work))

    df = spark.createDataFrame(rows, "id int, q string, t string")
    got = aug.expand_variants(df, ["q", "t"], rules, max_expansions=200).collect()
    assert sum(len(x["variants"]) > 1 for x in got) > 10
    for x in got:
        assert [tuple(v) for v in x["variants"]] == variants(next((q, t) for i, q, t in rows if i == x["id"])), x["id"]
