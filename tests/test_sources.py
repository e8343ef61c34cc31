"""Readers, rule assets and sinks on small files derived from the driver tables."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from callwright.operators import rules as rules_op
from callwright.plans import fixtures as fx
from callwright.sources import assets, readers, sinks

from .conftest import SF_SMALL


def _tmp(prefix):
    return tempfile.mkdtemp(prefix=prefix)


def test_conversion_rule_documents_match_fixture(spark):
    doc = {
        "rules_by_func": {
            "mode_on": {"AI_Mode": {"code": "BP", "enable": 0, "type": -1}},
            "mode_off": {"Outdoor": [{"code": "BP", "when": {"enable": 1, "type": 0}}], "Privacy_Mode": {"func": "GN", "enable": False}},
            "info": {"Personal_Info": {"code": "GN", "get": True}, "Air_Quality": [{"code": "IO", "timeframe": 0, "location": "*"}]},
            "talk": {"Default": {"code": "MR"}},
        }
    }
    rows = assets.normalise_conversion_rules(doc)
    assert [r[1:4] for r in rows] == [
        ("BP", "mode_on", "AI_Mode"),
        ("BP", "mode_off", "Outdoor"),
        ("GN", "mode_off", "Privacy_Mode"),
        ("GN", "info", "Personal_Info"),
        ("IO", "info", "Air_Quality"),
        ("MR", "talk", "Default"),
    ]
    assert rows[4][4] == [("timeframe", 1, "n:0", "0", "int"), ("location", 2, "*", "*", "str")]
    conds = assets.conditions_frame(spark, rows)
    calls = rules_op.match_calls(
        __import__("callwright.operators.calls", fromlist=["x"]).calls_with_args(fx.tagged(spark, SF_SMALL)), rules_op.rules_from_conditions(conds)
    )
    assert calls.filter(F.col("rule").isNotNull()).count() > 0


def test_v2_and_template_and_replacement_assets(spark):
    v2 = assets.v2_rules(['{"raw_func":"BP","when":{"enable":0,"type":-1},"new_func":"mode","args":{"target":"AI_MODE"}}', ""])
    assert v2[0][1:3] == ("BP", "mode") and v2[0][4][0] == ("enable", 1, "n:0", "0", "int")
    assert v2[0][5] == [("target", "AI_MODE", "str", "AI_MODE", "s:AI_MODE")]
    assert assets.conditions_frame(spark, v2).columns[-1] == "out"
    tm = assets.template_map_rules({"function_map": {"function_BP": [{"when": {"enable": 1}, "new_name": "mode_off", "args": {"mode": "{code}"}}], "reverse_by_name": {}}})
    assert tm[0]["code"] == "BP" and tm[0]["out"] == [(1, "mode", "{code}", "str")]
    assert assets.template_rules_frame(spark, tm).count() == 1
    d = _tmp("cw-rules-")
    with open(f"{d}/m.jsonl", "w", encoding="utf-8") as f:
        f.write('{"ori": ["a"], "sr": ["b"]}\n\n{"ori": ["c"], "sr": ["d", "e"]}\n')
    assert assets.replacement_rules(f"{d}/m.jsonl") == [(1, ["a"], ["b"]), (2, ["c"], ["d", "e"])]
    with open(f"{d}/bad.jsonl", "w", encoding="utf-8") as f:
        f.write('{"ori": ["a"], "sr": []}\n')
    with pytest.raises(ValueError, match="line 1"):
        assets.replacement_rules(f"{d}/bad.jsonl")


def test_spec_forms(spark):
    doc = {
        "functions": [
            {"name": "f", "description": "d", "args": [{"name": "b", "enum": [1, 2]}, {"name": "a", "type": "integer", "minimum": 0}]},
            {"name": "g", "parameters": {"y": {"type": "string"}, "x": {}}},
        ]
    }
    rows = assets.spec_rows(doc)
    assert ("f", 1, "d", "b", 0, "string", 1, "1", None, None, None) in rows
    assert ("g", 2, None, "y", 9999, "string", None, None, None, None, None) in rows
    assert assets.spec_frame(spark, doc).count() == len(rows)


def test_jsonl_readers(spark):
    d = _tmp("cw-jsonl-")
    with open(f"{d}/t.jsonl", "w", encoding="utf-8") as f:
        f.write('{"message": "a", "expected": "{}"}\n\nnot json\n{"message": "b"} tail\n{"message": "c"}\n')
    tol = readers.read_jsonl_tolerant(spark, f"{d}/t.jsonl")
    assert sorted(r["m"] for r in tol.select(F.try_variant_get("value", "$.message", "string").alias("m")).collect()) == ["a", "c"]
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, f"{d}/t.jsonl").collect()


def test_prompt_parts_pairs_and_repair_cases(spark):
    d = _tmp("cw-parts-")
    with open(f"{d}/p.json", "w", encoding="utf-8") as f:
        json.dump({"datas": ["text one", {"k": 1, "a": [1, 2]}]}, f)
    parts = readers.read_prompt_parts(spark, f"{d}/p.json").orderBy("pos").collect()
    assert [r["text"] for r in parts] == ["text one", '{"k":1,"a":[1,2]}']
    with open(f"{d}/pairs.jsonl", "w", encoding="utf-8") as f:
        f.write('{"tag": "<function_BP>(enable=0, type=\\"*\\")", "json": {"name": "x"}}\nbroken\n{"tag": "none", "json": {}}\n')
    pr = readers.read_pair_rules(spark, f"{d}/pairs.jsonl").collect()
    assert len(pr) == 1 and pr[0]["code"] == "BP" and [a["canon"] for a in pr[0]["args"]] == ["0", "*"]
    with open(f"{d}/cases.csv", "w", encoding="utf-8") as f:
        f.write("id,label,text\nok1,success_expected,<function_MR>()<end>\n")
    assert readers.read_repair_cases(spark, f"{d}/cases.csv").first()["raw"] == "<function_MR>()<end>"
    with pytest.raises(ValueError):
        readers.read_repair_cases(spark, f"{d}/cases.txt")


def test_csv_dir_aliases_and_skips(spark):
    d = _tmp("cw-csvdir-")
    t = fx.tagged(spark, SF_SMALL).orderBy("row_id").limit(20).collect()  # a small file to read back
    with open(f"{d}/a.csv", "w", encoding="utf-8") as f:
        f.write("idx,utterance,call\n")
        for r in t:
            f.write(f'{r["row_id"]},"{r["query"]}\nline2","{r["llm_output"].replace(chr(34), chr(34) * 2)}"\n')
    with open(f"{d}/b.csv", "w", encoding="utf-8") as f:
        f.write("x,y\n1,2\n")
    df = readers.read_csv_dir(spark, d)
    rows = df.collect()
    assert len(rows) == len(t) and all("\n" not in r["query"] for r in rows) and {r["src_path"] for r in rows} == {"a.csv"}


def test_split_report_counts_rows_and_files(spark):
    rows = [("train", 0, "a.json"), ("train", 0, "a.json"), ("eval", 0, "b.json"), ("train", 1, "c.csv")]
    df = spark.createDataFrame(rows, "split string, src_kind int, src_file string")
    assert sinks.split_report(df).first().asDict() == {"train": 3, "eval": 1, "test": 0, "json_files": 2, "csv_files": 1}
    assert sinks.split_report(df.drop("src_file").limit(0)).first().asDict() == {"train": 0, "eval": 0, "test": 0}


def test_sinks_round_trip(spark):
    d = _tmp("cw-sink-")
    from callwright.plans.catalog import q_rule_convert, q_split_exact

    split = q_split_exact(spark, SF_SMALL)
    counts = {r["split"]: r["count"] for r in sinks.write_splits(split, f"{d}/splits").collect()}
    back = spark.read.json(f"{d}/splits")
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == counts
    conv = q_rule_convert(spark, SF_SMALL)
    sinks.write_converted_csv(conv, f"{d}/conv")
    assert spark.read.option("header", True).csv(f"{d}/conv").count() == conv.count()
    sinks.write_by_function(conv.withColumnRenamed("query", "q"), f"{d}/byfunc")
    assert sorted(os.listdir(f"{d}/byfunc"))[0].startswith("_") or any(n.startswith("func=") for n in os.listdir(f"{d}/byfunc"))


def test_strict_types_keep_bool_and_int_apart(spark):
    from callwright.operators.calls import calls_with_args

    doc = {"rules_by_func": {"on": {"A": {"code": "BP", "enable": True}}}}
    loose = assets.conditions_frame(spark, assets.normalise_conversion_rules(doc))
    strict_rows = [(s, c, mf, me, [(k, p, assets.expect_key(True, strict=True), *typed) for k, p, _, *typed in conds]) for s, c, mf, me, conds in assets.normalise_conversion_rules(doc)]
    strict = assets.conditions_frame(spark, strict_rows)
    df = spark.createDataFrame([(1, "<function_BP>(enable=1)<end>"), (2, "<function_BP>(enable=true)<end>")], "row_id long, llm_output string")
    calls = calls_with_args(df)
    got_loose = {r["row_id"]: r["map_func"] for r in rules_op.convert_calls(calls, rules_op.rules_from_conditions(loose)).collect()}
    got_strict = {r["row_id"]: r["map_func"] for r in rules_op.convert_calls(calls, rules_op.rules_from_conditions(strict), strict_types=True).collect()}
    assert got_loose == {1: "on", 2: "on"}
    assert got_strict == {1: "", 2: "on"}


def _write(folder, name, text):
    import os

    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_json_array_violations_and_odd_file_names(spark):
    d = _tmp("cw-json-")
    rows = (
        '[{"user": " a ", "assistant": {"b": 1}}, {"user": "t", "assistant": "{\\"c\\": 2}"}, {"user": 5, "assistant": {}},'
        ' {"user": "x", "assistant": [1]}, {"user": "x", "assistant": 7}, {"user": "x"}, {"assistant": {}}, {"user": "x", "assistant": "{"}]'
    )
    _write(d, "json/a b+(1).json", rows)
    got = [(r["user"], r["assistant"], r["error"]) for r in readers.read_json_arrays(spark, d).orderBy("src_pos").collect()]
    assert got[:2] == [("a", '{"b":1}', None), ("t", '{"c":2}', None)]
    assert [e for _, _, e in got[2:]] == [
        "user is no text",
        "assistant is neither an object nor text",
        "assistant is neither an object nor text",
        "missing key assistant",
        "missing key user",
        "invalid assistant JSON",
    ]
    assert readers.read_json_arrays(spark, d, "json/a b+(1).json").count() == 8
    assert readers.read_json_arrays(spark, d, "json/a b+1.json").count() == 0


def test_swapped_csv_headers_are_read_by_name(spark):
    d = _tmp("cw-csv-")
    _write(d, "csv/1.csv", 'input,output_json\nhello,"{""a"": 1}"\n')
    assert [(r["user"], r["assistant"]) for r in readers.read_labelled_csv(spark, d).collect()] == [("hello", '{"a":1}')]
    _write(d, "csv/2.csv", 'output_json,input\n"{""a"": 2}",bye\n')
    _write(d, "csv/a [1].csv", 'extra,input,output_json\nx,hi,"{""a"": 3}"\nx,too,"{""a"": 4}",many\nshort,row\n')
    rows = sorted((r["user"], r["assistant"]) for r in readers.read_labelled_csv(spark, d).collect())
    assert rows == [("bye", '{"a":2}'), ("hello", '{"a":1}'), ("hi", '{"a":3}')]
    _write(d, "csv/3.csv", "other\n1\n")
    with pytest.raises(Exception, match="found other"):
        readers.read_labelled_csv(spark, d).collect()
    assert readers.read_labelled_csv(spark, d, "csv/1.csv").count() == 1


def test_messages_and_records(spark):
    d = _tmp("cw-msg-")
    _write(d, "m.csv", "\ufeffEXPECT,Query(한글)\n<function_MR>(), 안녕 \nx,\n")
    assert [tuple(r) for r in readers.read_messages(spark, f"{d}/m.csv").collect()] == [("안녕", "<function_MR>()")]
    lines = [
        '{"message": " a ", "expected": {"k": [1, "x"]}}',
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "assistant": " t "}',
        '{"messages": [{"role": "system", "content": "s"}], "calls": [{"name": "f"}]}',
        '{"message": 5, "expected": "x"}', "", "{bad", '{"message": "n", "expected": null, "assistant": null}',
    ]
    _write(d, "m.jsonl", "\n".join(lines))
    got = sorted(tuple(r) for r in readers.read_messages(spark, f"{d}/m.jsonl").collect())
    assert got == [("a", '{"k":[1,"x"]}'), ("n", ""), ("s", '{"calls":[{"name":"f"}]}'), ("u", "t")]
    records = [
        '{"query": " q ", "calls": [{"code": "BP", "args": {"b": 1, "a": true}}, 7, {"func": "MR"}]}',
        '{"Query(한글)": "한", "LLM Output": "<function_IO>(a=1, b=x)<end>"}',
        '{"message": "", "expected": "<function_MR>()"}', '{"query": "", "calls": null}',
    ]
    _write(d, "r.jsonl", "\n".join(records + ["{bad"]))
    _write(d, "r.json", "[" + ",\n".join(records) + "]")
    _write(d, "r.csv", 'QUERY,Expected\nq,"<function_IO>(a=1, b=x)"\n,"<function_MR>()"\n')
    flat = lambda df: sorted((r["query"], [(c["pos"], c["func"], c["args_json"]) for c in r["calls"]]) for r in df.collect())
    expected = [("", []), ("q", [(1, "BP", '{"a":true,"b":1}'), (2, "MR", "{}")]), ("한", [(1, "IO", '{"a":1,"b":"x"}')])]
    assert flat(readers.read_records(spark, f"{d}/r.jsonl", "json")) == expected
    assert flat(readers.read_records(spark, f"{d}/r.json", "json_array")) == expected
    assert flat(readers.read_records(spark, f"{d}/r.csv")) == [("q", [(1, "IO", '{"a":1,"b":"x"}')])]


def test_rows_map_alike_with_too_many_rules_for_a_broadcast(spark, monkeypatch):
    t = fx.tagged(spark, SF_SMALL).select("row_id", "llm_output")
    mapped = lambda: sorted(tuple(r) for r in rules_op.map_rows_template(t, "llm_output", fx.template_rules(spark)).select("row_id", "mapped_json").collect())
    in_row = mapped()
    monkeypatch.setattr(rules_op, "MAX_BROADCAST_RULES", 0)
    assert mapped() == in_row


def test_rules_by_index_match_like_rules_in_a_row(spark):
    import random

    from callwright.operators.calls import calls_with_args

    r = random.Random(8)
    value = lambda: r.choice(["*", "__ANY__", 1, 2, 3, 1.0, True, "x", "yy"])
    conds = []
    for seq in range(400):
        keys = r.sample("abcd", r.randint(0, 3))
        code = r.choice(["BP", "BP", "BP", "GN"])
        for pos, key in enumerate(keys) if keys else [(None, None)]:
            v = value() if key else None
            conds.append((seq, code, f"f{seq}", f"e{seq}", key, None if key is None else pos + 1, None if key is None else assets.expect_key(v), None if v is None else str(v), "str"))
    rules = rules_op.rules_from_conditions(spark.createDataFrame(conds, "seq int, code string, map_func string, map_enum string, k string, k_pos int, expect string, value string, vtype string"))
    rules = rules.where("seq > 12 or size(when) > 0")  # else the first rule without conditions takes all calls
    text = lambda: f"<function_{r.choice(['BP', 'GN', 'ZZ'])}>({', '.join(f'{k}={r.choice([1, 2, 3, 1.0, True, chr(120), 7])}' for k in r.sample('abcde', r.randint(0, 4)))})"
    df = spark.createDataFrame([(i, text()) for i in range(300)], "row_id long, llm_output string").repartition(3)
    calls = calls_with_args(df.unionByName(df))
    for wildcards in (rules_op.WILDCARDS_CONVERT, rules_op.WILDCARDS_TEMPLATE):
        for part in (rules, rules.where("size(when) > 1"), rules.where("seq > 1000")):
            flat = lambda out: sorted((x["row_id"], x["pos"], x["func"], -1 if x["rule"] is None else x["rule"]["seq"]) for x in out.collect())
            assert flat(rules_op.match_by_index(calls, part, wildcards)) == flat(rules_op.match_calls(calls, part, wildcards))


def test_many_rules_of_one_code_are_looked_up(spark, monkeypatch):
    from callwright.operators.calls import calls_with_args

    conds = spark.range(0, 50_000).selectExpr("cast(id as int) seq", "'BP' code", "concat('f', id) map_func", "'' map_enum", "'v' k", "1 k_pos", "concat('n:', id) expect", "cast(id as string) value", "'int' vtype")
    rules = rules_op.rules_from_conditions(conds)
    calls = calls_with_args(spark.range(0, 2000).selectExpr("id row_id", "concat('<function_BP>(u=1, v=', id * 30, ')') llm_output"))
    out = rules_op.convert_calls(calls, rules).select("row_id", "map_func").collect()
    assert len(out) == 2000 and all(r["map_func"] == (f"f{r['row_id'] * 30}" if r["row_id"] * 30 < 50_000 else "") for r in out)


def test_template_values_keep_their_type(spark):
    doc = {"function_BP": [{"when": {"m": "__ANY__"}, "new_name": "never"}, {"when": {"a": "*"}, "new_name": "set", "args": {"lvl": 3, "on": True, "r": 1.5, "no": None, "l": [1], "t": "{{{a}}} {code}", "u": "{zz}"}}]}
    rules = assets.template_rules_frame(spark, assets.template_map_rules(doc))
    df = spark.createDataFrame([("<function_BP>(a={b}, b=1)",), ("<function_BP>(a=1, code=X)",)], "t string")
    got = [r["mapped_json"] for r in rules_op.map_rows_template(df, "t", rules).collect()]
    head = '[{"functionName":"set","arguments":{"lvl":3,"on":true,"r":1.5,"no":null,"l":[1],"t":'
    assert got == [head + '"{{b}} BP","u":"{zz}"}}]', head + '"{1} X","u":"{zz}"}}]']


def test_function_section_hints_order_and_empty_function(spark):
    from callwright.operators import prompts

    doc = {
        "functions": [
            {"name": "zeta", "description": "d", "args": [{"name": "v", "type": "int", "minimum": 0, "max": 9, "enum": ["a", "b"]}, {"name": "p", "pattern": "x+"}, {"name": "n"}]},
            {"name": "alpha", "parameters": {}},
        ]
    }
    text = prompts.functions_section(prompts.function_blocks(assets.spec_frame(spark, doc))).first()["section"]
    assert text.split("Available functions:\n")[1] == (
        "- zeta: d\n  arguments (object):\n    - v:  a/b min=0 max=9\n    - p:  pattern=x+\n    - n:\n"
        '  example: {"name": "zeta", "arguments": {"v": "...", "p": "...", "n": "..."}}\n'
        '- alpha:\n  (no parameters)\n  example: {"name": "alpha", "arguments": {}}'
    )


def _splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: _splits(spark, size)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_json_array_is_split_over_tasks(spark, small_splits):
    import random

    r = random.Random(4)
    odd = ['"', "\\", "}", "{", "[", "]", ",", "x", "\n", "é", "中", ":", '\\"']
    text = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 25)))
    rows = [{"user": "u" + text(), "assistant": {text(): [text(), {"a": {}}], "n": i} if i % 3 else json.dumps({"t": text()})} for i in range(200)]
    rows[77]["assistant"] = {"long": "}{" * 1500}
    d = _tmp("cw-split-")
    _write(d, "json/a.json", json.dumps(rows))
    _write(d, "json/b.json", json.dumps(rows, ensure_ascii=False, indent=3) + "\n")
    _write(d, "json/empty.json", " [\n] ")
    want = [x["user"].strip() for x in rows]
    for size in (1 << 27, 4000, 300):
        small_splits(size)
        df = readers.read_json_arrays(spark, d)
        got = df.orderBy("src_file", "src_pos").collect()
        assert [x["user"] for x in got] == want * 2 and not any(x["error"] for x in got)
        assert [json.loads(x["assistant"]) for x in got[:200]] == [a if isinstance(a, dict) else json.loads(a) for a in (x["assistant"] for x in rows)]
    assert spark.read.option("lineSep", "}").text(f"{d}/json").rdd.getNumPartitions() > 50


@pytest.mark.parametrize(
    "text",
    ['{"user": "a", "assistant": {}}', "", "7", '[{"user": "a", "assistant": {}}', '[{"user": "a", "assistant": {}},]', '[{"user": "a", "assistant": {}} {"user": "b", "assistant": {}}]',
     '[[{"user": "a", "assistant": {}}]]', '[{"user": "a", "assistant": {}}] x', '[1, {"user": "a", "assistant": {}}]', '[{"user": "a", "assistant": {}}, 1]', '[{"user": "a, "assistant": {}}]', "[1]"],
)
def test_other_top_levels_are_errors(spark, text):
    d = _tmp("cw-strict-")
    _write(d, "json/a.json", text + " ")
    rows = readers.read_json_arrays(spark, d).collect()
    assert any(r["error"] for r in rows)
    with pytest.raises(Exception, match="invalid row"):
        readers.require_valid(readers.read_json_arrays(spark, d)).collect()


def test_csv_is_split_over_tasks(spark, small_splits):
    import csv as python_csv
    import random

    from callwright.sources.splittable import csv_records

    r = random.Random(9)
    odd = ['"', ",", "\n", "x", "y", " ", "é", "\r\n", '""', "'"]
    rows = [["id", "a", "b"]] + [[str(i), "".join(r.choice(odd) for _ in range(r.randint(0, 30))), 'mid"quote' if i % 5 == 0 else "p\nq"] for i in range(400)]
    rows[50][1] = 'line\n"' * 900
    d = _tmp("cw-csvsplit-")
    with open(f"{d}/a.csv", "w", encoding="utf-8", newline="") as f:
        python_csv.writer(f, lineterminator="\n").writerows(rows[:200])
        f.write('\nx,un"quoted "" cell,"closed"tail\n1,2,3,4\nshort\n')
        python_csv.writer(f).writerows(rows[200:])
    with open(f"{d}/a.csv", encoding="utf-8", newline="") as f:
        want = [x for x in list(python_csv.reader(f))[1:] if x and len(x) <= 3]
    for size in (1 << 27, 5000, 400, 60):
        small_splits(size)
        got = csv_records(spark, d).orderBy("src_pos").collect()
        assert [x["cells"] for x in got] == want, size
        assert {tuple(x["header"]) for x in got} == {("id", "a", "b")}


def test_grouped_documents_read_back(spark):
    from glob import glob

    from callwright.operators import profile as prof
    from callwright.sources import documents

    d = _tmp("cw-doc-")
    rows = [(i, f'<function_{"AB" if i % 3 else ["CD", "EF"][i % 2]}>(k={i % 7}, t="x{i}")<end>', f'q "{i}"\\n') for i in range(900)]
    t = spark.createDataFrame(rows, "row_id long, llm_output string, query string").repartition(5)
    calls = prof.calls_with_source(prof.profile_calls(t), t)
    record = F.to_json(F.struct("row_id", F.col("pos").alias("call_order"), "raw_args", "query"))

    def loaded(lines, name):
        documents.write_document(lines, f"{d}/{name}", files=4)
        files = sorted(glob(f"{d}/{name}/part-*"))
        return json.loads("".join(open(f, encoding="utf-8").read() for f in files)), files

    doc, files = loaded(documents.by_function(calls, record), "by_function")
    assert len(files) > 1
    want = {}
    for r in calls.orderBy("func", "row_id", "pos").collect():
        want.setdefault(r["func"], []).append({"row_id": r["row_id"], "call_order": r["pos"], "raw_args": r["raw_args"], "query": r["query"]})
    assert doc == want and len(want["AB"]) > 500
    args = prof.profile_args(prof.profile_calls(t))
    values = prof.func_arg_value_list(args)
    doc, _ = loaded(documents.value_list_document(values), "values")
    assert doc == [{"func": r["func"], "arg_key": r["arg_key"], "values": r["values"]} for r in args.groupBy("func", "arg_key").agg(F.sort_array(F.collect_set("val")).alias("values")).orderBy("func", "arg_key").collect()]
    spec = prof.function_spec(values, prof.descriptions_frame(spark))
    doc, _ = loaded(documents.function_spec_document(spec), "spec")
    flat = [(f["name"], f["description"], a["name"], a["type"], n + 1, json.dumps(e)) for f in doc["functions"] for a in f["args"] for n, e in enumerate(a["enum"])]
    assert flat == [tuple(r) for r in spec.select("func", "description", "arg_key", "arg_type", "enum_pos", "enum_value").orderBy("func", "arg_key", "enum_pos").collect()]
    assert documents.by_function(calls.where("false"), record).count() == 0


def test_records_of_json_files_are_split_and_single_objects_read(spark, small_splits):
    d = _tmp("cw-records-")
    record = lambda i: {"query": f"q}}{{ {i}", "calls": [{"code": "BP", "args": {"a": i, "t": '"}'}}, {"func": "MR"}]}
    _write(d, "many.json", json.dumps([record(i) for i in range(300)], indent=1))
    _write(d, "one.json", " " + json.dumps(record(1000)) + "\n")
    _write(d, "flat.json", json.dumps({"message": "m", "expected": "<function_MR>()"}))
    _write(d, "broken.json", json.dumps(record(1))[:-1])
    for size in (1 << 27, 700):
        small_splits(size)
        got = sorted((r["query"], [(c["func"], c["args_json"]) for c in r["calls"]]) for r in readers.read_records(spark, d, "json_array").collect())
        want = [(f"q}}{{ {i}", [("BP", json.dumps({"a": i, "t": '"}'}, separators=(",", ":"))), ("MR", "{}")]) for i in [*range(300), 1000]]
        assert got == sorted([*want, ("m", [("MR", "{}")])])
