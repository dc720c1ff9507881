import json
import sys

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import arrays as A
from lodestrata.functions import columns as C
from lodestrata.functions import parsers as X
from lodestrata.operators import aggregates as G
from lodestrata.operators import manifests as M
from lodestrata.operators import pairing as P
from lodestrata.operators import statistics as S
from lodestrata.operators import traces as T
from lodestrata.operators import validate as V
from lodestrata.sources import files, sinks


@pytest.mark.parametrize(
    "notation,code,kind",
    [
        ("JSON", "[1 2]", "unbalanced_or_mismatched_delimiter"),
        ("JSON", '{"a": "x', "unterminated_string_or_token"),
        ("JSON", '"\\q"', "invalid_escape_or_control_character"),
        ("JSON", "{} 1", "extra_content_or_multiple_roots"),
        ("JSON", "", "invalid_leading_token"),
        ("JSON", '{"a": }', "other_parser_error"),
        ("JSON", "\\n{}", "literal_escaped_layout_outside_string"),
        ("JSON", "[" * 200_000, "other_parser_error"),
        ("XML", "<a></b>", "unbalanced_or_mismatched_delimiter"),
        ("XML", "<a", "unterminated_string_or_token"),
        ("XML", "<a/><b/>", "extra_content_or_multiple_roots"),
        ("XML", "<a>&#0;</a>", "invalid_number"),
        ("XML", "<a>\x01</a>", "invalid_token"),
        ("TOML", 'a = "x', "unterminated_string_or_token"),
        ("TOML", "[=]", "invalid_key_syntax"),
        ("CSV", '"a', "other_parser_error"),
        ("JSON", "[1]", "local_parser_succeeded"),
        ("PDF", "x", "unsupported_format"),
        (None, None, "unsupported_format"),
    ],
)
def test_parser_kinds(notation, code, kind):
    assert X.parse_outcome(notation, code)[0] == kind


def test_visible_terms(spark):
    cases = {
        "Text <CODE><item-a key='v'>x</item-a></CODE> outside \"other\": 1": ["item", "item_a"],
        '{"first.name": 1, "two words": 2}': ["first", "first_name", "name"],
        "rows[0] = 5\n[[ shop.list ]]\n": ["list", "rows", "rows_0", "shop", "shop_list"],
        "id,unit price\nid,unit_price\n": ["id", "price", "unit", "unit_price"],
        "nothing here": [],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    assert [r[0] for r in df.select(C.visible_terms(F.col("p"))).collect()] == [*cases.values(), []]


def test_term_weights_and_modes(spark):
    df = spark.createDataFrame([("Unit", [("unit_price", 3.0), ("unit", 1.0)]), ("x", [("x", 9.0)]), (None, []), ("zzz", [("unit", 2.0)])], "p string, t array<struct<term: string, weight: double>>")
    assert [r[0] for r in df.select(C.fuzzy_score(F.col("p"), F.col("t"))).collect()] == [3.0, 0.0, 0.0, 0.0]
    t = spark.createDataFrame([("<|BEGIN_CODE|>",), ("{",), ("unit",), ("other",), (None,)], "x string")
    got = {m: [r[0] for r in t.select(C.protected_token(F.col("x"), m, F.array(F.lit("unit")))).collect()] for m in C.PROTECTION_MODES}
    assert got == {"none": [False] * 5, "markers": [True] + [False] * 4, "json-syntax": [True, True] + [False] * 3, "json-constraints": [True, True, True, False, False]}
    with pytest.raises(ValueError):
        C.protected_token(F.col("x"), "all")


def test_top_with_margin(spark):
    df = spark.createDataFrame([([0.5, 2.0, 2.0], [7, 8, 9]), ([1.0], [3])], "s array<double>, i array<int>")
    a, b = [r[0] for r in df.select(A.top_with_margin(F.col("s"), F.col("i"), 2)).collect()]
    assert [tuple(x) for x in a["top"]] == [(2.0, 9), (2.0, 8)] and a["margin"] == 0.0 and b["margin"] is None


def test_external_program(spark):
    program = "import json, sys\nfor x in sys.stdin:\n    r = json.loads(x)\n    print(json.dumps({'key': r['key'], 'score': len(r['text'])}))"
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, t string")
    assert sorted(map(tuple, X.external_scores(df, "id", "t", [sys.executable, "-c", program]).collect())) == [(1, 3.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(Exception, match="CalledProcessError"):
        X.external_scores(df, "id", "t", [sys.executable, "-c", "raise SystemExit(3)"]).collect()
    assert X.external_scores(df.limit(0), "id", "t", ["false"]).count() == 0


def test_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ("{",), (None,)], "d string")
    rows = df.select(X.fingerprint("d").alias("f"), X.compact_fingerprint("d").alias("c")).collect()
    want = [hashlib.sha256(x.encode()).hexdigest() for x in ('{"a": [1, 2], "b": 1}', '{"a":[1,2],"b":1}')]
    assert [rows[0]["f"], rows[0]["c"]] == want and rows[1]["f"] is rows[2]["c"] is None


def test_lines_and_errors_name_their_place(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.checked_lines(spark, str(good), "a int").collect()) == [1, 2]
    assert files.checked_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    with pytest.raises(RuntimeError, match=r"bad\.jsonl:3"):
        files.checked_lines(spark, str(bad), "a int")
    assert files.first_records(spark, str(bad), 1).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b|c", None, None)], "k string, n int, x double").orderBy("k")
    assert sinks.console_table(df).split("\n")[2] == "a      1  0.5000" and "n/a" in sinks.console_table(df)
    assert "b\\|c" in sinks.markdown_table(df, {"x": ".2f"})
    for report in (sinks.console_table, sinks.markdown_table):
        with pytest.raises(ValueError):
            report(df, most_rows=1)


def test_run_state(tmp_path):
    with sinks.RunState(tmp_path / "run") as run:
        run.progress(done=3)
        assert json.loads((tmp_path / "run" / "status.json").read_text())["done"] == 3
    assert json.loads((tmp_path / "run" / "status.json").read_text())["state"] == "complete"
    with pytest.raises(KeyError), sinks.RunState(tmp_path / "run"):
        raise KeyError("x")
    assert json.loads((tmp_path / "run" / "status.json").read_text())["state"] == "failed" and not (tmp_path / "run" / "COMPLETE").exists()


def test_provenance(spark):
    df = spark.createDataFrame([(1,)], "a int")
    a, b = sinks.provenance(df, bits=4), sinks.provenance(df, bits=2)
    assert a["columns"] == {"a": "int"} and a["run_fingerprint"] != b["run_fingerprint"] == sinks.provenance(df, bits=2)["run_fingerprint"]


def test_gates(spark):
    rows = spark.createDataFrame([("r", "1", 4, "x"), ("r", "1", 4, "x"), ("r", None, 2, None), ("s", "9", 4, "y")], "run string, task_id string, bits int, p string")
    tasks = spark.createDataFrame([("1",), ("2",)], "task_id string")
    got = {(r["run"], r["rule"]): r["violations"] for r in V.result_gate(rows, tasks, "run", "task_id", ["p"], {"bits": 4}, ["p"]).collect()}
    assert got == {("r", "missing_p"): 1, ("r", "other_bits"): 1, ("r", "several_p"): 1, ("s", "missing_p"): 0, ("s", "other_bits"): 0, ("s", "several_p"): 0, ("r", "missing_key"): 1, ("s", "missing_key"): 2, ("r", "unexpected_key"): 1, ("s", "unexpected_key"): 1, ("r", "repeated_key"): 1, ("s", "repeated_key"): 0}
    report = V.result_gate(rows, tasks, "run", "task_id", [], {}, [])
    assert V.exit_code(report) == 1 and V.exit_code(report.filter("violations = 0")) == 0
    order = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3)], "run string, task_id string, place int")
    source = spark.createDataFrame([("a", 5), ("b", 9), ("c", 7)], "task_id string, ord int")
    assert [r["inversions"] for r in V.order_violations(order, source, "run", "task_id", "place", "ord").collect()] == [1]


def test_arguments():
    assert V.checked_quota(100, ["a", "b"]) == 50
    for wrong in (0, -2, 5):
        with pytest.raises(ValueError):
            V.checked_quota(wrong, ["a", "b"])
    for wrong in ([], ["a", "a"], ["z"]):
        with pytest.raises(ValueError):
            V.checked_categories(wrong, ["a", "b"])


def test_limits_and_complete_categories(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "ord int, category string")
    assert [V.limited(df, n).count() for n in (None, 0, -1, 4)] == [9, 9, 9, 4] and V.limited(df, 0, False).count() == 0
    got = M.complete_categories(df, "category", ["b"], "ord", 7, ["a", "b", "c"]).orderBy("selection_index").collect()
    assert [(r["ord"], r["selection_index"], r["seed"]) for r in got] == [(1, 0, 7), (3, 1, 7), (5, 2, 7), (7, 3, 7)]
    with pytest.raises(ValueError, match="no rows"):
        M.complete_categories(df, "category", ["c"], "ord", 7, ["a", "b", "c"])


TRACE = "k string, trace_method string, model_name_or_path string, model_revision string, kivi_commit string, seed int, selected_task_ids array<string>, task_traces array<struct<task_id: string, input_type: string, output_type: string, prompt_tokens: int, frozen_token_ids: array<int>, positions: array<struct<i: int>>>>"


def test_trace_pairs(spark):
    def trace(seed=1, ids=("a", "b"), frozen=(1, 2), positions=2):
        return spark.createDataFrame([("k", "m", "n", "r", "c", seed, ["a", "b"], [None] + [(t, "Text", "JSON", 5, list(frozen), [(i,) for i in range(positions)]) for t in ids])], TRACE)

    def found(x, y):
        return sorted((r["violation"], r["task_id"]) for r in T.pair_violations(x, y, "k").collect())

    assert found(trace(), trace()) == []
    assert found(trace(), trace(seed=2)) == [("header_seed", None)]
    assert found(trace(), trace(ids=("b", "a"))) == [("task_order", None)]
    assert found(trace(), trace(frozen=(2, 1))) == [("task_frozen_token_ids", "a"), ("task_frozen_token_ids", "b")]
    assert found(trace(ids=("a",)), trace(ids=("a",), positions=3)) == [("position_count", "a")]


def test_intervals(spark):
    df = spark.createDataFrame([("g", i, float(i % 10)) for i in range(400)] + [("n", 1, None)], "g string, id int, v double")
    exact = S.bootstrap_interval(df, ["g"], "v", "id", 100, 3).first()
    floor = S.floor_interval(df, ["g"], "v", "id", 100, 3).first()
    light = S.weighted_interval(df, ["g"], "v", "id", 300, 3).first()
    for r in (exact, floor, light):
        assert 3.9 < r["low"] < 4.5 < r["high"] < 5.1
    assert abs(light["high"] - light["low"] - 2 * 1.96 * 2.872 / 20) < 0.15
    got = S.scheduled_intervals(df, ["g", "h"], "g", ["v"], "id", 20, 5).collect()
    assert [(r["g"], r["measure"], r["seed"]) for r in got] == [("g", "v", 5)]


def test_interpolated_percentile(spark):
    df = spark.createDataFrame([(None if i % 3 else "g", float(i * 7 % 31)) for i in range(50)] + [("e", None)], "g string, v double")
    want = {r["g"]: r["p"] for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", 0.37).alias("p")).collect()}
    assert {r["g"]: r["p"] for r in G.interpolated_percentile(df, ["g"], "v", 0.37, "p").collect()} == pytest.approx(want)


def test_assembled_rows_and_configurations(spark):
    df = spark.createDataFrame([(1, 4, "JSON"), (2, None, None)], "id int, key_bits int, output_type string")
    r = P.assembled(df, {"run": ["id", "seed"], "treatment": ["key_bits"]}, "id").orderBy("id").collect()
    assert r[0]["run"]["seed"] is None and r[0]["treatment"]["key_bits"] == 4
    keys = [json.loads(r[0]) for r in df.orderBy("id").select(C.full_configuration(df.columns, {"bits": 16})).collect()]
    assert len(keys[0]) == len(C.CONFIGURATION) == 23 and keys[0][:3] == ["16", "4", "null"] and keys[1][1] == "null" and keys[0][20] == '"JSON"'
