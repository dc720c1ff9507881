import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import traces as T
from lodestrata.sources import files, sinks
from lodestrata.streaming import incremental as I


def test_json_roots(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1},\n {"id": "y"}]')
    (tmp_path / "o.json").write_text('{"results": [{"id": "z", "n": 3}]}')
    (tmp_path / "bad.json").write_text('{"n": 1}')
    assert files.json_array(spark, str(tmp_path / "a.json"), "id string, n int").count() == 2
    assert [tuple(r) for r in files.json_rows(spark, str(tmp_path / "o.json"), "id string, n int").collect()] == [("z", 3)]
    with pytest.raises(ValueError):
        files.json_array(spark, str(tmp_path / "o.json"), "id string")
    with pytest.raises(ValueError):
        files.json_rows(spark, str(tmp_path / "bad.json"), "id string")
    assert files.json_object(spark, str(tmp_path / "bad.json"), "n int").first()["n"] == 1


def test_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    assert [r["_corrupt"] for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "id string", strict=False).collect()] == [None, '{"id": ']
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "l.jsonl"), "id string").collect()
    assert sorted(r["parses"] for r in files.located_lines(spark, str(tmp_path / "l.jsonl")).collect()) == [False, True]
    with pytest.raises(Exception, match="a row has no id"):
        files.keys_only(spark.createDataFrame([("a",), (None,)], "id string"), "id").collect()


def test_selection_list(spark, tmp_path):
    (tmp_path / "s.csv").write_text("condition,task_id\nq4,a\nq2,b\nq4,c\nq4,\n")
    got = files.selection_list(spark, str(tmp_path / "s.csv"), "q4", ["c", "d"]).orderBy("place").collect()
    assert [r["task_id"] for r in got] == ["c", "d", "a"]


def test_checksums(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("hello")
    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    (tmp_path / "SUMS").write_text(f"{good}  a.txt\n{good}  b.txt\n")
    assert {r["name"]: r["ok"] for r in files.checksum_report(spark, str(tmp_path / "SUMS"), str(root)).collect()} == {"a.txt": True, "b.txt": False}


def test_characters_and_sections(spark):
    df = spark.createDataFrame([(1, "ba"), (2, ""), (3, None)], "k int, t string")
    assert {r["k"]: r["ids"] for r in files.character_ids(df, "k", "t").collect()} == {1: [1, 0], 2: [], 3: None}
    lines = spark.createDataFrame(list(enumerate(["x", "__SECTION__gpu", "1", "__SECTION__log"])), "n int, l string")
    assert [tuple(r) for r in files.sections(lines, "n", "l").collect()] == [(None, 0, "x"), ("gpu", 2, "1")]
    assert files.synthetic_records(spark, 5, 1).collect() == files.synthetic_records(spark, 5, 1).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x,"y"\nz'), ("b", 2, None)], "k string, n int, t string")
    assert sinks.write_csv(df, str(tmp_path / "c")) == 2
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').count() == 2
    assert sinks.write_csv(df.limit(0), str(tmp_path / "e")) == 0
    assert all(p.stat().st_size == 0 for p in (tmp_path / "e").glob("part-*"))
    assert sinks.append_new(df, str(tmp_path / "log"), "k") == 2 and sinks.append_new(df, str(tmp_path / "log"), "k") == 0
    assert sinks.write_text(df, "k", str(tmp_path / "t")) == (2, 2) and sinks.write_text(df, "k", str(tmp_path / "t")) == (2, 2)
    assert sinks.export(df, str(tmp_path / "x"), "n", "k") == {"rows": 2, "preview": 2, "examples": 2}
    assert json.loads((tmp_path / "x" / "summary.json").read_text())["rows"] == 2
    assert "| n/a |" in sinks.markdown_table(df) and "1.00" in sinks.markdown_table(df, {"n": ".2f"})
    with pytest.raises(RuntimeError), sinks.RunState(tmp_path / "run"):
        raise RuntimeError("no")
    assert (tmp_path / "run" / "FAILED").read_text().startswith("RuntimeError")


def test_resume(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = spark.createDataFrame([("a", "f"), ("b", "f"), ("a", "f"), (None, "f")], "id string, run_fingerprint string")
    rows.write.parquet(src)
    go = lambda: I.resume(spark, src, "id string, run_fingerprint string", out, cp, "id", "f")
    assert go() == 2 and go() == 0
    rows.limit(1).withColumn("run_fingerprint", F.lit("other")).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="another run"):
        go()


def test_stateful_seal(spark, tmp_path):
    src = str(tmp_path / "s")
    seen = []
    appends = [[("k", 5)], [("k", 1)], [("k", 4), ("j", None)]]
    for n, a in enumerate(appends):
        spark.createDataFrame(a, "key string, n int").coalesce(1).write.mode("append").parquet(src)
        q = I.sealed_counts(spark.readStream.schema("key string, n int").parquet(src), "key", "n", 2).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [x for x in seen if x[0] == "k"] == [("k", 5, 2, 3, 3, 2), ("k", 6, 4, 4, 2, 2), ("k", 10, 8, 8, 2, 2)]
    assert ("j", 0, 0, 0, 0, 0) in seen
    r = I.sealed_closed_form(spark.createDataFrame([(10,)], "t long"), "t", 2).first()
    assert (r["sealed_keys"], r["sealed_values"]) == (8, 8)


def test_stop_and_prefix(spark):
    assert I.stop_step(["a", "<|END_CODE|>", "b", "c", "d"]) == (4, "end_code")
    assert I.stop_step(["a", "</s>"]) == (2, "eos") and I.stop_step(["x"] * 50) == (32, "loop") and I.stop_step(list("abc") * 9, limit=5) == (5, "max_new_tokens")
    done = spark.createDataFrame([(0,), (2,)], "i int")
    assert [r["place"] for r in I.missing_prefix(done, "i", 5).collect()] == [1]
    assert I.missing_prefix(done.limit(0), "i", 5).count() == 0


TASKS = "array<struct<task_id: string, positions: array<struct<prediction_index: int, target_token_id: int, target_token: string, target_token_kind: string, top1_token_id: int>>>>"


def test_traces(spark):
    def trace(i, cond, second):
        return (i, cond, [("a", [(0, 1, "{", "structural_marker", 1), (1, 2, "x", "content", second), None, (None, 3, "y", "content", None)]), None])

    df = spark.createDataFrame([trace(1, "fp16", 2), trace(2, "q4", 9), (3, "q4", None)], f"trace_id long, run_condition string, task_traces {TASKS}")
    got = {r["run_condition"]: r for r in T.disagreements(T.positions(df), "run_condition").collect()}
    assert (got["q4"]["disagreements"], got["q4"]["first_disagreement"], got["fp16"]["disagreements"], got["q4"]["structural_share"]) == (1, 1, 0, 0.0)
    pairs = T.aligned(df.filter("run_condition = 'fp16'"), df.filter("run_condition = 'q4'")).collect()
    assert sorted((r["prediction_index"], r["same_best"]) for r in pairs) == [(0, True), (1, False)]
