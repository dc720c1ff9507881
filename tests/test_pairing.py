import math

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import aggregates as G
from lodestrata.operators import manifests as M
from lodestrata.operators import pairing as P
from lodestrata.operators import statistics as S
from lodestrata.operators import validate as V

ROW = "task_id string, input_type string, output_type string, query string, generation_protocol string, render_score int, key_validation_score double, final_eval_score double, place int"


def rows(spark, *xs):
    return spark.createDataFrame([(t, "Text", "JSON", f"q{t}", "p", r, k, s, i) for i, (t, r, k, s) in enumerate(xs)], ROW)


def four(spark):
    return rows(spark, ("a", 1, 1.0, 1.0), ("b", 0, 0.0, 0.0), ("c", 1, 0.5, 0.6), ("d", 0, 0.0, 0.0)), rows(spark, ("a", 0, 0.0, 0.0), ("b", 1, 1.0, 1.0), ("c", 1, 0.5, 0.6), ("d", 0, 0.0, None))


def test_four_pairs(spark):
    p = P.scored(P.strict_pairs(*four(spark), "task_id"))
    r = P.transition_report(p).first()
    assert [r[f"parse_{k}"] for k in ("both_pass", "baseline_only", "candidate_only", "both_fail")] == [1, 1, 1, 1]
    assert [r[f"score_{k}"] for k in ("improved", "regressed", "unchanged")] == [1, 1, 2]
    assert [x["task_id"] for x in P.induced_failures(p).collect()] == ["a"]
    assert [x["task_id"] for x in P.worst(p, 2, "score_delta", "task_id").collect()] == ["a", "c"]


def test_violations(spark):
    a, b = four(spark)
    assert P.pair_violations(a, b, "task_id").count() == 0
    off = b.withColumn("place", 3 - F.col("place"))
    with pytest.raises(ValueError, match="differing_order"):
        P.strict_pairs(a, off, "task_id", ordinal="place")
    bad = b.filter("task_id <> 'a'").union(b.filter("task_id = 'b'")).union(b.limit(1).withColumn("task_id", F.lit(None).cast("string")))
    got = {r["violation"] for r in P.pair_violations(a, bad, "task_id").collect()}
    assert got == {"missing_in_candidate", "duplicate_key_in_candidate", "null_key_in_candidate"}
    with pytest.raises(ValueError):
        P.positional_pairs(a, off.orderBy("place"), "task_id", "place")
    assert P.positional_pairs(a, b, "task_id", "place").count() == 4


@pytest.mark.parametrize("b,c,p", [(23, 60, 5.973595638605141e-05), (125, 118, 0.7003952678088791), (0, 0, 1.0), (1, 1, 1.0), (0, 1, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert spark.range(1).select(S.mcnemar(F.lit(b), F.lit(c))).first()[0] == pytest.approx(p, rel=1e-11)


def test_macro(spark):
    df = spark.createDataFrame([("T-generation", 1.0), ("T-generation", 0.0), ("T-conversion", 0.25), ("V-generation", 0.75), ("V-conversion", 0.0), ("V-conversion", None)], "c string, s double").withColumn("g", F.lit(1))
    r = G.macro_summary(df, ["g"], "c", "s").first()
    assert (r["macro_percent"], r["task_weighted_score"], r["complete"], r["unscored"]) == (37.5, 0.4, False, 1)
    assert G.macro_summary(df.filter("c <> 'V-conversion'"), ["g"], "c", "s").first()["macro_score"] is None
    assert G.macro_summary(df.limit(0), ["g"], "c", "s").count() == 0


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 2, 5, 9, 9, 9, 12, None]], "v int").withColumn("g", F.lit(1))
    for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        v = [1, 1, 2, 5, 9, 9, 9, 12]
        assert G.nearest_percentile(df, ["g"], "v", p, "x").first()["x"] == v[round((len(v) - 1) * p)]
        assert G.floor_percentile(df, ["g"], "v", p, "x").first()["x"] == v[int((len(v) - 1) * p)]
    assert df.limit(0).agg(G.linear_percentile("v", 0.5)).first()[0] == 0.0


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(40)] + [("b", 1, 3.0)], "g string, i int, v double")
    got = {r["g"]: r for r in S.bootstrap_interval(df, ["g"], "v", "i", 200, 1).collect()}
    assert got["b"]["low"] == got["b"]["high"] == 3.0
    assert 1.2 < got["a"]["low"] < 2.0 < got["a"]["high"] < 2.8
    again = {r["g"]: r for r in S.bootstrap_interval(df.orderBy(F.desc("i")), ["g"], "v", "i", 200, 1).collect()}
    assert again == got


def test_numbers_are_contiguous_in_every_group(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(700 if g == "a" else 3)], "g string, i int")
    got = S.numbered(df, ["g"], "i", "slot").collect()
    for g, n in (("a", 700), ("b", 3), (None, 3)):
        assert sorted(r["slot"] for r in got if r["g"] == g) == list(range(n))
    assert S.numbered(df.limit(0), ["g"], "i", "slot").count() == 0


def test_samples_are_balanced_and_repeatable(spark):
    df = spark.createDataFrame([(f"t{i:02d}", f"s{i % 5}", f"c{i % 2}", i) for i in range(20)], "id string, s string, c string, ord int")
    a = [r["id"] for r in M.stratified_round_robin(df, "id", "s", 7, 11).orderBy("selection_index").collect()]
    assert a == [r["id"] for r in M.stratified_round_robin(df.orderBy(F.desc("id")), "id", "s", 7, 11).orderBy("selection_index").collect()]
    sizes = [int(x[1:]) % 5 for x in a]
    assert max(map(sizes.count, range(5))) - min(map(sizes.count, range(5))) <= 1 and len(a) == 7
    assert {r["c"]: r["count"] for r in M.category_balanced(df, "id", "c", "s", 4, 3).groupBy("c").count().collect()} == {"c0": 4, "c1": 4}
    assert [r["id"] for r in M.head(df, "ord", 2).collect()] == ["t00", "t01"]
    assert M.contiguous(df, "ord").first()["contiguous"] and M.contiguous(df.limit(0), "ord").first()["contiguous"]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")] + [(1, 9, None)], "g int, i int, v string")
    assert [(r["v"], r["first"], r["last"], r["length"]) for r in M.runs(df, "g", ["i"], "v").orderBy("first").collect()] == [("a", 0, 1, 2), ("b", 2, 4, 3), ("a", 5, 5, 1), (None, 9, 9, 1)]


def test_gate(spark):
    df = spark.createDataFrame([("a", "x", 4), ("a", "", 4), (None, "y", 2)], "id string, q string, bits int")
    got = {r["rule"]: r["violations"] for r in V.gate(df, "id", ["q"], {"bits": 4}, 2).collect()}
    assert got == {"row_count": 1, "null_key": 1, "repeated_key": 1, "missing_q": 1, "other_bits": 1}
    with pytest.raises(ValueError, match="other_bits: 1"):
        V.assert_gate(V.gate(df, "id", ["q"], {"bits": 4}, 2))


def test_manifest(spark):
    src = spark.createDataFrame([("a", "Text", "JSON", 0), ("a", "Text", "XML", 1), ("b", "CSV", "JSON", 2)], "task_id string, input_type string, output_type string, ord int")
    man = spark.createDataFrame([("b", "CSV", "JSON", 0), ("a", "Text", "XML", 1)], "task_id string, input_type string, output_type string, selection_index int")
    got = P.manifest_rows(src, man, "task_id", "selection_index", "ord").orderBy("manifest_selection_index").collect()
    assert [r["ord"] for r in got] == [2, 1]
    with pytest.raises(Exception, match="no matching source row for z"):
        P.manifest_rows(src, man.withColumn("task_id", F.lit("z")), "task_id", "selection_index", "ord").collect()


def test_order_hash(spark):
    df = spark.createDataFrame([(g, k, i) for g, ks in (("x", "abc"), ("y", "abc"), ("z", "acb")) for i, k in enumerate(ks)], "g string, k string, i int")
    h = {r["g"]: r["order_hash"] for r in P.same_order(df, "g", "k", "i").collect()}
    assert h["x"] == h["y"] != h["z"]
    assert not math.isnan(1.0)
