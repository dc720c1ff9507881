import pytest
from pyspark.sql import functions as F

from lodestrata.functions import arrays as A
from lodestrata.functions import columns as C
from lodestrata.functions import parsers as X


def one(spark, expr, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}

    def kind(v):
        return f"array<{kind(v[0]) if v else 'string'}>" if isinstance(v, list) else kinds.get(type(v), "string")

    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


def test_categories_and_transitions(spark):
    r, i = F.col("r"), F.col("i")
    df = spark.createDataFrame([(True, "Text"), (False, "CSV"), (None, None)], "r boolean, i string")
    assert [x[0] for x in df.select(C.leaderboard_category(r, i)).collect()] == ["V-generation", "T-conversion", "T-conversion"]
    assert one(spark, C.transition(F.col("a"), F.col("b")), a=0.5, b=0.5 + 1e-13) == "unchanged"
    assert one(spark, C.transition(F.col("a"), F.col("b")), a=None, b=0.1) == "improved"


def test_marked_code(spark):
    t = F.col("t")
    text = "x<|BEGIN_CODE|>\n a <|END_CODE|> b <|END_CODE|>"
    assert one(spark, C.marked_code(t), t=text) == "a <|END_CODE|> b"
    assert one(spark, C.marker_issues(t), t="<|END_CODE|> <|BEGIN_CODE|> x") == ["missing_end_marker"]
    assert one(spark, C.marker_issues(t), t="") == ["missing_begin_marker", "missing_end_marker"]
    assert one(spark, C.official_code(t), t="<|BEGIN_CODE|>\n{}<|END_CODE|> x <|END_CODE|>") == "{}"
    assert one(spark, C.official_code(t), t="<|BEGIN_CODE|>a<|END_CODE|>\n```json\n b\n```") == "b"
    assert one(spark, C.json_candidate(t), t='so: {"a": [1]} done') == '{"a": [1]}'
    assert one(spark, C.json_candidate(t), t="so: { open") == "{ open"


def test_tokens_and_terms(spark):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in ("", " \n", "<|END_CODE|>", "abc", "a:", None)], "t string")
    assert [r[0] for r in df.select(C.token_kind(t)).collect()] == ["empty", "whitespace", "structural_marker", "content", "structural_marker", "empty"]
    assert one(spark, C.identifier_parts(t), t="Launch-Date") == ["launch", "date", "launch_date"]
    assert one(spark, C.tail_repeats(t, 2), t=["a", "b", "x", "y", "x", "y", "x", "y"]) == 3
    assert one(spark, C.tail_repeats(t, 2), t=["x", "y", "x"]) == 1
    assert set(one(spark, C.visible_terms(t), t='<code>mission, name, launch\n{"crew": 1}</code> hidden = 2')) == {"crew"}  # a line with blanks is no header
    assert {"mission", "name", "launch", "date", "crew"} <= set(one(spark, C.visible_terms(t), t="To JSON.\n<code>mission_name,launch.date,crew[0].name\nA,2025,B</code>"))
    weights = {r["term"]: r["weight"] for r in one(spark, C.path_terms(t), t="items[0].user_name")}
    assert weights == {"items": 1.0, "user_name": 4.0, "user": 2.0, "name": 2.0}


def test_effective_bits_and_fingerprint(spark):
    assert one(spark, C.effective_bits(F.lit(100), F.lit(10), F.lit(20), F.lit(4), F.lit(8))) == pytest.approx(6.8)
    assert one(spark, C.effective_bits(F.lit(0), F.lit(1), F.lit(2), F.lit(4), F.lit(8))) == 0.0
    assert one(spark, C.set_fingerprint(F.col("t")), t=["b", "a"]) == one(spark, C.set_fingerprint(F.col("t")), t=["a", "b"])


def test_packing(spark):
    v = F.col("v")
    block = A.affine(v, 2)
    assert one(spark, A.packed(block["codes"], 2), v=[0.0, 1.0, 2.0, 3.0]) == [0b11100100]
    assert one(spark, A.unpacked(A.packed(block["codes"], 2), 2, F.lit(4)), v=[0.0, 1.0, 2.0, 3.0]) == [0, 1, 2, 3]
    assert one(spark, A.restored(A.affine(v, 4)), v=[3.5, 3.5]) == [3.5, 3.5]
    with pytest.raises(ValueError):
        A.affine(v, 3)
    with pytest.raises(Exception, match="group size"):
        one(spark, A.groups(v, 3), v=[1.0, 2.0])


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_restored_error_is_half_a_step(spark, bits):
    v = [((i * 37) % 101) / 7 - 5 for i in range(64)]
    got = one(spark, F.flatten(F.transform(A.affine_blocks(F.col("v"), bits, 32), A.restored)), v=v)
    step = (max(v) - min(v)) / (2**bits - 1)
    assert max(abs(a - b) for a, b in zip(got, v)) <= step / 2 + 1e-9


def test_residual_and_protection(spark):
    v = [1.0, 0.3, 0.3, 0.3]
    got = one(spark, A.symmetric_recent(F.col("v"), 2, 1, F.array(F.lit(True), F.lit(False), F.lit(False)), 16), v=v)
    assert got[3] == 0.3 and got[1] == 0.3 and got[2] == 0.0  # the mask is aligned at the right
    assert one(spark, A.sealed_prefix(F.lit(0), F.lit(5), 2, 3)) == 3
    assert one(spark, A.sealed_prefix(F.lit(0), F.lit(4), 2, 3)) == 0


def test_budget(spark):
    assert one(spark, A.first_within_budget(F.col("c"), F.lit(10.0)), c=[5, 9, 3]) == [0, 2]
    mask = lambda order: one(spark, A.token_budget_mask(F.col("c"), F.col("s"), order, 4, 8, 1, 8.0), c=[True] * 5, s=[0.1, 0.9, 0.2, 0.8, 0.0])
    assert mask("prefix") == [True, True, False, False, False]
    assert mask("recent") == [False, False, True, True, False]
    assert mask("score") == [False, True, False, True, False]


def test_paths():
    doc = {"items": [{"name": None}], "o": {"a": 1}}
    ok = lambda p: X.path_exists(doc, X.split_path(p))
    assert ok("items.*.name") and ok("items[0].name") and not ok("items[1]") and not ok("o.*") and ok("o.a")
    assert X.leaves({"a": [], "b": {"c": [1, {}]}}) == {"$.a": "[]", "$.b.c[0]": "1", "$.b.c[1]": "{}"}


def test_parsers(spark):
    rows = [("JSON", '{"a": 1} x'), ("JSON", '{"a"'), ("XML", "<a><b></a>"), ("TOML", "a = 1"), ("CSV", 'a,"b'), ("HTML", "x"), (None, None)]
    kinds = [X.parse_outcome(*r)[0] for r in rows]
    assert kinds == ["extra_content_or_multiple_roots", "unbalanced_or_mismatched_delimiter", "unbalanced_or_mismatched_delimiter", "local_parser_succeeded", "other_parser_error", "unsupported_format", "unsupported_format"]
    df = spark.createDataFrame([('{"x": 7, "age": 8}', '{"x": 7, "age": 9}'), ("{", "{}"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(X.leaf_agreement("a", "b")).collect()]
    assert (got[0]["common_accuracy"], got[0]["f1"], got[0]["exact"]) == (0.5, 0.5, False) and got[1]["f1"] is None and got[2]["f1"] is None
    df = spark.createDataFrame([('{"items": [{"name": "A"}]}', ["items.*.name", "q"]), (None, None), ("x", [])], "d string, r array<string>")
    assert [(r[0]["parsed"], r[0]["share"]) for r in df.select(X.path_report("d", "r")).collect()] == [(True, 0.5), (False, 0.0), (False, 0.0)]
    df = spark.createDataFrame([(1.0, 0.75), (0.0, None)], "r double, p double")
    assert [r[0] for r in df.select(X.final_score("r", "p")).collect()] == [0.8, None]


def test_sizes(spark):
    assert one(spark, C.readable_bytes(F.lit(0))) == "0.0 B"
    assert one(spark, C.readable_bytes(F.lit(1024 * 1536))) == "1.5 MB"
    assert one(spark, C.checkpoint_key(F.lit(7), F.lit("a b/ö"), F.lit(4), F.lit(None).cast("int"), F.lit(2))) == "0007_a_b__K4_V2"


@pytest.mark.parametrize("piece", [" ", "\n", "a, ", "_", "<code>", "{", '"a": ', "```\n", "<a "])
def test_long_texts_take_linear_time(spark, piece):
    text = piece * 30_000 + "x"
    assert one(spark, C.stripped(F.col("t")), t=text).endswith("x")
    assert one(spark, F.size(C.visible_terms(F.col("t"))), t=text) >= 0
    assert one(spark, F.length(C.json_candidate(F.col("t"))), t=text) >= 0
    assert one(spark, F.length(C.official_code(F.col("t"))), t=text) >= 0


def test_first_braces(spark):
    assert one(spark, C.first_braces(F.col("t")), t="a { b { c } d }") == "{ b { c }" and one(spark, C.first_braces(F.col("t")), t="no } {") == ""


def test_official_code_of_every_text_against_brute_force(spark, tmp_path):
    import hashlib
    import re

    from lodestrata.plans.reference_queries import queries

    spaces = ["\u00a0", "\u2000", "\u200a", "\u200b", "\u3000", "\ufeff", " \t\n"]
    shapes = ["{s}a{s}b{s}", "x```json\n{s}a{s}b{s}```y", "<|BEGIN_CODE|>{s}a{s}b{s}<|END_CODE|>", "{s}"]
    texts = [shape.replace("{s}", s) for shape in shapes for s in spaces] + [None]

    def brute(t):
        m = re.search(r"```[^\n]*\n(.*?)(?:```|\Z)", t, re.S) or re.search(r"<\|BEGIN_CODE\|>[ \t]*\n?(.*?)(?:<\|END_CODE\|>|\Z)", t, re.S)
        return (m.group(1) if m else t).strip()

    spark.createDataFrame(list(enumerate(texts)), "eval_id long, text string").write.parquet(f"{tmp_path}/evaluation.parquet")
    got = {r["eval_id"]: r["code"] for r in queries()["official_code_all"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(brute(t).encode()).hexdigest() for i, t in enumerate(texts) if t is not None}
