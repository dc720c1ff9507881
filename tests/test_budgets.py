import pytest
from pyspark.sql import functions as F

from lodestrata.operators import budgets as B

SHAPE = dict(layers=1, heads=1, dim=4, group=4, residual=4, key_bits=4, value_bits=4, protected_bits=8)


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<boolean>' if isinstance(v[0], bool) else 'array<double>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


def masked(spark, shape, mask):
    return one(spark, B.stored_bytes(shape, F.size("m"), F.col("m")), m=mask)


@pytest.mark.parametrize("target,chosen", [("keys", [0]), ("values", [0, 1])])
def test_key_groups_pay_once_and_values_per_token(spark, target, chosen):
    shape = B.StorageShape(**SHAPE, target=target)
    wanted = [i in chosen for i in range(8)]
    size = masked(spark, shape, wanted)
    assert size > masked(spark, shape, [False] * 8)
    bits = size * 8 / (2 * 8 * 4)
    got = one(spark, B.byte_budget_mask(shape, F.col("m"), "prefix", bits), m=[True] * 8)
    assert got == wanted
    assert masked(spark, shape, got) <= one(spark, B.target_bytes(shape, F.lit(8), bits))


def test_orders_and_skipping(spark):
    shape = B.StorageShape(**SHAPE)
    scores = [0.1, 0.9, 0.2, 0.8, 0.3, 0.0, 0.0, 0.0]
    for order in ("prefix", "recent", "score"):
        got = one(spark, B.byte_budget_mask(shape, F.col("m"), order, 15.0, F.col("s")), m=[True] * 8, s=scores)
        assert masked(spark, shape, got) <= one(spark, B.target_bytes(shape, F.lit(8), 15.0))
    assert one(spark, B.ordered_candidates(F.col("m"), F.col("s"), "score"), m=[True] * 7 + [False], s=scores) == [1, 3, 4, 2, 0, 5, 6]
    assert one(spark, B.byte_budget_mask(shape, F.col("m"), "prefix", 1.0), m=[True] * 8) == [False] * 8
    with pytest.raises(ValueError):
        B.StorageShape(**{**SHAPE, "dim": 6})
    with pytest.raises(ValueError):
        B.ordered_candidates(F.col("m"), None, "score")


def test_full_precision_fallbacks(spark):
    df = spark.createDataFrame([(5.0, 1, 1, None, None), (0.0, 3, 2, None, None), (None, None, 2, 6.0, 4)], "r double, p int, g int, x double, s int")
    none = F.lit(None).cast("int")
    got = [r[0] for r in df.select(B.full_precision_bytes(F.col("r"), F.col("p"), F.col("g"), F.col("x"), F.col("s"), none, F.lit(0), F.lit(8))).collect()]
    assert got == [5.0, 5 * 28 * 4 * 8 * 4.0, 10 * 28 * 4 * 8 * 4.0]


def test_channel_scales(spark):
    df = spark.createDataFrame([(1, [1.0, 10.0]), (1, [0.4, -7.0]), (None, [2.0, 2.0]), (2, [])], "g int, v array<double>")
    got = [r["quantised"] for r in B.quantised_cache(df, ["g"], "v", 2, "channel").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [[1.0, 10.0], [0.0, -10.0], [2.0, 2.0], None]))
    tok = [r["quantised"] for r in B.quantised_cache(df, ["g"], "v", 2).collect()]
    assert tok[0] == [0.0, 10.0] and tok[3] == []


def test_budget_report(spark):
    tasks = spark.createDataFrame([("a", '{"user": {"name": 1}} text more text', ["user.name"]), ("b", "", None)], "id string, q string, paths array<string>")
    per = B.budget_per_task(tasks, "id", "q", "paths", 4, 8, 2, 8.0, "score")
    a, b = per.orderBy("id").collect()
    assert a["n_protected"] <= a["n_candidates"] and 4 <= a["bits"] <= 16 and 0 < a["score_share"] <= 1 and b["tokens"] == 0 and b["bits"] == 0
    s = B.budget_summary(per).first()
    assert s["n_rows"] == 2 and s["p90_tokens"] == a["tokens"]
    assert B.budget_summary(per.limit(0)).count() == 0
    assert B.compression(B.StorageShape(**SHAPE), 4000) > 1


def test_own_tokenizer(spark):
    from lodestrata.operators.budgets import budget_per_task

    df = spark.createDataFrame([(1, "a{b}c", ["x.y"]), (2, None, None)], "id long, prompt string, paths array<string>")
    args = ("id", "prompt", "paths", 4, 8, 0, 16.0, "score")
    letters = budget_per_task(df, *args, tokenize=lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ""), lambda c: c != "")).orderBy("id").collect()
    assert [r["tokens"] for r in letters] == [5, 0] and letters[0]["n_candidates"] == 2
    assert budget_per_task(df, *args).orderBy("id").first()["tokens"] == 5
