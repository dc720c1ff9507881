import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm.sampling import ProportionalSample, normal_label, rake, round_and_repair

FIELDS = ["kind", "tier"]


def make(spark, pool, draws, targets, **kw):
    p = spark.createDataFrame([(1, i, *x, "z") for i, x in enumerate(pool)] if pool and len(pool[0]) == 3 else [], "pool_id long, place long, task_id string, kind string, tier string, draw_id string")
    d = spark.createDataFrame(draws, "draw_id long, pool_id long, category_field string, sample_size int")
    t = spark.createDataFrame(targets, "draw_id long, category string, target_share double, min_rows int" + (", category_field string" if targets and len(targets[0]) == 5 else ""))
    return ProportionalSample(p, d, t, FIELDS, order="place", **kw)


POOL = [(f"a{i}", "A", "x") for i in range(60)] + [(f"b{i}", " b\t", "y") for i in range(30)] + [(f"c{i}", "C", "x") for i in range(3)] + [(f"n{i}", None, "y") for i in range(10)]


def shares(s, draw=1):
    return {r["cell"]: r["count"] for r in s.sample().filter(F.col("draw_id") == draw).groupBy("cell").count().collect()}


def test_exact_shares_and_report(spark):
    s = make(spark, POOL + POOL[:5], [(1, 1, "kind", 20)], [(1, "A", 0.5, 1), (1, "B", 0.45, 1), (1, "C", 0.05, 1)])
    assert shares(s) == {"kind=a": 10, "kind=b": 9, "kind=c": 1}
    assert s.sample().select("task_id").distinct().count() == 20
    assert s.report().filter("gap > 0").count() == 0


def test_unmet_targets(spark):
    s = make(spark, POOL, [(1, 1, "kind", 40)], [(1, "A", 0.5, 1), (1, "B", 0.3, 1), (1, "C", 0.1, 5), (1, "Missing", 0.1, 2)])
    assert {(r["category"], r["available"], r["needed"], r["gap"]) for r in s.report().filter("gap > 0").collect()} == {("C", 3, 5, 2), ("Missing", 0, 4, 4)}
    assert shares(s) == {"kind=a": 20, "kind=b": 12, "kind=c": 3}


def test_minimum_is_repaired_by_others(spark):
    s = make(spark, POOL, [(1, 1, "kind", 20)], [(1, "A", 0.5, 1), (1, "B", 0.5, 1), (1, "C", 0.0, 3)])
    got = shares(s)
    assert got["kind=c"] == 3 and sum(got.values()) == 20


def test_edges(spark):
    s = make(spark, POOL, [(1, 1, "kind", 0), (2, 9, "kind", 5), (3, 1, "kind", None)], [(1, "A", 1.0, 0), (2, "A", 1.0, 1)])
    assert s.sample().count() == 0
    assert [(r["draw_id"], r["gap"]) for r in s.report().orderBy("draw_id").collect()] == [(1, 0), (2, 5)]
    empty = make(spark, [], [], [])
    assert empty.sample().count() == 0 and empty.report().count() == 0


def test_repeatable_and_seeded(spark):
    args = (spark, POOL, [(1, 1, "kind", 20)], [(1, "A", 0.5, 1), (1, "B", 0.5, 1)])
    ids = lambda s: sorted(r["task_id"] for r in s.sample().collect())
    assert ids(make(*args)) == ids(make(*args)) != ids(make(*args, seed=7))


def test_two_margins(spark):
    targets = [(1, "A", 0.6, 1, "kind"), (1, "B", 0.4, 1, "kind"), (1, "x", 0.6, 1, "tier"), (1, "y", 0.4, 1, "tier")]
    s = make(spark, POOL, [(1, 1, None, 20)], targets)
    assert shares(s) == {"kind=a=tier=x": 12, "kind=b=tier=y": 8}


def test_margins_that_contradict_one_another(spark):
    pool = [(f"a{i}", "A", "x") for i in range(40)] + [(f"b{i}", "B", "y") for i in range(40)]
    targets = [(1, "A", 0.8, 1, "kind"), (1, "B", 0.2, 1, "kind"), (1, "x", 0.2, 1, "tier"), (1, "y", 0.8, 1, "tier")]
    s = make(spark, pool, [(1, 1, None, 40)], targets)
    assert shares(s) == {"kind=a=tier=x": 20, "kind=b=tier=y": 20}
    got = {(r["category"], r["needed"], r["sampled"], r["gap"], r["shortfall"], r["contradicted"]) for r in s.report().collect()}
    assert got == {("A", 32, 20, 12, 0, True), ("B", 8, 20, 0, 0, False), ("x", 8, 20, 0, 0, False), ("y", 32, 20, 12, 0, True)}


def test_small_pools_against_all_samples():
    """On pools of up to 9 rows and two margins, no other sample is much nearer to the targets than the raked one."""
    rng = np.random.default_rng(4)
    codes = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    for _ in range(40):
        counts, size = rng.integers(1, 4, 4).astype(float), 4
        targets = [{0: a, 1: size - a} for a in map(float, rng.integers(1, 4, 2))]
        fit = rake(counts, codes, targets, size)
        quota = round_and_repair(fit, counts, codes, targets, [{}, {}], size)

        def miss(q, targets=targets):
            return sum(abs(q[codes[:, m] == c].sum() - w) for m, t in enumerate(targets) for c, w in t.items())

        every = [np.array(q) for q in np.ndindex(*(int(c) + 1 for c in counts)) if sum(q) == size]
        assert (quota <= counts).all() and quota.sum() <= size and miss(quota) <= min(map(miss, every)) + 2


def test_raking_meets_margins_where_cells_allow():
    counts = np.array([50.0, 20, 30, 100])
    codes = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    targets = [{0: 30.0, 1: 30.0}, {0: 40.0, 1: 20.0}]
    fit = rake(counts, codes, targets, 60)
    assert abs(fit[:2].sum() - 30) < 1e-3 and abs(fit[[0, 2]].sum() - 40) < 1e-3 and (fit <= counts + 1e-9).all()
    q = round_and_repair(fit, counts, codes, targets, [{0: 1, 1: 1}, {}], 60)
    assert q.sum() == 60 and (q <= counts).all()


def test_labels(spark):
    cases = {"A b": "a b", " A\t": "a", "\u00a0\u3000x y\u200b": "x y", "": "", " ": "", "Ä ": "ä", "a\n": "a", "x": "x", " " * 100_000 + "z" + " " * 100_000: "z", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(normal_label(F.col("t"))).collect()] == list(cases.values())
