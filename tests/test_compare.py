import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators.compare import Field, compare_copies

SCHEMA = "run_id long, task_id string, query string, score double, query_1 string"
FIELDS = [Field("query"), Field("score", 1e-6)]


def diff(spark, a, b, keys=None, per=2):
    left, right = (spark.createDataFrame([(*r, "x") for r in rows], SCHEMA) for rows in (a, b))
    out = compare_copies(left, right, keys or {"run_id": None, "task_id": "number"}, FIELDS, "missing_left", "missing_right", per)
    return sorted(map(tuple, out.collect()), key=str)


def test_notation_is_no_difference(spark):
    a = [(1, "000042", "café\nline", 0.5), (1, "000043", "x", None)]
    b = [(1, "42", "café  \r\nline \n", 0.5 + 9e-7), (1, " 00000043 ", "x", None)]
    assert diff(spark, a, b) == []


def test_plain_text(spark):
    import time

    from pyspark.sql import functions as F

    from lodestrata.operators.compare import plain_text

    cases = {"a \t\r\nb\u3000\nc\x0c\rd \n\n": "a\nb\nc\nd", "  a  b": "  a  b", "": "", " ": "", "\n\n": "", "e\u0301 ": "é", "x\u00a0": "x", "a \n": "a", "a\tb": "a\tb", " \n a": "\n a"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert [r[0] for r in df.select(plain_text(F.col("t"))).collect()] == [*cases.values(), None]
    long = spark.createDataFrame([(c * 300_000 + "x \n",) for c in (" ", "\n", "\u3000", " \n")], "t string")
    began = time.time()
    assert long.select(F.length(plain_text(F.col("t")))).count() == 4 and time.time() - began < 60


def test_every_kind(spark):
    a = [(1, "1", "x", 0.5), (1, "2", "y", 0.1), (2, "3", None, 0.2), (3, "4", "q", None), (3, "5", "only", 1.0)]
    b = [(1, "1", " x", 0.5), (1, "2", "y", 0.1001), (2, "3", "", 0.2), (3, "4", "q", 0.0), (4, "9", "new", 1.0)]
    assert diff(spark, a, b) == sorted([(1, "000001", "query"), (1, "000002", "score"), (2, "000003", "query"), (3, "000004", "score"), (3, "000005", "missing_right"), (4, "000009", "missing_left")], key=str)


def test_repeats_nulls_and_empty_tables(spark):
    a = [(1, "1", "x", 0.5)] * 3 + [(None, None, None, None)]
    assert diff(spark, a, a[:1] + a[3:] * 2) == []
    assert diff(spark, a, []) == [(1, "000001", "missing_right"), (None, None, "missing_right")]
    assert diff(spark, [], []) == []


def test_clashing_column_names(spark):
    a, b = (spark.createDataFrame([(1, "1", q, 0.5)], "leaf long, term string, a string, n double") for q in "xy")
    out = compare_copies(a, b, {"leaf": None, "term": "number"}, [Field("a"), Field("n", 1e-6)], "l", "r")
    assert [tuple(r) for r in out.collect()] == [(1, "000001", "a")] and out.columns == ["leaf", "term", "diff_kind"]


def test_several_versions_compare_as_sets(spark):
    a = [(1, "1", "a", 0.1), (1, "1", "b", 0.9)]
    assert diff(spark, a, list(reversed(a))) == []
    assert diff(spark, a, [(1, "1", "a", 0.1), (1, "1", "c", 0.9)]) == [(1, "000001", "query")]
    between = [(1, "1", "a", 0.1), (1, "1", "b", 0.5), (1, "1", "c", 0.9)]
    assert diff(spark, between, [(1, "1", "a", 0.1), (1, "1", "bb", 0.5), (1, "1", "c", 0.9)]) == [(1, "000001", "query")]
    assert diff(spark, between, [(1, "1", "a", 0.1), (1, "1", "b", 0.6), (1, "1", "c", 0.9)]) == [(1, "000001", "score")]
    near = [(1, "1", "a", 0.1 + 4e-7), (1, "1", "b", 0.5 - 9e-7), (1, "1", "c", 0.9), (1, "1", "c", 0.9 + 5e-7)]
    assert diff(spark, between, near) == [] == diff(spark, near, between)
    assert diff(spark, [(None, "1", None, None), (None, "1", "a", None)], [(None, "1", "a", None), (None, "1", "a", float("nan"))]) == [(None, "000001", "query"), (None, "000001", "score")]
    large = [(1, "1", "a", 1e300), (1, "1", "a", float("inf")), (1, "1", "a", -0.0)]
    assert diff(spark, large, [(1, "1", "a", 1e300), (1, "1", "a", float("inf")), (1, "1", "a", 0.0)]) == []
    assert diff(spark, large, [(1, "1", "a", 1.1e300), (1, "1", "a", float("inf")), (1, "1", "a", 0.0)]) == [(1, "000001", "score")]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(*[st.lists(st.tuples(st.integers(0, 2), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 0.0, 4e-7, 1e-6, 2.5e-6])), max_size=12)] * 2)
def test_versions_against_brute_force(spark, x, y):
    want = []
    for k in {r[0] for r in x} | {r[0] for r in y}:
        a, b = ([r for r in z if r[0] == k] for z in (x, y))
        if not a or not b:
            want.append((k, "000007", "missing_left" if b else "missing_right"))
            continue
        if {r[1] for r in a} != {r[1] for r in b}:
            want.append((k, "000007", "query"))

        def partner(v, rows):
            return any(v is w is None or None not in (v, w) and abs(v - w) <= 1e-6 for w in (r[2] for r in rows))

        if not all(partner(r[2], b) for r in a) or not all(partner(r[2], a) for r in b):
            want.append((k, "000007", "score"))
    rows = [[(k, "7", q, s) for k, q, s in z] for z in (x, y)]
    assert diff(spark, *rows) == sorted(want, key=str)


def test_equal_ranges_are_not_read_deeper(spark):
    from lodestrata.operators.compare import DIFFER, _side, compared_ranges, laid_out
    from pyspark.sql import functions as F

    left = spark.range(20_000).select(F.col("id").alias("run_id"), F.lit("1").alias("task_id"), F.col("id").cast("string").alias("query"), F.lit(0.5).alias("score"))
    right = left.withColumn("query", F.when(F.col("run_id") == 77, "other").otherwise(F.col("query")))
    keys = {"k_0": F.col("run_id")}
    for other, sizes in ((right, [4, 10, 12]), (left, [4])):
        rows = laid_out(_side(left, keys, FIELDS, True).unionByName(_side(other, keys, FIELDS, False)), ["k_0"], FIELDS, 40_000, 4, 12)
        levels, inside = compared_ranges(rows, 4, 12)
        assert [size for size, _ in levels] == sizes
        compared = [df.count() for _, df in levels]
        differ = [df.filter(DIFFER).count() for _, df in levels]
        if other is left:
            assert compared == [16] and differ == [0] and inside.count() == 0
            continue
        assert differ == [1, 1, 1] and compared[0] == 16 and compared[1] <= 64 and compared[2] <= 4
        assert 0 < inside.count() < 60
        top = [r["top"] for r in inside.select("top").distinct().collect()]
        files = [f for f in rows.inputFiles() if spark.read.parquet(f).filter(F.col("top") == top[0]).count()]
        assert len(top) == 1 and len(files) == 1 < len(rows.inputFiles())  # the finer levels open one file of all
        assert f"In(top, [{top[0]}])" in levels[1][1]._jdf.queryExecution().toString() or f"EqualTo(top,{top[0]})" in levels[1][1]._jdf.queryExecution().toString()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 300), st.integers(0, 3), max_size=120), st.dictionaries(st.integers(0, 300), st.integers(0, 3), max_size=120))
def test_against_brute_force(spark, x, y):
    want = [(k, "000007", "missing_right") for k in x.keys() - y.keys()] + [(k, "000007", "missing_left") for k in y.keys() - x.keys()]
    want += [(k, "000007", "query") for k in x.keys() & y.keys() if x[k] != y[k]]
    rows = [[(k, "7", f"t{v}", 0.0) for k, v in z.items()] for z in (x, y)]
    assert diff(spark, *rows) == sorted(want, key=str)
    assert list(itertools.chain(diff(spark, rows[0], rows[0]))) == []
