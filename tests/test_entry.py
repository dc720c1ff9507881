import math
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def entry():
    import __spark_entry__

    return __spark_entry__


def test_every_sql_has_its_query():
    e = entry()
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_without_the_llm_subpackage():
    code = "import sys; sys.modules['lodestrata.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p2_found' not in e.queries(); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestrata")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n), encoding="utf-8").read(), n


@needs_data
def test_flagship(spark):
    rows = entry().entry(spark).orderBy("bits").collect()
    assert [r["bits"] for r in rows] == [2, 4] and all(0 <= r["p_value"] <= 1 and r["low"] <= r["mean_delta"] <= r["high"] for r in rows)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


def _core():
    from lodestrata.plans import artifact_queries, problem_queries, reference_queries

    modules = (reference_queries, artifact_queries, problem_queries)
    return {k: f for m in modules for k, f in m.queries().items()}, {k: s for m in modules for k, s in m.oracle_sql().items()}


@needs_data
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM '{SMALL}/{f}'")
    queries, sql = _core()
    wrong = []
    for name, text in sql.items():
        df = queries[name](spark, SMALL)
        cols = sorted(df.columns)
        got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
        done = con.execute(text)
        names = [d[0] for d in done.description]
        want = sorted(str([_plain(r[names.index(c)]) for c in cols]) for r in done.fetchall()) if sorted(names) == cols else names
        if got != want:
            wrong.append(name)
    assert wrong == []
