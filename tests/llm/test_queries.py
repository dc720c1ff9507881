import os

import pytest

from lodestrata.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COLUMNS = {"p1_found": ["draw_id", "category"], "p2_found": ["eval_id", "defect"], "p4_found": ["eval_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS[name] and len(df.collect()) == df.distinct().count() > 0


def test_unmet_targets_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM '{SMALL}/{f}'")
    want = sorted(con.execute(Q.oracle_sql()["p1_found"]).fetchall())
    assert sorted(map(tuple, Q.p1_found(spark, SMALL).collect())) == want


def test_samples_meet_what_the_pool_can(spark):
    report = {(r["draw_id"], r["category"]): r for r in Q.p1_targets(spark, SMALL).collect()}
    sizes = {r["draw_id"]: r["sample_size"] for r in spark.read.parquet(f"{SMALL}/sample_draws.parquet").collect()}
    sample = Q.p1_sample(spark, SMALL).collect()
    assert len({(r["draw_id"], r["task_id"]) for r in sample}) == len(sample)
    for draw, size in sizes.items():
        mine = [r for (d, _), r in report.items() if d == draw]
        assert sum(r["sampled"] for r in mine) == sum(r["draw_id"] == draw for r in sample) <= size
        if not any(r["gap"] for r in mine):
            floors = [r for r in mine if r["sampled"] < min(r["needed"], r["available"])]
            assert not floors or sum(r["needed"] for r in mine) > size


def test_joint_margins(spark):
    report = Q.p1_margins(spark, SMALL).collect()
    assert max(len({r["field"] for r in report if r["draw_id"] == d}) for d in {r["draw_id"] for r in report}) == 3
    sample = Q.p1_margin_sample(spark, SMALL).collect()
    assert sample and len({(r["draw_id"], r["task_id"]) for r in sample}) == len(sample)
    for r in report:
        assert r["gap"] == max(0, r["needed"] - r["sampled"]) >= (r["shortfall"] if r["sampled"] <= r["available"] else 0)
