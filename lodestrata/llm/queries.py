"""Registered queries of the training-data operators for language models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from .answers import answer_defects, truncated_answers, truncation_by_source
from .leakage import find_leaks
from .packing import fill_report, pack, token_counts
from .residue import find_residue
from .sampling import ProportionalSample

FIELDS = ["leaderboard_category", "stratum", "output_type"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _draws(spark: SparkSession, sf_dir: str) -> ProportionalSample:
    pool = _t(spark, sf_dir, "allformats_100_category_balanced_seed42")
    return ProportionalSample(pool, _t(spark, sf_dir, "sample_draws"), _t(spark, sf_dir, "sample_targets"), FIELDS, order="selection_index")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir).report().filter("gap > 0 AND shortfall > 0").select("draw_id", "category")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir).sample()


def p1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir).report()


def _joint(spark: SparkSession, sf_dir: str) -> ProportionalSample:
    """One draw per pool by all margins for which the pool has draws, each margin with the targets of its first draw, of the least size."""
    draws = _t(spark, sf_dir, "sample_draws")
    firsts = draws.groupBy("pool_id", "category_field").agg(F.min("draw_id").alias("own"), F.min("sample_size").alias("size"))
    joint = firsts.groupBy("pool_id").agg(F.min("own").alias("draw_id"), F.min("size").alias("sample_size")).withColumn("category_field", F.lit(None).cast("string"))
    whose = firsts.select("pool_id", "category_field", F.col("own").alias("draw_id")).join(_t(spark, sf_dir, "sample_targets"), "draw_id").drop("draw_id")
    targets = whose.join(joint.select("pool_id", "draw_id"), "pool_id").drop("pool_id")
    return ProportionalSample(_t(spark, sf_dir, "allformats_100_category_balanced_seed42"), joint, targets, FIELDS, order="selection_index")


def p1_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one draw per pool over up to three margins at once."""
    return _joint(spark, sf_dir).report()


def p1_margin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir).sample()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects(_t(spark, sf_dir, "evaluation"), "eval_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_answers(_t(spark, sf_dir, "evaluation"), "eval_id").filter("truncated").select("eval_id")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(truncated_answers(_t(spark, sf_dir, "evaluation"), "eval_id")).withColumnRenamed("answer_source", "export_source")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["container_kind"]: r["capacity_tokens"] for r in _t(spark, sf_dir, "containers").collect()}


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stage(token_counts(_t(spark, sf_dir, "documents"), "doc_id"), "tokens")
    return pack(items, _capacities(spark, sf_dir))


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("item_key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir), _capacities(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "heldout_items"), "doc_id", "item_id").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(_t(spark, sf_dir, "documents"), "doc_id").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_sample, p1_targets, p1_margins, p1_margin_sample, p2_found, p4_found, p4_sources, p7_assignment, p7_fill, p8_found, p9_found)
    return {f.__name__: f for f in made}


_LABEL = r"lower(regexp_replace({}, '^[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}\x{{feff}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}\x{{feff}}]+$', '', 'g'))"

_HOLDS = (
    "WITH x AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT pool_id, '{f}' AS field, {_LABEL.format(f)} AS label, task_id FROM allformats_100_category_balanced_seed42 WHERE {f} IS NOT NULL AND task_id IS NOT NULL" for f in FIELDS)
    + "), h AS (SELECT pool_id, field, label, count(*) AS n FROM x GROUP BY 1, 2, 3), g AS ("
    + f"SELECT t.draw_id, t.category, coalesce(h.n, 0) AS n, greatest(coalesce(t.min_rows, 0), CAST(round(t.target_share * d.sample_size) AS BIGINT)) AS need FROM sample_targets t JOIN sample_draws d USING (draw_id) LEFT JOIN h ON h.pool_id = d.pool_id AND h.field = d.category_field AND h.label = {_LABEL.format('t.category')}) "
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _HOLDS + "SELECT draw_id, category FROM g WHERE n < need"}
