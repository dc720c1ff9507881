"""Position-level comparison of token traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("structural_marker", "control_marker")


def positions(traces: DataFrame) -> DataFrame:
    """One row per position that is not null, with its trace, task and places."""
    tasks = traces.select("trace_id", "run_condition", F.posexplode("task_traces").alias("task_ord", "t")).filter(F.col("t").isNotNull())
    return tasks.select("trace_id", "run_condition", "task_ord", F.col("t.task_id").alias("task_id"), F.posexplode("t.positions").alias("item_ord", "p")).filter(F.col("p").isNotNull()).select("trace_id", "run_condition", "task_ord", "task_id", "item_ord", "p.*")


def disagreements(pos: DataFrame, *groups: str) -> DataFrame:
    """Positions whose best token is not the target, by kind, and the first such place; null tokens do not count."""
    off = F.col("top1_token_id") != F.col("target_token_id")
    structural = F.col("target_token_kind").isin(*STRUCTURAL)
    both = F.col("top1_token_id").isNotNull() & F.col("target_token_id").isNotNull()
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = pos.filter(both).groupBy(*groups).agg(
        F.count("*").alias("positions"),
        F.count_if(off).alias("disagreements"),
        F.count_if(structural).alias("structural_positions"),
        F.count_if(structural & off).alias("structural_disagreements"),
        F.min(F.when(off, F.col("item_ord"))).alias("first_disagreement"),
    )
    return sums.withColumn("disagreement_share", ratio(F.col("disagreements"), F.col("positions"))).withColumn("structural_share", ratio(F.col("structural_disagreements"), F.col("structural_positions")))


def header_violations(base: DataFrame, cand: DataFrame, fields: list[str]) -> DataFrame:
    """(field, base_values, cand_values) of header fields whose sets of values differ between two sides."""
    out = None
    for f in fields:
        b, c = (df.agg(F.array_sort(F.collect_set(F.coalesce(F.col(f).cast("string"), F.lit("null")))).alias(n)) for df, n in ((base, "b"), (cand, "c")))
        one = b.select(F.lit(f).alias("field"), "b").join(c.select(F.lit(f).alias("field"), "c"), "field").filter("b <> c").select("field", F.col("b").alias("base_values"), F.col("c").alias("cand_values"))
        out = one if out is None else out.unionByName(one)
    return out


def aligned(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Positions of two runs side by side, by task and prediction index: whether targets and best tokens agree.

    A task or an index that one side repeats is taken once, at its first place.
    """
    one = lambda df, s: positions(df).filter(F.col("prediction_index").isNotNull() & F.col("task_id").isNotNull()).groupBy("task_id", "prediction_index").agg(F.min_by(F.struct("target_token_id", "top1_token_id", "target_token_kind"), F.struct("trace_id", "task_ord", "item_ord")).alias(s))
    j = one(base, "b").join(one(cand, "c"), ["task_id", "prediction_index"])
    return j.select("task_id", "prediction_index", F.col("b.target_token_kind").alias("kind"), F.col("b.target_token_id").eqNullSafe(F.col("c.target_token_id")).alias("same_target"), F.col("b.top1_token_id").eqNullSafe(F.col("c.top1_token_id")).alias("same_best"))


#: Header and task fields on which two traces must agree.
HEADER = ("trace_method", "model_name_or_path", "model_revision", "kivi_commit", "seed", "selected_task_ids")
TASK = ("input_type", "output_type", "prompt_tokens", "frozen_token_ids")


def pair_violations(base: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """(``key``, ``violation``, ``task_id``): all that forbids comparing two traces position by position, for pairs with the same key.

    Kinds: header_<field>; task_order, where the lists of task ids differ (a repeated
    id counts at its first place); and, for tasks of both, task_<field> (arrays as a
    whole, null equals null) and position_count.  Each side must have one trace a key.
    """
    b, c = (df.select(F.col(key).alias("k"), F.struct(*HEADER).alias("h"), F.filter(F.coalesce("task_traces", F.array()), lambda t: t.isNotNull()).alias("t")) for df in (base, cand))
    j = b.alias("b").join(c.alias("c"), "k").select("k", F.col("b.h").alias("bh"), F.col("c.h").alias("ch"), F.col("b.t").alias("bt"), F.col("c.t").alias("ct"))
    ids = lambda t: F.array_distinct(F.transform(t, lambda x: x["task_id"]))
    heads = [F.when(~F.col(f"bh.{f}").eqNullSafe(F.col(f"ch.{f}")), F.lit(f"header_{f}")) for f in HEADER] + [F.when(~ids(F.col("bt")).eqNullSafe(ids(F.col("ct"))), F.lit("task_order"))]
    header = j.select("k", F.explode(F.array_compact(F.array(*heads))).alias("violation"), F.lit(None).cast("string").alias("task_id"))
    last = lambda t, x: F.element_at(F.filter(t, lambda y: y["task_id"].eqNullSafe(x)), -1)
    shared = j.select("k", "bt", "ct", F.explode(F.array_intersect(ids(F.col("bt")), ids(F.col("ct")))).alias("id")).select("k", F.col("id").alias("task_id"), last(F.col("bt"), F.col("id")).alias("x"), last(F.col("ct"), F.col("id")).alias("y"))
    count = lambda t: F.coalesce(F.when(t["positions"].isNotNull(), F.size(t["positions"])), F.lit(0))
    found = [F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f"task_{f}")) for f in TASK] + [F.when(count(F.col("x")) != count(F.col("y")), F.lit("position_count"))]
    tasks = shared.select("k", F.explode(F.array_compact(F.array(*found))).alias("violation"), "task_id")
    return header.unionByName(tasks).withColumnRenamed("k", key)
