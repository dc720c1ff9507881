"""Deterministic samples and manifests: stratified, category-balanced, round-robin, head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validate import checked_categories


def shuffle_key(seed: int, *parts: str) -> Column:
    """A portable pseudo-random order: md5 of seed and columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def stratified_round_robin(df: DataFrame, key: str, stratum: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows, one stratum after the other in shuffled order, each stratum shuffled: sizes differ by one at most where strata last.

    Adds ``selection_index``.  Only rows within the limit of their stratum reach the
    final ordering.
    """
    within = Window.partitionBy(stratum).orderBy(shuffle_key(seed, key), key)
    ranked = df.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= limit)
    ordered = ranked.orderBy("_rn", shuffle_key(seed, stratum), stratum).limit(limit)
    return ordinal(ordered.drop("_rn"), "selection_index", shuffle_key(seed + 1, key), F.col(key))


def category_balanced(df: DataFrame, key: str, category: str, stratum: str, per_category: int, seed: int) -> DataFrame:
    """The same number of rows of every category, round-robin over its strata; fewer where a category has too few."""
    within = Window.partitionBy(category, stratum).orderBy(shuffle_key(seed, key), key)
    turn = Window.partitionBy(category).orderBy("_rn", shuffle_key(seed, stratum), stratum)
    picked = df.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= per_category).withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= per_category)
    return ordinal(picked.drop("_rn", "_turn"), "selection_index", shuffle_key(seed + 1, key), F.col(key))


def complete_categories(df: DataFrame, category: str, wanted: list[str], order: str, seed: int, known: list[str]) -> DataFrame:
    """Every row of the wanted categories in source order, with ``selection_index``, ``sampling`` and ``seed``; a category without rows is an error.

    The index counts rows of earlier coarse ranges of the order first, so no task
    numbers all rows.
    """
    checked_categories(wanted, known)
    rows = df.filter(F.col(category).isin(wanted))
    seen = {r[0] for r in rows.select(category).distinct().collect()}
    if set(wanted) - seen:
        raise ValueError(f"no rows of the categories {sorted(set(wanted) - seen)}")
    part = rows.withColumn("_part", F.floor(F.col(order) / 100_000))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = part.join(sizes.drop("_n"), "_part").withColumn("selection_index", F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    return local.drop("_part", "_offset").withColumns({"sampling": F.lit("category-complete"), "seed": F.lit(seed)})


def round_robin(df: DataFrame, category: str, order: str, limit: int) -> DataFrame:
    """The first rows of each category in turn, without shuffling."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(category).orderBy(order))).filter(F.col("_rn") <= limit)
    return ranked.orderBy("_rn", category).limit(limit).drop("_rn")


def head(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows by an ordinal."""
    return df.orderBy(order).limit(limit)


def ordinal(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Contiguous numbers from 0 in a given order (for bounded selections: one task numbers them)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def contiguous(df: DataFrame, index: str) -> DataFrame:
    """One row: whether an index runs from 0 without gaps and repeats."""
    return df.agg(F.count("*").alias("n_rows"), ((F.coalesce(F.max(index), F.lit(-1)) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*")) & (F.coalesce(F.min(index), F.lit(0)) == 0)).alias("contiguous"))


def first_per(df: DataFrame, group: str, order: str) -> DataFrame:
    """The first row of each group, as a partial aggregate: no window, no sort."""
    return df.groupBy(group).agg(F.min_by(F.struct("*"), order).alias("_r")).select("_r.*")


def runs(df: DataFrame, group: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Runs of equal neighbours: (group, run_no, value, first, last, length) by the first order column.

    bucket: a coarsening of the order (a day of a timestamp); rows are then sorted
    within (group, bucket) only and joined to the bucket before by its last value
    and its number of runs, so a hot group is never sorted by one task.
    """
    rows = df.withColumn("_b", F.lit(0) if bucket is None else bucket)
    w = Window.partitionBy(group, "_b").orderBy(*order)
    rows = rows.withColumn("_prev", F.lag(F.struct(value)).over(w))
    last = rows.groupBy(group, "_b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(group).orderBy("_b")
    before = last.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.lag("_last").over(across).alias("_before"))
    joined = rows.join(before, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_bb")))
    prev = F.coalesce("_prev", "_before")
    flagged = joined.withColumn("_new", F.when(prev.isNull() | ~prev[value].eqNullSafe(F.col(value)), 1).otherwise(0))
    local = flagged.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = flagged.groupBy(group, "_b").agg(F.sum("_new").alias("_n"))
    prefix = starts.select(F.col(group).alias("_g2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    numbered = local.join(prefix, F.col(group).eqNullSafe(F.col("_g2")) & F.col("_b").eqNullSafe(F.col("_b2"))).withColumn("run_no", F.col("_offset") + F.col("_local"))
    return numbered.groupBy(group, "run_no").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))
