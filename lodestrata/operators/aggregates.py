"""Category means, configuration matrices, profiles and the percentiles of the reports.

The rounding order of each summary is part of its definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY_SIZES, guarded_ratio, parsed_ok, score_or_zero, set_fingerprint


def category_means(df: DataFrame, group: list[str], category: str, score: str) -> DataFrame:
    """Per group and category: scored and unscored rows and the mean of the scored ones."""
    return df.groupBy(*group, category).agg(F.count(score).alias("scored"), F.count_if(F.col(score).isNull()).alias("unscored"), F.avg(score).alias("mean_score"))


def macro_summary(df: DataFrame, group: list[str], category: str, score: str, expected: dict[str, int] | None = None) -> DataFrame:
    """Unweighted mean of the category means, and the mean over all rows, as fractions and percents.

    macro_* is null unless every expected category has a scored row.  Rounding is
    last: fractions to 6 places, percents to 2.  complete: exactly the expected
    rows, all scored.
    """
    expected = expected or CATEGORY_SIZES
    cats = category_means(df, group, category, score).filter(F.col(category).isin(list(expected)))
    sizes = F.coalesce(*[F.when(F.col(category) == k, F.lit(v)) for k, v in expected.items()])
    both = cats.withColumn("_exact", (F.col("scored") == sizes) & (F.col("unscored") == 0)).groupBy(*group).agg(
        F.avg("mean_score").alias("_macro"), F.count("mean_score").alias("categories"), (F.sum(F.col("mean_score") * F.col("scored")) / F.sum("scored")).alias("_micro"), F.sum("scored").alias("scored"), F.sum("unscored").alias("unscored"), F.min("_exact").alias("_exact")
    )
    whole = F.col("categories") == len(expected)
    return both.select(
        *group,
        "scored",
        "unscored",
        F.when(whole, F.round("_macro", 6)).alias("macro_score"),
        F.when(whole, F.round(F.col("_macro") * 100, 2)).alias("macro_percent"),
        F.round("_micro", 6).alias("task_weighted_score"),
        (whole & F.col("_exact")).alias("complete"),
    )


def format_summary(df: DataFrame, group: list[str], score: str, render: str, path: str) -> DataFrame:
    """Per group: rows, mean score of scored rows, parsed rows and share, mean path score, perfect rows; means to 6 places.

    Path and parse figures count unscored rows as 0.
    """
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.count_if(parsed_ok(F.col(render))).alias("parsed"),
        F.round(F.avg(parsed_ok(F.col(render)).cast("int")), 6).alias("parse_share"),
        F.round(F.avg(score_or_zero(F.col(path))), 6).alias("mean_path"),
        F.count_if(score_or_zero(F.col(score)) == 1.0).alias("perfect"),
    )


def mean_of_rounded(df: DataFrame, group: list[str], value: str, places: int) -> DataFrame:
    """Mean of values that are rounded first."""
    return df.groupBy(*group).agg(F.round(F.avg(F.round(value, places)), places).alias("mean_of_rounded"), F.count(value).alias("parts"))


def profile(df: DataFrame, text: Column, parts: Column) -> DataFrame:
    """One row: rows, and least, greatest and mean length of a text and size of an array (null arrays count 0)."""
    size = F.coalesce(F.when(parts.isNotNull(), F.size(parts)), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.min(F.length(text)).alias("min_length"), F.max(F.length(text)).alias("max_length"), F.avg(F.length(text)).alias("mean_length"), F.min(size).alias("min_parts"), F.max(size).alias("max_parts"), F.avg(size).alias("mean_parts"))


def most_common(df: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Values by how often they occur, ties by value; all, or the first k."""
    counts = df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(value).asc_nulls_last())
    return counts if k is None else counts.limit(k)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


#: Accuracy of the approximate percentile that narrows an exact one.
_BAND = 100_000


def linear_percentile(value: str, p: float) -> Column:
    """Percentile with linear interpolation; 0 for no values."""
    return F.coalesce(F.percentile(value, p), F.lit(0.0))


def interpolated_percentile(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Percentile with linear interpolation between the places around (n - 1) p, for groups of any size: no buffer of values is built."""
    low, high = (_ranked(df, group, value, p, place, "_at") for place in (lambda n: F.floor((n - 1) * F.lit(p)), lambda n: F.ceil((n - 1) * F.lit(p))))
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
    on = [F.col(f"s.{g}").eqNullSafe(F.col(f"{x}.{g}")) for x in ("l", "h") for g in group]
    joined = sizes.alias("s").join(low.alias("l"), on[: len(group)]).join(high.alias("h"), on[len(group) :])
    at = (F.col("s._n") - 1) * F.lit(p)
    between = F.when(F.floor(at) == at, F.col("l._at").cast("double")).otherwise((F.ceil(at) - at) * F.col("l._at") + (at - F.floor(at)) * F.col("h._at"))
    return joined.select(*[F.col(f"s.{g}").alias(g) for g in group], between.alias(name))


def nearest_percentile(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Value at place round((n - 1) p), half to even, found by counting equal values instead of listing them."""
    return _ranked(df, group, value, p, lambda n: F.rint((n - 1) * p), name)


def floor_percentile(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Value at place floor((n - 1) p)."""
    return _ranked(df, group, value, p, lambda n: F.floor((n - 1) * F.lit(p)), name)


def _ranked(df: DataFrame, group: list[str], value: str, p: float, place, name: str) -> DataFrame:
    """The value at an exact place of each group's sorted values.

    In groups of more than a million rows an approximate band around the percentile
    is found first, and only the equal values within it are ranked, so no task sorts
    a large group.
    """
    margin = 2.0 / _BAND
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(value).alias("_v"))
    keys = [f"_g{i}" for i in range(len(group))]
    band = rows.groupBy(*keys).agg(F.percentile_approx("_v", [max(0.0, p - margin), min(1.0, p + margin)], _BAND).alias("_band"), F.count("*").alias("_all"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    large = F.col("_all") > 10 * _BAND
    on = None
    for k in keys:
        same = F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    near = rows.alias("r").join(band.alias("b"), on).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", F.when(large, F.col("_band")[0]).otherwise(F.col("_min")).alias("_lo"), F.when(large, F.col("_band")[1]).otherwise(F.col("_max")).alias("_hi"), "_all")
    inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
    counts = near.filter(F.col("_v") <= F.col("_hi")).groupBy(*keys, "_all", inside.alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_upto", F.sum("_n").over(w))
    want = place(F.col("_all"))
    found = ranked.filter(F.col("_v").isNotNull() & (F.col("_upto") > want) & (F.col("_upto") - F.col("_n") <= want))
    return found.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.col("_v").alias(name))


def config_matrix(df: DataFrame, config: list[str], task: str, render: str, path: str, score: str, sizes: str | None = None) -> DataFrame:
    """Per configuration: tasks, parsed ``k/n``, mean path and score, and the fingerprint of its task set."""
    ok = parsed_ok(F.col(render))
    return df.groupBy(*config).agg(
        F.count("*").alias("n_rows"),
        F.concat(F.count_if(ok).cast("string"), F.lit("/"), F.count("*").cast("string")).alias("parsed"),
        F.round(F.avg(score_or_zero(F.col(path))), 6).alias("mean_path"),
        F.round(F.avg(score_or_zero(F.col(score))), 6).alias("mean_score"),
        set_fingerprint(F.collect_set(task)).alias("task_set"),
    )


def ratio_of_means(df: DataFrame, group: list[str], part: str, whole: str, name: str, default: float = 0.0) -> DataFrame:
    """Mean of one column over the mean of another: never the mean of ratios."""
    return df.groupBy(*group).agg(guarded_ratio(F.avg(part), F.avg(whole), default).alias(name))


def condition_matrix(means: DataFrame, condition: str, category: str, value: str, categories: list[str]) -> DataFrame:
    """One row per condition, one column per category."""
    return means.groupBy(condition).pivot(category, categories).agg(F.first(value))
