"""Exact paired tests and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: min(1, 2 P(X <= min(b, c))) of a fair coin; 1 without any.

    Summed in log space, so it holds for any counts.
    """
    n, k = (b + c).cast("double"), F.least(b, c)

    def step(a: Column, i: Column) -> Column:
        log_c = a["log_c"] + F.when(i > 0, F.log((n - i + 1) / i)).otherwise(0.0)
        return F.struct(log_c.alias("log_c"), (a["total"] + F.exp(log_c - n * F.log(F.lit(2.0)))).alias("total"))

    start = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda a: a["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail * 2))


def numbered(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Contiguous numbers from 0 within each group, ordered by the first two digits of md5(order), then by order, which must be unique.

    Rows are ranked within 256 parts of a group and shifted by the sizes of the
    parts before, so no task sorts a whole group.
    """
    part = F.substring(F.md5(F.col(order).cast("string")), 1, 2)
    rows = df.withColumn("_part", F.coalesce(part, F.lit("")))
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_part"]
    offsets = sizes.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_o{i}"))
        on = same if on is None else on & same
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return local.join(offsets, on).withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset", *[f"_o{i}" for i in range(len(keys))])


def bootstrap_means(deltas: DataFrame, group: list[str], value: str, order: str, samples: int, seed: int) -> DataFrame:
    """(group, ``rep``, ``mean``): means of ``samples`` resamples with replacement of each group's values.

    Place i of resample r takes the value number md5(seed:r:i) mod n, so any engine
    draws the same.  Values are numbered as ``numbered`` does, by ``order``, which
    must be unique; null groups are left out.  The work is samples times rows; the
    picks are made and joined in parallel.
    """
    slots = numbered(deltas.filter(F.col(value).isNotNull()), group, order, "slot")
    sizes = slots.groupBy(*group).agg(F.count("*").alias("n"))
    reps = slots.select(*group, F.col("slot").alias("i")).join(sizes, group).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")))
    picks = reps.withColumn("slot", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("n")))
    return picks.join(slots.select(*group, "slot", value), [*group, "slot"]).groupBy(*group, "rep").agg(F.avg(value).alias("mean"))


def bootstrap_interval(deltas: DataFrame, group: list[str], value: str, order: str, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(group, low, high): linearly interpolated bounds of the resampled means."""
    tail = (1 - level) / 2
    return bootstrap_means(deltas, group, value, order, samples, seed).groupBy(*group).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def stratified_interval(deltas: DataFrame, group: list[str], stratum: str, value: str, order: str, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Bounds of the mean of stratum means, each stratum resampled on its own."""
    tail = (1 - level) / 2
    by_stratum = bootstrap_means(deltas, [*group, stratum], value, order, samples, seed)
    means = by_stratum.groupBy(*group, "rep").agg(F.avg("mean").alias("mean"))
    return means.groupBy(*group).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def _at_floor(values: Column, p: float) -> Column:
    """The element of a sorted array at place floor(p (n - 1)), from 0."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def floor_interval(deltas: DataFrame, group: list[str], value: str, order: str, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(group, low, high): the resampled means at the floored places of the sorted list, without interpolation.

    Only the means of a group's resamples (``samples`` numbers) are listed, never its rows.
    """
    tail = (1 - level) / 2
    sorted_means = F.array_sort(F.collect_list("mean"))
    return bootstrap_means(deltas, group, value, order, samples, seed).groupBy(*group).agg(sorted_means.alias("_m")).select(*group, _at_floor(F.col("_m"), tail).alias("low"), _at_floor(F.col("_m"), 1 - tail).alias("high"))


def scheduled_intervals(deltas: DataFrame, conditions: list[str], condition: str, values: list[str], order: str, samples: int, seed: int, step: int = 100) -> DataFrame:
    """(condition, ``measure``, ``seed``, low, high) of several measures: measure m of condition c, as listed, is drawn with seed + step c + m."""
    out = None
    for c, name in enumerate(conditions):
        rows = deltas.filter(F.col(condition) == name)
        for m, value in enumerate(values):
            own = seed + step * c + m
            one = bootstrap_interval(rows, [condition], value, order, samples, own).select(condition, F.lit(value).alias("measure"), F.lit(own).alias("seed"), "low", "high")
            out = one if out is None else out.unionByName(one)
    return out


#: Distribution function of the Poisson distribution of mean 1, at 0, 1, 2 ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def weighted_means(deltas: DataFrame, group: list[str], value: str, key: str, samples: int, seed: int) -> DataFrame:
    """(group, ``rep``, ``mean``): means of ``samples`` resamples, each row weighted by a Poisson number of mean 1 drawn from md5(seed:rep:key).

    Rows are neither numbered nor joined, and are summed where they are read: nothing
    but one partial sum per task, group and resample is shuffled, whatever the rows.
    A resample in which a group has no weight is left out.
    """
    rows = deltas.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"), F.col(key).cast("string").alias("_k"))
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.coalesce("_k", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weighed = each.withColumn("_u", u).withColumn("_w", sum((F.col("_u") >= p).cast("int") for p in POISSON))
    return weighed.groupBy(*group, "rep").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n")).filter("_n > 0").select(*group, "rep", (F.col("_s") / F.col("_n")).alias("mean"))


def weighted_interval(deltas: DataFrame, group: list[str], value: str, key: str, samples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(group, low, high): linearly interpolated bounds of ``weighted_means``; the form for large groups."""
    tail = (1 - level) / 2
    return weighted_means(deltas, group, value, key, samples, seed).groupBy(*group).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))
