"""Artifact gates: rules over a table, giving its violations in one pass per rule kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(df: DataFrame, key: str, required: list[str], fixed: dict[str, object] | None = None, expected_rows: int | None = None, categories: dict[str, int] | None = None, category: str = "category") -> DataFrame:
    """(``rule``, ``violations``), one row per rule: row count, null and repeated keys, missing fields, fields with another value than the fixed one, and category counts.
    """
    aggs = {"row_count": F.abs(F.count("*") - expected_rows) if expected_rows is not None else F.lit(0), "null_key": F.count_if(F.col(key).isNull()), "repeated_key": F.count(key) - F.count_distinct(key)}
    for f in required:
        aggs[f"missing_{f}"] = F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == ""))
    for f, v in (fixed or {}).items():
        aggs[f"other_{f}"] = F.count_if(~F.col(f).eqNullSafe(F.lit(v)))
    for c, n in (categories or {}).items():
        aggs[f"category_{c}"] = F.abs(F.count_if(F.col(category) == c) - n)
    if categories:
        aggs["unknown_category"] = F.count_if(~F.coalesce(F.col(category), F.lit("")).isin(list(categories)))
    one = df.agg(*[a.cast("long").alias(n) for n, a in aggs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in aggs])).alias("r")).select("r.*")


def key_difference(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(``rule``, ``key_text``): keys that are missing or not expected."""
    a, b = df.select(F.col(key).alias("k")).distinct(), expected.select(F.col(key).alias("k")).distinct()
    return b.join(a, "k", "left_anti").select(F.lit("missing").alias("rule"), F.col("k").cast("string").alias("key_text")).unionByName(a.join(b, "k", "left_anti").select(F.lit("unexpected").alias("rule"), F.col("k").cast("string").alias("key_text")))


def assert_gate(report: DataFrame) -> None:
    """Raises with every violated rule."""
    bad = report.filter("violations > 0").orderBy("rule").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def gate_by(df: DataFrame, group: str, rules: dict[str, Column]) -> DataFrame:
    """(``group``, ``rule``, ``violations``): rules as aggregates that count violations, for every value of a column, in one pass."""
    sums = df.groupBy(group).agg(*[c.cast("long").alias(f"r_{i}") for i, c in enumerate(rules.values())])
    return sums.select(group, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r_{i}").alias("violations")) for i, n in enumerate(rules)])).alias("r")).select(group, "r.*")


def summary_gate(df: DataFrame, group: str, score: str, category: str, sizes: dict[str, int]) -> DataFrame:
    """(``group``, ``rule``, ``violations``): what keeps each condition's summary from being complete: rows, scored rows, unscored rows and the rows of every category."""
    total = sum(sizes.values())
    rules = {"row_count": F.abs(F.count("*") - total), "scored_rows": F.abs(F.count(score) - total), "unscored_rows": F.count_if(F.col(score).isNull())}
    rules |= {f"category_{c}": F.abs(F.count_if(F.col(category) == c) - n) for c, n in sizes.items()}
    return gate_by(df, group, rules)


def manifest_gate(manifest: DataFrame, group: str, key: str, category: str, output: str, expected_rows: int, categories: dict[str, int], outputs: dict[str, int] | None = None) -> DataFrame:
    """(``group``, ``rule``, ``violations``) of the manifests in a table: rows, null and repeated keys, rows per category and per output type, and any others.

    Output types are compared in lower case.
    """
    kind = F.lower(F.col(output))
    rules = {"row_count": F.abs(F.count("*") - expected_rows), "null_key": F.count_if(F.col(key).isNull() | (F.col(key) == "")), "repeated_key": F.count(key) - F.count_distinct(key)}
    rules |= {f"category_{c}": F.abs(F.count_if(F.col(category) == c) - n) for c, n in categories.items()}
    rules["other_category"] = F.count_if(~F.coalesce(F.col(category), F.lit("")).isin(list(categories)))
    if outputs:
        rules |= {f"output_{o}": F.abs(F.count_if(kind == o.lower()) - n) for o, n in outputs.items()}
        rules["other_output"] = F.count_if(~F.coalesce(kind, F.lit("")).isin([o.lower() for o in outputs]))
    return gate_by(manifest, group, rules)


def result_gate(rows: DataFrame, expected: DataFrame, group: str, key: str, required: list[str], fixed: dict[str, object], single: list[str]) -> DataFrame:
    """(``group``, ``rule``, ``violations``) of result files against the expected keys: missing and unexpected keys, missing fields, values other than the fixed ones, and columns that must have one value only.

    Null keys are unexpected.  The expected keys are joined by key, so neither side
    must be small.
    """
    rules = {f"missing_{f}": F.count_if(F.col(f).isNull()) for f in required}
    rules |= {f"other_{f}": F.count_if(~F.col(f).eqNullSafe(F.lit(v))) for f, v in fixed.items()}
    rules |= {f"several_{f}": F.greatest(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("null"))) - 1, F.lit(0)) for f in single}
    wanted = expected.select(F.col(key).alias("_k")).distinct()
    seen = rows.groupBy(group, key).agg(F.count("*").alias("_n")).join(wanted.withColumn("_ok", F.lit(True)), F.col(key) == F.col("_k"), "left")
    n = F.lit(wanted.count())
    keys = seen.groupBy(group).agg(F.count_if("_ok").alias("_found"), F.count_if(F.col("_ok").isNull()).alias("unexpected"), F.sum(F.col("_n") - 1).alias("repeated"))
    both = keys.select(group, F.explode(F.array(F.struct(F.lit("missing_key").alias("rule"), (n - F.col("_found")).alias("violations")), F.struct(F.lit("unexpected_key").alias("rule"), F.col("unexpected").alias("violations")), F.struct(F.lit("repeated_key").alias("rule"), F.coalesce("repeated", F.lit(0)).alias("violations")))).alias("r")).select(group, "r.*")
    return gate_by(rows, group, rules).unionByName(both) if rules else both


def order_violations(rows: DataFrame, source: DataFrame, group: str, key: str, place: str, source_place: str) -> DataFrame:
    """(``group``, ``inversions``): neighbours of a group, by ``place``, whose keys stand the other way round in the source; 0 means the source's order is kept.

    Keys that the source lacks are left out (``key_difference`` reports them).
    """
    at = source.groupBy(key).agg(F.min(source_place).alias("_at"))
    joined = rows.select(group, key, F.col(place).alias("_place")).join(at, key)
    w = Window.partitionBy(group).orderBy("_place", key)
    return joined.withColumn("_before", F.lag("_at").over(w)).groupBy(group).agg(F.count_if(F.col("_before") > F.col("_at")).alias("inversions"))


def exit_code(report: DataFrame) -> int:
    """0 where a gate's report has no violation, else 1, for command lines."""
    return int(not report.filter("violations > 0").isEmpty())


def checked_categories(categories: list[str], known: list[str]) -> list[str]:
    """The categories, if there are some, none twice and none unknown; else an error."""
    if not categories or len(set(categories)) < len(categories):
        raise ValueError("categories must be given, each once")
    if set(categories) - set(known):
        raise ValueError(f"unknown categories: {sorted(set(categories) - set(known))}")
    return categories


def checked_quota(limit: int, categories: list[str]) -> int:
    """Rows per category of a balanced selection; the limit must be a positive multiple of the categories."""
    if limit <= 0 or limit % len(categories):
        raise ValueError(f"the limit must be a positive multiple of {len(categories)}")
    return limit // len(categories)


def limited(df: DataFrame, limit: int | None, unlimited_at_zero: bool = True) -> DataFrame:
    """The first rows, if a positive limit is given; a limit of 0 or less means all of them, or none."""
    if limit is None or limit <= 0 and unlimited_at_zero:
        return df
    return df.limit(max(limit, 0))
